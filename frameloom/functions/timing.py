"""Frame times, start times and weekly schedules as column expressions. Times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def frame_micros(start_us: Column, frame_idx: Column, fps: float) -> Column:
    """Time of a frame; at a rate of zero or less, the start."""
    return start_us + F.round(frame_idx / F.lit(float(fps)) * 1e6).cast("long") if fps > 0 else start_us


def frame_index(frame: Column, position: Column) -> Column:
    """The number that a frame is named by, else its position."""
    return F.coalesce(frame.try_cast("long"), position.cast("long"))


def parsed_start(text: Column) -> Column:
    """ISO-8601 text as a timestamp; without an offset it is UTC. Fractions before an offset may be of any length."""
    padded = F.regexp_replace(text, r"(\.\d{1,6})\d*(?=Z|[+-]\d\d:?\d\d$|$)", "$1")
    zoned = F.when(padded.rlike(r"(Z|[+-]\d\d:?\d\d)$"), padded).otherwise(F.concat(padded, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def iso_millis(us: Column) -> Column:
    """ISO-8601 text to the millisecond, cut and not rounded."""
    seconds = F.floor(us / 1_000_000)
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.floor(F.pmod(us, F.lit(1_000_000)) / 1000).cast("string"), 3, "0"), F.lit("Z"))


def weekday(us: Column) -> Column:
    """Monday is 0."""
    return F.pmod(F.floor(us / DAY_US) + 3, F.lit(7)).cast("int")


def minutes_us(hhmm: Column) -> Column:
    """Microseconds of the day of "HH:MM"; anything else is an error of the schedule and gives null."""
    ok = hhmm.rlike(r"^\d{1,2}:\d{2}$")
    parts = F.split(hhmm, ":")
    return F.when(ok, (parts[0].try_cast("long") * 60 + parts[1].try_cast("long")) * 60_000_000)


def armed(us: Column, schedule: Column, begin: Column | None = None, end: Column | None = None) -> Column:
    """Whether a schedule (days, from, to) holds at a time. No schedule always holds; a night's window that wraps counts
    for the day on which it begins; both ends are within. begin and end: from and to as minutes_us has them, if they are
    known."""
    day, time = weekday(us), F.pmod(us, F.lit(DAY_US))
    begin = minutes_us(schedule["from"]) if begin is None else begin
    end = minutes_us(schedule["to"]) if end is None else end
    days = schedule["days"]
    today = days.isNull() | F.array_contains(days, day)
    yesterday = days.isNull() | F.array_contains(days, F.pmod(day - 1, F.lit(7)).cast("int"))
    open_all_day = F.coalesce(schedule["from"], F.lit("")).eqNullSafe("") | F.coalesce(schedule["to"], F.lit("")).eqNullSafe("")
    return (
        F.when(schedule.isNull(), True)
        .when(open_all_day, today)
        .when(begin.isNull() | end.isNull(), F.lit(None).cast("boolean"))
        .when(begin <= end, today & time.between(begin, end))
        .when(time >= begin, today)
        .when(time <= end, yesterday)
        .otherwise(False)
    )
