"""Time-based rules over observations: intrusion, loitering and presence of unenrolled people.

Observations: track_id, frame_idx, us (microseconds), zone_id, person_id, and a tiebreak. Each event is a run (see
timeline) with its first observation's zone, person and time, and its last one's time. Without a zone table a rule over
zones has no events; without a registry the unenrolled rule is skipped rather than flagging everyone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions.timing import armed, minutes_us
from frameloom.operators.timeline import runs

EVENT = ("event_type", "zone_id", "track_id", "person_id", "started_us", "ended_us", "first_frame", "zone_name", "observation_count", "dwell_seconds")


def _events(found: DataFrame, kind: str, dwell: bool) -> DataFrame:
    seconds = (F.col("last_us") - F.col("first_us")) / 1e6
    return found.select(
        F.lit(kind).alias("event_type"),
        F.col("first_zone_id").cast("long").alias("zone_id"),
        F.col("track_id").cast("long").alias("track_id"),
        F.col("first_person_id").cast("long").alias("person_id"),
        F.col("first_us").alias("started_us"),
        F.col("last_us").alias("ended_us"),
        F.col("first_frame").cast("long").alias("first_frame"),
        F.col("first_zone_name").alias("zone_name") if "first_zone_name" in found.columns else F.lit(None).cast("string").alias("zone_name"),
        F.col("n").alias("observation_count"),
        (seconds if dwell else F.lit(None).cast("double")).alias("dwell_seconds"),
    )


def _zoned(obs: DataFrame, zones: DataFrame, most: int = 10_000) -> DataFrame:
    """Observations with their zone's attributes, its times parsed once a zone. Zones are a table of settings: up to `most`
    are broadcast and observations not shuffled; more are joined by a shuffle."""
    times = {"begin": minutes_us(F.col("schedule.from")), "end": minutes_us(F.col("schedule.to"))}
    z = zones.where("is_active").withColumns(times).select(F.col("zone_id").alias("_zone"), F.col("name").alias("zone_name"), "zone_type", "schedule", "schedule_has_loiter", "begin", "end")
    few = z.count() <= most
    return obs.join(F.broadcast(z) if few else z, F.col("zone_id") == F.col("_zone")).drop("_zone")


def intrusion(obs: DataFrame, zones: DataFrame, gap: int, tiebreak: Sequence[str]) -> DataFrame:
    """Runs in restricted zones while armed. A run goes on from one restricted zone into another and counts for the first."""
    rows = _zoned(obs, zones)
    test = (F.col("zone_type") == "restricted") & armed(F.col("us"), F.col("schedule"), F.col("begin"), F.col("end"))
    found = runs(rows, ["track_id"], gap, tiebreak, test, first=("zone_id", "person_id", "us", "zone_name"), last=("us",))
    return _events(found, "intrusion", False)


def loitering(obs: DataFrame, zones: DataFrame, gap: int, default_seconds: float, tiebreak: Sequence[str]) -> DataFrame:
    """Runs in any zone that last its number of seconds, whatever its type and schedule; a zone whose number is null is
    left out, one without a number has the default."""
    bar = F.when(F.col("schedule_has_loiter"), F.col("schedule.loiter_seconds")).otherwise(F.lit(default_seconds))
    rows = _zoned(obs, zones).withColumn("bar", bar)
    found = runs(rows, ["zone_id", "track_id"], gap, tiebreak, F.col("bar").isNotNull(), first=("person_id", "us", "zone_name", "bar"), last=("us",))
    found = found.withColumn("first_zone_id", F.col("zone_id")).where((F.col("last_us") - F.col("first_us")) / 1e6 >= F.col("first_bar"))
    return _events(found, "loitering", True)


def unenrolled(obs: DataFrame, registry: DataFrame | None, gap: int, debounce: int, tiebreak: Sequence[str]) -> DataFrame | None:
    """Runs of so many observations of people who are not in the registry; who is not known is not in it either."""
    if registry is None:
        return None
    known = registry.where("is_active").select(F.col("person_id").alias("_known")).distinct()
    rows = obs.join(known, F.col("person_id") == F.col("_known"), "left_anti")
    found = runs(rows, ["track_id"], gap, tiebreak, None, first=("zone_id", "person_id", "us"), last=("us",)).where(F.col("n") >= debounce)
    return _events(found, "unenrolled", False)


def all_events(*parts: DataFrame | None) -> DataFrame:
    """The events of the rules that ran."""
    held = [p for p in parts if p is not None]
    if not held:
        raise ValueError("no rule ran")
    out = held[0]
    for p in held[1:]:
        out = out.unionByName(p)
    return out
