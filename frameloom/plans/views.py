"""Detections, observations and settings as views of the driver's tables, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.operators.vectors import unit_vectors
from frameloom.runtime import make_importable

HOUR_US = 3_600_000_000
FRAME_HOURS = 6
WIDTH, HEIGHT = 240, 220
CLASSES = ("person", "backpack", "handbag", "suitcase", "knife", "cell phone", "laptop", "bottle", "dog", "chair")
CAMERA = 1
#: id, type, active, corners, days, from, to, (has a number of seconds, seconds)
ZONES = (
    (11, "yard", "restricted", True, ((5, 5), (60, 5), (60, 70), (5, 70)), None, None, None, (False, None)),
    (12, "dock", "restricted", True, ((40, 20), (95, 20), (95, 90), (70, 50), (40, 90)), None, "22:00", "06:00", (True, 90_000.0)),
    (13, "hall", "general", True, ((0, 60), (50, 60), (50, 200), (0, 200)), (0, 1, 2, 3, 4), "08:00", "17:00", (True, None)),
    (14, "shed", "restricted", False, ((0, 0), (99, 0), (99, 300), (0, 300)), None, None, None, (False, None)),
    (15, "ramp", "restricted", True, ((60, 0), (99, 0), (99, 300)), (5, 6), "18:00", "09:30", (False, None)),
)
HOMOGRAPHY = (0.01, 0.002, 1.0, -0.001, 0.012, 2.0, 0.0004, 0.0001, 1.0)
#: Loiter time and registry bar that give events on these tables.
LOITER_SECONDS = 86_400.0
ENROLLED_BALANCE = 5000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return make_importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def us_of(name: str) -> F.Column:
    """Microseconds of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({name} AS TIMESTAMP_NTZ))")


def observations(spark: SparkSession, sf_dir: str, hours: int = FRAME_HOURS) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("track_id"), us_of("ts").alias("us"),
        F.regexp_extract("props", '"k": *(-?[0-9]+)', 1).try_cast("double").alias("x"), F.col("value").alias("y"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("person_id"), F.lit(CAMERA).alias("camera_id"),
    ).withColumn("frame_idx", F.expr(f"us div {hours * HOUR_US}"))


OBS = f"""obs AS (SELECT event_id, user_id AS track_id, epoch_us(ts) AS us,
    TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS x, value AS y,
    CASE WHEN user_id % 10 <> 0 THEN user_id END AS person_id, epoch_us(ts) // {FRAME_HOURS * HOUR_US} AS frame_idx FROM events)"""


def zones(spark: SparkSession) -> DataFrame:
    rows = [
        (CAMERA, k, i, name, kind, active, [(float(x), float(y)) for x, y in corners], None if days is None and begin is None and not loiter[0] else (None if days is None else list(days), begin, end, loiter[1]), loiter[0])
        for k, (i, name, kind, active, corners, days, begin, end, loiter) in enumerate(ZONES)
    ]
    schema = "camera_id int, zone_ord int, zone_id long, name string, zone_type string, is_active boolean, polygon array<struct<x:double,y:double>>, schedule struct<days:array<int>,from:string,to:string,loiter_seconds:double>, schedule_has_loiter boolean"
    return spark.createDataFrame(rows, schema)


def _us(hhmm: str | None) -> str:
    return "NULL" if hhmm is None else str((int(hhmm[:2]) * 60 + int(hhmm[3:])) * 60_000_000)


ZONE = "zone AS (SELECT * FROM (VALUES " + ", ".join(
    f"({k}, {i}, '{name}', '{kind}', {active}, CAST({'NULL' if days is None else list(days)} AS INT[]), CAST({_us(begin)} AS BIGINT), CAST({_us(end)} AS BIGINT), {has}, CAST({'NULL' if seconds is None else seconds} AS DOUBLE))"
    for k, (i, name, kind, active, _, days, begin, end, (has, seconds)) in enumerate(ZONES)
) + ") v(zone_ord, zone_id, name, zone_type, is_active, days, from_us, to_us, has_loiter, loiter_seconds))"
EDGE = "edge AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {a[0]}.0::DOUBLE, {a[1]}.0::DOUBLE, {b[0]}.0::DOUBLE, {b[1]}.0::DOUBLE)" for i, _, _, _, corners, *_ in ZONES for a, b in zip((corners[-1], *corners[:-1]), corners)
) + ") v(zone_id, px, py, qx, qy))"
INSIDE = """inside AS (SELECT o.event_id, e.zone_id, bool_or(abs((qx - px) * (y - py) - (qy - py) * (x - px)) <= 1e-9
        AND x BETWEEN least(px, qx) - 1e-9 AND greatest(px, qx) + 1e-9 AND y BETWEEN least(py, qy) - 1e-9 AND greatest(py, qy) + 1e-9)
        OR count(*) FILTER (WHERE (py > y) <> (qy > y) AND x < px + (y - py) * (qx - px) / nullif(qy - py, 0)) % 2 = 1 AS held
    FROM obs o CROSS JOIN edge e GROUP BY 1, 2)"""
ZONED = """zoned AS (SELECT o.*, z.zone_id FROM obs o LEFT JOIN (SELECT event_id, arg_min(i.zone_id, zone_ord) AS zone_id
    FROM inside i JOIN zone USING (zone_id) WHERE held AND is_active GROUP BY 1) z USING (event_id))"""


def armed_sql(us: str = "us") -> str:
    day, time = f"((({us} // 86400000000) + 3) % 7)", f"({us} % 86400000000)"
    return f"""CASE WHEN from_us IS NULL OR to_us IS NULL THEN days IS NULL OR list_contains(days, CAST({day} AS INT))
        WHEN from_us <= to_us THEN (days IS NULL OR list_contains(days, CAST({day} AS INT))) AND {time} BETWEEN from_us AND to_us
        WHEN {time} >= from_us THEN days IS NULL OR list_contains(days, CAST({day} AS INT))
        WHEN {time} <= to_us THEN days IS NULL OR list_contains(days, CAST(({day} + 6) % 7 AS INT)) ELSE FALSE END"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("display_name"), (F.col("c_acctbal") > ENROLLED_BALANCE).alias("is_active"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of frames: l_orderkey is the frame, and pos the place in it."""
    order = Window.partitionBy("frame").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    names = F.array(*map(F.lit, CLASSES))
    x1, y1 = (F.col("l_partkey") * 7 % 200 - 20).cast("double"), (F.col("l_suppkey") * 13 % 150 - 10).cast("double")
    person = F.col("l_returnflag") != "R"
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "frame")
    held = ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
    # places are found before anything else is derived, so that only these columns are shuffled
    return rows.select("frame", *held, (F.row_number().over(order) - 1).cast("long").alias("pos")).select(
        "frame", "pos",
        F.when(person, "person").otherwise("object").alias("kind"),
        F.when(person, "person").otherwise(names[(F.col("l_partkey") % 9 + 1).cast("int")]).alias("class_name"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 40 + F.col("l_quantity") * 2).alias("x2"), (y1 + 60 + F.col("l_linenumber") * 15).alias("y2"),
        (1 - F.col("l_discount") * 9).alias("confidence"), F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part"),
    ).withColumn("id", F.col("pos"))


DET = """det AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
    CASE WHEN l_returnflag <> 'R' THEN 'person' ELSE 'object' END AS kind,
    CASE WHEN l_returnflag <> 'R' THEN 'person' ELSE """ + str(list(CLASSES)) + """[l_partkey % 9 + 2] END AS class_name,
    CAST(l_partkey * 7 % 200 - 20 AS DOUBLE) AS x1, CAST(l_suppkey * 13 % 150 - 10 AS DOUBLE) AS y1,
    l_partkey * 7 % 200 - 20 + 40 + l_quantity * 2 AS x2, CAST(l_suppkey * 13 % 150 - 10 + 60 + l_linenumber * 15 AS DOUBLE) AS y2,
    1 - l_discount * 9 AS confidence, l_suppkey AS supp, l_partkey AS part FROM lineitem)"""  # fmt: skip


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a prototype of the person that its label names; every seventh is inactive."""
    people = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("person_id"))
    return vectors(spark, sf_dir).join(people, "id").select(F.col("id").alias("index_row"), "person_id", (F.col("id") % 7 != 0).alias("is_active"), "v")


EMB = "emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS person_id, vec_id % 7 <> 0 AS is_active FROM embeddings)"
