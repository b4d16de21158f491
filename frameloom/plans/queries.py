"""One query for each operator over the driver's whole tables, with the same rows as SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.config import Config, TrackerConfig
from frameloom.functions import geometry as geo
from frameloom.functions import labels, numbers, timing
from frameloom.functions import vectors as vec
from frameloom.operators import detections as det
from frameloom.operators import document, evaluation, identity, keyframes, neighborhood, rules, tables, timeline, tracking, vector_index
from frameloom.operators import vectors as vop
from frameloom.operators import zones as zop
from frameloom.plans import views as v
from frameloom.sources import stages

CONFIG = Config()
GAP = CONFIG.rules.intrusion_gap_frames
TIE = ["event_id"]
#: Bars at which the driver's nearly random vectors match, are unsure and are new.
ACCEPT, REJECT, EPS = 0.40, 0.33, 0.65
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def box_sql(a: str, b: str, least: str = " + 1e-12") -> str:
    both = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    size = lambda t: f"({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1)"
    return f"(CASE WHEN {both} > 0 THEN {both} / ({size(a)} + {size(b)} - {both}{least}) ELSE 0.0 END)"


# runs and rules

RUNS = """q AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER w <= {gap} + 1 THEN 0 ELSE 1 END AS starts FROM {rows} WINDOW w AS (PARTITION BY {keys} ORDER BY frame_idx, event_id)),
    r AS (SELECT *, sum(starts) OVER (PARTITION BY {keys} ORDER BY frame_idx, event_id) AS run FROM q)"""


@query(f"""WITH {v.OBS}, {RUNS.format(gap=GAP, rows='obs', keys='track_id')}
    SELECT track_id, CAST(run AS BIGINT) AS run, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n FROM r GROUP BY track_id, run""")
def runs_gap_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.runs(v.observations(spark, sf_dir), ["track_id"], GAP, TIE)


def _zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zop.classify(v.observations(spark, sf_dir), v.zones(spark))


ZONED = f"{v.OBS}, {v.ZONE}, {v.EDGE}, {v.INSIDE}, {v.ZONED}"
INTRUSION = f"""SELECT 'intrusion' AS event_type, CAST(arg_min(zone_id, (frame_idx, event_id)) AS BIGINT) AS zone_id, track_id, arg_min(coalesce(person_id, -1), (frame_idx, event_id)) AS person_id,
    arg_min(us, (frame_idx, event_id)) AS started_us, arg_max(us, (frame_idx, event_id)) AS ended_us, min(frame_idx) AS first_frame,
    arg_min(name, (frame_idx, event_id)) AS zone_name, count(*) AS observation_count, CAST(NULL AS DOUBLE) AS dwell_seconds"""


def _person(df: DataFrame) -> DataFrame:
    """A first observation's missing person as -1 until the end, as picking by order skips nulls in neither engine alike."""
    return df.withColumn("person_id", F.nullif("person_id", F.lit(-1)))


@query(f"""WITH {ZONED}, a AS (SELECT o.*, z.name FROM zoned o JOIN zone z USING (zone_id) WHERE z.is_active AND z.zone_type = 'restricted' AND {v.armed_sql()}),
    {RUNS.format(gap=GAP, rows='a', keys='track_id')}, e AS ({INTRUSION} FROM r GROUP BY track_id, run) SELECT * REPLACE (nullif(person_id, -1) AS person_id) FROM e""")
def intrusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _zoned(spark, sf_dir).withColumn("person_id", F.coalesce("person_id", F.lit(-1)))
    return _person(rules.intrusion(obs, v.zones(spark), GAP, TIE))


LOITERING = f"""SELECT 'loitering' AS event_type, CAST(zone_id AS BIGINT) AS zone_id, track_id, arg_min(coalesce(person_id, -1), (frame_idx, event_id)) AS person_id,
    arg_min(us, (frame_idx, event_id)) AS started_us, arg_max(us, (frame_idx, event_id)) AS ended_us, min(frame_idx) AS first_frame, any_value(name) AS zone_name, count(*) AS observation_count,
    (arg_max(us, (frame_idx, event_id)) - arg_min(us, (frame_idx, event_id))) / 1e6 AS dwell_seconds"""


@query(f"""WITH {ZONED}, a AS (SELECT o.*, z.name, CASE WHEN has_loiter THEN loiter_seconds ELSE {v.LOITER_SECONDS} END AS bar FROM zoned o JOIN zone z USING (zone_id)
        WHERE z.is_active AND CASE WHEN has_loiter THEN loiter_seconds ELSE {v.LOITER_SECONDS} END IS NOT NULL),
    {RUNS.format(gap=GAP, rows='a', keys='zone_id, track_id')}, e AS ({LOITERING}, any_value(bar) AS bar FROM r GROUP BY zone_id, track_id, run)
    SELECT * EXCLUDE (bar) REPLACE (nullif(person_id, -1) AS person_id) FROM e WHERE dwell_seconds >= bar""")
def loitering(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _zoned(spark, sf_dir).withColumn("person_id", F.coalesce("person_id", F.lit(-1)))
    return _person(rules.loitering(obs, v.zones(spark), GAP, v.LOITER_SECONDS, TIE))


UNENROLLED = f"""WITH {ZONED}, a AS (SELECT *, CAST(NULL AS VARCHAR) AS name FROM zoned o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.person_id AND c.c_acctbal > {v.ENROLLED_BALANCE})),
    {RUNS.format(gap=GAP, rows='a', keys='track_id')}, e AS (SELECT 'unenrolled' AS event_type, nullif(arg_min(coalesce(CAST(zone_id AS BIGINT), -1), (frame_idx, event_id)), -1) AS zone_id, track_id,
    nullif(arg_min(coalesce(person_id, -1), (frame_idx, event_id)), -1) AS person_id, arg_min(us, (frame_idx, event_id)) AS started_us, arg_max(us, (frame_idx, event_id)) AS ended_us,
    min(frame_idx) AS first_frame, CAST(NULL AS VARCHAR) AS zone_name, count(*) AS observation_count, CAST(NULL AS DOUBLE) AS dwell_seconds FROM r GROUP BY track_id, run)
    SELECT * FROM e WHERE observation_count >= {CONFIG.rules.unenrolled_debounce_frames}"""


@query(UNENROLLED)
def unenrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unenrolled(_zoned(spark, sf_dir), v.registry(spark, sf_dir), GAP, CONFIG.rules.unenrolled_debounce_frames, TIE)


UNION = " UNION ALL ".join(f"SELECT * FROM ({SQL[k]})" for k in ("intrusion", "loitering", "unenrolled"))


@query(UNION)
def event_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones are found once for all three rules."""
    zoned, zones = tables.materialize(_zoned(spark, sf_dir), "zoned"), v.zones(spark)
    known = zoned.withColumn("person_id", F.coalesce("person_id", F.lit(-1)))
    inside, stay = rules.intrusion(known, zones, GAP, TIE), rules.loitering(known, zones, GAP, v.LOITER_SECONDS, TIE)
    alone = rules.unenrolled(zoned, v.registry(spark, sf_dir), GAP, CONFIG.rules.unenrolled_debounce_frames, TIE)
    return rules.all_events(_person(inside), _person(stay), alone)


@query(f"SELECT event_type, count(*) AS n FROM ({UNION}) GROUP BY 1")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_union(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {v.OBS}, {v.ZONE} SELECT event_id, CAST(zone_id AS BIGINT) AS zone_id, {v.armed_sql()} AS armed FROM obs, zone")
def zone_armed(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = v.zones(spark).groupBy("camera_id").agg(F.collect_list(F.struct("zone_id", "schedule")).alias("zs"))
    rows = v.observations(spark, sf_dir).join(F.broadcast(zones), "camera_id").select("event_id", "us", F.explode("zs").alias("z"))
    return rows.select("event_id", F.col("z.zone_id").alias("zone_id"), timing.armed(F.col("us"), F.col("z.schedule")).alias("armed"))


# times and names


@query("""SELECT event_id, epoch_us(ts) + CAST(round(event_id % 1000 / 30.0 * 1e6) AS BIGINT) AS frame_us,
    strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM events""")
def frame_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "events").select("event_id", v.us_of("ts").alias("us"))
    return rows.select("event_id", timing.frame_micros(F.col("us"), F.col("event_id") % 1000, 30).alias("frame_us"), F.concat(F.expr("date_format(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, us div 1000000), \"yyyy-MM-dd'T'HH:mm:ss\")"), F.lit("."), F.lpad((F.pmod("us", F.lit(1_000_000)) / 1000).cast("int").cast("string"), 3, "0"), F.lit("Z")).alias("iso"))


@query("SELECT p_partkey, coalesce(TRY_CAST(CASE WHEN p_size % 3 = 0 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS BIGINT), CAST(p_size AS BIGINT)) AS frame_idx FROM part")
def frame_index_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.col("p_partkey").cast("string"))
    return v.table(spark, sf_dir, "part").select("p_partkey", timing.frame_index(name, F.col("p_size")).alias("frame_idx"))


@query("""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(name), '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), chr(1)) AS sort_key
    FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey || p_name WHEN 1 THEN p_name || p_size || 'B' ELSE p_name END AS name FROM part)""")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 3
    name = F.when(key == 0, F.concat("p_partkey", "p_name")).when(key == 1, F.concat("p_name", "p_size", F.lit("B"))).otherwise(F.col("p_name"))
    return v.table(spark, sf_dir, "part").select("p_partkey", labels.natural_key(name).alias("sort_key"))


@query("SELECT p_partkey, CASE lower(trim(p_brand)) WHEN 'brand#1' THEN 'first' WHEN 'brand#12' THEN 'twelfth' ELSE p_brand END AS label FROM part")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "part").select("p_partkey", labels.mapped(F.col("p_brand"), {"brand#1": "first", "brand#12": "twelfth"}).alias("label"))


@query(f"WITH {v.DET} SELECT frame, pos, CAST(coalesce(nullif(supp % 5, 0), nullif(part % 7, 0), 0) AS BIGINT) AS ref FROM det")
def effective_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.detections(spark, sf_dir).select("frame", "pos", labels.reference(F.col("supp") % 5, F.col("part") % 7).alias("ref"))


# boxes, polygons, projections


@query(f"WITH {ZONED} SELECT event_id, CAST(e.zone_id AS BIGINT) AS zone_id, held FROM inside e")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = v.zones(spark).groupBy("camera_id").agg(F.collect_list(F.struct("zone_id", "polygon")).alias("zs"))
    rows = v.observations(spark, sf_dir).join(F.broadcast(zones), "camera_id").select("event_id", "x", "y", F.explode("zs").alias("z"))
    return rows.select("event_id", F.col("z.zone_id").alias("zone_id"), geo.in_polygon(F.col("x"), F.col("y"), F.col("z.polygon")).alias("held"))


@query(f"WITH {ZONED} SELECT event_id, CAST(zone_id AS BIGINT) AS zone_id FROM zoned")
def zone_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoned(spark, sf_dir).select("event_id", "zone_id")


_M = v.HOMOGRAPHY
_AT = lambda a, b, c: f"({a} * gx + {b} * gy + {c}) / ({_M[6]} * gx + {_M[7]} * gy + {_M[8]})"


@query(f"WITH {v.DET}, g AS (SELECT frame, pos, (x1 + x2) * 0.5 AS gx, y2 AS gy FROM det) SELECT frame, pos, {_AT(*_M[:3])} AS world_x, {_AT(*_M[3:6])} AS world_y FROM g")
def homography_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.projected(*geo.ground_point(geo.Box.of()), _M)
    return v.detections(spark, sf_dir).select("frame", "pos", x.alias("world_x"), y.alias("world_y"))


@query(f"WITH {v.DET} SELECT frame, pos, class_name FROM det WHERE class_name IN {CONFIG.detection.allowlist} AND confidence >= {CONFIG.detection.min_confidence}")
def allowlist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.allowed(v.detections(spark, sf_dir), CONFIG.detection.allowlist, CONFIG.detection.min_confidence).select("frame", "pos", "class_name")


def _clamp_sql(c: str, most: int) -> str:
    return f"greatest(0, least({most - 1}, CAST(round_even({c}, 0) AS INT)))"


@query(f"""WITH {v.DET}, c AS (SELECT frame, pos, {_clamp_sql('x1 * 0.75', 160)} AS x1, {_clamp_sql('y1 * 0.75', 120)} AS y1, {_clamp_sql('x2 * 0.75', 160)} AS x2, {_clamp_sql('y2 * 0.75', 120)} AS y2 FROM det)
    SELECT * FROM c WHERE NOT (x2 <= x1 OR y2 <= y1)""")
def clamp_and_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.detections(spark, sf_dir).withColumns({c: F.col(c) * 0.75 for c in ("x1", "y1", "x2", "y2")})
    return det.clamp_and_reject(rows, 160, 120).select("frame", "pos", "x1", "y1", "x2", "y2")


@query(f"WITH {v.DET} SELECT a.frame, a.pos AS a_pos, b.pos AS b_pos, {box_sql('a', 'b')} AS iou FROM det a JOIN det b ON a.frame = b.frame AND a.pos < b.pos AND {box_sql('a', 'b')} >= 0.5")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.detections(spark, sf_dir)
    share = geo.iou(geo.Box.of(alias="a"), geo.Box.of(alias="b"))
    pairs = d.alias("a").join(d.alias("b"), (F.col("a.frame") == F.col("b.frame")) & (F.col("a.pos") < F.col("b.pos")) & (share >= 0.5))
    return pairs.select(F.col("a.frame").alias("frame"), F.col("a.pos").alias("a_pos"), F.col("b.pos").alias("b_pos"), share.alias("iou"))


_LETTER = """l AS (SELECT p_partkey, w, h, least(640.0 / w, 640.0 / h) AS ratio FROM (SELECT p_partkey, CAST(p_size * 37 + 100 AS DOUBLE) AS w, CAST(p_partkey % 700 + 90 AS DOUBLE) AS h FROM part)),
    p AS (SELECT *, ((640.0 - round_even(w * ratio, 0)) % 32) / 2 AS pad_x, ((640.0 - round_even(h * ratio, 0)) % 32) / 2 AS pad_y FROM l)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 100).cast("double").alias("w"), (F.col("p_partkey") % 700 + 90).cast("double").alias("h"))


@query(f"WITH {_LETTER} SELECT p_partkey, ratio AS ratio, pad_x AS pad_x, pad_y AS pad_y, greatest(0, least(w, (100 - pad_x) / ratio)) AS back_x, greatest(0, least(h, (900 - pad_y) / ratio)) AS back_y FROM p")
def letterbox_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = geo.letterbox(F.col("w"), F.col("h"), 640, 32)
    point = geo.Box(F.lit(100.0), F.lit(100.0), F.lit(100.0), F.lit(900.0))
    back = geo.unletterbox(point, fit["ratio"], fit["pad_x"], fit["pad_y"], F.col("w"), F.col("h"))
    return _images(spark, sf_dir).select("p_partkey", *(fit[k].alias(k) for k in ("ratio", "pad_x", "pad_y")), back.x1.alias("back_x"), back.y2.alias("back_y"))


@query("""WITH i AS (SELECT p_partkey, p_partkey // 4 AS batch, CAST(CASE WHEN p_partkey // 4 % 3 = 0 THEN 640 ELSE p_size * 37 + 100 END AS DOUBLE) AS w, CAST(CASE WHEN p_partkey // 4 % 3 = 0 THEN 360 ELSE p_partkey % 700 + 90 END AS DOUBLE) AS h FROM part),
    k AS (SELECT batch, count(DISTINCT (w, h)) = 1 AS same FROM i GROUP BY 1), r AS (SELECT *, least(640.0 / w, 640.0 / h) AS ratio FROM i JOIN k USING (batch)),
    n AS (SELECT *, round_even(w * ratio, 0) AS nw, round_even(h * ratio, 0) AS nh FROM r), p AS (SELECT *, CASE WHEN same THEN (640.0 - nw) % 32 ELSE 640.0 - nw END / 2 AS pad_x, CASE WHEN same THEN (640.0 - nh) % 32 ELSE 640.0 - nh END / 2 AS pad_y FROM n)
    SELECT p_partkey, batch, ratio, pad_x, pad_y, CAST(nw + 2 * pad_x AS INT) AS canvas_w, CAST(nh + 2 * pad_y AS INT) AS canvas_h FROM p""")
def letterbox_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four images; in every third one all have one size."""
    batch = F.floor(F.col("p_partkey") / 4)
    alike = batch % 3 == 0
    rows = _images(spark, sf_dir).select("p_partkey", batch.alias("batch"), F.when(alike, 640.0).otherwise(F.col("w")).alias("w"), F.when(alike, 360.0).otherwise(F.col("h")).alias("h"))
    return det.letterboxed(rows, 640).select("p_partkey", "batch", "ratio", "pad_x", "pad_y", "canvas_w", "canvas_h")


@query("""WITH i AS (SELECT p_partkey, CAST(p_size * 37 + 100 AS DOUBLE) AS w, CAST(p_partkey % 700 + 90 AS DOUBLE) AS h FROM part), s AS (SELECT *, least(1.0, 1280.0 / greatest(w, h)) AS k FROM i)
    SELECT p_partkey, greatest(32, CAST(floor(w * k / 32) * 32 AS INT)) AS new_w, greatest(32, CAST(floor(h * k / 32) * 32 AS INT)) AS new_h FROM s""")
def resize_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = geo.resized(F.col("w"), F.col("h"))
    return _images(spark, sf_dir).select("p_partkey", w.alias("new_w"), h.alias("new_h"))


@query(f"""WITH {v.DET} SELECT frame, pos, CAST(greatest(0, floor((x1 + x2) * 0.5 - (x2 - x1) * 1.8 / 2)) AS BIGINT) AS x1, CAST(greatest(0, floor((y1 + y2) * 0.5 - (y2 - y1) * 1.8 / 2)) AS BIGINT) AS y1,
    CAST(least({v.WIDTH}, ceil((x1 + x2) * 0.5 + (x2 - x1) * 1.8 / 2)) AS BIGINT) AS x2, CAST(least({v.HEIGHT}, ceil((y1 + y2) * 0.5 + (y2 - y1) * 1.8 / 2)) AS BIGINT) AS y2 FROM det""")
def expand_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = geo.expanded(geo.Box.of(), 1.8, v.WIDTH, v.HEIGHT)
    return v.detections(spark, sf_dir).select("frame", "pos", *(c.cast("long").alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), grown)))


# relations


def _words_sql(near: float = 0.15) -> str:
    return f"""list_filter([CASE WHEN abs(nx) < {near} AND abs(ny) < {near} THEN 'cerca' END, CASE WHEN nx > 0.2 THEN 'a la derecha' WHEN nx < -0.2 THEN 'a la izquierda' END,
        CASE WHEN ny > 0.3 THEN 'abajo' WHEN ny < -0.3 THEN 'arriba' END], lambda x: x IS NOT NULL)"""


def _offset_sql(a: str, b: str) -> str:
    return f"""(({b}.x1 + {b}.x2) * 0.5 - ({a}.x1 + {a}.x2) * 0.5) / greatest(1e-6, {a}.x2 - {a}.x1) AS nx, (({b}.y1 + {b}.y2) * 0.5 - ({a}.y1 + {a}.y2) * 0.5) / greatest(1e-6, {a}.y2 - {a}.y1) AS ny"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = v.detections(spark, sf_dir)
    return d.where("kind = 'person'"), d.where("kind = 'object'")


@query(f"""WITH {v.DET}, j AS (SELECT p.frame, p.pos AS p_id, o.pos AS o_id, {_offset_sql('p', 'o')}, {box_sql('p', 'o')} AS iou FROM det p JOIN det o ON p.frame = o.frame AND p.kind = 'person' AND o.kind = 'object'),
    w AS (SELECT *, {_words_sql()} AS words FROM j)
    SELECT frame, p_id, o_id, CASE WHEN len(words) > 0 THEN array_to_string(words, ',') ELSE 'superpuesto a' END AS relation, iou AS intersection, nx AS x_alignment, ny AS y_alignment,
    CASE WHEN len(words) > 0 THEN array_to_string(words, ' y ') ELSE 'superpuesto a' END AS phrase FROM w WHERE len(words) > 0 OR iou >= 0.01""")
def neighborhood_po(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighborhood.person_object(*_sides(spark, sf_dir))


@query(f"""WITH {v.DET}, j AS (SELECT a.frame, a.pos AS p_id, b.pos AS q_id, {_offset_sql('a', 'b')} FROM det a JOIN det b ON a.frame = b.frame AND a.kind = 'person' AND b.kind = 'person' AND a.pos < b.pos),
    w AS (SELECT *, {_words_sql()} AS words FROM j)
    SELECT frame, p_id, q_id, array_to_string(words, ',') AS relation, CAST(NULL AS DOUBLE) AS intersection, nx AS x_alignment, ny AS y_alignment, array_to_string(words, ' y ') AS phrase FROM w WHERE len(words) > 0""")
def neighborhood_pp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighborhood.person_person(_sides(spark, sf_dir)[0])


_IMAGE = """j AS (SELECT p.frame, p.pos AS p_id, o.pos AS o_id, (p.x1 + p.x2) * 0.5 - (o.x1 + o.x2) * 0.5 AS dx, (p.y1 + p.y2) * 0.5 - (o.y1 + o.y2) * 0.5 AS dy,
    sqrt((p.x2 - p.x1) ** 2 + (p.y2 - p.y1) ** 2) AS pd, sqrt((o.x2 - o.x1) ** 2 + (o.y2 - o.y1) ** 2) AS od, {iou} AS share FROM det p JOIN det o ON p.frame = o.frame AND p.kind = 'person' AND o.kind = '{kind}' AND {test})"""
_SIDES = "CASE WHEN abs(dx) > abs(dy) THEN CASE WHEN dx > 0 THEN 'right_of' ELSE 'left_of' END END, CASE WHEN abs(dy) > abs(dx) THEN CASE WHEN dy > 0 THEN 'below' ELSE 'above' END END"
_OBJECT = f"""WITH {v.DET}, {_IMAGE.format(iou=box_sql('p', 'o', ''), kind='object', test='TRUE')}
    SELECT frame, p_id, o_id, array_to_string(list_filter([CASE WHEN sqrt(dx * dx + dy * dy) < 0.8 * pd THEN 'near' END, {_SIDES}, CASE WHEN share > 0.05 THEN 'overlap' END], lambda x: x IS NOT NULL), ',') AS relation,
    sqrt(dx * dx + dy * dy) AS distance, degrees(atan2(dy, dx)) AS angle_deg, share AS iou FROM j"""


@query(_OBJECT)
def image_relations_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighborhood.image_relations(*_sides(spark, sf_dir), "object")


@query(f"""WITH {v.DET}, {_IMAGE.format(iou='0', kind='person', test='p.pos <> o.pos')}
    SELECT frame, p_id, o_id, array_to_string(list_filter([CASE WHEN sqrt(dx * dx + dy * dy) < 0.8 * (pd + od) / 2 THEN 'near_person' END, {_SIDES}], lambda x: x IS NOT NULL), ',') AS relation,
    sqrt(dx * dx + dy * dy) AS distance, degrees(atan2(dy, dx)) AS angle_deg, CAST(NULL AS DOUBLE) AS iou FROM j""")
def image_relations_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _sides(spark, sf_dir)[0]
    return neighborhood.image_relations(people, people, "person")


@query(f"SELECT frame, p_id, o_id, relation, nullif(iou, 0) AS intersection, angle_deg / 180 AS x_alignment FROM ({_OBJECT}) WHERE relation <> ''")
def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighborhood.relation_rows(image_relations_object(spark, sf_dir))
    return rows.select("frame", "p_id", "o_id", "relation", "intersection", "x_alignment")


# rankings within a frame


@query(f"WITH {v.DET}, l AS (SELECT frame, pos, supp % 4 - 1 AS label FROM det) SELECT frame, pos, CAST(CASE WHEN label >= 0 AND row_number() OVER (PARTITION BY frame, label ORDER BY pos) = 1 THEN label ELSE -1 END AS BIGINT) AS unique_label FROM l")
def unique_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.unique_labels(v.detections(spark, sf_dir).withColumn("label", F.col("supp") % 4 - 1)).select("frame", "pos", "unique_label")


@query(f"""WITH {v.DET}, l AS (SELECT frame, pos, supp % 3 AS person_id, coalesce(CASE WHEN part % 2 = 0 THEN part % 10 / 10.0 END, confidence) AS score FROM det WHERE kind = 'person')
    SELECT frame, pos, row_number() OVER (PARTITION BY frame, person_id ORDER BY score DESC, pos) = 1 AS won FROM l""")
def unique_pid_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.detections(spark, sf_dir).where("kind = 'person'").withColumn("person_id", F.col("supp") % 3)
    return det.unique_people(d.withColumn("best_sim", F.when(F.col("part") % 2 == 0, F.col("part") % 10 / 10.0))).select("frame", "pos", "won")


_AREA = "greatest(0, x2 - x1) * greatest(0, y2 - y1)"


@query(f"WITH {v.DET}, a AS (SELECT frame, pos, row_number() OVER (PARTITION BY frame ORDER BY {_AREA} DESC, pos) AS rank FROM det WHERE kind = 'person') SELECT frame, pos, CAST(rank AS INT) AS rank FROM a WHERE rank <= 6")
def topk_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.largest(v.detections(spark, sf_dir).where("kind = 'person'"), 6).select("frame", "pos", "rank")


@query(f"WITH {v.DET} SELECT frame, pos FROM det WHERE kind = 'person' QUALIFY row_number() OVER (PARTITION BY frame ORDER BY {_AREA} DESC, pos) = 1")
def largest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.largest(v.detections(spark, sf_dir).where("kind = 'person'"), 1).select("frame", "pos")


@query(f"""WITH {v.DET}, a AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {_AREA} DESC, pos) AS rank FROM det WHERE kind = 'person'),
    g AS (SELECT *, rank <= 2 AND {_AREA} > 0 AND {_AREA} / ({v.WIDTH * v.HEIGHT}.0 + 1e-6) >= 0.2 AS seen FROM a)
    SELECT frame, pos, CASE WHEN seen AND confidence >= 0.6 THEN 'pose' || supp % 5 WHEN seen THEN 'before' ELSE 'indefinido' END AS pose, CASE WHEN seen THEN confidence ELSE 0.0 END AS pose_score FROM g""")
def pose_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.detections(spark, sf_dir).withColumn("pose_label", F.concat(F.lit("pose"), F.col("supp") % 5)).withColumn("pose_conf", F.col("confidence")).withColumn("action", F.lit("before"))
    return det.pose_gate(d, v.WIDTH, v.HEIGHT, 0.2, 0.6, 2).select("frame", "pos", "pose", "pose_score")


@query(f"""WITH {v.DET} SELECT frame % 100 AS video_id, frame, pos, row_number() OVER (PARTITION BY frame % 100 ORDER BY frame, pos) - 1 AS rid FROM det WHERE kind = 'person' AND confidence >= 0.5""")
def rid_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.detections(spark, sf_dir).withColumn("video_id", F.col("frame") % 100).withColumn("embedded", F.col("confidence") >= 0.5)
    return det.numbered(d, ["frame", "pos"]).select("video_id", "frame", "pos", "rid")


@query(f"WITH {v.DET} SELECT frame, count(*) FILTER (WHERE kind = 'person') AS persons, count(*) FILTER (WHERE kind = 'object') AS objects, avg(confidence) AS mean_confidence FROM det GROUP BY 1")
def per_frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.frame_counts(v.detections(spark, sf_dir), F.avg("confidence").alias("mean_confidence"))


@query(f"WITH {v.DET} SELECT frame, pos, CASE WHEN confidence >= 0.5 THEN 'high' WHEN confidence >= 0.1 THEN 'low' ELSE 'dropped' END AS band FROM det")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("confidence"), CONFIG.tracker
    return v.detections(spark, sf_dir).select("frame", "pos", F.when(c >= t.high, "high").when(c >= t.low, "low").otherwise("dropped").alias("band"))


@query(f"""WITH {v.DET} SELECT frame, pos, class_name FROM det WHERE kind = 'person' UNION ALL SELECT frame, pos, class_name FROM det WHERE kind = 'object' AND class_name IN ('knife', 'bottle') AND confidence >= 0.35""")
def secondary_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, objects = _sides(spark, sf_dir)
    return det.append_secondary(people, objects, ("knife", "bottle"), CONFIG.detection.secondary_confidence).select("frame", "pos", "class_name")


@query()
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.nms(v.detections(spark, sf_dir).select("frame", "pos", "class_name", "x1", "y1", "x2", "y2", "confidence"), CONFIG.detection.nms_iou, CONFIG.detection.min_confidence)


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.greedy_match(*_sides(spark, sf_dir))


# vectors and identities

SIM = f"WITH {v.EMB}"
NEAR = "near AS (SELECT q.id AS query_id, b.id, list_cosine_similarity(q.v, b.v) AS sim, b.person_id, b.is_active, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, b.v) DESC, b.id) AS rank FROM emb q JOIN emb b ON q.id <> b.id WHERE q.id % 20 = 0)"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.vectors(spark, sf_dir).where("id % 20 = 0")


@query(f"{SIM}, {NEAR} SELECT query_id, id, sim AS sim, CAST(rank AS INT) AS rank FROM near WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vop.knn(_probes(spark, sf_dir), v.vectors(spark, sf_dir), 10)


@query()
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by the index, which is written and read back; its recall is tested."""
    path = tables.scratch_path(spark, "vector_index")
    vector_index.write(vector_index.build(v.vectors(spark, sf_dir)), path)
    return vector_index.search(vector_index.read(spark, path), _probes(spark, sf_dir), 10)


@query(f"{SIM} SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM emb a JOIN emb b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.35")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vop.similar_pairs(v.vectors(spark, sf_dir), 0.35)


@query(f"""{SIM}, u AS (SELECT person_id, unnest(list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12))) AS x, generate_subscripts(v, 1) - 1 AS place FROM emb),
    m AS (SELECT person_id, place, avg(x) AS m FROM u GROUP BY 1, 2)
    SELECT person_id, CAST(place AS INT) AS place, m / (sqrt(sum(m * m) OVER (PARTITION BY person_id)) + 1e-12) AS value FROM m""")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vop.centroids(v.gallery(spark, sf_dir), "person_id").select("person_id", F.posexplode("v").alias("place", "value"))


@query(f"""{SIM}, {NEAR}, best AS (SELECT query_id, arg_min(person_id, rank) AS person_id, arg_min(sim, rank) AS sim FROM near WHERE rank <= 30 AND is_active GROUP BY 1)
    SELECT e.id AS query_id, CASE WHEN sim >= {ACCEPT} THEN 'match' WHEN sim IS NULL OR sim <= {REJECT} THEN 'create' ELSE 'gray' END AS outcome, CASE WHEN sim >= {ACCEPT} THEN b.person_id END AS person_id, sim AS best_sim
    FROM emb e LEFT JOIN best b ON b.query_id = e.id WHERE e.id % 20 = 0""")
def assign_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identity.decide(_probes(spark, sf_dir), v.gallery(spark, sf_dir), t_accept=ACCEPT, t_reject=REJECT, k=30, exclude_self=True)
    return found


@query(f"{SIM}, {NEAR} SELECT query_id, string_agg(CAST(person_id AS VARCHAR), ',' ORDER BY rank) AS people FROM near WHERE rank <= 3 AND is_active GROUP BY 1")
def hit_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identity.evidence(identity.hits(_probes(spark, sf_dir), v.gallery(spark, sf_dir), 30, exclude_self=True))
    return found.select("query_id", F.array_join("people", ",").alias("people"))


@query(f"{SIM} SELECT person_id, count(*) FILTER (WHERE is_active) AS n_active FROM emb GROUP BY 1")
def active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.active_counts(v.gallery(spark, sf_dir))


@query(f"""{SIM}, {NEAR}, top AS (SELECT query_id, person_id AS hit, sim FROM near WHERE rank = 1 AND is_active), c AS (SELECT person_id, count(*) FILTER (WHERE is_active) AS n FROM emb GROUP BY 1)
    SELECT e.id, e.person_id, sim AS sim FROM emb e JOIN top ON query_id = e.id AND hit = e.person_id JOIN c ON c.person_id = e.person_id WHERE e.id % 20 = 0 AND sim >= {REJECT} AND n < 1000000""")
def support_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = _probes(spark, sf_dir).join(v.gallery(spark, sf_dir).select(F.col("index_row").alias("id"), "person_id"), "id")
    return identity.support(probes, v.gallery(spark, sf_dir), min_sim_add=REJECT, most=1_000_000, k=30, exclude_self=True)


@query(f"""{SIM}, n AS (SELECT id, person_id, is_active, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) AS v FROM emb),
    m AS (SELECT person_id, place, avg(x) AS m FROM (SELECT person_id, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM n WHERE is_active) GROUP BY 1, 2),
    c AS (SELECT person_id, list(m ORDER BY place) AS c FROM m GROUP BY 1),
    k AS (SELECT n.id, row_number() OVER (PARTITION BY n.person_id ORDER BY list_cosine_similarity(v, c) DESC, n.id) AS place FROM n JOIN c USING (person_id) WHERE is_active)
    SELECT n.id AS index_row, n.person_id, coalesce(k.place <= 4, FALSE) AS is_active FROM n LEFT JOIN k ON k.id = n.id""")
def keep_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.consolidate(v.gallery(spark, sf_dir), CONFIG.identity.keep_k)


@query(f"""{SIM}, n AS (SELECT id, person_id, is_active, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) AS v FROM emb),
    m AS (SELECT person_id, place, avg(x) AS m FROM (SELECT person_id, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM n WHERE is_active) GROUP BY 1, 2),
    c AS (SELECT person_id, list(m ORDER BY place) AS c FROM m GROUP BY 1),
    k AS (SELECT n.id, row_number() OVER (PARTITION BY n.person_id ORDER BY list_cosine_similarity(v, c) DESC, n.id) AS place FROM n JOIN c USING (person_id) WHERE is_active),
    u AS (SELECT person_id, list_transform(c, lambda x: x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-12)) AS v FROM c)
    SELECT n.id AS index_row, n.person_id, coalesce(k.place <= 4, FALSE) AS is_active, CAST(NULL AS VARCHAR) AS proto_type, CAST(NULL AS BIGINT) AS n, n.v[1] AS first, n.v[64] AS last FROM n LEFT JOIN k ON k.id = n.id
    UNION ALL SELECT (SELECT max(id) FROM n) + row_number() OVER (ORDER BY u.person_id), u.person_id, TRUE, 'centroid', (SELECT count(*) FROM n WHERE n.person_id = u.person_id AND is_active), u.v[1], u.v[64] FROM u""")
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's centroid is added and what is far from it dropped."""
    rows = identity.consolidated(v.gallery(spark, sf_dir), CONFIG.identity.keep_k)
    return rows.select("index_row", "person_id", "is_active", "proto_type", "n", F.col("v")[0].alias("first"), F.col("v")[63].alias("last"))


@query(f"""WITH RECURSIVE {v.EMB}, pairs AS (SELECT a.id AS a, b.id AS b FROM emb a JOIN emb b ON a.id <> b.id WHERE 1 - list_cosine_similarity(a.v, b.v) <= {EPS}),
    core AS (SELECT a AS id FROM pairs GROUP BY a HAVING count(*) + 1 >= 4), links AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach AS (SELECT id, id AS root FROM core UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
    roots AS (SELECT id, min(root) AS root FROM reach GROUP BY 1), border AS (SELECT a AS id, min(root) AS root FROM pairs JOIN roots ON roots.id = b GROUP BY 1)
    SELECT e.id, r.root IS NOT NULL AS core, coalesce(r.root, b.root, -1) AS cluster FROM emb e LEFT JOIN roots r ON r.id = e.id LEFT JOIN border b ON b.id = e.id""")
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vop.dbscan(v.vectors(spark, sf_dir), EPS, CONFIG.cluster.min_samples)


@query(f"""WITH {v.DET}, d AS (SELECT frame, pos, kind, class_name, confidence, x1, y1, x2, y2, part % 7 AS rid, CASE WHEN kind = 'person' THEN supp % 5 END AS track_id FROM det),
    o AS (SELECT o_orderkey AS frame FROM orders) SELECT CAST(o.frame % 20 AS VARCHAR) AS video_id, CAST(o.frame AS VARCHAR) AS frame, pos, kind, class_name, confidence, x1, y1, x2, y2, rid, track_id FROM o JOIN d USING (frame)""")
def stage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's files, written with frames that have no entries, and read by the next stage."""
    d = v.detections(spark, sf_dir).withColumns({"video_id": F.col("frame") % 20, "frame": F.col("frame").cast("string"), "rid": F.col("part") % 7, "track_id": F.when(F.col("kind") == "person", F.col("supp") % 5)})
    none = {c: F.lit(None).cast("long") for c in ("person_global_id", "user_id")} | {"attributes": F.lit(None).cast("map<string,string>")}
    frames = v.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 20).alias("video_id"), F.col("o_orderkey").cast("string").alias("frame"))
    path = tables.scratch_path(spark, "stage")
    stages.write_texts(stages.stage_texts(frames, d.withColumns(none)), path)
    read = stages.entries(stages.texts(spark, f"{path}/*"))
    return read.select("video_id", "frame", "pos", "kind", "class_name", "confidence", "x1", "y1", "x2", "y2", "rid", "track_id")


@query()
def gallery_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.gallery(spark, sf_dir).select(F.col("person_id").alias("gallery_id"), F.col("index_row").alias("id"), "v")
    return identity.fold(rows, t_accept=ACCEPT, t_reject=REJECT, gray_creates=False, min_sim_add=0.45, most=CONFIG.identity.max_protos_per_person)


@query()
def enroll_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = v.gallery(spark, sf_dir).select(F.concat(F.lit("name"), F.col("person_id")).alias("name"), "v")
    return identity.enroll(images, v.gallery(spark, sf_dir), t_accept=CONFIG.identity.enroll_t_accept, t_reject=CONFIG.identity.enroll_t_reject, k=10)


@query()
def duplicate_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of eight videos, each with an eighth of the gallery; every fifth detection has no vector."""
    videos = 8
    d = v.detections(spark, sf_dir).where("kind = 'person'").withColumns({"gallery_id": F.col("frame") % videos, "person_id": F.col("supp") % 3, "score": F.col("confidence")})
    own = v.vectors(spark, sf_dir)
    n = own.count()
    options = F.array(*(F.struct(((F.col("part") + i) % 6).alias("person_id"), (F.lit(0.85) - i * 0.1 - F.col("part") % 2 * 0.2).alias("sim")) for i in range(3)))
    rows = d.withColumns({"candidates": options, "vector_id": F.when(F.col("part") % 5 > 0, (F.col("part") * 7 + F.col("supp")) % n)})
    known = v.gallery(spark, sf_dir).withColumn("gallery_id", F.col("index_row") % videos)
    return identity.resolve_duplicates(rows, known, t_accept=0.8, t_reject=REJECT, min_sim_add=CONFIG.identity.min_sim_add, most=CONFIG.identity.max_protos_per_person, vectors=own)


@query()
def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a video are the orders of one remainder; its boxes drift, so the overlap asked for is lower."""
    d = v.detections(spark, sf_dir).select((F.col("frame") % 97).alias("video_id"), F.col("frame").alias("frame_idx"), "pos", "x1", "y1", "x2", "y2", "confidence")
    return tracking.track(d, d.select("video_id", "frame_idx"), TrackerConfig(match=0.3))


# key frames and evaluation


@query("SELECT event_id, CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.0 END AS scaled FROM events WINDOW w AS (PARTITION BY user_id)")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "events").withColumn("clip", F.col("user_id"))
    return keyframes.scaled(rows, "value").select("event_id", "scaled")


@query()
def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("frame_idx"), "value")
    return keyframes.peaks(keyframes.scaled(rows, "value"), "scaled", distance=3)


_F1 = """pr AS (SELECT DISTINCT user_id AS clip, event_id AS frame FROM events WHERE event_type = 'click'), wa AS (SELECT DISTINCT user_id AS clip, event_id AS frame FROM events WHERE event_type = 'view'),
    tp AS (SELECT clip, count(*) AS tp FROM (SELECT DISTINCT p.clip, p.frame FROM pr p JOIN wa w ON p.clip = w.clip AND abs(p.frame - w.frame) <= 30) GROUP BY 1),
    c AS (SELECT coalesce(p.clip, w.clip) AS clip, coalesce(np, 0) AS np, coalesce(nw, 0) AS nw FROM (SELECT clip, count(*) AS np FROM pr GROUP BY 1) p FULL JOIN (SELECT clip, count(*) AS nw FROM wa GROUP BY 1) w ON p.clip = w.clip),
    s AS (SELECT c.clip, CASE WHEN np > 0 THEN coalesce(tp, 0) / np ELSE 0.0 END AS p, CASE WHEN nw > 0 THEN coalesce(tp, 0) / nw ELSE 0.0 END AS r FROM c LEFT JOIN tp ON tp.clip = c.clip)"""


@query(f"WITH {_F1} SELECT clip, p * 100 AS precision, r * 100 AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END * 100 AS f1_score FROM s")
def keyframe_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("frame"), "event_type")
    found = evaluation.tolerance_match(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), 30)
    return found


@query(f"WITH {_F1} SELECT clip, round_even(p * 100, 2) AS precision, round_even(r * 100, 2) AS recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END * 100, 2) AS f1_score FROM s")
def keyframe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as reports show it, to two digits."""
    rows = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("frame"), "event_type")
    return evaluation.tolerance_match(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), 30, digits=2)


@query("""SELECT p_partkey, coalesce(TRY_CAST(t AS DOUBLE), 0.0) AS number, CASE WHEN regexp_full_match(t, '-?[0-9]+') THEN CAST(t AS BIGINT) END AS whole, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_retailprice / (p_size % 5) END AS ratio
    FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN '-' || p_size || '.5' END AS t FROM part)""")
def numbers_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, whole numbers, fractions and nulls as numbers."""
    key = F.col("p_partkey") % 4
    text = F.when(key == 0, F.col("p_name")).when(key == 1, F.col("p_partkey").cast("string")).when(key == 2, F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit(".5")))
    return v.table(spark, sf_dir, "part").select("p_partkey", numbers.number(text).alias("number"), numbers.whole(text).alias("whole"), numbers.ratio(F.col("p_retailprice"), F.col("p_size") % 5).alias("ratio"))


@query(f"""WITH {v.DET}, d AS (SELECT class_name, abs(confidence - part % 10 / 10.0) AS diff FROM det)
    SELECT class_name, min(diff) AS least, avg(diff) AS mean, max(diff) AS greatest, count(*) FILTER (WHERE diff > 0.123) AS failures, count(*) AS n FROM d GROUP BY ROLLUP (class_name)""")
def parity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.detections(spark, sf_dir).select("class_name", F.abs(F.col("confidence") - F.col("part") % 10 / 10.0).alias("diff"))
    return evaluation.parity(d, "class_name", "diff", 0.123)


@query(f"""WITH {v.OBS}, s AS (SELECT track_id, us, event_id, row_number() OVER (PARTITION BY track_id ORDER BY us, event_id) - 1 AS seq, count(*) OVER (PARTITION BY track_id) AS total FROM obs)
    SELECT track_id, seq // 10 AS clip, count(*) AS n, min(us) AS first_us FROM s WHERE seq // 10 < total // 10 GROUP BY 1, 2""")
def clip_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.streaming.clips import chunked

    return chunked(v.observations(spark, sf_dir), "track_id", ["us", "event_id"], 10).groupBy("track_id", "clip").agg(F.count("*").alias("n"), F.min("us").alias("first_us"))


# faces and hands, from landmarks made of the parts table


def _marks(n: int) -> Column:
    return F.array(*(F.struct((F.col("p_partkey") * (7 * i + 3) % 101 / 100.0).alias("x"), (F.col("p_partkey") * (5 * i + 2) % 97 / 96.0).alias("y")) for i in range(n)))


def _mark(i: int, c: str) -> str:
    return f"(p_partkey * {7 * i + 3} % 101 / 100.0)" if c == "x" else f"(p_partkey * {5 * i + 2} % 97 / 96.0)"


_UP = " + ".join(f"CAST({_mark(t, 'y')} < {_mark(p, 'y')} AS INT)" for t, p in ((8, 6), (12, 10), (16, 14), (20, 18)))
_FOLDED = " AND ".join(f"{_mark(t, 'y')} >= {_mark(p, 'y')} - 0.02" for t, p in ((8, 6), (12, 10), (16, 14), (20, 18)))
_UPRIGHT = " AND ".join(f"{_mark(4, 'y')} + 0.02 < {_mark(k, 'y')}" for k in (3, 2, 0))


@query(f"""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN {_mark(4, 'x')} < {_mark(3, 'x')} ELSE {_mark(4, 'x')} > {_mark(3, 'x')} END AS side, {_UP} AS up, {_FOLDED} AS folded, {_UPRIGHT} AS upright FROM part)
    SELECT p_partkey, CASE WHEN folded AND upright AND side THEN 'pulgar_arriba' WHEN up + CAST(side AS INT) = 0 THEN 'puño' WHEN up + CAST(side AS INT) = 5 THEN 'palma' ELSE 'otro' END AS gesture FROM s""")
def hand_gesture(spark: SparkSession, sf_dir: str) -> DataFrame:
    hand = F.when(F.col("p_size") % 2 == 0, "Right").otherwise("Left")
    return v.table(spark, sf_dir, "part").select("p_partkey", labels.gesture(_marks(21), hand).alias("gesture"))


def _axis(c: str, middle: float, limit: float) -> str:
    return f"CASE WHEN abs({c}) <= {middle} THEN 1.0 WHEN abs({c}) >= {limit} THEN 0.0 ELSE 1 - (abs({c}) - {middle}) / {limit - middle} END"


@query(f"""WITH s AS (SELECT p_partkey, p_partkey % 61 / 100.0 - 0.3 AS dx, p_size % 50 / 100.0 - 0.25 AS dy, p_size / 600.0 AS mouth FROM part)
    SELECT p_partkey, round({_axis('dx', 0.05, 0.25)} * 0.7 + {_axis('dy', 0.05, 0.20)} * 0.3, 3) AS attention, CASE WHEN mouth > 0.05 THEN 'abierta' ELSE 'cerrada' END AS mouth FROM s""")
def face_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = F.col("p_partkey") % 61 / 100.0 - 0.3, F.col("p_size") % 50 / 100.0 - 0.25
    return v.table(spark, sf_dir, "part").select("p_partkey", labels.attention(dx, dy).alias("attention"), labels.mouth_state(F.col("p_size") / 600.0).alias("mouth"))


@query("""WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[1:8], lambda x: x * 20) AS s FROM embeddings), x AS (SELECT vec_id, list_transform(s, lambda y: exp(y - list_max(s))) AS w FROM e),
    p AS (SELECT vec_id, list_transform(w, lambda y: y / list_sum(w)) AS p FROM x), a AS (SELECT vec_id, CAST(round_even(list_dot_product(p, [1.0, 5, 10, 18, 28, 40.5, 50.5, 80.0]::DOUBLE[]), 0) AS INT) AS age, list_max(p) AS c FROM p)
    SELECT vec_id, age, age >= 18 AS adult, c AS confidence FROM a""")
def age_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 20)
    rows = v.table(spark, sf_dir, "embeddings").select("vec_id", labels.age_of(scores).alias("a"))
    return rows.select("vec_id", "a.age", "a.adult", "a.confidence")


@query("""WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[1:9], lambda x: x * 20) AS s FROM embeddings), x AS (SELECT vec_id, list_transform(s, lambda y: exp(y - list_max(s))) AS w FROM e), p AS (SELECT vec_id, list_transform(w, lambda y: y / (list_sum(w) + 1e-8)) AS p FROM x)
    SELECT vec_id, coalesce(['neutral', 'feliz', 'triste', 'sorpresa', 'miedo', 'enojo', 'disgusto'][list_position(p, list_max(p))], 'class_' || (list_position(p, list_max(p)) - 1)) AS label, list_max(p) AS confidence FROM p""")
def emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine scores for seven names, so some labels are numbers."""
    scores = F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double") * 20)
    return v.table(spark, sf_dir, "embeddings").select("vec_id", labels.emotion_of(scores).alias("e")).select("vec_id", "e.label", "e.confidence")


_FACE_X, _FACE_Y = (lambda i: f"((p_partkey * 31 + {i} * 17) % 97) / 100.0"), (lambda i: f"((p_size * 13 + {i} * 29) % 89) / 100.0")


def _gaze_sql(eye: tuple[int, ...], iris: int) -> str:
    xs, ys = ("[" + ", ".join(f(i) for i in eye) + "]::DOUBLE[]" for f in (_FACE_X, _FACE_Y))
    off = lambda at, v: f"({at} - list_sum({v}) / {len(eye)}) / greatest(list_max({v}) - list_min({v}), 1e-6)"
    return f"{off(_FACE_X(iris), xs)}, {off(_FACE_Y(iris), ys)}"


@query(f"""WITH g AS (SELECT p_partkey, [{_gaze_sql(labels.LEFT_EYE, labels.LEFT_IRIS)}, {_gaze_sql(labels.RIGHT_EYE, labels.RIGHT_IRIS)}] AS g, sqrt(pow({_FACE_X(13)} - {_FACE_X(14)}, 2) + pow({_FACE_Y(13)} - {_FACE_Y(14)}, 2))::DOUBLE AS mouth FROM part),
    s AS (SELECT p_partkey, (g[1] + g[3]) / 2 AS dx, (g[2] + g[4]) / 2 AS dy, mouth FROM g)
    SELECT p_partkey, round({_axis('dx', 0.05, 0.25)} * 0.7 + {_axis('dy', 0.05, 0.20)} * 0.3, 3) AS attention, CASE WHEN mouth > 0.05 THEN 'abierta' ELSE 'cerrada' END AS state, round(mouth, 3) AS ratio FROM s""")
def face_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaze and mouth from all landmarks of a face."""
    i = F.sequence(F.lit(0), F.lit(labels.LANDMARKS - 1))
    marks = F.transform(i, lambda k: F.struct((((F.col("p_partkey") * 31 + k * 17) % 97) / 100.0).alias("x"), (((F.col("p_size") * 13 + k * 29) % 89) / 100.0).alias("y")))
    # few bytes make much work here, so rows are dealt out by their number and not by their size
    part = v.table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    rows = part.select("p_partkey", labels.face_of(marks).alias("f"))
    return rows.select("p_partkey", "f.attention", "f.mouth.state", "f.mouth.ratio")


# documents and tables


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = F.array(document.leaf("state", "string", F.col("p_type")), document.leaf("ratio", "number", F.col("p_size")))
    nodes = F.array(document.node("action", "string", F.col("p_brand")), document.node("armed", "boolean", F.col("p_size") > 25), document.node("face", "object", children=children))
    return v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), nodes.alias("metadata"))


@query("""SELECT p_partkey AS object_id, '0000' AS path, CAST(NULL AS VARCHAR) AS parent_path, 'action' AS name, 'string' AS data_type, p_brand AS value FROM part
    UNION ALL SELECT p_partkey, '0001', NULL, 'armed', 'boolean', CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END FROM part UNION ALL SELECT p_partkey, '0002', NULL, 'face', 'object', NULL FROM part
    UNION ALL SELECT p_partkey, '0002.0000', '0002', 'state', 'string', p_type FROM part UNION ALL SELECT p_partkey, '0002.0001', '0002', 'ratio', 'number', CAST(p_size AS VARCHAR) FROM part""")
def metadata_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.shred(_trees(spark, sf_dir))


@query(f"WITH {v.DET}, k AS (SELECT * FROM (VALUES ('person', 1), ('bag', 2)) v(class_name, id)), n AS (SELECT DISTINCT class_name FROM det WHERE class_name NOT IN (SELECT class_name FROM k)) SELECT class_name, CAST(id AS BIGINT) AS id FROM k UNION ALL SELECT class_name, 2 + row_number() OVER (ORDER BY class_name) FROM n")
def class_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("person", 1), ("bag", 2)], "class_name string, id long")
    return tables.get_or_create(known, v.detections(spark, sf_dir), "class_name")


_RESOLVE = f"""WITH {v.DET}, o AS (SELECT frame, pos, frame * 100 + pos AS object_id, CASE WHEN kind = 'person' THEN supp % 6 END AS user_id FROM det), u AS (SELECT frame, user_id, arg_max(object_id, pos) AS object_id FROM o WHERE user_id IS NOT NULL GROUP BY 1, 2)
    SELECT d.frame, d.pos, coalesce(u.object_id, z.object_id, n.object_id) AS object_id FROM det d LEFT JOIN u ON u.frame = d.frame AND u.user_id = d.part % 6 LEFT JOIN o z ON z.frame = d.frame AND z.pos = d.part % 6 LEFT JOIN o n ON n.frame = d.frame AND n.pos + 1 = d.part % 6"""


@query(_RESOLVE)
def resolve_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.detections(spark, sf_dir)
    objects = d.select("frame", "pos", (F.col("frame") * 100 + F.col("pos")).alias("object_id"), F.when(F.col("kind") == "person", F.col("supp") % 6).alias("user_id"))
    return document.resolve(d.select("frame", "pos", (F.col("part") % 6).alias("ref")), objects, "ref").select("frame", "pos", "object_id")


@query("SELECT l.l_orderkey AS video_id, l.l_partkey, o.o_custkey AS key_frame_id FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey AND l.l_linenumber = CAST(substr(o.o_orderpriority, 1, 1) AS INT)")
def event_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("pos"), F.col("o_custkey").alias("key_frame_id"))
    rows = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), "l_partkey", "l_linenumber")
    return document.at_position(rows, frames, F.col("l_linenumber")).select("video_id", "l_partkey", "key_frame_id")


@query(f"""WITH {v.DET}, f AS (SELECT o_orderkey AS frame FROM orders), b AS (SELECT frame, pos, class_name || ' ' || format('{{:.3f}}', confidence) AS label, 'box_' || lpad(CAST(pos AS VARCHAR), 3, '0') || '_' || replace(class_name, ' ', '_') || '.jpg' AS crop FROM det WHERE confidence >= 0.8)
    SELECT f.frame, CAST(f.frame AS VARCHAR) || '_overview.jpg' AS overview, CAST(count(b.pos) OVER (PARTITION BY f.frame) AS INT) AS n_boxes, b.pos, b.label, b.crop FROM f LEFT JOIN b USING (frame)""")
def review_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole manifests, box by box."""
    frames = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"))
    listed = document.review_manifest(frames, v.detections(spark, sf_dir).where("confidence >= 0.8"))
    return listed.select("frame", "overview", "n_boxes", F.explode_outer("boxes").alias("b")).select("frame", "overview", "n_boxes", "b.*")


@query(f"""WITH {v.DET} SELECT frame % 50 AS video_id, dense_rank() OVER (PARTITION BY frame % 50 ORDER BY frame) - 1 AS place, frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY pos) - 1 AS BIGINT) AS nth, pos, class_name, confidence, x1, y1, x2, y2 FROM det""")
def video_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, written and read back by their schema, object by object in their order."""
    d = v.detections(spark, sf_dir).withColumn("video_id", F.col("frame") % 50)
    frames = d.select("video_id", "frame").distinct().withColumn("pos", F.col("frame"))
    schema = "array<struct<pos:long,frame:long,objects:array<struct<pos:long,class_name:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>>>"
    path = tables.scratch_path(spark, "documents")
    stages.write_texts(document.documents(frames, d), path)
    read = spark.read.text(path).select("video_id", F.posexplode(F.from_json("value", schema)).alias("place", "f"))
    objects = read.select(F.col("video_id").cast("long").alias("video_id"), F.col("place").cast("long").alias("place"), "f.frame", F.posexplode("f.objects").alias("nth", "o"))
    return objects.select("video_id", "place", "frame", F.col("nth").cast("long").alias("nth"), "o.*")


@query(f"""SELECT c_custkey AS person_id, c_name AS display_name, c_acctbal > {v.ENROLLED_BALANCE} AS is_active FROM customer WHERE c_custkey % 10 <> 0
    UNION ALL SELECT c_custkey, 'again ' || c_name, TRUE FROM customer WHERE c_custkey % 10 = 0""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = v.registry(spark, sf_dir)
    changes = known.where("person_id % 10 = 0").select("person_id", F.concat(F.lit("again "), "display_name").alias("display_name"), F.lit(True).alias("is_active"))
    return tables.upsert(known, changes, "person_id")


@query("""SELECT s_nationkey AS camera_id, s_suppkey AS calibration, s_acctbal > 0 AND s_nationkey % 5 <> 0 AS is_active FROM supplier
    UNION ALL SELECT n_nationkey, 100000 + n_nationkey, TRUE FROM nation WHERE n_nationkey % 5 = 0""")
def calibration_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = v.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("camera_id"), F.col("s_suppkey").alias("calibration"), (F.col("s_acctbal") > 0).alias("is_active"))
    new = v.table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("camera_id"), (F.col("n_nationkey") + 100_000).cast("long").alias("calibration"))
    return tables.supersede(known, new, "camera_id")


@query("SELECT r_name AS name, CAST(r_regionkey + 1 AS BIGINT) AS id FROM region UNION ALL SELECT n_name, 5 + row_number() OVER (ORDER BY n_name) FROM (SELECT DISTINCT n_name FROM nation WHERE n_name NOT IN (SELECT r_name FROM region))")
def project_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = v.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 1).cast("long").alias("id"))
    return tables.get_or_create(known, v.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "name")


@query("""WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings)
    SELECT id, list_max(list_transform(v, lambda x: abs(x))) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-12) AS top, v[1] / (sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-12) AS first, id % 9 <> 0 AS valid FROM e""")
def normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth vector has no length."""
    own = F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(F.col("embedding").cast("array<double>"))
    rows = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), own.alias("v"))
    unit = vec.normalized(F.col("v"))
    return rows.select("id", F.array_max(F.transform(unit, lambda x: F.abs(x))).alias("top"), unit[0].alias("first"), vec.valid(F.col("v")).alias("valid"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


@query("SELECT s_nationkey AS camera_id, max(s_suppkey) AS calibration FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def active_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("camera_id"), F.col("s_suppkey").alias("calibration"))
    return latest(rows, "camera_id", "calibration")


from frameloom.plans import record_queries  # noqa: E402, F401  adds its queries
