"""Queries of the store's rows, identities, calibrations and detector outputs over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import geometry as geo
from frameloom.functions import labels
from frameloom.operators import calibration, document, evaluation, identity, neighborhood, records, tables, timeline
from frameloom.operators import detections as det
from frameloom.plans import views as v
from frameloom.plans.queries import SQL, query

VIDEOS = 8
CLASS = "cls AS (SELECT class_name, row_number() OVER (ORDER BY class_name) AS id FROM (SELECT DISTINCT class_name FROM det))"
#: Entries: corners with fractions, some of them missing, and a user of every entry.
ENTRY = """ent AS (SELECT frame, pos, kind, class_name, confidence, CASE WHEN supp % 11 = 0 THEN NULL ELSE x1 * 0.75 END AS x1, y1 * 0.75 AS y1, x2 * 0.75 AS x2, y2 * 0.75 AS y2,
    CASE WHEN supp % 6 > 0 THEN supp % 6 END AS user_id FROM det)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.detections(spark, sf_dir).withColumn("user_id", F.nullif(F.col("supp") % 6, F.lit(0)))
    return d.withColumns({c: F.col(c) * 0.75 for c in ("x1", "y1", "x2", "y2")}).withColumn("x1", F.when(F.col("supp") % 11 != 0, F.col("x1")))


@query(f"""WITH {v.DET}, {CLASS}, {ENTRY} SELECT frame * 10 AS key_frame_id, pos, CAST(cls.id AS BIGINT) AS object_class_id, confidence, CAST(trunc(coalesce(x1, 0)) AS BIGINT) AS x1, CAST(trunc(y1) AS BIGINT) AS y1,
    CAST(trunc(x2) AS BIGINT) AS x2, CAST(trunc(y2) AS BIGINT) AS y2, CASE WHEN kind = 'person' THEN user_id END AS user_id FROM ent JOIN cls USING (class_name)""")
def object_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir)
    classes = tables.get_or_create(spark.createDataFrame([], "class_name string, id long"), rows, "class_name")
    frames = rows.select("frame").distinct().withColumn("key_frame_id", F.col("frame") * 10)
    return records.object_rows(records.objects(rows), frames, classes)


@query(f"WITH {v.DET} SELECT frame, pos, kind, class_name, confidence, x1, CAST(NULL AS BIGINT) AS track_id, CAST(NULL AS BIGINT) AS person_global_id, rid, rid AS user_id FROM (SELECT *, CASE WHEN kind = 'person' THEN part % 100 END AS rid FROM det)")
def entry_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.detections(spark, sf_dir).withColumn("rid", F.when(F.col("kind") == "person", F.col("part") % 100))
    return records.entries(rows).select("frame", "pos", "kind", "class_name", "confidence", "x1", "track_id", "person_global_id", "rid", "user_id")


@query("""WITH f AS (SELECT (p_partkey - 1) % 10 AS video_id, (p_partkey - 1) // 10 AS pos, p_partkey AS key_frame_id FROM part)
    SELECT e.event_id, f.key_frame_id, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END AS details FROM events e LEFT JOIN f ON f.video_id = e.user_id % 10 AND f.pos = e.event_id % 300 - 5""")
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") - 1
    frames = v.table(spark, sf_dir, "part").select((key % 10).alias("video_id"), F.floor(key / 10).alias("pos"), F.col("p_partkey").alias("key_frame_id"))
    rows = v.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("video_id"), (F.col("event_id") % 300 - 5).alias("position"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("details"))
    return records.event_rows(rows, frames).select("event_id", "key_frame_id", "details")


@query(f"""SELECT '{{"event_type":"' || event_type || '","zone_id":' || coalesce(CAST(zone_id AS VARCHAR), 'null') || ',"person_global_id":' || coalesce(CAST(person_id AS VARCHAR), 'null') || ',"track_id":' || track_id
    || ',"started_at":"' || strftime(make_timestamp(started_us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z","ended_at":"' || strftime(make_timestamp(ended_us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z","first_frame_idx":' || first_frame
    || ',"details":{{"zone_name":' || coalesce('"' || zone_name || '"', 'null') || ',"observation_count":' || observation_count || ',"dwell_seconds":' || 'null' || '}}}}' AS document FROM ({SQL['intrusion']})""")
def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.plans.queries import intrusion

    return records.event_documents(intrusion(spark, sf_dir))


@query(f"""WITH {v.DET}, o AS (SELECT frame, pos, frame * 100 + pos AS object_id, CASE WHEN kind = 'person' THEN supp % 6 END AS user_id FROM det), u AS (SELECT frame, user_id, arg_max(object_id, pos) AS object_id FROM o WHERE user_id IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT frame % 50 AS video_id, frame, row_number() OVER (PARTITION BY frame % 50 ORDER BY frame) - 1 AS pos FROM (SELECT DISTINCT frame FROM det)),
    r AS (SELECT p_partkey, CAST(p_partkey % 50 AS BIGINT) AS video_id, CASE WHEN p_size % 9 = 0 THEN p_name ELSE CAST(p_size - 3 AS VARCHAR) END AS position, p_partkey % 7 AS related_ref, p_size % 5 AS parent_ref FROM part),
    k AS (SELECT r.*, f.frame FROM r JOIN f ON f.video_id = r.video_id AND TRY_CAST(position AS BIGINT) - 1 = f.pos AND TRY_CAST(position AS BIGINT) > 0)
    SELECT p_partkey, k.frame, coalesce(a.object_id, b.object_id, c.object_id) AS related_object_id, coalesce(d.object_id, e.object_id, g.object_id) AS parent_object_id, '' AS relation FROM k
    LEFT JOIN u a ON a.frame = k.frame AND a.user_id = related_ref LEFT JOIN o b ON b.frame = k.frame AND b.pos = related_ref LEFT JOIN o c ON c.frame = k.frame AND c.pos + 1 = related_ref
    LEFT JOIN u d ON d.frame = k.frame AND d.user_id = parent_ref LEFT JOIN o e ON e.frame = k.frame AND e.pos = parent_ref LEFT JOIN o g ON g.frame = k.frame AND g.pos + 1 = parent_ref""")
def video_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.detections(spark, sf_dir)
    listed = d.select("frame", "pos", (F.col("frame") * 100 + F.col("pos")).alias("object_id"), F.when(F.col("kind") == "person", F.col("supp") % 6).alias("user_id"))
    frames = records.frame_records(d.select((F.col("frame") % 50).alias("video_id"), F.lpad(F.col("frame").cast("string"), 12, "0").alias("frame")).distinct(), 0, 30).withColumn("frame", F.col("frame").cast("long"))
    size = F.col("p_size")
    rows = v.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("video_id"), F.when(size % 9 == 0, F.col("p_name")).otherwise((size - 3).cast("string")).alias("position"), (F.col("p_partkey") % 7).alias("related_ref"), (size % 5).alias("parent_ref"), F.lit(None).cast("string").alias("relation"))
    found = records.frame_relations(records.video_relations(rows, frames), listed)
    return found.select("p_partkey", "frame", "related_object_id", "parent_object_id", "relation")


@query("""WITH f AS (SELECT CAST(p_size AS BIGINT) AS video_id, CASE WHEN p_partkey % 7 = 0 THEN 'x' || p_partkey WHEN p_partkey % 11 = 0 THEN p_partkey || '_neighborhood' ELSE CAST(p_partkey AS VARCHAR) END AS frame FROM part)
    SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS pos, 1000000 + coalesce(CAST(round(TRY_CAST(frame AS BIGINT) / 25.0 * 1e6) AS BIGINT), 0) AS us FROM f WHERE NOT contains(frame, 'neighborhood')""")
def frame_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.when(key % 7 == 0, F.concat(F.lit("x"), key)).when(key % 11 == 0, F.concat(key, F.lit("_neighborhood"))).otherwise(key.cast("string"))
    rows = v.table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("video_id"), name.alias("frame"))
    return records.frame_records(rows, 1_000_000, 25)


@query("""WITH s AS (SELECT p_partkey AS object_id, '0000' AS path, CAST(NULL AS VARCHAR) AS parent_path, 'action' AS name, p_brand AS value FROM part
    UNION ALL SELECT p_partkey, '0001', NULL, 'armed', CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END FROM part UNION ALL SELECT p_partkey, '0002', NULL, 'face', NULL FROM part
    UNION ALL SELECT p_partkey, '0002.0000', '0002', 'state', p_type FROM part UNION ALL SELECT p_partkey, '0002.0001', '0002', 'ratio', CAST(p_size AS VARCHAR) FROM part), n AS (SELECT *, 99 + row_number() OVER (ORDER BY object_id, path) AS id FROM s)
    SELECT n.id, n.object_id, p.id AS metadata_id, n.name, n.value FROM n LEFT JOIN n p ON p.object_id = n.object_id AND p.path = n.parent_path""")
def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameloom.plans.queries import metadata_shred

    return records.metadata_rows(metadata_shred(spark, sf_dir), 100).select("id", "object_id", "metadata_id", "name", "value")


_FILES = """fl AS (SELECT p_size AS folder, CASE WHEN p_partkey % 3 = 0 THEN 'img_' ELSE '' END || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.webp' ELSE '.txt' END AS name FROM part),
    fk AS (SELECT folder, name, regexp_extract(name, '^(.*)\\.[^.]+$', 1) AS stem, list_position(['.jpg', '.png', '.jpeg', '.bmp', '.webp'], regexp_extract(name, '(\\.[^.]+)$', 1)) AS place FROM fl)"""


@query(f"""WITH {_FILES}, fr AS (SELECT p_size AS folder, CAST(p_partkey AS VARCHAR) AS frame FROM part), ok AS (SELECT * FROM fk WHERE place > 0),
    e AS (SELECT folder, stem, arg_min(name, (place, name)) AS path FROM ok GROUP BY 1, 2), x AS (SELECT fr.folder, fr.frame, arg_min(ok.name, (ok.place, ok.name)) AS near FROM fr JOIN ok ON ok.folder = fr.folder AND contains(ok.stem, fr.frame) GROUP BY 1, 2)
    SELECT fr.folder, fr.frame, coalesce(e.path, x.near) AS path FROM fr LEFT JOIN e ON e.folder = fr.folder AND e.stem = fr.frame LEFT JOIN x ON x.folder = fr.folder AND x.frame = fr.frame""")
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    ending = F.element_at(F.array(*map(F.lit, (".png", ".jpg", ".webp", ".txt"))), (key % 4 + 1).cast("int"))
    part = v.table(spark, sf_dir, "part").withColumn("folder", F.col("p_size"))
    files = part.select("folder", F.concat(F.when(key % 3 == 0, "img_").otherwise(""), key, ending).alias("name"))
    return records.image_paths(part.select("folder", key.cast("string").alias("frame")), files)


@query("SELECT o_orderpriority || '/' AS folder_path, o_orderpriority || '.' || o_orderstatus AS timestamp, o_orderstatus AS speed_inference, count(*) AS images FROM orders GROUP BY ALL")
def upload_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit("."), "o_orderstatus").alias("timestamp"), F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("speed_inference"))
    return records.upload_manifest(rows)


_FACE = """f AS (SELECT p_partkey AS id, p_partkey % 2 = 0 AS eyes, p_partkey % 3 > 0 AS mouth, CASE WHEN p_size % 4 > 0 THEN p_type END AS state, CAST(p_size AS BIGINT) AS ratio, p_partkey % 5 > 0 AS emo, p_brand AS label,
    CASE WHEN p_size % 3 > 0 THEN CAST(p_size * 2 AS BIGINT) END AS age, p_size % 2 = 0 AS sure FROM part)"""


@query(f"""WITH {_FACE}, r AS (SELECT id, '00' AS path, 'face' AS name, 'object' AS data_type, NULL AS value FROM f UNION ALL SELECT id, '00.00', 'attention', 'object', NULL FROM f WHERE eyes UNION ALL SELECT id, '00.00.00', 'attention', 'string', label FROM f WHERE eyes
    UNION ALL SELECT id, '00.01', 'mouth', 'object', NULL FROM f WHERE mouth UNION ALL SELECT id, '00.01.00', 'state', 'string', state FROM f WHERE mouth AND state IS NOT NULL UNION ALL SELECT id, '00.01.01', 'ratio', 'float', CAST(ratio AS VARCHAR) FROM f WHERE mouth
    UNION ALL SELECT id, '00.02', 'emotion', 'object', NULL FROM f WHERE emo UNION ALL SELECT id, '00.02.00', 'label', 'string', label FROM f WHERE emo UNION ALL SELECT id, '00.03', 'age', 'object', NULL FROM f WHERE age IS NOT NULL
    UNION ALL SELECT id, '00.03.00', 'confidence', 'float', CAST(ratio AS VARCHAR) FROM f WHERE age IS NOT NULL AND sure UNION ALL SELECT id, '00.03.01', 'age', 'integer', CAST(age AS VARCHAR) FROM f WHERE age IS NOT NULL
    UNION ALL SELECT id, '00.04', 'adult', 'boolean', CASE WHEN age >= 18 THEN 'true' ELSE 'false' END FROM f WHERE age IS NOT NULL) SELECT id AS object_id, path, CASE WHEN len(path) > 2 THEN path[:len(path) - 3] END AS parent_path, name, data_type, value FROM r""")
def face_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    n, age = size.cast("long"), F.when(size % 3 > 0, (size * 2).cast("long"))
    mouth = F.struct(F.when(size % 4 > 0, F.col("p_type")).alias("state"), n.alias("ratio"))
    emotion = F.struct(F.col("p_brand").alias("label"), F.lit(None).cast("double").alias("confidence"))
    face = F.struct(F.when(key % 2 == 0, F.struct(F.col("p_brand").alias("attention"))).alias("attention"), F.when(key % 3 > 0, mouth).alias("mouth"), F.when(key % 5 > 0, emotion).alias("emotion"), age.alias("age"), F.when(size % 2 == 0, n).alias("age_confidence"), (age >= 18).alias("adult"))
    return document.face_rows(v.table(spark, sf_dir, "part").select(key.alias("object_id"), face.alias("face")))


@query("""WITH h AS (SELECT p_partkey AS id, list_filter([{'s': 'Left', 'g': p_brand}, {'s': CASE WHEN p_size % 2 = 0 THEN 'Right' ELSE 'Left' END, 'g': p_type}, {'s': 'Right', 'g': p_name}], lambda x: p_size % 5 > 0) AS hands FROM part),
    s AS (SELECT id, list_filter(hands, lambda x: x.s = 'Right')[1] AS r, list_filter(hands, lambda x: x.s = 'Left')[1] AS l FROM h)
    SELECT id AS object_id, '00' AS path, CAST(NULL AS VARCHAR) AS parent_path, 'hands' AS name, 'object' AS data_type, CAST(NULL AS VARCHAR) AS value FROM s UNION ALL SELECT id, '00.00', '00', 'Right', 'object', NULL FROM s WHERE r IS NOT NULL
    UNION ALL SELECT id, '00.00.00', '00.00', 'gesture', 'string', r.g FROM s WHERE r IS NOT NULL UNION ALL SELECT id, '00.01', '00', 'Left', 'object', NULL FROM s WHERE l IS NOT NULL UNION ALL SELECT id, '00.01.00', '00.01', 'gesture', 'string', l.g FROM s WHERE l IS NOT NULL""")
def hand_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    hand = lambda side, gesture: F.struct(side.alias("hand"), F.col(gesture).alias("gesture"))
    hands = F.array(hand(F.lit("Left"), "p_brand"), hand(F.when(F.col("p_size") % 2 == 0, "Right").otherwise("Left"), "p_type"), hand(F.lit("Right"), "p_name"))
    return document.hand_rows(v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), F.when(F.col("p_size") % 5 > 0, hands).otherwise(F.array()).alias("hands")))


@query(f"SELECT frame, p_id, q_id, relation, 'Persona ' || p_id || ' está ' || phrase || ' de Persona ' || q_id || '.' AS markdown FROM ({SQL['neighborhood_pp']})")
def relation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = v.detections(spark, sf_dir).where("kind = 'person'")
    found = neighborhood.stored(neighborhood.person_person(people), F.concat(F.lit("Persona "), F.col("q_id").cast("string")))
    return found.select("frame", "p_id", "q_id", "relation", "markdown")


@query(f"""WITH {v.DET} SELECT frame, pos, array_to_string(list_filter(['pose: pose' || supp % 5 || CASE WHEN part % 3 > 0 THEN format(' ({{:.3f}})', part % 8 / 8.0) ELSE '' END, CASE WHEN supp % 4 > 0 THEN 'track: ' || supp % 4 END, CASE WHEN part % 2 > 0 THEN 'pid: ' || part END], lambda x: x IS NOT NULL), chr(10)) AS lines FROM det""")
def person_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("part"), F.col("supp")
    lines = labels.person_lines(F.concat(F.lit("pose"), supp % 5), F.when(part % 3 > 0, part % 8 / 8.0), F.when(supp % 4 > 0, supp % 4), F.when(part % 2 > 0, part))
    return v.detections(spark, sf_dir).select("frame", "pos", lines.alias("lines"))


# identities


@query(f"""WITH {v.DET}, r AS (SELECT frame % 100 AS video_id, frame, pos, kind, CASE WHEN kind = 'person' AND confidence >= 0.5 THEN row_number() OVER (PARTITION BY frame % 100, kind = 'person' AND confidence >= 0.5 ORDER BY frame, pos) - 1 END AS rid FROM det)
    SELECT frame, pos, CASE WHEN rid IS NULL THEN NULL WHEN rid % 4 = 3 THEN -1 ELSE rid % 6 - 1 END AS track_id, CASE WHEN rid % 4 <> 3 AND rid % 6 - 1 IN (0, 2) THEN (rid % 6 - 1) * 10 + 1 END AS person_global_id,
    CASE WHEN rid % 4 <> 3 AND rid % 6 - 1 IN (0, 2) THEN (rid % 6 - 1) * 10 + 1 ELSE rid END AS user_id, CASE WHEN rid % 4 <> 3 AND rid % 6 - 1 BETWEEN 0 AND 2 THEN 'label ' || (rid % 6 - 1) END AS evidence FROM r""")
def label_to_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.detections(spark, sf_dir).withColumn("video_id", F.col("frame") % 100).withColumn("embedded", F.col("confidence") >= 0.5)
    rids = det.numbered(d, ["frame", "pos"]).select("frame", "pos", "rid")
    rows = d.join(rids, ["frame", "pos"], "left").select("video_id", "frame", "pos", "kind", "rid")
    labels = rows.where("rid % 4 != 3").select("video_id", "rid", (F.col("rid") % 6 - 1).alias("label"))
    of = F.when(F.col("label") != 1, F.col("label") * 10 + 1)
    outcomes = labels.select("video_id", "label").distinct().where("label between 0 and 2").select("video_id", "label", of.alias("person_id"), F.concat(F.lit("label "), "label").alias("evidence"))
    return identity.assigned(identity.labelled(rows, labels), outcomes).select("frame", "pos", "track_id", "person_global_id", "user_id", "evidence")


@query("SELECT user_id % 50 AS video_id, count(DISTINCT event_id % 7 - 1) FILTER (WHERE event_id % 7 > 0) AS people FROM events GROUP BY 1")
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("video_id"), (F.col("event_id") % 7 - 1).alias("label"))
    return evaluation.people_found(rows)


@query(f"""WITH {v.EMB}, g AS (SELECT id AS index_row, person_id, is_active FROM emb WHERE id % 10 <> 0), n AS (SELECT id, person_id FROM emb WHERE id % 10 = 0)
    SELECT index_row, person_id, is_active FROM g UNION ALL SELECT (SELECT max(index_row) FROM g) + row_number() OVER (ORDER BY person_id, CAST(id AS VARCHAR)), person_id, TRUE FROM n""")
def add_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = v.gallery(spark, sf_dir)
    new = g.where("index_row % 10 = 0").select("person_id", F.col("index_row").cast("string").alias("proto_id"), F.lit(None).cast("string").alias("modality"), "v")
    return identity.add_prototypes(g.where("index_row % 10 != 0"), new, 64).select("index_row", "person_id", "is_active")


@query(f"""WITH {v.EMB}, n AS (SELECT DISTINCT 'name' || (id % 13) AS name FROM emb WHERE id % 10 = 0) SELECT name, (SELECT max(person_id) FROM emb WHERE id % 10 <> 0) + row_number() OVER (ORDER BY name) AS person_id FROM n""")
def create_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = v.gallery(spark, sf_dir)
    new = g.where("index_row % 10 = 0").select(F.concat(F.lit("name"), F.col("index_row") % 13).alias("name"), F.col("index_row").cast("string").alias("proto_id"), F.lit("body").alias("modality"), "v")
    return identity.create_people(g.where("index_row % 10 != 0"), new, 64)[0].select("name", "person_id")


@query(f"SELECT c_custkey AS person_id, c_name AS display_name, c_acctbal > {v.ENROLLED_BALANCE} AND c_custkey % 10 <> 3 AS is_active FROM customer")
def registry_deactivate(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = v.registry(spark, sf_dir)
    gone = spark.range(-5, 10**6).select((F.col("id") * 10 + 3).alias("person_id")).join(known.select("person_id"), "person_id", "left_semi")
    return tables.deactivate(known, gone, "person_id")


# calibration


_M = v.HOMOGRAPHY
_WORLD = lambda a, b, c: f"({a} * gx + {b} * gy + {c}) / ({_M[6]} * gx + {_M[7]} * gy + {_M[8]})"


@query(f"""WITH {v.DET}, {v.ZONE}, {v.EDGE}, g AS (SELECT frame, pos, frame % 3 AS camera_id, (x1 + x2) * 0.5 AS gx, y2 AS gy FROM det),
    w AS (SELECT *, CASE WHEN camera_id < 2 THEN {_WORLD(*_M[:3])} END AS world_x, CASE WHEN camera_id < 2 THEN {_WORLD(*_M[3:6])} END AS world_y FROM g),
    i AS (SELECT frame, pos, e.zone_id, world_x < 0 OR count(*) FILTER (WHERE (py > world_y) <> (qy > world_y) AND world_x < px + (world_y - py) * (qx - px) / nullif(qy - py, 0)) % 2 = 1 AS held FROM w JOIN edge e ON camera_id = 1 WHERE world_x >= 0 GROUP BY frame, pos, e.zone_id, world_x),
    z AS (SELECT frame, pos, arg_min(i.zone_id, zone_ord) AS zone_id FROM i JOIN zone USING (zone_id) WHERE held AND is_active GROUP BY 1, 2)
    SELECT w.frame, w.pos, world_x, world_y, CAST(zone_id AS BIGINT) AS zone_id FROM w LEFT JOIN z ON z.frame = w.frame AND z.pos = w.pos""")
def world_and_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three cameras are calibrated, and one of them has zones."""
    known = spark.createDataFrame([(0, list(_M)), (1, list(_M))], "camera_id long, homography array<double>")
    d = v.detections(spark, sf_dir).withColumn("camera_id", F.col("frame") % 3)
    return calibration.with_world(d, known, v.zones(spark)).select("frame", "pos", "world_x", "world_y", "zone_id")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correspondences of cameras by size, every third one far off and some malformed; the last two cameras have too few."""
    x, y = F.col("p_partkey").cast("double") % 640, (F.col("p_partkey") * 7 % 480).cast("double")
    wx, wy = geo.projected(x, y, _M)
    n = F.row_number().over(v.Window.partitionBy("p_size").orderBy("p_partkey"))
    far = F.when(n % 3 == 0, F.col("p_partkey") % 17 * 40 + 25).otherwise(0)
    rows = v.table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("camera_id"), x.alias("image_x"), y.alias("image_y"), (wx + far).alias("world_x"), F.when(F.col("p_partkey") % 13 != 0, wy - far / 2).alias("world_y"), n.alias("n"), (n % 3 == 0).alias("off"))
    return rows.where("camera_id < 49 or n <= 3").drop("n")


_POINT = "CAST(p_partkey AS DOUBLE) % 640 AS ix, CAST(p_partkey * 7 % 480 AS DOUBLE) AS iy"
_TO = lambda a, b, c: f"({a} * ix + {b} * iy + {c}) / ({_M[6]} * ix + {_M[7]} * iy + {_M[8]})"


@query(f"""WITH p AS (SELECT CAST(p_size AS BIGINT) AS camera_id, p_partkey, {_POINT}, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part),
    q AS (SELECT *, p_partkey % 13 <> 0 AS whole, n % 3 = 0 AS off FROM p WHERE camera_id < 49 OR n <= 3), c AS (SELECT camera_id, count(*) FILTER (WHERE whole) AS n, count(*) FILTER (WHERE whole AND NOT off) AS inliers FROM q GROUP BY 1),
    spot AS (SELECT 100.0::DOUBLE AS ix, 50.0::DOUBLE AS iy)
    SELECT camera_id, CAST(n AS BIGINT) AS n, CASE WHEN n < 4 THEN 'fewer than four points' END AS reason, CASE WHEN n < 4 THEN 0 ELSE inliers END AS inliers,
    CASE WHEN n >= 4 THEN {_TO(*_M[:3])} END AS world_x, CASE WHEN n >= 4 THEN {_TO(*_M[3:6])} END AS world_y, CASE WHEN n >= 4 THEN TRUE END AS close FROM c, spot""")
def homography_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third pair is far off: the matrix that made the others is found, leads a point to its place, and they agree."""
    points = _points(spark, sf_dir)
    good = points.where("NOT off").na.drop()
    found = tables.materialize(calibration.estimate(points.drop("off")), "calibrations")
    errors = calibration.reprojection_error(good, found.where("homography is not null"))
    x, y = geo.projected(F.lit(100.0), F.lit(50.0), F.col("homography"))
    known = F.col("homography").isNotNull()
    return found.join(errors, "camera_id", "left").select("camera_id", "n", "reason", "inliers", F.when(known, x).alias("world_x"), F.when(known, y).alias("world_y"), (F.col("error") < 1e-6).alias("close"))


# detector outputs and times


@query(f"""WITH {v.DET}, d AS (SELECT frame, pos, part % 9 AS class_id, confidence, x1, y1, x2, y2 FROM det WHERE confidence >= 0.5)
    SELECT frame, pos, class_id, confidence, greatest(0, least(640, (x1 - 8) / 0.5)) AS x1, greatest(0, least(480, (y1 - 4) / 0.5)) AS y1, greatest(0, least(640, (x2 - 8) / 0.5)) AS x2, greatest(0, least(480, (y2 - 4) / 0.5)) AS y2 FROM d""")
def decoded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct("pos", F.array("x1", "y1", "x2", "y2", "confidence", (F.col("part") % 9).cast("double")).alias("r"))
    outputs = v.detections(spark, sf_dir).groupBy("frame").agg(F.transform(F.sort_array(F.collect_list(box)), lambda b: b["r"]).alias("raw"))
    outputs = outputs.withColumns({"ratio": F.lit(0.5), "pad_x": F.lit(8.0), "pad_y": F.lit(4.0), "w": F.lit(640.0), "h": F.lit(480.0)})
    return det.decoded(outputs, 0.5, 0.45)


@query(f"WITH {v.DET} SELECT frame, pos, least({v.WIDTH}, ceil((x1 + x2) * 0.5 + (x2 - x1) * 0.6)) - greatest(0, floor((x1 + x2) * 0.5 - (x2 - x1) * 0.6)) < 100 OR least({v.HEIGHT}, ceil((y1 + y2) * 0.5 + (y2 - y1) * 0.6)) - greatest(0, floor((y1 + y2) * 0.5 - (y2 - y1) * 0.6)) < 100 AS lowres FROM det")
def lowres_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.detections(spark, sf_dir).select("frame", "pos", det.lowres(geo.Box.of(), 1.2, v.WIDTH, v.HEIGHT, 100).alias("lowres"))


@query(f"WITH {v.DET} SELECT frame, pos, CASE WHEN part % 9 = 0 THEN 'person' ELSE 'object' END AS kind FROM det")
def kind_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.detections(spark, sf_dir).select("frame", "pos", det.split_kind(F.col("part") % 9).alias("kind"))


@query(f"WITH {v.DET}, t AS (SELECT frame, pos, kind, CASE WHEN supp % 5 > 0 THEN supp % 5 - 2 END AS track_id, CASE WHEN part % 4 > 0 THEN confidence END AS confidence, x1 + y1 * 7 + x2 * 11 + y2 * 13 AS box, part FROM det) SELECT frame, pos, track_id, coalesce(confidence, 0.0) AS confidence, CASE WHEN part % 6 > 0 THEN 4 ELSE 0 END AS corners, CASE WHEN part % 6 > 0 THEN box END AS box FROM t WHERE kind = 'person' AND track_id IS NOT NULL AND track_id <> -1")
def tracked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.detections(spark, sf_dir).withColumns({"track_id": F.when(F.col("supp") % 5 > 0, F.col("supp") % 5 - 2), "confidence": F.when(F.col("part") % 4 > 0, F.col("confidence")), "y2": F.when(F.col("part") % 6 > 0, F.col("y2"))})
    box = sum((F.get("bbox", F.lit(i)) * k for i, k in ((1, 7), (2, 11), (3, 13))), F.get("bbox", F.lit(0)))
    return timeline.tracked(rows).select("frame", "pos", "track_id", "confidence", F.size("bbox").alias("corners"), box.alias("box"))


@query("""WITH t AS (SELECT s_nationkey AS video_id, TRY_CAST(CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_acctbal AS VARCHAR) ELSE s_name END AS DOUBLE) AS seconds, s_suppkey % 4 AS n FROM supplier)
    SELECT video_id, sum(coalesce(seconds, 0)) AS total, CASE WHEN sum(n) > 0 THEN sum(coalesce(seconds, 0)) / sum(n) ELSE 0.0 END AS per_frame FROM t GROUP BY 1""")
def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal").cast("string")).otherwise(F.col("s_name"))
    rows = v.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("video_id"), seconds.alias("seconds"), (F.col("s_suppkey") % 4).alias("n"))
    return evaluation.stage_times(rows, "video_id")
