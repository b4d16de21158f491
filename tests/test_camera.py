"""Cases with known outcomes for geometry, schedules, rules, tracking, vectors, key frames and sources."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.config import TrackerConfig
from frameloom.functions import geometry as geo
from frameloom.functions import labels, timing
from frameloom.operators import detections, document, evaluation, identity, keyframes, rules, tables, timeline, tracking, vectors, zones
from frameloom.sources import manifest, store
from frameloom.streaming import clips

DAY = 86_400_000_000
SQUARE, NOTCH = [(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)]


def test_boxes(spark):
    rows = [((0, 0, 10, 10), (20, 20, 30, 30), 0.0), ((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3)]
    df = spark.createDataFrame([(*map(float, a), *map(float, b), c) for a, b, c in rows], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double, want double")
    got = df.select(geo.iou(geo.Box.of("a"), geo.Box.of("b")).alias("iou"), "want").collect()
    assert all(abs(r["iou"] - r["want"]) < 1e-9 for r in got)
    df = spark.createDataFrame([(-5.0, -5.0, 150.0, 80.0, 100, 50), (1.4, 1.6, 10.5, 10.4, 100, 50)], "x1 double, y1 double, x2 double, y2 double, w int, h int")
    assert [tuple(r) for r in df.select(*geo.clamped(geo.Box.of(), F.col("w"), F.col("h"))).collect()] == [(0, 0, 99, 49), (1, 2, 10, 10)]
    ground = geo.projected(*geo.ground_point(geo.Box(*(F.lit(float(v)) for v in (0, 0, 100, 200)))), (0.01, 0, 0, 0, 0.01, 0, 0, 0, 1))
    assert tuple(spark.range(1).select(*ground).first()) == (0.5, 2.0)


@pytest.mark.parametrize(
    ("polygon", "point", "want"),
    [(SQUARE, (5, 5), True), (SQUARE, (0, 5), True), (SQUARE, (10, 10), True), (SQUARE, (11, 5), False), (NOTCH, (5, 8), False), (NOTCH, (5, 5), True), (NOTCH, (2, 3), True), (SQUARE[:2], (5, 0), False), ([], (0, 0), False)],
)
def test_polygons(spark, polygon, point, want):
    df = spark.createDataFrame([([(float(x), float(y)) for x, y in polygon], *map(float, point))], "p array<struct<x:double,y:double>>, x double, y double")
    assert df.select(geo.in_polygon(F.col("x"), F.col("y"), F.col("p"))).first()[0] is want


FRIDAY = 20_000 * DAY + (4 - (20_000 + 3) % 7) * DAY
HOUR = DAY // 24


@pytest.mark.parametrize(
    ("us", "schedule", "want"),
    [
        (FRIDAY, None, True), (FRIDAY, ([], None, None), False), (FRIDAY, ([4], None, None), True), (FRIDAY + 9 * HOUR, (None, "09:00", "17:00"), True), (FRIDAY + 17 * HOUR, (None, "09:00", "17:00"), True),
        (FRIDAY + 17 * HOUR + 1, (None, "09:00", "17:00"), False), (FRIDAY + 23 * HOUR, ([4], "22:00", "06:00"), True), (FRIDAY + 25 * HOUR, ([4], "22:00", "06:00"), True),
        (FRIDAY + 34 * HOUR, ([4], "22:00", "06:00"), False), (FRIDAY - HOUR, ([4], "22:00", "06:00"), False), (FRIDAY, (None, "9am", "17:00"), None),
    ],
)
def test_schedules(spark, us, schedule, want):
    df = spark.createDataFrame([(us, schedule)], "us long, s struct<days:array<int>,from:string,to:string>")
    assert df.select(timing.armed(F.col("us"), F.col("s"))).first()[0] is want


def observations(spark, frames, zone=1, person=None, step=1_000_000):
    rows = [(7, f, f * step, zone, person, k) for k, f in enumerate(frames)]
    return spark.createDataFrame(rows, "track_id long, frame_idx long, us long, zone_id long, person_id long, event_id long")


def zone_table(spark, kind="restricted", schedule=None, has=False):
    schema = "zone_id long, name string, zone_type string, is_active boolean, schedule struct<days:array<int>,from:string,to:string,loiter_seconds:double>, schedule_has_loiter boolean"
    return spark.createDataFrame([(1, "z", kind, True, schedule, has)], schema)


@pytest.mark.parametrize(("frames", "n"), [([10, 11, 12, 13, 14, 16], 1), ([10, 11, 12, 13, 14, 18], 2), ([], 0)])
def test_intrusion_gap(spark, frames, n):
    found = rules.intrusion(observations(spark, frames), zone_table(spark), 2, ["event_id"]).collect()
    assert len(found) == n and sum(r["observation_count"] for r in found) == len(frames)


@pytest.mark.parametrize(("last", "n"), [(29, 0), (30, 1)])
def test_loitering_time(spark, last, n):
    zone = zone_table(spark, "general", (None, None, None, 30.0), True)
    assert rules.loitering(observations(spark, range(last + 1)), zone, 2, 99.0, ["event_id"]).count() == n
    assert rules.loitering(observations(spark, range(200)), zone_table(spark, "general", (None, None, None, None), True), 2, 30.0, ["event_id"]).count() == 0


@pytest.mark.parametrize(("n_obs", "person", "n"), [(4, None, 0), (5, None, 1), (5, 9, 0), (5, 8, 1)])
def test_unenrolled(spark, n_obs, person, n):
    registry = spark.createDataFrame([(9, True), (8, False)], "person_id long, is_active boolean")
    obs = observations(spark, range(n_obs), person=person)
    assert rules.unenrolled(obs, registry, 2, 5, ["event_id"]).count() == n
    assert rules.unenrolled(obs, None, 2, 5, ["event_id"]) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=25), st.integers(0, 4))
def test_runs_as_a_loop(spark, frames, gap):
    want, before = 0, None
    for f in sorted(frames):
        want += before is None or f - before > gap + 1
        before = f
    assert timeline.runs(observations(spark, frames), ["track_id"], gap, ["event_id"]).count() == want


def test_first_zone_wins(spark):
    corners = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    listed = spark.createDataFrame([(1, 0, 5, corners, False), (1, 1, 6, corners, True), (1, 2, 7, corners, True)], "camera_id int, zone_ord int, zone_id long, polygon array<struct<x:double,y:double>>, is_active boolean")
    points = spark.createDataFrame([(1, 1, 5.0, 5.0), (2, 1, 50.0, 5.0), (3, 2, 5.0, 5.0), (4, None, None, None)], "id int, camera_id int, x double, y double")
    for most in (10, 0):
        assert {r["id"]: r["zone_id"] for r in zones.classify(points, listed, most).collect()} == {1: 6, 2: None, 3: None, 4: None}


def track_frames(frames):
    t, out = tracking.Tracker(TrackerConfig()), []
    for boxes, scores in frames:
        out.append(t.frame(np.array(boxes, float).reshape(-1, 4), np.array(scores, float)).tolist())
    return t, out


def box(x, y=0):
    return [x, y, x + 100, y + 200]


def test_tracker():
    _, out = track_frames([([box(5 * k)], [0.9]) for k in range(20)])
    assert out == [[1]] * 20
    lead = [([box(0)], [0.9])] * 10
    t, out = track_frames([*lead, *[([], [])] * 5, ([box(0)], [0.3])])
    assert out[-1] == [1] and t.made == 1
    spawn = [([], [])] * 3 + [([box(0)], [0.9])] * 2 + [([], [])] + [([box(0)], [0.9])] * 5
    _, out = track_frames(spawn)
    assert [bool(x and x[0] > 0) for x in out] == [False] * 8 + [True] * 3
    _, out = track_frames([([box(4 * k), box(96 - 4 * k, 150)], [0.9, 0.9]) for k in range(25)])
    assert out == [[1, 2]] * 25
    _, out = track_frames([([box(0)], [0.2 if 5 <= k <= 9 else 0.9]) for k in range(15)])
    assert out == [[1]] * 15


def test_tracks_in_a_stream_as_in_batch(spark, tmp_path):
    rows = [(1, f, 0, *map(float, box(3 * f)), 0.9) for f in range(12) if f != 6] + [(1, 6, None, None, None, None, None, None)]
    schema = "camera_id long, frame_idx long, pos long, x1 double, y1 double, x2 double, y2 double, confidence double"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = clips.live_tracks(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and not q.exception()
    batch = tracking.track(df.withColumnRenamed("camera_id", "video_id").where("pos is not null"), df.select(F.col("camera_id").alias("video_id"), "frame_idx"))
    assert {(r["frame_idx"], r["track_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(r["frame_idx"], r["track_id"]) for r in batch.collect()}


def cluster_model(x, eps, least):
    near = (x @ x.T) >= 1 - eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack = [i]
            label[i] = i
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[j] = i
                    stack.append(j)
    for i in np.flatnonzero(~core):
        touched = label[near[i] & core]
        label[i] = touched.min() if len(touched) else -1
    return label.tolist()


@pytest.mark.parametrize(("seed", "eps", "least"), [(0, 0.3, 4), (1, 0.5, 4), (2, 0.4, 3)])
def test_clusters(spark, seed, eps, least):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 0.08, (8, 16)) + c for c in rng.normal(0, 1, (3, 16))] + [rng.normal(0, 1, (5, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in vectors.dbscan(df, eps, least).collect()}
    assert [got[i] for i in range(len(x))] == cluster_model(x, eps, least)
    tiny = {tuple(r) for r in vectors.similar_pairs(df, 0.5, tile=7).select("a", "b").collect()}
    assert tiny == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if x[i] @ x[j] >= 0.5}


def test_identities(spark):
    unit = lambda *v: (np.array(v) / np.linalg.norm(v)).tolist()
    rows = [(1, 0, unit(1, 0)), (1, 1, unit(1, 0.1)), (1, 2, unit(0, 1)), (1, 3, unit(1, 1))]
    df = spark.createDataFrame(rows, "gallery_id long, id long, v array<double>")
    fold = lambda gray: [(r["person_id"], r["outcome"]) for r in identity.fold(df, t_accept=0.8, t_reject=0.45, gray_creates=gray, min_sim_add=0.68, most=5).orderBy("id").collect()]
    assert fold(False) == [(1, "created"), (1, "matched"), (2, "created"), (None, "gray")]
    assert fold(True)[-1] == (3, "created_gray")
    empty = spark.createDataFrame([], "index_row long, person_id long, is_active boolean, v array<double>")
    assert [r["outcome"] for r in identity.decide(df.select("id", "v"), empty, t_accept=0.8, t_reject=0.4, k=3).collect()] == ["create"] * 4
    with pytest.raises(TypeError):
        identity.decide(df.select("id", "v"), empty, k=3)


def test_suppression_and_matching(spark):
    rows = [(1, 0, "a", *map(float, box(0)), 0.9), (1, 1, "a", *map(float, box(5)), 0.8), (1, 2, "b", *map(float, box(5)), 0.7), (1, 3, "a", *map(float, box(300)), 0.1)]
    df = spark.createDataFrame(rows, "frame long, pos long, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double")
    assert sorted(r["pos"] for r in detections.nms(df, 0.45, 0.25).collect()) == [0, 2]
    found = {(r["a_pos"], r["b_pos"]) for r in evaluation.greedy_match(df.where("pos < 2"), df.where("pos >= 2")).collect()}
    assert found == {(1, 2), (0, None), (None, 3)}


def test_peaks():
    x = np.zeros(100)
    x[[10, 15, 50]] = 0.6, 0.9, 0.5
    x[70:73] = 0.8
    assert keyframes.peaks_of(x, 0.3, 20, 0.1).tolist() == [15, 50, 71]
    assert keyframes.peaks_of(x, 0.55, 20, 0.1).tolist() == [15, 71] and not len(keyframes.peaks_of(np.zeros(0), 0.3, 20, 0.1))


def test_dimension_tables(spark, tmp_path):
    known = spark.createDataFrame([("a", 1, True)], "name string, id long, is_active boolean")
    names = spark.createDataFrame([("c",), ("b",), ("a",), (None,), ("b",)], "name string")
    assert {(r["name"], r["id"]) for r in tables.get_or_create(known.drop("is_active"), names, "name").collect()} == {("a", 1), ("b", 2), ("c", 3)}
    changed = tables.supersede(known, spark.createDataFrame([("a", 9)], "name string, id long"), "name")
    assert {(r["id"], r["is_active"]) for r in changed.collect()} == {(1, False), (9, True)}
    store.create(spark, str(tmp_path))
    store.create(spark, str(tmp_path))
    store.append(spark.createDataFrame([(3, "person")], "id long, name string"), str(tmp_path), "object_class")
    assert [tuple(r) for r in store.read(spark, str(tmp_path), "object_class").collect()] == [(3, "person")]


def test_requests(spark):
    raw = spark.createDataFrame([('{"record": {"folder_path": "a", "timestamp": "t", "speed_inference": "x"}}',), ('{"record": {"timestamp": "t"}}',), ("no json",), (None,)], "value string")
    good, bad = manifest.requests(raw)
    assert [(r["folder_path"], r["speed"]) for r in good.collect()] == [("a", 1.0)] and bad.count() == 3


def test_names_and_metadata(spark):
    df = spark.createDataFrame([("f10",), ("F9",), ("f100",)], "n string")
    assert [r["n"] for r in df.orderBy(labels.natural_key(F.col("n"))).collect()] == ["F9", "f10", "f100"]
    got = spark.range(1).select(labels.stringified(F.lit(True), "boolean"), labels.stringified(F.lit(None).cast("int"), "number"), labels.reference(F.lit(0), F.lit(-1)), labels.reference(F.lit(None).cast("long"), F.lit(0))).first()
    assert tuple(got) == ("true", "None", -1, 0)
    parsed = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.5+01:00",), ("2024-01-02T03:04:05",), ("bad",)], "t string").select(F.unix_micros(timing.parsed_start(F.col("t")))).collect()
    assert [r[0] for r in parsed] == [1704164645000000, 1704161045500000, 1704164645000000, None]


def test_documents_keep_empty_frames(spark):
    frames = spark.createDataFrame([(1, 5, 0), (1, 6, 1)], "video_id long, frame long, pos long")
    boxes = spark.createDataFrame([(1, 5, 0, "person", 0.5, 0.0, 0.0, 1.0, 1.0)], "video_id long, frame long, pos long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")
    text = document.documents(frames, boxes).first()["document"]
    assert text.count('"frame"') == 2 and '"objects":[]' in text


def test_live_sessions_close(spark, tmp_path):
    pdf = pd.DataFrame({"track_id": [1, 1, 1, 1], "ts": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:20", "2024-01-01 00:05:00", "2024-01-01 01:00:00"])})
    spark.createDataFrame(pdf).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = clips.live_presence(spark.readStream.schema("track_id long, ts timestamp").parquet(f"{tmp_path}/in"), "60 seconds", "10 seconds")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and not q.exception()
    assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
