"""Identities, the gallery's storage, detector outputs and calibrations on cases with known outcomes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from frameloom.functions import labels
from frameloom.operators import calibration, detections, identity, records, tables, tiles
from frameloom.sources import store

BARS = {"t_accept": 0.8, "t_reject": 0.45, "min_sim_add": 0.68, "most": 3}
DETECTIONS = "gallery_id long, frame long, pos long, person_id long, score double, v array<double>, candidates array<struct<person_id:long,sim:double>>"
GALLERY = "gallery_id long, index_row long, person_id long, is_active boolean, v array<double>"


def unit(*x: float) -> list[float]:
    return (np.array(x, float) / np.linalg.norm(x)).tolist()


def resolved(spark, rows, known=(), k=10):
    df = spark.createDataFrame(rows, DETECTIONS)
    gallery = spark.createDataFrame(list(known), GALLERY) if known else None
    return {(r["frame"], r["pos"]): (r["person_id"], r["outcome"]) for r in identity.resolve_duplicates(df, gallery, k=k, **BARS).collect()}


def test_duplicates_take_what_is_free(spark):
    known = [(1, 0, 5, True, unit(1, 0, 0)), (1, 1, 6, True, unit(0, 1, 0)), (1, 2, 7, False, unit(0, 0, 1))]
    rows = [
        (1, 1, 0, 5, 0.5, unit(1, 0, 0), [(9, 0.9)]),  # beaten: its candidate
        (1, 1, 1, 5, 0.9, unit(1, 0, 0), None),  # the best stays
        (1, 1, 2, 5, 0.4, unit(0, 1, 0), [(9, 0.95), (8, 0.1)]),  # 9 is taken, 8 too far: found in the gallery
        (1, 1, 3, 5, 0.3, unit(0, 0, 1), None),  # its person is inactive: far from the rest
        (1, 1, 4, 5, 0.2, None, [(5, 0.99)]),  # 5 is its own group's, and it has no vector
        (1, 1, 5, None, 0.1, unit(1, 0, 0), None),
        (1, 2, 0, 5, 0.5, unit(0, 0, 1), None),  # finds whom the frame before made
        (1, 2, 1, 5, 0.6, unit(0, 0, 1), None),
        (1, 3, 0, 5, 0.5, unit(1, 1, 1), None),  # not far, not near
        (1, 3, 1, 5, 0.5, unit(1, 1, 1), None),
    ]
    assert resolved(spark, rows, known) == {
        (1, 0): (9, "reassigned"), (1, 1): (5, "kept"), (1, 2): (6, "found"), (1, 3): (8, "dup_created"), (1, 4): (None, "none"), (1, 5): (None, "kept"),
        (2, 0): (8, "found"), (2, 1): (5, "kept"), (3, 0): (5, "kept"), (3, 1): (9, "dup_created_gray"),
    }
    assert resolved(spark, [r[:5] + (r[5], None) for r in rows[:2]]) == {(1, 0): (1, "dup_created"), (1, 1): (5, "kept")}
    assert resolved(spark, []) == {}


def test_duplicates_stream_through_their_gallery(spark):
    """Batches of three rows, frames and groups that lie across them, and vectors by id: the same as with vectors in rows, and
    no gallery's frames are brought together as a whole."""
    rng = np.random.default_rng(3)
    found = {i: unit(*rng.normal(size=3)) for i in range(6)}
    rows = [(g, f, p, int(rng.integers(2)), float(rng.integers(3)), int(rng.integers(6)), None) for g in (0, 1) for f in range(12) for p in range(5)]
    want = identity.resolve_duplicates(spark.createDataFrame([(*r[:5], found[r[5]], None) for r in rows], DETECTIONS), **BARS)
    ided = spark.createDataFrame(rows, DETECTIONS.replace("v array<double>", "vector_id long"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        got = identity.resolve_duplicates(ided, vectors=spark.createDataFrame(list(found.items()), "id long, v array<double>"), **BARS)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == len(rows)
        assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def plain_duplicates(rows, known, k):
    """The same rules on lists, a detection at a time."""
    store_ = sorted(([n, p, a, np.array(v)] for _, n, p, a, v in known), key=lambda r: r[0])
    out, nxt = {}, max([r[1] for r in store_], default=0) + 1

    def search(v):
        near = sorted(range(len(store_)), key=lambda i: (-round(float(store_[i][3] @ v), 12), i))[:k]
        return [(store_[i][1], float(store_[i][3] @ v)) for i in near if store_[i][2]]

    for frame in sorted({r[1] for r in rows}):
        people = {}
        for r in sorted((r for r in rows if r[1] == frame), key=lambda r: r[2]):
            out[frame, r[2]] = (r[3], "kept")
            if r[3] is not None:
                people.setdefault(r[3], []).append(r)
        for own, group in people.items():
            taken = {own}
            for r in sorted(group, key=lambda r: -r[4])[1:]:
                pick = next((c for c in r[6] or [] if c[0] not in taken and c[1] >= BARS["t_accept"]), None)
                outcome = "reassigned"
                if pick is None and r[5] is None:
                    out[frame, r[2]] = (None, "none")
                    continue
                if pick is None:
                    v = np.array(r[5])
                    hits = search(v)
                    pick, outcome = next((c for c in hits if c[0] not in taken and c[1] >= BARS["t_accept"]), None), "found"
                    if pick is not None:
                        again = search(v)
                        if again[0][0] == pick[0] and again[0][1] >= BARS["min_sim_add"] and sum(s[1] == pick[0] and s[2] for s in store_) < BARS["most"]:
                            store_.append([len(store_), pick[0], True, v])
                    else:
                        outcome = "dup_created" if not hits or hits[0][1] <= BARS["t_reject"] else "dup_created_gray"
                        pick, nxt = (nxt, 0.0), nxt + 1
                        store_.append([len(store_), pick[0], True, v])
                out[frame, r[2]] = (pick[0], outcome)
                taken.add(pick[0])
    return out


def test_duplicates_are_those_of_plain_lists(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 8))
    vector = lambda: unit(*(middle[rng.integers(6)] + rng.normal(size=8) * 0.6))
    known = [(1, i, int(rng.integers(1, 5)), bool(rng.random() < 0.8), vector()) for i in range(14)]
    rows = [(1, f, p, int(rng.integers(1, 4)) if rng.random() < 0.9 else None, float(rng.random()), vector() if rng.random() < 0.8 else None, [(int(rng.integers(1, 8)), float(rng.random())) for _ in range(2)]) for f in range(40) for p in range(6)]
    for k in (3, 10):
        got, want = resolved(spark, rows, known, k), plain_duplicates(rows, known, k)
        assert got == want and len({o for _, o in got.values()}) >= 5


def test_nearest_prototypes_are_kept(monkeypatch):
    """Among those that come again, are equal, are no numbers or are added in between, the nearest are those of a plain search
    each time; a vector that comes again is compared with nothing twice, and equal prototypes once."""
    monkeypatch.setattr(identity, "BLOCK", 16)
    rng = np.random.default_rng(5)
    for most in (1 << 17, 30):
        monkeypatch.setattr(identity, "NEAREST", most)
        pool = [np.array(unit(*rng.normal(size=6))) for _ in range(80)]
        pool[7] = np.full(6, np.nan)
        held = [(int(rng.integers(9)), bool(rng.random() < 0.8), pool[rng.integers(40)]) for _ in range(70)]
        rows = pd.DataFrame([(i, *h) for i, h in enumerate(held)], columns=["index_row", "person_id", "is_active", "v"])
        near = identity.Nearest(rows.sample(frac=1, random_state=1), 6, 10)
        compared, merge = [], near._merge
        monkeypatch.setattr(near, "_merge", lambda slots, i, j, vectors: (compared.extend((int(slots[a]), int(b)) for a, b in zip(i, j)), merge(slots, i, j, vectors))[1])
        for step in range(60):
            asked = [int(i) for i in rng.permutation(80)[:12]]
            if step % 3:
                near.ask([identity.named(pool[i]) for i in asked], np.stack([pool[i] for i in asked]))
            for i in asked:
                sims = [float((h[2] * pool[i]).sum()) for h in held]
                best = sorted((-s, n) for n, s in enumerate(sims) if np.isfinite(s))[:10]
                assert near.near(identity.named(pool[i]), pool[i]) == [(held[n][0], -s) for s, n in best if held[n][1]]
                if rng.random() < 0.4:
                    held.append((int(rng.integers(9)), True, pool[i]))
                    near.add(held[-1][0], pool[i])
        assert near.used == len({h[2].tobytes() for h in held}) < len(held) == len(near.people)
        assert most == 30 or len(set(compared)) == len(compared)


def test_galleries_are_dealt_evenly(spark):
    """Eight galleries of a size are eight tasks, whatever their numbers hash to; the largest is dealt first."""
    assert sorted(tiles.spread({t: 10 for t in range(8)}, 8).values()) == list(range(8))
    assert tiles.spread({5: 3, -7: 9, 1: 3, 2: 3}, 2) == {-7: 0, 1: 1, 2: 1, 5: 1}
    rows = [(g, 1, p, 1, float(p), unit(1, g), None) for g in range(8) for p in range(3)]
    done = identity.resolve_duplicates(spark.createDataFrame(rows, DETECTIONS), **BARS).where("outcome != 'kept'")
    parts = done.groupBy(F.spark_partition_id()).agg(F.count_distinct("gallery_id").alias("n")).collect()
    assert max(r["n"] for r in parts) == -(-8 // max(spark.sparkContext.defaultParallelism, 4)) and done.count() == 16


def test_gallery_goes_on_where_it_was_left(spark, tmp_path):
    rows = spark.createDataFrame([(7, 1, unit(1, 0)), (7, 2, unit(1, 0.1)), (7, 3, unit(0, 1))], "gallery_id long, id long, v array<double>")
    known = spark.createDataFrame([(7, 0, 41, True, unit(1, 0)), (7, 1, 42, False, unit(0, 1))], GALLERY)
    found = identity.fold(rows, t_accept=0.8, t_reject=0.45, gray_creates=False, min_sim_add=0.68, most=5, gallery=known).orderBy("id").collect()
    assert [(r["person_id"], r["outcome"]) for r in found] == [(41, "matched"), (41, "matched"), (43, "created")]
    folder = str(tmp_path / "gallery")
    assert store.load_gallery(spark, folder, 2).count() == 0
    assert store.save_gallery(known.drop("gallery_id"), folder) == 1
    people, more = identity.create_people(store.load_gallery(spark, folder, 2), spark.createDataFrame([("b", "p1", None, [3.0, 4.0]), ("a", "p2", "face", [0.0, 2.0])], "name string, proto_id string, modality string, v array<double>"), 2)
    assert {(r["name"], r["person_id"]) for r in people.collect()} == {("a", 43), ("b", 44)}
    assert store.save_gallery(more, folder) == 2 and store.versions(spark, folder) == [1, 2]
    got = {r["index_row"]: (r["person_id"], r["modality"], r["is_active"], r["v"]) for r in store.load_gallery(spark, folder, 2).collect()}
    assert got[2][:3] == (43, "face", True) and got[3] == (44, "body", True, pytest.approx([0.6, 0.8])) and len(got) == 4
    assert store.load_gallery(spark, folder, 3).count() == 0
    with pytest.raises(PySparkException, match="needs 3 numbers and has 2"):
        identity.add_prototypes(known.drop("gallery_id"), spark.createDataFrame([(1, "p", "body", [1.0, 2.0])], "person_id long, proto_id string, modality string, v array<double>"), 3).collect()


def test_enrollment_of_vectors_that_cancel_out_is_an_error(spark):
    images = spark.createDataFrame([("gone", unit(1, 0)), ("gone", unit(-1, 0)), ("new", unit(0, 1)), ("known", unit(1, 0)), ("gray", unit(1, 1))], "name string, v array<double>")
    gallery = spark.createDataFrame([(0, 5, True, unit(1, 0))], "index_row long, person_id long, is_active boolean, v array<double>")
    got = {r["name"]: (r["outcome"], r["person_id"]) for r in identity.enroll(images, gallery, t_accept=0.85, t_reject=0.45, k=10).collect()}
    assert got == {"gone": ("error", None), "new": ("create", None), "known": ("match", 5), "gray": ("error", None)}


def test_detector_outputs(spark):
    anchors = [[50.0, 52.0, 200.0], [50.0, 50.0, 200.0], [20.0, 20.0, 10.0], [20.0, 20.0, 10.0], [0.9, 0.8, 0.1], [0.2, 0.1, 0.7]]
    final = [[40.0, 40.0, 60.0, 60.0, 0.9, 1.0], [41.0, 40.0, 60.0, 60.0, 0.8, 1.0], [0.0, 0.0, 9.0, 9.0, 0.1, 0.0]]
    rows = spark.createDataFrame([(1, anchors, 0.5, 10.0, 0.0, 300.0, 500.0), (2, final, 1.0, 0.0, 0.0, 50.0, 500.0), (3, [], 1.0, 0.0, 0.0, 50.0, 50.0)], "frame long, raw array<array<double>>, ratio double, pad_x double, pad_y double, w double, h double")
    got = sorted(tuple(r) for r in detections.decoded(rows, 0.25, 0.45).collect())
    # overlapping anchors of one class are suppressed, final boxes are not; corners go back to the image
    assert got == [(1, 0, 0, 0.9, 60.0, 80.0, 100.0, 120.0), (1, 2, 1, 0.7, 300.0, 390.0, 300.0, 410.0), (2, 0, 1, 0.9, 40.0, 40.0, 50.0, 60.0), (2, 1, 1, 0.8, 41.0, 40.0, 50.0, 60.0)]
    steps = [(n, lambda df, c=n: df.withColumn(c.partition("|")[0], F.lit(1))) for n in ("pose", "emotion|age", "hands")]
    assert detections.apply_steps(rows, detections.gated(steps, {"age": True, "pose": False})).columns[-1] == "emotion"
    assert detections.parsed_names("{0: 'person', 1: 'bicycle'}") == {0: "person", 1: "bicycle"} and detections.parsed_names("{0:") is None and detections.parsed_names(None) is None and detections.parsed_names("[1]") is None


def test_models_lose_no_row_unseen(spark):
    def load():
        def predict(pdf: pd.DataFrame) -> pd.DataFrame:
            if (pdf["id"] == 3).any():
                raise ValueError("bad row")
            return pdf.assign(reason=None)

        return predict

    rows = spark.range(6)
    got = {r["id"]: r["reason"] for r in detections.with_model(rows, load, "id long, reason string", 4, lambda row, e: row.assign(reason=str(e))).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "bad row", 4: None, 5: None}
    with pytest.raises(PySparkException, match="bad row"):
        detections.with_model(rows, load, "id long, reason string", 4).collect()


def test_calibrations(spark):
    m = np.array([[0.01, 0.002, 1.0], [-0.001, 0.012, 2.0], [0.0004, 0.0001, 1.0]])
    rng = np.random.default_rng(1)
    image = rng.uniform(0, 600, (30, 2))
    world = np.column_stack([image, np.ones(30)]) @ m.T
    world = world[:, :2] / world[:, 2:]
    rows = [(1, *a, *b) for a, b in zip(image.tolist(), world.tolist())] + [(1, 100.0, 100.0, 900.0, 900.0), (1, None, 1.0, 1.0, 1.0)]
    rows += [(2, *a, *b) for a, b in zip(image[:3].tolist(), world[:3].tolist())] + [(3, float(k), float(k), 1.0, 2.0) for k in range(5)]
    got = {r["camera_id"]: r for r in calibration.estimate(spark.createDataFrame(rows, "camera_id long, image_x double, image_y double, world_x double, world_y double")).collect()}
    # one pair is far off and is left out of the fit; a null one doesn't count
    assert got[1]["n"] == 31 and np.allclose(np.array(got[1]["homography"]).reshape(3, 3), m, atol=1e-6)
    assert got[2]["homography"] is None and got[2]["reason"] == "fewer than four points" and got[3]["reason"] == "degenerate points"


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k")).repartition(7)
    got = [(r["k"], r["id"]) for r in tables.numbered(df, ["k"], 5).orderBy("id").collect()]
    assert got == [(k, 5 + i) for i, k in enumerate(sorted(k for k, _ in got))]
    assert tables.numbered(df.where("k < 0"), ["k"]).count() == 0


def test_ten_age_groups_have_no_middles(spark):
    scores = lambda n: F.array(*(F.lit(float(i)) for i in range(n)))
    got = spark.range(1).select(*(labels.age_of(scores(n)).alias(f"n{n}") for n in (1, 8, 10, 12, 100, 101))).first()
    assert [got[f"n{n}"]["age"] for n in (1, 8, 10, 12)] == [0, 67, None, 11] and got["n100"]["age"] == 98 and got["n101"]["age"] == 99


def test_nulls_in_records(spark):
    entries = spark.createDataFrame([(1, 0, "person", None, None, None, 2.9, -2.9, None, 7), (1, 1, None, "dog", 0.5, 1.0, 1.0, 1.0, 1.0, 7)], "frame long, pos long, kind string, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, user_id long")
    got = [(r["class_name"], r["x1"], r["y1"], r["x2"], r["y2"], r["user_id"]) for r in records.objects(entries).orderBy("pos").collect()]
    assert got == [("object", 0, 2, -2, 0, 7), ("dog", 1, 1, 1, 1, None)]
