"""Files between stages: what is written is read back, odd files give no rows, and clips are taken up a few at a time."""

import json

import numpy as np

from frameloom.sources import stages

ENTRIES = "video_id string, frame string, pos long, kind string, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, rid long, track_id long, person_global_id long, user_id long, attributes map<string,string>"


def test_stage_files_come_back(spark, tmp_path):
    rows = [("v1", "10", 1, "object", "bag", 0.5, 1.0, 2.0, 3.0, 4.0, None, None, None, None, None), ("v1", "10", 0, "person", "person", 0.25, 0.0, 0.0, 9.0, 9.0, 7, -1, 3, 3, {"pose": "sit \"down\""}), ("v2", "é \"x\"", 0, "person", None, None, None, None, None, None, 0, None, None, None, None)]
    frames = spark.createDataFrame([("v1", "10"), ("v1", "9"), ("v2", "é \"x\"")], "video_id string, frame string")
    related = spark.createDataFrame([("v1", 0, "10", 3, 4, "object", "cerca", 0.25)], "video_id string, pos long, frame string, parent_id long, related_id long, related_kind string, relation string, iou double")
    stages.write_texts(stages.stage_texts(frames, spark.createDataFrame(rows, ENTRIES), related), f"{tmp_path}/s")
    whole = stages.texts(spark, f"{tmp_path}/s/*")
    assert sorted(map(str, (tuple(r) for r in stages.entries(whole).collect()))) == sorted(map(str, rows))
    assert [tuple(r) for r in stages.relations(whole).collect()] == [tuple(r) for r in related.collect()]
    text = {r["video_id"]: json.loads(r["text"]) for r in whole.collect()}
    assert list(text["v1"]) == ["10", "9", "neighborhood"] and text["v1"]["9"] == [] and text["v1"]["10"][0]["bbox"] == [0, 0, 9, 9] and text["v2"]["neighborhood"] == []


def test_a_long_stage_is_several_texts(spark, tmp_path):
    """A text is as long as is asked for at most, however long the video is; together they have all frames once, in order."""
    rows = [("v", str(f), p, "person", "person", 0.5, 0.0, 0.0, 1.0, 2.0, p, f, None, None, None) for f in range(100, 140) for p in range(3)]
    frames = spark.createDataFrame([("v", str(f)) for f in range(100, 150)], "video_id string, frame string")
    related = spark.createDataFrame([("v", 0, "110", 3, 4, "object", "cerca", 0.25)], "video_id string, pos long, frame string, parent_id long, related_id long, related_kind string, relation string, iou double")
    stages.write_texts(stages.stage_texts(frames, spark.createDataFrame(rows, ENTRIES), related, size=2000), f"{tmp_path}/s")
    whole = stages.texts(spark, f"{tmp_path}/s/*")
    texts = sorted(r["text"] for r in whole.collect())
    assert len(texts) > 5 and max(map(len, texts)) <= 2300
    assert [n for t in texts for n in json.loads(t)] == [str(f) for f in range(100, 150)] + ["neighborhood"]
    assert sorted(map(str, (tuple(r) for r in stages.entries(whole).collect()))) == sorted(map(str, rows))
    assert stages.relations(whole).count() == 1


def test_stages_take_little_disk(spark, tmp_path):
    """Entries are shuffled once and written compressed; frames that lie across batches, repeated and unnamed ones, and entries
    of one pos are as before, in the order of their texts."""
    rows = [("v", str(f), p // 2, "person", f"c{3 - p}", 0.5, 0.0, 0.0, 1.0, 2.0, p, f, None, None, None) for f in range(100, 200) for p in range(4)]
    rows += [("v", "7", None, "person", c, None, None, None, None, None, None, None, None, None, None) for c in "ba"]
    odd = [("v", "9", 0, *rows[0][3:]), (None, "100", 0, *rows[0][3:]), ("v", None, 0, *rows[0][3:]), ("w", "100", 0, *rows[0][3:])]
    frames = spark.createDataFrame([("v", str(f)) for f in [*range(100, 210), 100, 7, 7]] + [("v", None), ("u", "1")], "video_id string, frame string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        whole = stages.stage_texts(frames, spark.createDataFrame(rows + odd, ENTRIES))
        assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        stages.write_texts(whole, f"{tmp_path}/s")
    finally:
        spark.conf.set(key, before)
    text = {r["video_id"]: r["text"] for r in stages.texts(spark, f"{tmp_path}/s/*").collect()}
    got = json.loads(text["v"])
    assert json.loads(text["u"]) == {"1": []} and sorted(text) == ["u", "v"] and list(got) == [str(f) for f in [*range(100, 210), 7]]
    assert [e["class_name"] for e in got["150"]] == ["c2", "c3", "c0", "c1"] and [e["class_name"] for e in got["7"]] == ["a", "b"] and got["205"] == []
    assert sum(len(v) for v in got.values()) == len(rows)
    files = [f for f in (tmp_path / "s").rglob("part-*")]
    assert len(files) == 2 and sum(f.stat().st_size for f in files) < len(text["v"]) / 4


def test_more_videos_than_files_side_by_side(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "OPEN", 2)
    frames = spark.createDataFrame([(f"v{i}", str(f)) for i in range(30) for f in range(3)], "video_id string, frame string")
    stages.write_texts(stages.stage_texts(frames, spark.createDataFrame([], ENTRIES), size=20), f"{tmp_path}/s")
    found = [(r["video_id"], n) for r in stages.texts(spark, f"{tmp_path}/s/*").collect() for n in json.loads(r["text"])]
    assert sorted(found) == sorted((f"v{i}", str(f)) for i in range(30) for f in range(3))
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) == 0


def test_odd_stage_files(spark):
    texts = [("a", "no json"), ("b", None), ("c", "[]"), ("d", '{"5": [{"kind": "person", "bbox": [1, 2]}, {"bbox": [1, 2, 3, 4.5]}], "6": null, "7": "x"}')]
    got = stages.entries(spark.createDataFrame(texts, "video_id string, text string")).collect()
    assert [(r["video_id"], r["frame"], r["pos"], r["kind"], r["x1"], r["y2"]) for r in sorted(got, key=lambda r: r["pos"])] == [("d", "5", 0, "person", None, None), ("d", "5", 1, None, 1.0, 4.5)]


def test_vectors_and_frames_are_written(spark, tmp_path):
    vectors = spark.createDataFrame([("v", i, [i / 3, 1.0]) for i in (2, 0, 1)] + [("w", 0, None)], "video_id string, rid long, v array<double>")
    stages.write_vectors(vectors, f"{tmp_path}/v")
    got = {(r["video_id"], r["rid"]): r["v"] for r in stages.read_vectors(spark, f"{tmp_path}/v").collect()}
    assert got == {("v", i): [float(np.float32(i / 3)), 1.0] for i in range(3)} | {("w", 0): None}
    frames = spark.createDataFrame([(1, i, bytes([i])) for i in range(5)] + [(2, 0, b"z")], "clip long, frame_idx long, content binary")
    keys = spark.createDataFrame([(1, 3), (1, 3), (2, 0), (2, 9)], "clip long, frame_idx long")
    stages.write_frames(frames, keys, f"{tmp_path}/f")
    assert sorted((r["clip"], r["name"], bytes(r["content"])) for r in spark.read.parquet(f"{tmp_path}/f").collect()) == [(1, "frame_3.jpg", b"\x03"), (2, "frame_0.jpg", b"z")]


def test_clips_are_taken_up_a_few_at_a_time(spark, tmp_path):
    """Twenty-three clips, ten at most in a batch; more come before a restart, which neither loses nor repeats any."""
    def put(first, last):
        for c in range(first, last):
            spark.createDataFrame([(c, i) for i in range(3)], "clip long, frame_idx long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    sizes = []

    def take(batch, number):
        sizes.append(batch.select("clip").distinct().count())
        batch.write.mode("append").parquet(f"{tmp_path}/out")

    put(0, 23)
    for more in (23, 30):
        put(23, more)
        query = stages.clip_stream(spark, f"{tmp_path}/in", "clip long, frame_idx long").writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and not query.exception()
    assert max(sizes) <= 10 and sum(sizes) == 30
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(c, i) for c in range(30) for i in range(3)]
