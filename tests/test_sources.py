"""Images, upload requests, live clips and small column functions on cases with known outcomes."""

import json
import math
import struct
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameloom.functions import geometry as geo
from frameloom.functions import labels, timing, vectors
from frameloom.operators import detections, keyframes
from frameloom.sources import images, manifest, store
from frameloom.streaming import clips


def png(width: int, height: int) -> bytes:
    """A black image."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = (b"\0" + b"\0" * 3 * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    folder = tmp_path / "video7"
    folder.mkdir()
    for name, data in (("10.png", png(4, 3)), ("9.png", png(2, 2)), ("a2.jpg", b"no image"), ("notes.txt", b"x"), ("big.PNG", png(1, 1))):
        (folder / name).write_bytes(data)
    listed = images.frames(spark, str(folder))
    assert [(r["video_id"], r["frame"], r["pos"]) for r in listed.orderBy("pos").collect()] == [("video7", "9", 0), ("video7", "10", 1), ("video7", "a2", 2)]
    assert images.frames(spark, str(folder), images.PHOTO_GLOB).count() == 4
    read = images.decoded(spark, str(folder))
    sizes = {r["frame"]: (r["width"], r["height"], r["readable"]) for r in images.with_sizes(listed, read).collect()}
    assert sizes == {"9": (2, 2, True), "10": (4, 3, True), "a2": (None, None, False)}
    photos = spark.createDataFrame([(False, 1.0, 1.0), (True, None, 1.0), (True, 1.0, 0.0), (True, 1.0, 1.0), (True, 1.0, None)], "readable boolean, x1 double, n double")
    # a norm that is not known is no sign of a bad embedding
    assert [r["reason"] for r in images.photo_reasons(photos).collect()] == ["unreadable", "no person", "bad embedding", None, None]


def test_stretches(spark):
    rows = spark.range(100).select(F.col("id").alias("frame_idx"))
    assert [r[0] for r in images.sampled(rows, 10, 3, 1.0, 2.05).orderBy("frame_idx").collect()] == [10, 13, 16, 19]
    with pytest.raises(ValueError, match="positive step"):
        images.sampled(rows, 10, 0, 1, 2)


def test_requests_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"record": {"folder_path": "a/", "timestamp": "t1", "speed_inference": "2"}}, {"record": {"folder_path": " ", "timestamp": "t2"}}, {"other": 1}]
    (tmp_path / "in" / "1.txt").write_text("\n".join(json.dumps(x) for x in lines))
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    query = manifest.process(manifest.stream(spark, f"{tmp_path}/in"), lambda df: df.withColumn("done", F.lit(True)), good, bad, f"{tmp_path}/state")
    query.trigger(availableNow=True).start().awaitTermination(60)
    assert [(r["folder_path"], r["speed"], r["done"], r["batch"]) for r in spark.read.parquet(good).collect()] == [("a/", 2.0, True, 0)]
    assert sorted(r["reason"] for r in spark.read.parquet(bad).collect()) == ["no folder", "no folder"]


def test_first_hand_of_each_side(spark):
    rows = spark.createDataFrame([(1, 1, "Left", 0), (1, 1, "Right", 1), (1, 1, "Left", 2), (1, 2, "Right", 0), (1, 2, None, 1)], "frame long, person_id long, side string, pos long")
    assert sorted((r["person_id"], r["side_ord"], r["pos"]) for r in detections.first_per_side(rows).collect()) == [(1, 0, 1), (1, 1, 0), (2, 0, 0)]


def test_columns(spark):
    one = spark.range(1)
    lit = lambda *x: geo.Box(*(F.lit(float(v)) for v in x))
    assert tuple(one.select(*geo.cropped(lit(-3.7, 2.9, 99.9, 700), 100, 50)).first()) == (0, 2, 99, 50)
    assert tuple(one.select(*geo.from_center(F.lit(10.0), F.lit(20.0), F.lit(4.0), F.lit(6.0))).first()) == (8.0, 17.0, 12.0, 23.0)
    eye = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 1.0), (3.0, 1.0), (4.0, 0.0), (3.0, -1.0), (1.0, -1.0))))
    shut = F.array(*(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")) for _ in range(6)))
    assert tuple(one.select(labels.eye_aspect(eye), labels.eye_aspect(shut)).first()) == (0.5, None)
    a, b, none = (F.array(*(F.lit(float(v)) for v in x)) for x in ((3, 4), (4, 3), (0, 0)))
    got = one.select(vectors.cosine(a, b), vectors.cosine(a, none)).first()
    assert math.isclose(got[0], 0.96) and got[1] is None
    assert one.select(timing.iso_millis(F.lit(1_704_067_200_123_987))).first()[0] == "2024-01-01T00:00:00.123Z"


def test_photos_and_first_sizes(spark, tmp_path):
    """Photos in the plain order of names, capitals first; the size of a folder is that of its first readable image."""
    folder = tmp_path / "ana"
    folder.mkdir()
    for name, data in (("10.png", png(4, 3)), ("9.png", png(2, 2)), ("A.PNG", png(5, 5)), ("0.jpg", b"no image")):
        (folder / name).write_bytes(data)
    assert [r["name"] for r in images.photos(spark, str(folder)).orderBy("pos").collect()] == ["0.jpg", "10.png", "9.png", "A.PNG"]
    sized = images.with_sizes(images.photos(spark, str(folder)), images.decoded(spark, str(folder)))
    assert [tuple(r) for r in images.first_size(sized).collect()] == [("ana", 3, 4, 3)]


def test_published_requests_are_read(spark, tmp_path):
    rows = spark.createDataFrame([("a/", "1.5", 2.0), ("b/", "2", None), (None, "3", 1.0)], "folder_path string, timestamp string, speed_inference double")
    manifest.publish(rows, f"{tmp_path}/in")
    manifest.publish(rows.limit(0), f"{tmp_path}/in")
    good, bad = manifest.requests(spark.read.text(f"{tmp_path}/in"))
    assert sorted((r["folder_path"], r["timestamp"], r["speed"]) for r in good.collect()) == [("a/", "1.5", 2.0), ("b/", "2", 1.0)] and bad.count() == 1


def test_rounded_scales(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 3.0), (2, 5.0)], "clip long, value double")
    got = sorted((r["clip"], r["scaled"]) for r in keyframes.scaled(rows, "value", digits=4).collect())
    assert got == [(1, 0.0), (1, 0.3333), (1, 1.0), (2, 0.0)]
