"""Streams with a state against the same work on the whole, over splits into batches and restarts; the background model
against a plain loop."""

import os

import numpy as np
import pytest

from frameloom.operators import background, identity
from frameloom.streaming import clips, stateful


def fed(spark, parts, schema, work, path):
    """Rows that a stream gives for parts that come one after the other; the query is started anew for each."""
    os.makedirs(f"{path}/in")
    out = work(spark.readStream.schema(schema).parquet(f"{path}/in"))
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/out")
        assert query.awaitTermination(180) and not query.exception(), k
    return [tuple(r) for r in spark.read.parquet(f"{path}/out").collect()]


def cut(rows, edges):
    return [rows[a:b] for a, b in zip([0, *edges], [*edges, len(rows)])]


@pytest.mark.parametrize("edges", [[], [3, 4, 40], [25, 26]])
def test_clips_are_those_of_the_whole(spark, tmp_path, edges):
    """Two cameras in turn, nulls in a column, a rest that fills no clip; frames of a batch in any order."""
    schema = "camera_id long, frame_idx long, note string"
    rows = [(camera, i, None if i % 3 else f"n{i}") for i in range(29) for camera in ((1, 2) if i < 17 else (1,))]
    rng = np.random.default_rng(2)
    parts = [[p[i] for i in rng.permutation(len(p))] for p in cut(rows, edges)]
    got = fed(spark, parts, schema, lambda df: stateful.live_clips(df, "camera_id", ["frame_idx"], 8), tmp_path)
    want = clips.chunked(spark.createDataFrame(rows, schema), "camera_id", ["frame_idx"], 8).select("camera_id", "frame_idx", "note", "clip", "seq").collect()
    assert sorted(got, key=str) == sorted(map(tuple, want), key=str) and len(got) == 24 + 16


def test_clip_sizes():
    assert (stateful.clip_size(5, 30), stateful.clip_size(5, 0), stateful.clip_size(2.5, 25)) == (150, 150, 62) and clips.CLIP_FRAMES == 150


@pytest.mark.parametrize("gray_creates", [True, False])
def test_people_are_those_of_the_whole(spark, tmp_path, gray_creates):
    """Two galleries; what a batch adds is known to the next, after a restart too."""
    schema, rng = "gallery_id long, id long, v array<double>", np.random.default_rng(7)
    x = rng.normal(size=(6, 8))[rng.integers(0, 6, 90)] + rng.normal(size=(90, 8)) * rng.choice([0.05, 0.5], (90, 1))
    rows = [(int(i % 2), i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    rules = {"t_accept": 0.9, "t_reject": 0.7, "gray_creates": gray_creates, "min_sim_add": 0.92, "most": 3}
    got = fed(spark, cut(rows, [10, 55]), schema, lambda df: stateful.live_people(df, **rules), tmp_path)
    want = identity.fold(spark.createDataFrame(rows, schema), **rules).collect()
    close = lambda rs: sorted((*r[:4], None if r[4] is None else round(r[4], 12)) for r in map(tuple, rs))
    assert close(got) == close(want) and len({r[3] for r in got}) >= 3 - gray_creates


FRAMES = "clip long, frame_idx long, pixels array<double>"


def film(seed, frames=60, pixels=12):
    """A scene that flickers in part, drifts and has something pass; one frame is missing."""
    rng = np.random.default_rng(seed)
    scene = rng.uniform(20, 230, pixels)
    scene[pixels // 2 : pixels // 2 + 3] = 90
    rows = []
    for t in range(frames):
        x = scene + rng.normal(0, 1.5, pixels) + 0.05 * t
        x[: pixels // 3] += 60 * (t % 2)
        if 25 <= t < 31:
            x[pixels // 2 : pixels // 2 + 3] = rng.uniform(200, 250)
        rows.append((seed, t, None if t == 40 else np.clip(x, 0, 255).tolist()))
    return rows


def plain_mixture(frames, c=background.MixtureConfig()):
    """The same model pixel by pixel, with lists of components."""
    shares, held = [], None
    for k, frame in enumerate([f for f in frames if f is not None], 1):
        held = [[] for _ in frame] if held is None else held
        rate, front = 1 / min(2 * k, c.history), 0
        for p, x in enumerate(frame):
            modes, covered, known, shade = held[p], 0.0, False, False
            for w, m, v in modes:
                if covered < c.share:
                    known |= (x - m) ** 2 < c.near * v
                    f = x / m if m > 0 else -1
                    shade |= c.darkest <= f <= 1 and (f * m - x) ** 2 < c.near * v * f * f
                covered += w
            front += not known and not shade
            fit = next((i for i, (w, m, v) in enumerate(modes) if (x - m) ** 2 < c.near_new * v), None)
            after = []
            for i, (w, m, v) in enumerate(modes):
                w = (1 - rate) * w - rate * c.prior + (rate if i == fit else 0)
                if i == fit:
                    step, far = rate / w, (x - m) ** 2
                    m, v = m + step * (x - m), min(max(v + step * (far - v), c.variances[0]), c.variances[1])
                if i == fit or w >= rate * c.prior:
                    after.append([w, m, v])
            total = sum(w for w, _, _ in after)
            after = sorted(([w / total, m, v] for w, m, v in after), key=lambda y: -y[0])
            if fit is None:
                after = [[w * (1 - rate), m, v] for w, m, v in after][: c.components - 1 if len(after) == c.components else None]
                after.append([rate if after else 1.0, x, c.first_variance])
                total = sum(w for w, _, _ in after)
                after = sorted(([w / total, m, v] for w, m, v in after), key=lambda y: -y[0])
            held[p] = after
        shares.append(round(front / len(frame), 4))
    return shares


def test_background_is_the_plain_one():
    for seed in range(4):
        frames = [f for _, _, f in film(seed)]
        held, got = None, []
        for f in frames:
            held, share = background.share_of(held, f)
            got.append(share)
            held = held and background.Mixture.unpacked(held.packed())
        assert got[40] is None and [s for s in got if s is not None] == plain_mixture(frames)


def test_flicker_is_background_and_what_passes_is_not(spark):
    rows = film(1, pixels=30)
    got = {r["frame_idx"]: r["share"] for r in background.foreground(spark.createDataFrame(rows, FRAMES), "pixels").collect()}
    assert got[0] == 1 and got[40] is None
    assert max(got[t] for t in range(6, 25)) == 0 and min(got[t] for t in range(25, 28)) >= 0.1
    shadow = [(1, t, [100.0] * 10 if t < 20 else [70.0] * 5 + [240.0] * 5) for t in range(21)]
    assert {r["frame_idx"]: r["share"] for r in background.foreground(spark.createDataFrame(shadow, FRAMES), "pixels").collect()}[20] == 0.5


def test_live_background_is_that_of_the_whole(spark, tmp_path):
    rows = sorted(film(1) + film(2), key=lambda r: r[1])
    got = fed(spark, cut(rows, [2, 31, 81]), FRAMES, stateful.live_foreground, tmp_path)
    want = background.foreground(spark.createDataFrame(rows, FRAMES), "pixels").collect()
    assert sorted(got, key=str) == sorted(map(tuple, want), key=str) and len(got) == 120


def test_frames_of_no_or_another_size(spark):
    rows = [(1, 0, []), (1, 1, [5.0]), (1, 2, [5.0]), (1, 3, [5.0, 6.0]), (None, 1, [1.0]), (2, None, [1.0])]
    got = {(r["clip"], r["frame_idx"]): r["share"] for r in background.foreground(spark.createDataFrame(rows, FRAMES), "pixels").collect()}
    assert got == {(1, 0): 0.0, (1, 1): 1.0, (1, 2): 0.0, (1, 3): 1.0}
