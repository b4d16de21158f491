"""Sequential operators against plain models of their whole output."""

import itertools

import numpy as np
import pytest

from frameloom.config import TrackerConfig
from frameloom.operators.detections import suppress
from frameloom.operators.evaluation import greedy_pairs
from frameloom.operators.tracking import Tracker, _few_owners, _owners, pairwise_iou, track
from frameloom.operators import detections, evaluation, keyframes
from frameloom.operators.tracking import assignment

BOXES = "frame long, pos long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def boxes(seed, frames=6, most=14):
    """Boxes that overlap a lot, on a coarse grid, so that scores and overlaps tie."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(frames):
        for p in range(int(rng.integers(0, most))):
            x, y = rng.integers(0, 12, 2)
            w, h = rng.integers(1, 8, 2)
            rows.append((f, p, str(rng.choice(["person", "bag"])), float(rng.integers(0, 6)) / 5, float(x), float(y), float(x + w), float(y + h)))
    return rows


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both + 1e-12) if both else 0.0


@pytest.mark.parametrize("least", [0.0, 0.3, 0.6])
def test_suppression(spark, least):
    rows = boxes(1) + [(90, 0, "bag", 0.5, 0.0, 0.0, 0.0, 0.0), (91, 0, None, 0.9, 0.0, 0.0, 1.0, 1.0)]
    want = set()
    for f, c in {(r[0], r[2]) for r in rows if r[2]}:
        kept = []
        for r in sorted((r for r in rows if r[0] == f and r[2] == c and r[3] >= 0.3), key=lambda r: (-r[3], r[1])):
            if all(iou(r[4:], k[4:]) <= least for k in kept):
                kept.append(r)
        want |= set(kept)
    got = [tuple(r) for r in detections.nms(spark.createDataFrame(rows, BOXES), least, 0.3).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("least", [0.0, 0.4])
def test_greedy_matches(spark, least):
    a, b = boxes(2), boxes(3)
    want = []
    for f in {r[0] for r in a} | {r[0] for r in b}:
        left, right = {r[1]: r for r in a if r[0] == f}, {r[1]: r for r in b if r[0] == f}
        pairs = sorted(((-iou(x[4:], y[4:]), i, j) for i, x in left.items() for j, y in right.items() if iou(x[4:], y[4:]) > least))
        for share, i, j in pairs:
            if i in left and j in right:
                want.append((f, i, j, -share))
                del left[i], right[j]
        want += [(f, i, None, None) for i in left] + [(f, None, j, None) for j in right]
    got = evaluation.greedy_match(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES), least).collect()
    close = lambda rows: sorted(((r[0], r[1], r[2], None if r[3] is None or r[3] != r[3] else round(r[3], 9)) for r in map(tuple, rows)), key=str)
    assert close(got) == close(want)


def test_assignment_is_the_cheapest_of_all():
    rng = np.random.default_rng(4)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        for cost in (rng.random((n, m)), rng.integers(0, 3, (n, m)).astype(float), np.ones((n, m))):
            pairs = assignment(cost)
            assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
            wide = cost if n <= m else cost.T
            best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
            assert abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9
    assert assignment(np.zeros((0, 3))) == []


def plain_peaks(x, height, distance, prominence):
    """By the definition: middles of flat tops, the highest of near ones first (of equal ones the later), then how far down
    it is to higher ground on either side."""
    n, tops = len(x), []
    for i in range(1, n - 1):
        for j in range(i, n - 1):
            if len(set(x[i : j + 1])) == 1 and x[i - 1] < x[i] and x[j + 1] < x[i]:
                tops.append((i + j) // 2)
    tops = [p for p in tops if x[p] >= height]
    kept = []
    for p in sorted(tops, key=lambda p: (-x[p], -p)):
        if all(abs(p - k) >= distance for k in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        low = []
        for side in (range(p - 1, -1, -1), range(p + 1, n)):
            least = x[p]
            for i in side:
                if x[i] > x[p]:
                    break
                least = min(least, x[i])
            low.append(least)
        if x[p] - max(low) >= prominence:
            out.append(p)
    return out


def test_peaks(spark):
    rng = np.random.default_rng(6)
    rows, want = [], set()
    for clip in range(30):
        x = rng.integers(0, 5, int(rng.integers(0, 40))) / 4 if clip % 2 else np.round(rng.random(int(rng.integers(1, 40))), 2)
        rows += [(clip, i, float(v)) for i, v in enumerate(x)]
        want |= {(clip, p) for p in plain_peaks(x.tolist(), 0.3, 3, 0.25)}
    got = keyframes.peaks(spark.createDataFrame(rows, "clip long, frame_idx long, value double").repartition(3), "value", 0.3, 3, 0.25).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 30


def test_suppression_takes_all_groups_at_once():
    """Groups side by side keep what each keeps alone, with ties and a large group among small ones."""
    rng = np.random.default_rng(7)
    sizes = [1, 2, 300, 1, 5, 0, 9]
    group = np.repeat(np.arange(len(sizes)), sizes)
    corner = rng.integers(0, 40, (len(group), 2))
    boxes, scores = np.hstack([corner, corner + rng.integers(5, 30, (len(group), 2))]).astype(float), rng.integers(0, 9, len(group)) / 8
    want = []
    for g in range(len(sizes)):
        rest = sorted(np.flatnonzero(group == g).tolist(), key=lambda r: (-scores[r], r))
        while rest:
            want.append(rest[0])
            share = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            size = lambda a: (a[2] - a[0]) * (a[3] - a[1])
            a = boxes[rest[0]]
            rest = [r for r in rest[1:] if share(a, boxes[r]) <= 0.5 * (size(a) + size(boxes[r]) - share(a, boxes[r]))]
    assert sorted(suppress(boxes, scores, 0.5, group).tolist()) == sorted(want)


def test_greedy_pairs_of_all_groups_at_once():
    rng = np.random.default_rng(8)
    group, side = np.repeat(np.arange(40), 9), np.tile([0] * 4 + [1] * 5, 40)
    side[group == 3], side[group == 5] = 0, 1
    corner = rng.integers(0, 6, (len(group), 2)) * 4
    boxes = np.hstack([corner, corner + 12]).astype(float)
    share = pairwise_iou(boxes, boxes)
    want, used = set(), set()
    for s, i, j in sorted((-share[i, j], i, j) for i in np.flatnonzero(side == 0) for j in np.flatnonzero((side == 1) & (group == group[i])) if share[i, j] > 0.1):
        if not {i, j} & used:
            used |= {i, j}
            want.add((int(i), int(j), float(-s)))
    got = greedy_pairs(boxes, side, group, 0.1)
    assert {(int(i), int(j), float(s)) for i, j, s in zip(*got)} == want and len(want) > 100


def test_faces_are_dealt_out(spark, sf_dir):
    """A small file is one task, however much work its rows make."""
    from frameloom.plans import queries

    assert queries.QUERIES["face_geometry"](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_videos_side_by_side_track_as_each_alone(spark):
    """Videos of uneven lengths, frames without detections, scores that tie, and batches of a few rows."""
    rng = np.random.default_rng(11)
    config, rows, want = TrackerConfig(match=0.2, max_age=4), [], {}
    for video in range(7):
        alone = Tracker(config)
        for frame in range(int(rng.integers(5, 40))):
            corner = rng.integers(0, 9, (int(rng.integers(0, 7)), 2)) * 8
            boxes, scores = np.hstack([corner, corner + 40]).astype(float), rng.integers(0, 9, len(corner)) / 8
            ids = alone.frame(boxes, scores)
            want |= {(video, frame * 2, p): int(t) for p, t in enumerate(ids)}
            rows += [(video, frame * 2, p, *map(float, b), float(s)) for p, (b, s) in enumerate(zip(boxes, scores))] or [(video, frame * 2, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, pos long, x1 double, y1 double, x2 double, y2 double, confidence double")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "5")
    try:
        got = track(df.where("pos is not null"), df, config).collect()
    finally:
        spark.conf.set(key, before)
    assert {(r["video_id"], r["frame_idx"], r["pos"]): r["track_id"] for r in got} == want and len(got) == len(want)


def test_few_costs_on_lists_take_the_same_steps():
    rng = np.random.default_rng(12)
    for _ in range(300):
        n = int(rng.integers(1, 6))
        cost = rng.integers(0, 5, (n, n + int(rng.integers(0, 6)))) / 4
        assert _few_owners(cost.tolist()) == _owners(cost).tolist()
