"""Comparison of two sets of detections, and of predicted with wanted key frames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.numbers import number, ratio
from frameloom.operators.groups import map_groups
from frameloom.operators.tiles import column
from frameloom.operators.tracking import overlaps


#: Pairs of boxes that are compared at a time; a frame with more is compared as a whole.
PAIRS = 1 << 18


def greedy_pairs(boxes: np.ndarray, side: np.ndarray, group: np.ndarray, least_iou: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of side 0, rows of side 1 and overlaps of the pairs that each group gets from the greatest overlap down; rows come
    by group and side. A pair that both its boxes have as their best of what is left is one of these, so all of them are
    taken at once."""
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    begin, end = (np.searchsorted(group[second], group[first], where) for where in ("left", "right"))
    n = end - begin
    i = np.repeat(first, n)
    j = second[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]
    share = overlaps(boxes[i], boxes[j])
    near = np.flatnonzero(share > least_iou)
    near = near[np.lexsort((j[near], i[near], -share[near]))]
    i, j, share = i[near], j[near], share[near]
    found, place = [], np.empty(len(boxes), np.int64)
    while len(i):
        rows = np.arange(len(i))
        best = np.ones(len(i), bool)
        for x in (i, j):
            # the last that is written stays, which is the first of the order
            place[x[::-1]] = rows[::-1]
            best &= place[x] == rows
        found.append((i[best], j[best], share[best]))
        used = np.zeros(len(boxes), bool)
        used[i[best]] = used[j[best]] = True
        left = ~(used[i] | used[j])
        i, j, share = i[left], j[left], share[left]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(map(np.concatenate, zip(none, *found)))


def greedy_match(a: DataFrame, b: DataFrame, least_iou: float = 0.0) -> DataFrame:
    """frame, a_pos, b_pos and iou of boxes (frame, pos, x1..y2) paired from the greatest overlap down, whatever their
    class; unmatched ones have a null partner. Ties go by a_pos, then b_pos. A frame is one task."""
    columns = ["frame", "pos", "x1", "y1", "x2", "y2"]
    both = a.select(*columns, F.lit(0).alias("side")).unionByName(b.select(*columns, F.lit(1).alias("side")))

    def work(table: pa.Table, group: np.ndarray) -> pa.Table:
        boxes = np.column_stack([column(table, c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")]).astype(float)
        side, parts = column(table, "side").to_numpy(), []
        sizes = np.bincount(group[side == 0], minlength=group[-1] + 1) * np.bincount(group[side == 1], minlength=group[-1] + 1)
        run = (np.cumsum(sizes) // PAIRS)[group]
        for r in np.split(np.arange(len(group)), np.flatnonzero(np.diff(run)) + 1):
            i, j, share = greedy_pairs(boxes[r], side[r], group[r], least_iou)
            parts.append((r[0] + i, r[0] + j, share))
        i, j, share = map(np.concatenate, zip(*parts))
        alone = np.ones(len(group), bool)
        alone[i] = alone[j] = False
        lone = [np.flatnonzero(alone & (side == s)) for s in (0, 1)]
        frame, pos = column(table, "frame").cast(pa.int64()), column(table, "pos").cast(pa.int64())
        none = lambda rows, kind: pa.nulls(len(rows), kind)
        a_pos = pa.concat_arrays([pos.take(pa.array(np.concatenate((i, lone[0])))), none(lone[1], pa.int64())])
        b_pos = pa.concat_arrays([pos.take(pa.array(j)), none(lone[0], pa.int64()), pos.take(pa.array(lone[1]))])
        iou = pa.concat_arrays([pa.array(share), none(np.concatenate(lone), pa.float64())])
        return pa.table({"frame": frame.take(pa.array(np.concatenate((i, *lone)))), "a_pos": a_pos, "b_pos": b_pos, "iou": iou})

    return map_groups(both, ["frame"], ["side", "pos"], work, "frame long, a_pos long, b_pos long, iou double")


def parity(differences: DataFrame, key: str, value: str, limit: float) -> DataFrame:
    """Least, mean and greatest difference and the number over the limit, of each key and, with a null key, of all."""
    parts = [F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("greatest"), F.count_if(F.col(value) > limit).alias("failures"), F.count("*").alias("n")]
    return differences.rollup(key).agg(*parts)


def frame_counts(detections: DataFrame, *more: Column, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """How many persons and objects each frame has, with more aggregates if any; without keys, of all frames."""
    kinds = [F.count_if(F.col("kind") == kind).alias(f"{kind}s") for kind in ("person", "object")]
    return detections.groupBy(*keys).agg(*kinds, *more)


def people_found(labels: DataFrame, key: str = "video_id") -> DataFrame:
    """How many different labels each video has, noise (-1) and nulls left out."""
    return labels.groupBy(key).agg(F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("people"))


def tolerance_match(predicted: DataFrame, wanted: DataFrame, tolerance: int, digits: int | None = None) -> DataFrame:
    """precision, recall and f1 in per cent of key frames (clip, frame) within a tolerance of wanted ones, by clip; rounded to
    so many digits where any are asked for.

    Frames meet by buckets as wide as the tolerance and their neighbours, so the join is an equal one.
    """
    step = tolerance + 1
    near = wanted.select("clip", F.col("frame").alias("target"), F.explode(F.array(*(F.floor(F.col("frame") / step) + d for d in (-1, 0, 1)))).alias("bucket"))
    hit = predicted.withColumn("bucket", F.floor(F.col("frame") / step)).join(near, ["clip", "bucket"]).where(F.abs(F.col("frame") - F.col("target")) <= tolerance)
    found = hit.select("clip", "frame").distinct().groupBy("clip").agg(F.count("*").alias("tp"))
    made = predicted.select("clip", "frame").distinct().groupBy("clip").agg(F.count("*").alias("n_predicted"))
    asked = wanted.select("clip", "frame").distinct().groupBy("clip").agg(F.count("*").alias("n_wanted"))
    df = made.join(asked, "clip", "full").join(found, "clip", "left").na.fill(0)
    p = F.when(F.col("n_predicted") > 0, F.col("tp") / F.col("n_predicted")).otherwise(0.0)
    r = F.when(F.col("n_wanted") > 0, F.col("tp") / F.col("n_wanted")).otherwise(0.0)
    f = F.when(p + r > 0, p * r * 2 / (p + r)).otherwise(0.0)
    shown = lambda x: x if digits is None else F.bround(x, digits)
    return df.select("clip", *(shown(x * 100).alias(n) for n, x in (("precision", p), ("recall", r), ("f1_score", f))))


def stage_times(rows: DataFrame, key: str) -> DataFrame:
    """Total seconds of a stage by key, and seconds a frame, of rows (key, seconds: a number or text, n: frames). What is no
    number counts as 0, and so does the average over no frames."""
    total, n = F.sum(number(F.col("seconds"))), F.sum("n")
    return rows.groupBy(key).agg(total.alias("total"), ratio(total, n).alias("per_frame"))
