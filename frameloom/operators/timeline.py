"""Observations and their runs.

Observations: track_id, frame_idx, and whatever a rule needs. A run is a series of qualifying observations of one key of
which none lies more than gap + 1 frames after the one before; others in between don't break it. Runs need one shuffle,
on the key; rows are numbered within it by frame and a tiebreak, so repeated rows are counted each. A row with a null
frame, or for which the rule's predicate is null, doesn't qualify.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


CORNERS = ("x1", "y1", "x2", "y2")


def tracked(detections: DataFrame) -> DataFrame:
    """Persons with a track, with null confidence as 0, and their corners as bbox: an empty one where one is missing."""
    kept = detections.where((F.col("kind") == "person") & F.col("track_id").isNotNull() & (F.col("track_id") != -1))
    box = F.array(*CORNERS)
    bbox = F.when(F.forall(box, lambda c: c.isNotNull()), box).otherwise(F.array().cast("array<double>"))
    return kept.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "bbox": bbox})


def with_runs(obs: DataFrame, keys: Sequence[str], gap: int, tiebreak: Sequence[str], predicate: Column | None = None) -> DataFrame:
    """Qualifying observations with run, numbered from 1 within the key."""
    rows = obs.where(F.col("frame_idx").isNotNull() & (F.lit(True) if predicate is None else predicate))
    order = Window.partitionBy(*keys).orderBy("frame_idx", *tiebreak)
    before = F.lag("frame_idx").over(order)
    starts = F.when(before.isNull() | (F.col("frame_idx") - before > gap + 1), 1).otherwise(0)
    rows = rows.withColumn("_starts", starts)
    return rows.withColumn("run", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def runs(obs: DataFrame, keys: Sequence[str], gap: int, tiebreak: Sequence[str], predicate: Column | None = None, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """A row for each run: first_frame, last_frame, n and the first and last observation's columns as first_<c>, last_<c>."""
    at = F.struct("frame_idx", *tiebreak)
    picked = [F.min_by(c, at).alias(f"first_{c}") for c in first] + [F.max_by(c, at).alias(f"last_{c}") for c in last]
    grouped = with_runs(obs, keys, gap, tiebreak, predicate).groupBy(*keys, "run")
    return grouped.agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count("*").alias("n"), *picked)
