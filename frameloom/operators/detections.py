"""Filters and projections over detections, and rankings within a frame.

Detections: frame, pos, kind, class_name, x1..y2, confidence and what a stage adds. Rankings have a total order: ties go
by pos, as the frame lists them. Rows with null classes or scores fail a filter on them.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.geometry import Box, area, clamped, degenerate, expanded, letterbox, unletterbox
from frameloom.operators.groups import map_groups
from frameloom.operators.tiles import column


def allowed(df: DataFrame, classes: Sequence[str], least: float) -> DataFrame:
    return df.where(F.col("class_name").isin(*classes) & (F.col("confidence") >= least))


def clamp_and_reject(df: DataFrame, w: Column | int, h: Column | int) -> DataFrame:
    """Boxes held within the image; those without an area go."""
    box = clamped(Box.of(), w, h)
    return df.withColumns(dict(zip(("x1", "y1", "x2", "y2"), box))).where(~degenerate(Box.of()))


def split_kind(class_id: Column) -> Column:
    return F.when(class_id == 0, "person").otherwise("object")


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """rid from 0 over embedded persons in the given order: counts before each video's frames, then places within one.

    Ids are dense within a video, so the shuffle is on the video.
    """
    rows = df.where((F.col("kind") == "person") & F.col("embedded"))
    return rows.withColumn("rid", (F.row_number().over(Window.partitionBy("video_id").orderBy(*order)) - 1).cast("long"))


def _first_by(df: DataFrame, keys: Sequence[str], order: list[Column], n: int = 1, name: str = "_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def largest(df: DataFrame, n: int, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """The n largest boxes of each frame, the earlier of equals; rank from 1."""
    return _first_by(df, keys, [F.desc(area(Box.of())), F.col("pos")], name="rank").where(F.col("rank") <= n)


def unique_labels(df: DataFrame) -> DataFrame:
    """Keeps a label for the first of its frame; others and noise become -1, as unique_label."""
    first = F.row_number().over(Window.partitionBy("frame", "label").orderBy("pos"))
    return df.withColumn("unique_label", F.when((F.col("label") >= 0) & (first == 1), F.col("label")).otherwise(-1).cast("long"))


def unique_people(df: DataFrame) -> DataFrame:
    """won: the best of a person's detections in a frame by best_sim, else confidence; the others need another identity."""
    score = F.coalesce("best_sim", "confidence")
    first = F.row_number().over(Window.partitionBy("frame", "person_id").orderBy(F.desc_nulls_last(score), "pos"))
    return df.withColumn("won", F.col("person_id").isNull() | (first == 1))


def pose_gate(df: DataFrame, w: int, h: int, least_share: float, least_conf: float, most: int, unknown: str = "indefinido") -> DataFrame:
    """pose of the largest persons of a frame that are large enough; a label below its bar leaves what was there."""
    ranked = largest(df.where("kind = 'person'"), 2**31 - 1)
    size = area(Box.of())
    seen = (F.col("rank") <= most) & (size > 0) & (size / (F.lit(float(w * h)) + 1e-6) >= least_share)
    before = F.coalesce("action", F.lit(unknown))
    ranked = ranked.withColumn("pose", F.when(seen & (F.col("pose_conf") >= least_conf), F.col("pose_label")).when(seen, before).otherwise(unknown))
    return ranked.withColumn("pose_score", F.when(seen, F.col("pose_conf")).otherwise(0.0))


def append_secondary(df: DataFrame, second: DataFrame, classes: Sequence[str], least: float) -> DataFrame:
    return df.unionByName(allowed(second, classes, least), allowMissingColumns=True)


def first_per_side(hands: DataFrame) -> DataFrame:
    """The first hand of each side; right before left."""
    first = _first_by(hands.where(F.col("side").isin("Right", "Left")), ("frame", "person_id", "side"), [F.col("pos")]).where("_rank = 1")
    return first.withColumn("side_ord", F.when(F.col("side") == "Right", 0).otherwise(1)).drop("_rank")


def suppress(boxes: np.ndarray, scores: np.ndarray, least_iou: float, group: np.ndarray | None = None) -> np.ndarray:
    """Rows kept of boxes in descending order of score: each drops later ones of its group that overlap it by more. All groups,
    numbered from 0, take each step at once."""
    group = np.zeros(len(boxes), np.int64) if group is None else group
    rest = np.lexsort((-scores, group))
    areas = np.maximum(0, boxes[:, 2] - boxes[:, 0]) * np.maximum(0, boxes[:, 3] - boxes[:, 1])
    kept = [rest[:0]]
    while len(rest):
        first = np.append(True, np.diff(group[rest]) != 0)
        kept.append(rest[first])
        i, rest = rest[first][np.cumsum(first)[~first] - 1], rest[~first]
        w = np.minimum(boxes[i, 2], boxes[rest, 2]) - np.maximum(boxes[i, 0], boxes[rest, 0])
        h = np.minimum(boxes[i, 3], boxes[rest, 3]) - np.maximum(boxes[i, 1], boxes[rest, 1])
        both = np.maximum(0, w) * np.maximum(0, h)
        rest = rest[both <= least_iou * (areas[i] + areas[rest] - both)]
    return np.concatenate(kept)


def nms(df: DataFrame, least_iou: float, least: float) -> DataFrame:
    """Non-maximum suppression of each class in each frame; ties of score go by pos. A frame's class must fit a task."""

    def work(table: pa.Table, group: np.ndarray) -> pa.Table:
        boxes = np.column_stack([column(table, c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")]).astype(float)
        return table.take(np.sort(suppress(boxes, column(table, "confidence").to_numpy(zero_copy_only=False).astype(float), least_iou, group)))

    return map_groups(df.where(F.col("confidence") >= least), ["frame", "class_name"], ["pos"], work, df.schema)


def lowres(face: Box, scale: float, w: Column | int, h: Column | int, least: int = 48) -> Column:
    """Whether a face's box, grown and clipped, is too small or has no area."""
    grown = expanded(face, scale, w, h)
    return (grown.x2 - grown.x1 < least) | (grown.y2 - grown.y1 < least)


def decoded(outputs: DataFrame, least: float, least_iou: float) -> DataFrame:
    """Boxes (frame, pos, class_id, confidence, x1..y2, in the image's pixels) of a detector's outputs: frame, raw (rows of
    numbers), ratio, pad_x, pad_y, w, h.

    Rows of six numbers are boxes by corners with score and class, final as they are. Other outputs have a column for each
    anchor: middle, size, and a score for each class, of which the first best counts; those are suppressed by class.
    """
    final = F.size(F.get("raw", F.lit(0))) == 6
    rest = [c for c in ("frame", "ratio", "pad_x", "pad_y", "w", "h")]
    rows = outputs.where(final).select(*rest, F.posexplode("raw").alias("pos", "r"))
    rows = rows.select(*rest, "pos", F.col("r")[5].cast("long").alias("class_id"), F.col("r")[4].alias("confidence"), *(F.col("r")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))
    anchors = outputs.where(~final).select(*rest, "raw", F.explode(F.sequence(F.lit(0), F.size(F.get("raw", F.lit(0))) - 1)).alias("pos"))
    anchors = anchors.withColumn("scores", F.transform(F.expr("slice(raw, 5, size(raw))"), lambda x: F.get(x, F.col("pos"))))
    cx, cy, bw, bh = (F.get(F.col("raw")[i], F.col("pos")) for i in range(4))
    corners = dict(zip(("x1", "y1", "x2", "y2"), (cx - bw / 2, cy - bh / 2, cx + bw / 2, cy + bh / 2)))
    best = F.array_max("scores")
    anchors = anchors.select(*rest, "pos", (F.array_position("scores", best) - 1).alias("class_id"), best.alias("confidence"), *(v.alias(c) for c, v in corners.items()))
    kept = nms(anchors.withColumn("class_name", F.col("class_id").cast("string")), least_iou, least).drop("class_name")
    boxes = rows.where(F.col("confidence") >= least).unionByName(kept)
    back = unletterbox(Box.of(), F.col("ratio"), F.col("pad_x"), F.col("pad_y"), F.col("w"), F.col("h"))
    return boxes.select("frame", F.col("pos").cast("long").alias("pos"), "class_id", "confidence", *(v.alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), back)))


def gated(steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], flags: Mapping[str, bool]) -> list[Callable[[DataFrame], DataFrame]]:
    """The detectors that a run needs, in order: those of which a flag is set; names joined by | need any of them."""
    return [step for name, step in steps if any(flags.get(n, False) for n in name.split("|"))]


def letterboxed(images: DataFrame, size: int, stride: int = 32, batch: Sequence[str] = ("batch",)) -> DataFrame:
    """Images (batch, w, h) with ratio, new_w, new_h, pad_x, pad_y, and the canvas' sides: where all images of a batch have one
    size, the canvas is the least that a stride allows; a mixed batch needs one canvas for all, the whole square."""
    key = F.struct("w", "h")
    w = Window.partitionBy(*batch)
    same = F.min(key).over(w) == F.max(key).over(w)
    tight, whole = letterbox(F.col("w"), F.col("h"), size, stride), letterbox(F.col("w"), F.col("h"), size)
    out = images.withColumn("_same", same)
    out = out.withColumns({k: F.when(F.col("_same"), tight[k]).otherwise(whole[k]) for k in tight}).drop("_same")
    return out.withColumns({"canvas_w": (F.col("new_w") + 2 * F.col("pad_x")).cast("int"), "canvas_h": (F.col("new_h") + 2 * F.col("pad_y")).cast("int")})


def apply_steps(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def parsed_names(text: str | None) -> dict[int, str] | None:
    """Class names of a model's metadata, a Python dictionary as text; None where there is none or it can't be read."""
    try:
        return {int(k): v for k, v in ast.literal_eval(text).items()} if text else None
    except (ValueError, SyntaxError, AttributeError, TypeError):
        return None


def with_model(df: DataFrame, load, schema: str, batch: int = 16, failed: Callable[[pd.DataFrame, Exception], pd.DataFrame] | None = None) -> DataFrame:
    """Applies a model to rows in batches: load() gives, once a worker, a function from a pandas frame to a pandas frame.

    A batch on which it fails is tried again row by row. A row on which it fails alone becomes what `failed` makes of it and
    the error, such as a row with the reason; without `failed` the error is raised, so that no row is lost unseen.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    yield predict(part)
                except Exception:
                    for i in range(len(part)):
                        row = part.iloc[i : i + 1]
                        try:
                            yield predict(row)
                        except Exception as e:
                            if failed is None:
                                raise
                            yield failed(row, e)

    return df.mapInPandas(run, schema)
