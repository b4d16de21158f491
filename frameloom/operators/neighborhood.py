"""Spatial relations between the people and objects of a frame.

Pairs meet by frame, so a frame's rows must fit a task; the tests are part of the join and pairs that fail them are never
written out. Rows with a null frame meet nothing. Distances are scaled by the size of the first box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.geometry import Box, area, bearing, center, diagonal, height, iou, overlap, width
from frameloom.functions.labels import OVERLAPS, relations, sentence


def offsets(a: Box, b: Box) -> tuple[Column, Column]:
    (ax, ay), (bx, by) = center(a), center(b)
    return (bx - ax) / F.greatest(F.lit(1e-6), width(a)), (by - ay) / F.greatest(F.lit(1e-6), height(a))


def person_object(people: DataFrame, objects: DataFrame, min_iou: float = 0.01, near: float = 0.15) -> DataFrame:
    """Pairs (frame, p_id, o_id) that stand in a relation or overlap."""
    p, o = Box.of(alias="p"), Box.of(alias="o")
    nx, ny = offsets(p, o)
    words = relations(nx, ny, near)
    joined = people.alias("p").join(objects.alias("o"), (F.col("p.frame") == F.col("o.frame")) & ((F.size(words) > 0) | (iou(p, o) >= min_iou)))
    named = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(OVERLAPS)))
    return joined.select(
        F.col("p.frame").alias("frame"), F.col("p.id").alias("p_id"), F.col("o.id").alias("o_id"),
        F.array_join(named, ",").alias("relation"), iou(p, o).alias("intersection"), nx.alias("x_alignment"), ny.alias("y_alignment"),
        F.array_join(named, " y ").alias("phrase"),
    )


def person_person(people: DataFrame, near: float = 0.15) -> DataFrame:
    """Pairs (frame, p_id, q_id) of the earlier with the later person that stand in a relation; overlap alone is none."""
    a, b = Box.of(alias="a"), Box.of(alias="b")
    nx, ny = offsets(a, b)
    words = relations(nx, ny, near)
    joined = people.alias("a").join(people.alias("b"), (F.col("a.frame") == F.col("b.frame")) & (F.col("a.pos") < F.col("b.pos")) & (F.size(words) > 0))
    return joined.select(
        F.col("a.frame").alias("frame"), F.col("a.id").alias("p_id"), F.col("b.id").alias("q_id"),
        F.array_join(words, ",").alias("relation"), F.lit(None).cast("double").alias("intersection"), nx.alias("x_alignment"), ny.alias("y_alignment"),
        F.array_join(words, " y ").alias("phrase"),
    )


def stored(found: DataFrame, other: Column, places: int = 4) -> DataFrame:
    """Relations as they are stored: numbers rounded, and the sentence that says them; other: what the second one is called."""
    rounded = {c: F.round(c, places) for c in ("intersection", "x_alignment", "y_alignment")}
    return found.withColumn("markdown", sentence(F.col("p_id"), F.col("phrase"), other)).withColumns(rounded).drop("phrase")


def sides(a: Box, b: Box) -> tuple[Column, Column, Column, Column]:
    """Distance, bearing, and the side by the longer of the two offsets, of a as seen from b."""
    (ax, ay), (bx, by) = center(a), center(b)
    dx, dy = ax - bx, ay - by
    across = F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "right_of").otherwise("left_of"))
    along = F.when(F.abs(dy) > F.abs(dx), F.when(dy > 0, "below").otherwise("above"))
    return F.hypot(dx, dy), bearing(dx, dy), across, along


def image_relations(people: DataFrame, others: DataFrame, kind: str, factor: float = 0.8) -> DataFrame:
    """Every pair of a person with an object (kind "object"), or with another person, of an image, with distance, bearing
    and relations."""
    p, o = Box.of(alias="p"), Box.of(alias="o")
    far, angle, across, along = sides(p, o)
    union = area(p) + area(o) - overlap(p, o)
    share = F.when(union > 0, overlap(p, o) / union).otherwise(0.0)
    if kind == "object":
        words = F.array(F.when(far < diagonal(p) * factor, "near"), across, along, F.when(share > 0.05, "overlap"))
        apart = F.lit(True)
    else:
        words = F.array(F.when(far < (diagonal(p) + diagonal(o)) / 2 * factor, "near_person"), across, along)
        apart = F.col("p.id") != F.col("o.id")
    joined = people.alias("p").join(others.alias("o"), (F.col("p.frame") == F.col("o.frame")) & apart)
    return joined.select(
        F.col("p.frame").alias("frame"), F.col("p.id").alias("p_id"), F.col("o.id").alias("o_id"), F.array_join(F.array_compact(words), ",").alias("relation"),
        far.alias("distance"), angle.alias("angle_deg"), (share if kind == "object" else F.lit(None).cast("double")).alias("iou"),
    )


def relation_rows(found: DataFrame) -> DataFrame:
    """Image relations as stored rows: none without a relation, no overlap as null, the bearing as a share of a half turn."""
    return found.where("relation != ''").withColumn("intersection", F.nullif("iou", F.lit(0.0))).withColumn("x_alignment", F.col("angle_deg") / 180)
