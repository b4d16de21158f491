"""The nested document of a video, and its rows in tables.

Positions are columns, so nothing hangs on the order of rows. Ids are given by place within a video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.labels import box_label, stringified
from frameloom.operators.tables import materialize


def node(name: str, kind: str, value: Column | None = None, children: Column | None = None) -> Column:
    """A node of an attribute tree; an object has children, another kind a value."""
    leaf = "array<struct<name:string,data_type:string,value:string>>"
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(kind).alias("data_type"),
        (stringified(value, kind) if value is not None else F.lit(None).cast("string")).alias("value"),
        (children.cast(leaf) if children is not None else F.array().cast(leaf)).alias("children"),
    )


def leaf(name: str, kind: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("data_type"), stringified(value, kind).alias("value"))


def place_key(i: Column) -> Column:
    """A place from 0 as a text whose order is that of the number: four digits, and ten after a mark beyond these."""
    return F.when(i < 10_000, F.format_string("%04d", i)).otherwise(F.format_string("~%010d", i))


#: A node of an attribute tree as JSON; its children are texts again.
NODE = "name string, data_type string, value string, children array<string>"


def shred(objects: DataFrame, deepest: int = 10_000) -> DataFrame:
    """Rows of attribute trees (object_id, metadata: an array of nodes, or its JSON text) of any depth: object_id, path, parent
    path, name, data_type and value. Paths sort in the order of the tree, each node ahead of what is below it.

    Trees are taken apart level by level; each level is written once, and only whether there is a next one reaches the
    driver. Missing or malformed metadata and children give no rows; a tree deeper than `deepest` is an error."""
    kind = dict(objects.dtypes)["metadata"]
    text = F.col("metadata") if kind == "string" else F.to_json("metadata", {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    level = objects.select("object_id", none.alias("parent_path"), F.posexplode(F.from_json(text, "array<string>")).alias("i", "node"))
    out = []
    for depth in range(deepest + 1):
        key = place_key(F.col("i"))
        path = F.when(F.col("parent_path").isNull(), key).otherwise(F.concat("parent_path", F.lit("."), key))
        parsed = level.where(F.col("node").isNotNull()).select("object_id", path.alias("path"), "parent_path", F.from_json("node", NODE).alias("n"))
        rows = materialize(parsed.select("object_id", "path", "parent_path", "n.name", "n.data_type", "n.value", "n.children"), "level")
        if depth and rows.isEmpty():
            break
        out.append(rows.drop("children"))
        level = rows.select("object_id", F.col("path").alias("parent_path"), F.posexplode("children").alias("i", "node"))
    else:
        raise ValueError(f"a tree is deeper than {deepest}")
    whole = out[0]
    for rows in out[1:]:
        whole = whole.unionByName(rows)
    return whole


def _tree_rows(df: DataFrame, slots: list[tuple[str, str, str, Column | None, Column]]) -> DataFrame:
    """Rows of a tree whose nodes have fixed places: (path, name, kind, value, whether it is there); a node's parent is the
    path without its last part."""
    made = []
    for path, name, kind, value, there in slots:
        parent = F.lit(path.rpartition(".")[0] or None).cast("string")
        text = F.lit(None).cast("string") if value is None else stringified(value, kind)
        made.append(F.when(there, F.struct(F.lit(path).alias("path"), parent.alias("parent_path"), F.lit(name).alias("name"), F.lit(kind).alias("data_type"), text.alias("value"))))
    return df.select("object_id", F.explode(F.array_compact(F.array(*made))).alias("r")).select("object_id", "r.*")


def face_rows(objects: DataFrame) -> DataFrame:
    """Rows of the attribute tree of faces: object_id, face (attention: a struct of attention; mouth: of state and ratio;
    emotion: of label and confidence; age, age_confidence, adult). What is null has no node, but the face itself has one, and
    an age has its confidence before it."""
    at = lambda name: F.col(f"face.{name}")
    has = lambda name: at(name).isNotNull()
    return _tree_rows(
        objects,
        [
            ("00", "face", "object", None, F.lit(True)),
            ("00.00", "attention", "object", None, has("attention")),
            ("00.00.00", "attention", "string", at("attention.attention"), has("attention.attention")),
            ("00.01", "mouth", "object", None, has("mouth")),
            ("00.01.00", "state", "string", at("mouth.state"), has("mouth.state")),
            ("00.01.01", "ratio", "float", at("mouth.ratio"), has("mouth.ratio")),
            ("00.02", "emotion", "object", None, has("emotion")),
            ("00.02.00", "label", "string", at("emotion.label"), has("emotion.label")),
            ("00.02.01", "confidence", "float", at("emotion.confidence"), has("emotion.confidence")),
            ("00.03", "age", "object", None, has("age")),
            ("00.03.00", "confidence", "float", at("age_confidence"), has("age") & has("age_confidence")),
            ("00.03.01", "age", "integer", at("age"), has("age")),
            ("00.04", "adult", "boolean", at("adult"), has("adult")),
        ],
    )


def hand_rows(objects: DataFrame) -> DataFrame:
    """Rows of the attribute tree of hands: object_id, hands (an array of hand and gesture); the first of each side counts,
    the right one before the left."""
    side = lambda name: F.get(F.filter("hands", lambda h: h["hand"] == name), F.lit(0))
    sides = objects.select("object_id", side("Right").alias("right"), side("Left").alias("left"))
    there = {c: F.col(c).isNotNull() for c in ("right", "left")}
    return _tree_rows(
        sides,
        [
            ("00", "hands", "object", None, F.lit(True)),
            ("00.00", "Right", "object", None, there["right"]),
            ("00.00.00", "gesture", "string", F.col("right.gesture"), there["right"]),
            ("00.01", "Left", "object", None, there["left"]),
            ("00.01.00", "gesture", "string", F.col("left.gesture"), there["left"]),
        ],
    )


def at_position(rows: DataFrame, frames: DataFrame, position: Column) -> DataFrame:
    """rows with the key_frame_id of the frame (video_id, pos, key_frame_id) at a place of their video; out of range: null."""
    keyed = frames.select(F.col("video_id").alias("_video"), F.col("pos").alias("_pos"), "key_frame_id")
    return rows.join(keyed, (F.col("video_id") == F.col("_video")) & (position == F.col("_pos")), "left").drop("_video", "_pos")


def resolve(rows: DataFrame, objects: DataFrame, ref: str) -> DataFrame:
    """rows (frame, ref) with object_id: that of the frame's last object of such a user, else the one at that place from 0,
    else the one at that place from 1; objects: frame, pos, object_id, user_id. Three equal joins."""
    users = objects.where("user_id is not null").groupBy(F.col("frame").alias("_uf"), F.col("user_id").alias("_u")).agg(F.max_by("object_id", "pos").alias("_by_user"))
    zero = objects.select(F.col("frame").alias("_zf"), F.col("pos").alias("_z"), F.col("object_id").alias("_by_zero"))
    one = objects.select(F.col("frame").alias("_of"), (F.col("pos") + 1).alias("_o"), F.col("object_id").alias("_by_one"))
    out = rows.join(users, (F.col("frame") == F.col("_uf")) & (F.col(ref) == F.col("_u")), "left")
    out = out.join(zero, (F.col("frame") == F.col("_zf")) & (F.col(ref) == F.col("_z")), "left")
    out = out.join(one, (F.col("frame") == F.col("_of")) & (F.col(ref) == F.col("_o")), "left")
    return out.withColumn("object_id", F.coalesce("_by_user", "_by_zero", "_by_one")).drop("_uf", "_u", "_zf", "_z", "_of", "_o", "_by_user", "_by_zero", "_by_one")


def documents(frames: DataFrame, objects: DataFrame) -> DataFrame:
    """video_id and document: key frames in order, each with its objects in order; frames without objects have none.

    A video's document must fit a row.
    """
    listed = objects.groupBy("video_id", "frame").agg(F.sort_array(F.collect_list(F.struct("pos", "class_name", "confidence", "x1", "y1", "x2", "y2"))).alias("objects"))
    held = frames.join(listed, ["video_id", "frame"], "left")
    empty = F.array().cast(listed.schema["objects"].dataType)
    rows = held.withColumn("objects", F.coalesce("objects", empty))
    return rows.groupBy("video_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("pos", "frame", "objects")))).alias("document"))


def review_manifest(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per frame its overview and boxes with their crops' names; frames without boxes stay, with none."""
    label = box_label(F.col("class_name"), F.col("confidence"))
    crop = F.format_string("box_%03d_%s.jpg", F.col("pos").cast("int"), F.regexp_replace("class_name", r"\s+", "_"))
    listed = boxes.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("pos", label.alias("label"), crop.alias("crop")))).alias("boxes"))
    return frames.join(listed, "frame", "left").withColumn("overview", F.concat(F.col("frame").cast("string"), F.lit("_overview.jpg"))).withColumn("n_boxes", F.coalesce(F.size("boxes"), F.lit(0)))
