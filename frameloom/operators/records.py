"""Rows of the relational store from detections, events and relations.

Missing corners count as 0, corners are cut to whole pixels toward zero, and only persons have a user. A relation or event
that names a frame out of range keeps a null frame, or is left out where the store needs one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.numbers import whole
from frameloom.functions.timing import frame_micros, iso_millis
from frameloom.operators.document import at_position, resolve
from frameloom.operators.tables import numbered

CORNERS = ("x1", "y1", "x2", "y2")
#: Frames of this name hold relations and no detections.
PSEUDO = "neighborhood"


def entries(detections: DataFrame) -> DataFrame:
    """Detections as entries of a frame: nothing is known of attributes, track and identity yet, and an embedded one is
    referred to by its rid."""
    none = lambda t: F.lit(None).cast(t)
    return detections.withColumns({"attributes": none("map<string,string>"), "track_id": none("long"), "person_global_id": none("long"), "user_id": F.col("rid")})


def objects(rows: DataFrame) -> DataFrame:
    """Entries (frame, pos, kind, class_name, confidence, x1..y2, user_id) as a document's objects."""
    cut = {c: F.coalesce(whole(F.col(c)), F.lit(0)) for c in CORNERS}
    user = F.when(F.col("kind") == "person", F.col("user_id"))
    return rows.withColumns({**cut, "class_name": F.coalesce("class_name", F.lit("object")), "confidence": F.col("confidence").cast("double"), "user_id": user})


def object_rows(listed: DataFrame, frames: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the table object, of objects by frame, key frames (frame, key_frame_id) and classes (class_name, id)."""
    named = listed.join(frames.select("frame", "key_frame_id"), "frame").join(classes.select("class_name", F.col("id").alias("object_class_id")), "class_name")
    return named.select("key_frame_id", "pos", "object_class_id", "confidence", *CORNERS, "user_id")


def event_rows(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Events (video_id, position, details, ...) with their key frame, null out of range; missing details are {}."""
    linked = at_position(events, frames, F.col("position"))
    return linked.withColumn("details", F.coalesce("details", F.lit("{}")))


def event_documents(events: DataFrame) -> DataFrame:
    """A JSON text (document) for each event, with null fields."""
    details = F.struct("zone_name", "observation_count", "dwell_seconds").alias("details")
    when = [iso_millis(F.col(c)).alias(n) for c, n in (("started_us", "started_at"), ("ended_us", "ended_at"))]
    return events.select(F.to_json(F.struct("event_type", "zone_id", F.col("person_id").alias("person_global_id"), "track_id", *when, F.col("first_frame").alias("first_frame_idx"), details), {"ignoreNullFields": "false"}).alias("document"))


def frame_relations(relations: DataFrame, listed: DataFrame) -> DataFrame:
    """Relations (frame, related_ref, parent_ref, ...) of frames with the objects that they refer to (frame, pos, object_id,
    user_id): null where a reference leads nowhere. Missing texts are empty."""
    out = resolve(relations, listed, "related_ref").withColumnRenamed("object_id", "related_object_id")
    out = resolve(out, listed, "parent_ref").withColumnRenamed("object_id", "parent_object_id")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("relation", "markdown") if c in out.columns})


def video_relations(relations: DataFrame, frames: DataFrame) -> DataFrame:
    """Relations of a video, which name a frame by its place from 1 (position, a text or number), with the frame (video_id,
    pos, frame); those without such a place, or out of range, are left out."""
    place = whole(F.col("position"))
    keyed = frames.select(F.col("video_id").alias("_video"), F.col("pos").alias("_pos"), "frame")
    return relations.join(keyed, (F.col("video_id") == F.col("_video")) & (place - 1 == F.col("_pos")) & (place > 0)).drop("_video", "_pos")


def frame_records(frames: DataFrame, start_us: int, fps: float) -> DataFrame:
    """Key frames of a video (video_id, frame): their place by the name's letters, and their time; a name that is no number
    has the start."""
    kept = frames.where(~F.col("frame").contains(PSEUDO))
    start = F.lit(start_us).cast("long")
    time = F.coalesce(frame_micros(start, F.col("frame").try_cast("long"), fps), start)
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("frame")) - 1
    return kept.withColumn("pos", place.cast("long")).withColumn("us", time)


def metadata_rows(shredded: DataFrame, start: int = 1) -> DataFrame:
    """Rows of attribute trees (object_id, path, parent_path, ...) with ids in the order of the trees, and their parents'."""
    rows = numbered(shredded, ["object_id", "path"], start)
    parents = rows.select(F.col("object_id").alias("_object"), F.col("path").alias("_path"), F.col("id").alias("metadata_id"))
    out = rows.join(parents, (F.col("object_id") == F.col("_object")) & (F.col("parent_path") == F.col("_path")), "left")
    return out.select("id", "object_id", "metadata_id", "name", "data_type", "value")


#: Letters of the parts by which names are found in others.
GRAM = 5


def containing(words: DataFrame, names: DataFrame) -> DataFrame:
    """(folder, word, name and names' other columns) for words (folder, word) and names (folder, stem, ...) that contain them.

    Names are indexed by their parts of up to GRAM letters, of the lengths that are asked for. A word is looked up by the one
    of its parts that the fewest names of its folder have, and what that finds is compared in full. An empty word is in
    no part and finds nothing here. Parts are many times the names, which no estimate of sizes sees, so joins with them are
    never by broadcast, and names are dealt out before they are taken apart."""
    asked = words.where("word <> ''").withColumn("size", F.least(F.length("word"), F.lit(GRAM)))
    sizes = [r["size"] for r in asked.select("size").distinct().collect()]
    if not sizes:
        return words.limit(0).join(names, "folder")
    grams = lambda text, size: F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(F.col(text), i, size))
    parts = F.flatten(F.array(*(F.when(F.length("stem") >= n, grams("stem", F.lit(n))).otherwise(F.array().cast("array<string>")) for n in sorted(sizes))))
    index = names.repartition("folder", "stem").withColumn("gram", F.explode(F.array_distinct(parts)))
    held = index.groupBy("folder", "gram").agg(F.count("*").alias("names"))
    own = asked.withColumn("gram", F.explode(F.array_distinct(grams("word", F.col("size")))))
    # a part that no name has rules the word out
    counted = own.join(held.hint("merge"), ["folder", "gram"], "left")
    rarest = counted.groupBy("folder", "word").agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(index.hint("merge"), ["folder", "gram"]).where(F.contains("stem", "word")).drop("gram")


def image_paths(frames: DataFrame, files: DataFrame, endings: tuple[str, ...] = (".jpg", ".png", ".jpeg", ".bmp", ".webp")) -> DataFrame:
    """path of each frame's image (folder, frame) among files (folder, name): the frame's name with the first ending there
    is, else the first file that has the frame in its name, else null. Only frames without their own file are looked up
    among the names of their folder, by an index of parts of names."""
    order = F.array(*map(F.lit, endings))
    known = files.withColumn("ending", F.regexp_extract("name", r"(\.[^.]+)$", 1)).withColumn("place", F.array_position(order, F.col("ending"))).where("place > 0")
    known = known.withColumn("stem", F.expr("substring(name, 1, length(name) - length(ending))"))
    first = F.min_by("name", F.struct("place", "name"))
    exact = known.groupBy("folder", "stem").agg(first.alias("path"))
    out = frames.join(exact.hint("merge"), (frames["folder"] == exact["folder"]) & (frames["frame"] == exact["stem"]), "left").select(frames["folder"], frames["frame"], "path")
    rest = out.where("path is null").select("folder", F.col("frame").alias("word")).distinct()
    found = containing(rest, known.select("folder", "stem", "place", "name"))
    near = found.groupBy("folder", F.col("word").alias("frame")).agg(first.alias("near"))
    # an empty frame is in every name
    near = near.unionByName(known.groupBy("folder").agg(first.alias("near")).select("folder", F.lit("").alias("frame"), "near"))
    return out.join(near.hint("merge"), ["folder", "frame"], "left").select("folder", "frame", F.coalesce("path", "near").alias("path"))


def upload_manifest(images: DataFrame) -> DataFrame:
    """The manifest's row of each upload (timestamp, name, speed_inference): the folder, named by the time without its
    fraction, and how many images it has."""
    folder = F.concat(F.substring_index("timestamp", ".", 1), F.lit("/"))
    return images.groupBy(folder.alias("folder_path"), "timestamp", "speed_inference").agg(F.count("*").alias("images"))
