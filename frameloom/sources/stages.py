"""What stages of an analysis leave for the next: detections as JSON, vectors, selected frames, and documents.

A stage's JSON has an array of entries for each frame, and an array of relations under the name of no frame. Whatever can't
be read as such gives no rows; numbers that are missing are null. A video is one text, or several of bounded size with
frames of their own, a file each. A frame's entries, and the relations of a video, must fit a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The name under which relations stand, and the fields of an entry and of a relation.
RELATIONS = "neighborhood"
ENTRY = "kind string, class_name string, bbox array<double>, confidence double, _rid long, track_id long, person_global_id long, user_id long, attributes map<string,string>"
RELATION = "frame string, parent_id long, related_id long, related_kind string, relation string, iou double"
CORNERS = ("x1", "y1", "x2", "y2")
#: Characters at which a video's next text begins.
TEXT = 8 << 20
#: What a row of a stage is before it is text, and the files that a task writes side by side.
FRAME, ENTRIES, LAST = 0, 1, 2
OPEN = 64


def texts(spark: SparkSession, path: str) -> DataFrame:
    """video_id (the name of the folder a file is in) and text of JSON files."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.regexp_extract(F.input_file_name(), r"(?:video_id=)?([^/]+)/[^/]+$", 1).alias("video_id"), F.col("value").alias("text"))


def parts(whole: DataFrame) -> DataFrame:
    """video_id, name and JSON of what stands at the top of each text (video_id, text)."""
    return whole.select("video_id", F.explode(F.from_json("text", "map<string,string>")).alias("name", "json"))


def entries(whole: DataFrame) -> DataFrame:
    """Detections of texts (video_id, text): video_id, frame, pos, kind, class_name, confidence, corners, rid, track_id,
    person_global_id, user_id and attributes. A box without four corners has none."""
    listed = parts(whole).where(F.col("name") != RELATIONS)
    rows = listed.select("video_id", F.col("name").alias("frame"), F.posexplode(F.from_json("json", f"array<struct<{_typed(ENTRY)}>>")).alias("pos", "e"))
    corners = (F.when(F.size("e.bbox") == 4, F.get("e.bbox", F.lit(i))).alias(c) for i, c in enumerate(CORNERS))
    return rows.select("video_id", "frame", F.col("pos").cast("long").alias("pos"), "e.kind", "e.class_name", "e.confidence", *corners, F.col("e._rid").alias("rid"), "e.track_id", "e.person_global_id", "e.user_id", "e.attributes")


def relations(whole: DataFrame) -> DataFrame:
    """Relations of texts (video_id, text): video_id, pos and a relation's fields."""
    listed = parts(whole).where(F.col("name") == RELATIONS)
    return listed.select("video_id", F.posexplode(F.from_json("json", f"array<struct<{_typed(RELATION)}>>")).alias("pos", "r")).select("video_id", F.col("pos").cast("long").alias("pos"), "r.*")


def _typed(fields: str) -> str:
    return ", ".join(":".join(f.strip().split(" ", 1)) for f in fields.replace("map<string,string>", "map<string;string>").split(",")).replace(";", ",")


def _edges(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Places from which on rows are another frame's, or relations, than the row before, without the first."""
    n = len(table)
    last = pc.equal(table["what"], LAST)
    new = np.zeros(max(n - 1, 0), bool)
    for values in (table["video_id"], table["frame"], last) if n > 1 else ():
        a, b = values.slice(1), values.slice(0, n - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        new |= other.to_numpy(zero_copy_only=False) if isinstance(other, pa.Array) else other.to_numpy()
    return np.flatnonzero(new) + 1


def _listed(table: pa.Table) -> tuple[list, list]:
    """Videos and fields of whole frames' rows (video_id, what, frame, pos, e): of those that are named, and relations. Entries
    of one pos are in the order of their texts."""
    what, pos = table["what"].to_numpy(), table["pos"]
    starts = np.concatenate([[0], _edges(table)]).astype(np.int64)
    group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(table)))
    place = pc.fill_null(pos, -1 << 63).to_numpy()
    if ((place[1:] == place[:-1]) & (what[1:] == ENTRIES) & (what[:-1] == ENTRIES) & (group[1:] == group[:-1])).any():
        keys = [(c, "ascending") for c in ("group", "what", "pos", "e")]
        table = table.append_column("group", pa.array(group))
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
    e = table["e"].combine_chunks()
    entry = what == ENTRIES
    offsets = np.concatenate([[0], np.cumsum(np.bincount(group[entry], minlength=len(starts)))])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), e.filter(pa.array(entry)))
    first, kind = e.take(pa.array(starts)), what[starts]
    fields = pc.binary_join_element_wise(first, ": [", pc.binary_join(lists, ", "), "]", "")
    fields, real = pc.if_else(pa.array(kind == LAST), first, fields), pa.array(kind != ENTRIES)
    return table["video_id"].combine_chunks().take(pa.array(starts)).filter(real).to_pylist(), fields.filter(real).to_pylist()


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Videos and fields of rows that come sorted; a frame is held whole."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = _edges(batch)
        joins = not rest or not len(_edges(pa.Table.from_batches([rest[-1].slice(len(rest[-1]) - 1), batch.slice(0, 1)])))
        last = int(edges[-1]) if len(edges) else 0
        if not last and joins:
            rest.append(batch)
            continue
        yield _listed(pa.Table.from_batches([*rest, batch.slice(0, last)]))
        rest = [batch.slice(last)]
    if rest:
        yield _listed(pa.Table.from_batches(rest))


def _bodies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Texts of rows (video_id, what, frame, pos, e) that come sorted: one a video, or several where its fields have more than
    so many characters."""
    video, fields, held, kind = None, [], 0, pa.null()

    def typed() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("video_id").type
            yield batch

    def text() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([video], kind), pa.array(["{" + ", ".join(fields) + "}"])], names=["video_id", "text"])

    for some in _fields(typed()):
        for name, f in zip(*some):
            if fields and (name != video or held + len(f) > size):
                yield text()
                fields, held = [], 0
            video = name
            fields.append(f)
            held += len(f)
    if fields:
        yield text()


def stage_texts(frames: DataFrame, rows: DataFrame, related: DataFrame | None = None, size: int = TEXT) -> DataFrame:
    """video_id and text of a stage, of frames (video_id, frame), entries and relations as they are read; frames without
    entries have an empty array. Frames are in the order of their names; beyond `size` characters a video's next frames are
    another text, and relations are in the last.

    Frames' names and entries go to their video once, as columns, and stream by in order; entries become JSON there."""
    keep = {"ignoreNullFields": "false"}
    entry = [f.strip().split(" ")[0].removeprefix("_") for f in ENTRY.replace("map<string,string>", "map").split(",")]
    held = [c for f in entry for c in (CORNERS if f == "bbox" else (f,))]
    name = F.to_json(F.array("frame"))
    names = frames.where("frame IS NOT NULL").select("video_id", F.lit(FRAME).alias("what"), "frame", name.substr(F.lit(2), F.length(name) - 2).alias("text"))
    both = names.unionByName(rows.where("video_id IS NOT NULL AND frame IS NOT NULL").select("video_id", F.lit(ENTRIES).alias("what"), "frame", "pos", *held), allowMissingColumns=True)
    if related is not None:
        named = F.struct("pos", F.struct(*(f.strip().split(" ")[0] for f in RELATION.split(","))).alias("r"))
        arrays = related.groupBy("video_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(named)), lambda x: x["r"]), keep).alias("relations"))
        all_videos = frames.select("video_id").distinct().join(arrays, "video_id", "left")
        relation = F.concat(F.lit(f'"{RELATIONS}": '), F.coalesce("relations", F.lit("[]")))
        both = both.unionByName(all_videos.select("video_id", F.lit(LAST).alias("what"), F.lit("").alias("frame"), relation.alias("text")), allowMissingColumns=True)
    kind = both.schema["video_id"].dataType.simpleString()
    ordered = both.repartition("video_id").sortWithinPartitions("video_id", F.col("what") == LAST, "frame", "what", "pos")
    bbox = F.when(F.col("x1").isNotNull(), F.array(*CORNERS)).alias("bbox")
    json = F.to_json(F.struct(*(bbox if f == "bbox" else F.col(f).alias("_rid" if f == "rid" else f) for f in entry)), keep)
    e = F.when(F.col("what") == ENTRIES, json).otherwise(F.col("text")).alias("e")
    return ordered.select("video_id", "what", "frame", F.col("pos").cast("long").alias("pos"), e).mapInArrow(lambda batches: _bodies(batches, size), f"video_id {kind}, text string")


def write_texts(whole: DataFrame, path: str) -> None:
    """One folder a video, with a compressed file for each of its texts; also for documents, whose text is `document`. Texts
    are not sorted again for that while a task has up to OPEN videos."""
    text = "text" if "text" in whole.columns else "document"
    conf, key = whole.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(max(OPEN, int(before))))
    try:
        out = whole.select("video_id", F.col(text).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1)
        out.option("compression", "gzip").partitionBy("video_id").text(path)
    finally:
        conf.set(key, before)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (video_id, rid, v) in single precision, in the order of rid within a video's part."""
    rows = vectors.select("video_id", "rid", F.col("v").cast("array<float>").alias("v"))
    rows.repartition("video_id").sortWithinPartitions("video_id", "rid").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("video_id string, rid long, v array<float>").parquet(path)


def write_frames(frames: DataFrame, keys: DataFrame, path: str) -> None:
    """The bytes of selected frames: of frames (clip, frame_idx, content) those that keys (clip, frame_idx) name, once each,
    with the name of a picture, in a part of each clip. A key without its frame gives nothing."""
    picked = frames.join(keys.select("clip", "frame_idx"), ["clip", "frame_idx"], "left_semi")
    named = picked.select("clip", "frame_idx", F.concat(F.lit("frame_"), "frame_idx", F.lit(".jpg")).alias("name"), "content")
    named.repartition("clip").sortWithinPartitions("clip", "frame_idx").write.mode("overwrite").partitionBy("clip").parquet(path)


def clip_stream(spark: SparkSession, folder: str, schema: str, outstanding: int = 10) -> DataFrame:
    """A stream of clips that lie in a folder as one Parquet file each, oldest first: no more than so many are taken up at a
    time, others wait. Which were taken is part of the stream's checkpoint, so a restart loses and repeats none."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", outstanding).parquet(folder)
