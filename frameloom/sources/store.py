"""The relational store: tables of a video's analysis as Parquet, each batch of rows added once, whatever fails (see ledger)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators.tables import numbered
from frameloom.sources.ledger import Commit, Ledger

POINT, BOX = "struct<x:double,y:double>", "struct<x1:double,y1:double,x2:double,y2:double>"
#: Columns of the tables; ids are given before writing, or by the store where rows are inserted without.
TABLES = {
    "project": "id long, name string, bucket string, created_at timestamp",
    "camera": "id long, project_id long, name string, description string, installed_at timestamp, video_duration interval day to second, created_at timestamp",
    "video": "id long, camera_id long, key string, start_at timestamp, created_at timestamp",
    "key_frame": f"id long, video_id long, timestamp timestamp, size {POINT}, inference double, preprocess double, postprocess double",
    "object_class": "id long, name string",
    "object": f"id long, key_frame_id long, object_class_id long, confidence double, shape {BOX}, user_id long",
    "metadata": "id long, object_id long, metadata_id long, name string, data_type string, value string",
    "neighborhood": "id long, key_frame_id long, related_object_id long, intersection double, x_alignment double, y_alignment double, relation string, markdown string, parent_object_id long",
    "camera_calibration": "id long, camera_id long, homography array<double>, units string, reference_points string, reprojection_error double, is_active boolean",
    "zone": f"id long, camera_id long, name string, zone_type string, polygon array<{POINT}>, schedule string, is_active boolean",
    "authorized_identity": "person_global_id long, display_name string, role string, is_active boolean, enrolled_at timestamp, notes string",
    "event": "id long, video_id long, camera_id long, zone_id long, key_frame_id long, event_type string, person_global_id long, track_id long, started_at timestamp, ended_at timestamp, confidence double, details string",
}
GALLERY = "index_row long, person_id long, proto_id string, modality string, is_active boolean, v array<double>"


def create(spark: SparkSession, folder: str) -> None:
    """Makes each table that is not there yet."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}/data/part=none")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of committed parts; those that were inserted without ids have them by their place in the order of commits."""
    commits = Ledger(spark, f"{folder}/{name}").commits()
    rows = spark.read.schema(f"{TABLES[name]}, nth long, part string").parquet(f"{folder}/{name}/data")
    starts = spark.createDataFrame([(c.part, c.start) for c in commits], "part string, _start long")
    # as many rows as commits
    placed = rows.join(F.broadcast(starts), "part")
    columns = spark.createDataFrame([], TABLES[name]).columns
    if "id" in columns:
        placed = placed.withColumn("id", F.coalesce("id", F.col("_start") + F.col("nth")))
    return placed.select(*columns)


def append(df: DataFrame, folder: str, name: str, batch: str | None = None) -> Commit:
    """Adds rows that have their ids, with the table's columns in its order and null for those that are missing. A batch
    that was added before is not added again."""
    return _commit(df, folder, name, batch)


def insert(df: DataFrame, folder: str, name: str, order: Sequence[str], batch: str | None = None) -> DataFrame:
    """Adds rows without ids and gives them back with their ids, which follow on in the order that is named; a batch that was
    inserted before gets the ids that it has. Ids are dense, start at 1, and no two writers get the same."""
    spark = df.sparkSession
    commit = _commit(numbered(df.drop("id"), order, 1, "nth"), folder, name, batch)
    part = spark.read.parquet(f"{folder}/{name}/data/part={commit.part}")
    return part.withColumn("id", F.lit(commit.start) + F.col("nth")).drop("nth")


def _commit(df: DataFrame, folder: str, name: str, batch: str | None) -> Commit:
    columns = df.sparkSession.createDataFrame([], f"{TABLES[name]}, nth long")

    def write(part: str) -> int:
        columns.unionByName(df, allowMissingColumns=True).select(*columns.columns).write.parquet(part)
        return df.sparkSession.read.schema(columns.schema).parquet(part).count()

    return Ledger(df.sparkSession, f"{folder}/{name}").commit(write, batch)


def active(spark: SparkSession, folder: str, name: str, camera_id: int | None = None) -> DataFrame:
    """Active rows, of one camera or all, in the order of ids where there are any."""
    rows = read(spark, folder, name).where("is_active")
    return rows if camera_id is None else rows.where(F.col("camera_id") == camera_id).orderBy("id")


def repaired(gallery: DataFrame, size: int) -> DataFrame:
    """A gallery that can be used, of what was stored: vectors and the rest of a prototype may have been stored unequally.

    Where a vector has another size than asked for, the store is of another model, and all of it is reset. Else the gallery is
    cut before the first place that lacks its vector or its person, as later places can't be told to belong together; the
    next index is one more than the greatest that is left."""
    wrong = gallery.where(F.size("v") != size).limit(1).count()
    if wrong:
        return gallery.limit(0)
    torn = gallery.where(F.col("v").isNull() | F.col("person_id").isNull()).agg(F.min("index_row")).first()[0]
    return gallery if torn is None else gallery.where(F.col("index_row") < torn)


def next_index(gallery: DataFrame) -> int:
    return int(gallery.agg(F.coalesce(F.max("index_row") + 1, F.lit(0))).first()[0])


def save_gallery(gallery: DataFrame, folder: str, expected: int | None = None, batch: str | None = None) -> int:
    """Writes a gallery whole as its next version, from 1, and gives the version; earlier ones stay, so a run that fails while
    it writes leaves the last good one in place. expected: the version that this one was made from; if there is a later one,
    it is not lost, but a Conflict is raised, and the work is to be done again on that."""
    spark = gallery.sparkSession
    schema = spark.createDataFrame([], GALLERY)

    def write(part: str) -> int:
        schema.unionByName(gallery, allowMissingColumns=True).select(*schema.columns).write.parquet(part)
        return spark.read.schema(GALLERY).parquet(part).count()

    return Ledger(spark, folder).commit(write, batch, None if expected is None else expected - 1).number + 1


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions of a gallery that were written to the end."""
    return [c.number + 1 for c in Ledger(spark, folder).commits()]


def load_gallery(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """The last version of a gallery, repaired; empty where none was written."""
    last = Ledger(spark, folder).last()
    if last is None:
        return spark.createDataFrame([], GALLERY)
    return repaired(spark.read.schema(GALLERY).parquet(f"{folder}/data/part={last.part}"), size)
