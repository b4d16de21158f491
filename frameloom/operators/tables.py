"""Tables in the shared folder, connected components, and updates of small dimension tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only where the session runs on one machine and names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = (named or FALLBACK_DIR).rstrip("/")
    return f"{folder}/frameloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the folder of spark.checkpoint.dir and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """node and root, the smallest node reached, of every node with a link (a, b): labels spread and jump until none moves.
    Raises where so many rounds don't settle it."""
    e = links.where("a != b").select("a", "b")
    e = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    before = None
    for _ in range(rounds):
        roots = materialize(roots, "roots")
        state = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if state is None or state == before:
            break
        before = state
        near = e.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("seen"))
        spread = roots.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "seen").alias("root"))
        jump = spread.alias("x").join(roots.select(F.col("node").alias("at"), F.col("root").alias("to")), F.col("x.root") == F.col("at"), "left")
        roots = jump.select("node", F.least("root", F.coalesce("to", "root")).alias("root"))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return roots


def numbered(df: DataFrame, order: Sequence[str], start: int = 1, name: str = "id") -> DataFrame:
    """df with numbers from start in an order of its rows. Rows are sorted by ranges, and only how many each range has
    reaches the driver; equal rows are numbered in any order."""
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumns({"_range": F.shiftright(place, 33), "_place": place.bitwiseAND((1 << 33) - 1)}), "numbered")
    before, rows = start, []
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():
        rows.append((r["_range"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(rows, "_range long, _before long")
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def get_or_create(known: DataFrame, names: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    """known with a row for each new name, in order, numbered on from the greatest id."""
    top = known.agg(F.coalesce(F.max(id_column), F.lit(0))).first()[0]
    new = names.where(F.col(key).isNotNull()).select(key).distinct().join(known.select(key), key, "left_anti")
    new = numbered(new, [key], int(top) + 1, id_column)
    return known.unionByName(new.select(*known.columns) if set(known.columns) == {key, id_column} else new, allowMissingColumns=True)


def upsert(known: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """known with the rows of changes put in place of those of the same key, or added; the last of changes for a key must
    be its only one."""
    return known.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def supersede(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """known with the active rows of keys that new has made inactive, and new's rows added as the active ones."""
    replaced = new.select(F.col(key).alias("_key")).distinct()
    old = known.join(replaced, F.col(key) == F.col("_key"), "left")
    old = old.withColumn("is_active", F.col("is_active") & F.col("_key").isNull()).drop("_key")
    return old.unionByName(new.withColumn("is_active", F.lit(True)))


def deactivate(known: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """known with the rows of gone's keys made inactive; other columns and rows stay, and so do keys that are not there."""
    ids = gone.select(F.col(key).alias("_key")).distinct()
    out = known.join(ids, F.col(key) == F.col("_key"), "left")
    return out.withColumn("is_active", F.col("is_active") & F.col("_key").isNull()).drop("_key")
