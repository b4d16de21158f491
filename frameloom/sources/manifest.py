"""Upload manifests: the stream of folders to be processed, and what is wrong with others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "folder_path string, timestamp string, speed_inference string"


def requests(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and rejected ones with a reason, of JSON texts (value): {"record": {...}}."""
    read = raw.withColumn("r", F.from_json("value", f"record struct<{SCHEMA.replace(' string', ':string')}>")).select("value", "r.record.*")
    reason = F.when(F.col("folder_path").isNull() | (F.trim("folder_path") == ""), "no folder").when(F.col("timestamp").isNull(), "no timestamp")
    marked = read.withColumn("reason", reason).withColumn("speed", F.coalesce(F.col("speed_inference").try_cast("double"), F.lit(1.0)))
    return marked.where("reason is null").drop("reason", "value"), marked.where("reason is not null").select("value", "reason")


def publish(uploads: DataFrame, folder: str) -> None:
    """Appends requests (folder_path, timestamp, speed_inference) to a folder that a stream of requests reads."""
    record = F.struct(*(F.col(c).cast("string").alias(c) for c in ("folder_path", "timestamp", "speed_inference")))
    uploads.select(F.to_json(F.struct(record.alias("record"))).alias("value")).write.mode("append").text(folder)


def stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def process(source: DataFrame, handle: Callable[[DataFrame], DataFrame], good: str, bad: str, checkpoint: str):
    """Runs requests of a stream batch by batch: results and rejected ones are appended, each with its batch, so that a
    batch that is run again after a failure can be told from the first."""

    def run(batch: DataFrame, number: int) -> None:
        valid, rejected = requests(batch)
        handle(valid).withColumn("batch", F.lit(number)).write.mode("append").parquet(good)
        rejected.withColumn("batch", F.lit(number)).write.mode("append").parquet(bad)

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
