"""What the text operators share: table access, scratch tables in the shared folder, and vectorised word splitting."""

from __future__ import annotations

import functools
import gc
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from frameloom.runtime import make_importable

#: Only where the session runs on one machine and names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return make_importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; FALLBACK_DIR where that is unset and the
    session runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/frameloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage; any executor can be lost later."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if by := list(partition_by):
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets shuffle files of finished steps go now: Spark deletes them once the driver's JVM finds that nothing refers to
    them, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    out = batch.column(batch.schema.get_field_index(name))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def slices(batches: Iterable[pa.RecordBatch], name: str = "text", size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of a text column, or of one row, which bounds what is held at once."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // size
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def strings(values: pa.Array) -> list[str | None]:
    """The strings of an array as Python objects; far faster than to_pylist()."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of an array of texts, as codes into the batch's distinct words.

    codes: of all texts, one after the other; starts: where each text's codes start, with the end last; distinct: the
    words, and dictionary the same as an Arrow array. Null and empty texts have no words.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        encoded = lists.flatten().dictionary_encode()
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.combine_chunks()
        self.dictionary: pa.Array = encoded.dictionary
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        blank = pc.index(self.dictionary, "").as_py()
        if blank < 0:
            self.codes, self.starts = codes, offsets
            return
        real = codes != blank
        before = np.concatenate(([0], np.cumsum(real)))
        self.codes, self.starts = codes[real], before[offsets]

    @functools.cached_property
    def distinct(self) -> list[str]:
        return strings(self.dictionary)

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def spans(self) -> Iterator[np.ndarray]:
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()):
            yield self.codes[a:b]


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive starts."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def local_parallelism(name: str = "TOKENIZERS_PARALLELISM") -> None:
    """Each Spark task has one core: libraries start no threads of their own."""
    os.environ.setdefault(name, "false")
