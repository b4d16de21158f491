"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of rows that Python workers get at a time; less holds where the session says so.
BATCH_BYTES = 4 << 20


def make_importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, whatever their working folder is, and bounds
    what they hold: batches by bytes, and freed memory goes back to the system.

    On a cluster without that folder, ship the package with --py-files as usual.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(spark.conf.get(key).rstrip("b"))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "1"), ("MALLOC_TRIM_THRESHOLD_", "1048576")):
        spark.sparkContext.environment.setdefault(name, value)
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark
