"""The folder for tables that a query writes on its way, and the batches that it sends to Python."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch that goes to Python; a text that is longer than that comes alone.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application that the driver and all executors share, in the one that ``spark.checkpoint.dir`` names.

    Where that is unset, a local session gets a temporary folder; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scribewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/scribewell-{spark.sparkContext.applicationId}"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bounds the rows and bytes of the Arrow batches that this session sends to Python.

    Plans read these settings when they run, which is after an operator has returned, so they stay; smaller ones are left alone.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        # the default has a unit: "256MB"
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
