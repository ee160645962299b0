"""Sessions, and the package on the workers' path."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies on a shared disk (elsewhere it is installed or sent as a file)."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([_ROOT, *paths])


def small_batches(spark: SparkSession) -> None:
    """Small Arrow batches keep a Python worker's memory flat however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


def session(app: str = "lorebase", **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans and Arrow."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def written(rows, name: str = "stage"):
    """The rows as Parquet in a new shared folder: what made them runs once, and a lost executor costs no more than a read."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that driver and executors share; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="shared-")
    return f"{shared}/{name}-{uuid.uuid4()}"
