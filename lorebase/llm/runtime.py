"""What the operators share: a checkpoint folder, broadcasts of a checked size, Arrow batches of few rows."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder as shared  # noqa: F401
from ..session import ship, small_batches

#: Bytes that may be broadcast at once; operators have another way beyond it.
MAX_BROADCAST_BYTES = 64 << 20


def prepare(spark: SparkSession) -> None:
    """The package on the workers, small Arrow batches, a checkpoint folder."""
    ship(spark)
    small_batches(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder.

    With spark.cleaner.referenceTracking.cleanCheckpoints (which `session` sets; a session made elsewhere has to) Spark
    drops the files once nothing refers to them, else they stay until the folder is cleared.
    """
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def unlink(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared ones that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives freed memory back when its task ends: Python workers live on for later tasks."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library than glibc
                pass

    return tidied
