"""Shared storage for intermediate tables, and size-checked broadcasts.

Everything that must outlive a lost executor is written below the folder that
the cluster names in ``spark.checkpoint.dir``. Only where that setting is
absent and the master is local (tests, a laptop) is a folder made and set.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was measured to hold at most this many bytes.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, set as Spark's checkpoint folder too."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="kinfold-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; its files go when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/kinfold-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written`, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder; for small tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, size: int) -> DataFrame:
    """Broadcast ``df`` if its measured ``size`` in bytes allows, else leave the join to shuffle."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, whatever they are called."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInPandas``; as workers are reused, memory that the allocators hold free goes back when a task ends."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task
