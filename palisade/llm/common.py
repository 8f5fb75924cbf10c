"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one step of a Python task holds at a time, in bytes.
STEP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, one of our own if all runs on one machine; a cluster has to name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: a cluster has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="palisade-"))
    return sc.getCheckpointDir()


class Scratch:
    """Tables of one job in the shared folder, which ``clear`` deletes when no result reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        """``df`` as a table: cuts the lineage, and outlives any executor."""
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for p in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder that stays, as results read it."""
    return Scratch(df.sparkSession).written(df)


def unused(name: str, columns: list[str]) -> str:
    """A column name that is not taken (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5. A null id is as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(5))


def small_batches(spark: SparkSession) -> None:
    """Has Spark send Python at most 16 MB at a time, where a session has no setting of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key, None) is None:
        spark.conf.set(key, 16 << 20)


def steps(batch, column: int, size: int = STEP_BYTES):
    """Slices of an Arrow batch with at most ``size`` bytes of values in a text or binary column (one row at least)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = batch.num_rows
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()
