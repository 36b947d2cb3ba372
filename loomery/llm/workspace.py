"""Intermediate tables in the cluster's shared folder, bounded broadcasts and worker caches."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one id column that may be broadcast: 8 MB of longs at most.
BROADCAST_IDS = 1_000_000
#: Narrow rows in a file of a small table.
FILE_ROWS = 250_000
#: Rows in an Arrow batch that carries whole texts.
TEXT_BATCH = 256


def root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only for a local master that has none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomery-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Paths of the tables written inside each open scratch.
OPEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """At the end, delete what materialize wrote inside, but for the tables that the caller adds to the list it gets."""
    keep: list[DataFrame] = []
    OPEN.append([])
    try:
        yield keep
    finally:
        made, kept = OPEN.pop(), {t._loomery_path for t in keep}
        delete(spark, *(p for p in made if p not in kept))
        if OPEN:
            OPEN[-1] += kept


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return the reread table: lineage ends here.

    rows: about how many narrow rows it has. They are then dealt to as few files as hold FILE_ROWS each, after the
    tasks that compute them, where shuffles would leave a small file for each partition.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/loomery/{name}-{uuid.uuid4().hex}"
    if rows is not None and (files := max(1, -(-rows // FILE_ROWS))) < partitions(spark):
        df = df.repartition(files)
    df.write.parquet(path)
    if OPEN:
        OPEN[-1].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._loomery_path = path
    return table


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and no result still reads."""
    for t in tables:
        delete(t.sparkSession, t._loomery_path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows only; whole texts need few rows a batch to bound a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for the actions inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def keep_ids(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a written one-column table of ids: broadcast up to BROADCAST_IDS rows, else shuffled."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, column, how)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker does."""
    return sys.modules.setdefault("_loomery_worker_cache", types.ModuleType("_loomery_worker_cache")).__dict__


def tidy(run):
    """A function of batches that gives freed memory back to the system at its end: workers outlive their tasks."""

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library: nothing to trim

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
