"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under spark.checkpoint.dir, the shared folder; a local one only for a local master that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomery-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loomery/{name}"


def keep_table(df: DataFrame) -> DataFrame:
    """Write df in the shared folder and reread it, which ends its lineage."""
    path = shared_path(df.sparkSession, uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._loomery_path = path
    return table


#: Rows of (id, id) that a task may hold.
SMALL = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if a count allows it: texts then stay where they are."""
    return F.broadcast(table) if table.count() <= SMALL else table


def spread(df: DataFrame) -> DataFrame:
    """df in as many tasks as shuffles have if it comes in fewer than there are cores, as from one file."""
    spark = df.sparkSession
    few = df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if few else df


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was something at the path, which is gone now."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that keep_table wrote and no result still reads."""
    for t in tables:
        delete(t.sparkSession, t._loomery_path)
