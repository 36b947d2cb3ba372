"""Distributed prefix sums: a range sort, running sums inside each partition, and one offset per partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import materialize, partitions, tidy


def with_prefix(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df, a written table, in the given total order, with _index (rows before) and _before (sum of value before), over all rows.

    Rows are range-partitioned by the order, so a hot leading key is spread over many partitions. Running sums
    restart in each partition; one (count, sum) row per partition gives the offsets, which are as many as
    shuffle partitions and are broadcast. Ties in the order are equal rows. An empty table gives an empty table.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_part", "_row", "_run"))])

    def run(batches):
        part, row, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            v = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            s = np.cumsum(v)
            more = [np.full(len(v), part, np.int64), np.arange(row, row + len(v)), total + s - v]
            row, total = row + len(v), total + int(s[-1]) if len(v) else total
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more)], names=[*b.schema.names, "_part", "_row", "_run"])

    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    table = materialize(ranged.mapInArrow(tidy(run), schema), name, df.count())
    sums, at, offsets = table.groupBy("_part").agg(F.count("*").alias("n"), F.sum(value).alias("v")).orderBy("_part").collect(), (0, 0), []
    for r in sums:
        offsets.append((r["_part"], *at))
        at = at[0] + r["n"], at[1] + r["v"]
    off = spark.createDataFrame(offsets, "_part long, _rows0 long, _sum0 long")
    return (
        table.join(F.broadcast(off), "_part")
        .withColumn("_index", F.col("_row") + F.col("_rows0"))
        .withColumn("_before", F.col("_run") + F.col("_sum0"))
        .drop("_part", "_row", "_run", "_rows0", "_sum0")
    )


def running(df: DataFrame, group: str, order: list[Column], values: list[str]) -> DataFrame:
    """df, a written table with a long group column, with _pos (from 1) and _sum_<value> for each value, over its group in order.

    As with_prefix, but sums begin anew with each group. Only a group that goes on from one partition into the next
    needs an offset: at most one a partition, found from the partitions' first and last rows and broadcast.
    """
    spark = df.sparkSession
    counted = ["_pos", *(f"_sum_{v}" for v in values)]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_part", *counted))])

    def run(batches):
        part, last, carried = TaskContext.get().partitionId(), None, [0] * len(counted)
        for b in batches:
            g = b.column(b.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            more = [np.full(len(g), part, np.int64)]
            if len(g):
                at = np.arange(len(g))
                fresh = np.r_[g[0] != last, g[1:] != g[:-1]]
                begin = np.maximum.accumulate(np.where(fresh, at, 0))
                going_on = np.cumsum(fresh) == 0
                for k, v in enumerate([None, *values]):
                    x = np.ones(len(g), np.int64) if v is None else b.column(b.schema.get_field_index(v)).to_numpy(zero_copy_only=False).astype(np.int64)
                    total = np.cumsum(x)
                    total = total - (total - x)[begin] + np.where(going_on, carried[k], 0)
                    carried[k] = int(total[-1])
                    more.append(total)
                last = g[-1]
            else:
                more += [np.zeros(0, np.int64)] * len(counted)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more)], names=[*b.schema.names, "_part", *counted])

    ranged = df.repartitionByRange(partitions(spark), group, *order).sortWithinPartitions(group, *order)
    table = materialize(ranged.mapInArrow(tidy(run), schema), "running", df.count())
    ends = table.groupBy("_part").agg(F.min(group).alias("first"), F.max(F.struct(group, *counted)).alias("last")).orderBy("_part").collect()
    offsets, before = [], None
    for r in ends:
        open_ = before is not None and before[0] == r["first"]
        if open_:
            offsets.append((r["_part"], *before))
        sums = [r["last"][c] for c in counted]
        if open_ and r["last"][group] == r["first"]:
            sums = [x + y for x, y in zip(sums, before[1:], strict=True)]
        before = (r["last"][group], *sums)
    off = spark.createDataFrame(offsets, f"_part long, {group} long, " + ", ".join(f"_off{k} long" for k in range(len(counted))))
    out = table.join(F.broadcast(off), ["_part", group], "left")
    return out.select(*df.columns, *((F.col(c) + F.coalesce(F.col(f"_off{k}"), F.lit(0))).alias(c) for k, c in enumerate(counted)))
