"""Streams over the events table, run to their end; a folder of new files would run the same plans for ever."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import Store, stream_into
from ..operators.tables import shared_path
from ..streaming import state as Z
from .analytics import REWARD, reward
from .registry import query


def finished(df: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """What the stream has put out when all files there are have been read: the last row of each key, from a keyed store."""
    spark, name = df.sparkSession, f"stream_{uuid.uuid4().hex}"
    store = Store(spark, shared_path(spark, f"{name}/store"), keys, buckets=8)
    with Z.typed_state(spark):
        stream_into(store, df, shared_path(spark, f"{name}/checkpoint"), name, mode).awaitTermination()
    return store.read()


def events(t) -> DataFrame:
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parque[t]").withColumn("r", reward())


@query(f"with x as (select event_type, {REWARD} r from events) select event_type, count(*) total, cast(count(*) filter (where r > 0) as bigint) positive, cast(count(*) filter (where r < 0) as bigint) negative, avg(case when r > 0 then 1.0 else 0.0 end) rate from x group by 1")
def stream_counters(t):
    out = finished(Z.counters(events(t), "event_type", "r"), "update", ["event_type"])
    return out.select("event_type", "total", "positive", "negative", "rate")


@query("select cast(ts as date) as \"day\", event_type, count(*) n from events group by 1, 2")
def stream_daily(t):
    """Tumbling daily windows with a watermark, each as of its last update."""
    e = events(t).withColumn("at", F.col("ts").cast("timestamp"))
    out = finished(Z.windowed(e, "at", "event_type"), "update", ["start", "event_type"])
    return out.select(F.to_date("start").alias("day"), "event_type", "n")


@query(f"""with r as (select event_type, {REWARD} r, row_number() over (partition by event_type order by ts desc, event_id desc) - 1 k from events) select event_type, round(sum(r * 0.1 * pow(0.9, k)), 9) q, count(*) n from r group by 1""")
def stream_learned_values(t):
    """Typed state: the last update of each key."""
    rows = events(t).select("event_type", "ts", "event_id", "r")
    out = finished(Z.learned_values(rows, "event_type", "ts", "r"), "update", ["event_type"])
    return out.select("event_type", F.round("q", 9).alias("q"), "n")
