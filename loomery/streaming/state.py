"""Keyed state over streams: counters, learned values, message context.

Message contexts end with the retention of their messages, by event time and a watermark, without loss. Counters, last
tags and learned values are kept for every key, as they are meant to be remembered, unless `idle` bounds how long a
key may be silent.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def counters(events: DataFrame, key: str, score: str) -> DataFrame:
    """Running totals for each key; write in update mode."""
    s = F.col(score)
    return events.groupBy(key).agg(F.count("*").alias("total"), F.count_if(s > 0).alias("positive"), F.count_if(s < 0).alias("negative"), F.avg((s > 0).cast("double")).alias("rate"))


def windowed(events: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts for each key and window; rows later than the watermark are dropped."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key)
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def typed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which typed state and timers need."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def millis(t: pd.Timestamp) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


class Forgetting(StatefulProcessor):
    """Base of processors whose keys are forgotten when the watermark passes their last event by `idle`; None: never."""

    idle: pd.Timedelta | None = None

    def remember(self, last: pd.Timestamp, timers) -> None:
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(millis(last + self.idle), timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter([])

    def close(self) -> None:
        pass


class Learning(Forgetting):
    """Value state (q, n): q += rate * (reward - q), rewards of a batch in time order. One row a key and batch."""

    def __init__(self, key: str, ts: str, reward: str, rate: float, idle: str | None):
        self.key, self.ts, self.reward, self.rate, self.idle = key, ts, reward, rate, pd.Timedelta(idle) if idle else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", "q double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        q, n = self.value.get() if self.value.exists() else (0.0, 0)
        batch = in_order([b[[self.ts, self.reward]] for b in rows], self.ts)
        for r in batch[self.reward].clip(-1.0, 1.0):
            q, n = q + self.rate * (r - q), n + 1
        self.value.update((float(q), int(n)))
        if self.idle is not None:
            self.remember(batch[self.ts].iloc[-1], timerValues)
        yield pd.DataFrame({self.key: [key[0]], "q": [q], "n": [n]})

    def forget(self) -> None:
        self.value.clear()


class Recalling(Forgetting):
    """List state of the last 2 n texts with their times: each message comes out with the n before it of the last `days`."""

    def __init__(self, keys: list[str], ts: str, text: str, n: int, days: int):
        self.keys, self.ts, self.text, self.n, self.idle = keys, ts, text, n, pd.Timedelta(days=days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.said = handle, handle.getListState("said", "at timestamp, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [(pd.Timestamp(t), x) for t, x in (self.said.get() if self.said.exists() else [])]
        batch, out = in_order([b[[self.ts, self.text]] for b in rows], self.ts), []
        for at, x in zip(batch[self.ts], batch[self.text], strict=True):
            kept = [(t, y) for t, y in kept if at - t <= self.idle]
            out.append((*key, at, x, [y for _, y in kept[-self.n :]]))
            kept = [*kept, (at, x)][-2 * self.n :]
        self.said.put([(t.to_pydatetime(), y) for t, y in kept])
        self.remember(kept[-1][0], timerValues)
        yield pd.DataFrame(out, columns=[*self.keys, self.ts, self.text, "context"])

    def forget(self) -> None:
        self.said.clear()


class Correcting(Forgetting):
    """Value state of a sender's newest tag, and map state of how often each tag was given. One row a sender and batch:
    preferred, corrections, tags (distinct) and confidence, which each correction away from the preferred tag lowers."""

    def __init__(self, sender: str, tag: str, ts: str, idle: str | None):
        self.sender, self.tag, self.ts, self.idle = sender, tag, ts, pd.Timedelta(idle) if idle else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at string, tag string")
        self.counts = handle.getMapState("counts", "tag string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, tag = self.newest.get() if self.newest.exists() else ("", None)
        for b in rows:
            last = b.loc[b[self.ts].astype(str).idxmax()]
            if str(last[self.ts]) >= at:
                at, tag = str(last[self.ts]), last[self.tag]
            for name, n in b[self.tag].value_counts(dropna=True).items():
                old = self.counts.getValue((name,))[0] if self.counts.containsKey((name,)) else 0
                self.counts.updateValue((name,), (old + int(n),))
        self.newest.update((at, tag))
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        total = sum(counts.values())
        if self.idle is not None:
            self.remember(pd.Timestamp(at), timerValues)
        yield pd.DataFrame({self.sender: [key[0]], "preferred": [tag], "corrections": [total], "tags": [len(counts)], "confidence": [counts.get(tag, 0) / max(1, total)]})

    def forget(self) -> None:
        self.newest.clear()
        self.counts.clear()


def in_order(parts: list[pd.DataFrame], ts: str) -> pd.DataFrame:
    """A key's rows of one batch by time; how many they are is bounded by what a trigger may read (maxFilesPerTrigger)."""
    return pd.concat(parts).sort_values(ts, kind="stable")


def learned_values(rewards: DataFrame, key: str, ts: str, reward: str, rate: float = 0.1, idle: str | None = None, late: str = "1 day") -> DataFrame:
    """(key, q, n) of each key that a batch has rewards of.

    idle: keys without rewards for so long, by event time, are forgotten and begin anew; ts is a timestamp then.
    """
    rows, kind = (rewards.withWatermark(ts, late), "EventTime") if idle else (rewards, "None")
    return rows.groupBy(key).transformWithStateInPandas(Learning(key, ts, reward, rate, idle), f"{key} string, q double, n long", "Update", kind)


def contexts(messages: DataFrame, keys: list[str], ts: str, text: str, n: int = 3, days: int = 30, late: str = "1 day") -> DataFrame:
    """Each message with the last n earlier ones of its key, none older than `days` of event time before it.

    The state of a key is bounded: 2 n texts and their times; it goes when the watermark shows that all are too old.
    """
    schema = ", ".join(f"{k} string" for k in keys) + f", {ts} timestamp, {text} string, context array<string>"
    return messages.withWatermark(ts, late).groupBy(*keys).transformWithStateInPandas(Recalling(keys, ts, text, n, days), schema, "Append", "EventTime")


def corrected_tags(corrections: DataFrame, sender: str, tag: str, ts: str, idle: str | None = None, late: str = "1 day") -> DataFrame:
    """(sender, preferred, corrections, tags, confidence): last write wins by ts, a string or timestamp that sorts by time."""
    rows, kind = (corrections.withWatermark(ts, late), "EventTime") if idle else (corrections, "None")
    schema = f"{sender} {dict(corrections.dtypes)[sender]}, preferred string, corrections long, tags long, confidence double"
    return rows.groupBy(sender).transformWithStateInPandas(Correcting(sender, tag, ts, idle), schema, "Update", kind)


def last_tags(corrections: DataFrame, sender: str, tag: str, ts: str) -> DataFrame:
    """The newest tag of each sender: last write wins by event time; write in update mode."""
    return corrections.groupBy(sender).agg(F.max_by(tag, ts).alias("preferred"), F.count("*").alias("corrections"))
