"""Read models kept up to date by streams.

- ``Projection``: latest state by key, merged batch by batch into a versioned table; a batch that comes again changes nothing.
- ``stateful``: state by key in the stream's state store, skipping versions it has seen.
- ``windowed_counts``: event-time windows with a watermark (beyond the log's own order).
- ``delayed``: delayed actions of a running stream, by timers; ``due``: those of a whole log, as of a moment.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidelog.plans.scratch import drop, keep


class Projection:
    """A table of one row a key, folded by ``fold(old_state, new_events) -> state`` on DataFrames.

    Keys are dealt by hash into ``buckets``, and a batch writes the buckets it touches anew (folder ``v=<batch>``); the file
    ``state/<batch>.json`` says which folder has the newest form of each bucket. It is written last, so readers take the newest complete
    version. Choose so many buckets that one is a small file; it is a property of the table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str = "stream_id", buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/state")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _state(self, before: int | None = None) -> dict[int, int]:
        """Which version each bucket was last written by."""
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/state/{known[-1]:012d}.json"))
        try:
            return {int(b): v for b, v in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).items()}
        finally:
            stream.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict[int, int]) -> DataFrame:
        if not state:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/v={v}/__bucket={b}" for b, v in sorted(state.items())))

    def read(self, before: int | None = None) -> DataFrame:
        return self._rows(self._state(before))

    def upsert(self, rows: DataFrame, batch: int, order: str = "version") -> None:
        """Insert or replace rows by key, the highest ``order`` winning; the result of a batch does not depend on how often it comes.

        Only the buckets of the batch's keys are read and written.
        """
        state, names = self._state(before=batch), self.schema.fieldNames()
        new = keep(rows.select(*names).withColumn("__bucket", self._bucket()), "upsert")
        touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # at most the number of buckets
        if touched:
            old = self._rows({b: state[b] for b in touched if b in state}).withColumn("__bucket", self._bucket())
            best = old.unionByName(new).groupBy("__bucket", self.key).agg(F.max_by(F.struct(*names), F.col(order)).alias("r")).select("r.*", "__bucket")
            best.repartition(min(len(touched), 8 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/v={batch}")
        drop(new)
        self._fs.mkdirs(self._path(f"{self.path}/state"))
        out = self._fs.create(self._path(f"{self.path}/state/{batch:012d}.json"), True)
        out.write(bytearray(json.dumps(state | dict.fromkeys(touched, batch)), "utf-8"))
        out.close()
        self._clean()

    def _clean(self) -> None:
        """Delete bucket folders that neither of the last two versions has (the one before is what a repeated batch starts from)."""
        versions = self._versions()
        used = {(b, v) for n in (None, versions[-1]) for b, v in self._state(n).items()}
        for old in versions[:-2]:
            for b, v in self._state(old + 1).items():
                if (b, v) not in used:
                    self._fs.delete(self._path(f"{self.path}/v={v}/__bucket={b}"), True)
            self._fs.delete(self._path(f"{self.path}/state/{old:012d}.json"), False)

    def update_existing(self, rows: DataFrame, batch: int, order: str = "version") -> None:
        """As ``upsert``, but a key that is not there yet is ignored."""
        self.upsert(rows.join(self.read(before=batch).select(self.key), self.key, "left_semi"), batch, order)


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """A session whose streams keep their state in RocksDB, as Python state needs; afterwards the setting is what it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stateful(events: DataFrame, by: str, state: str, out: str, initial: tuple, evolve: Callable[[tuple, Any], tuple], result: Callable[[tuple], dict]) -> DataFrame:
    """Fold a stream of events by key in the state store. ``events`` has ``version``; ``state`` and ``out`` are DDL.

    Versions that were folded before are passed over, so events delivered again do no harm.
    """
    fields = [f.split()[0] for f in out.split(",")]

    class Folding(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.value = handle.getValueState("state", f"seen long, {state}")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            seen, *now = self.value.get() if self.value.exists() else (0, *initial)
            now = tuple(now)
            for row in pd.concat(list(rows)).sort_values("version").to_dict("records"):
                if row["version"] > seen:
                    now, seen = evolve(now, row), row["version"]
            self.value.update((int(seen), *now))
            yield pd.DataFrame([{by: key[0], "version": int(seen), **result(now)}])[[by, "version", *fields]]

        def close(self) -> None:
            pass

    kind = events.schema[by].dataType.simpleString()
    return events.groupBy(by).transformWithStateInPandas(Folding(), f"{by} {kind}, version long, {out}", "Update", "None")


def delayed(events: DataFrame, trigger: str, cancelled_by: str, delay: timedelta, late: str = "0 seconds", by: str = "stream_id", clock: str = "eventtime") -> DataFrame:
    """Delayed actions of a stream of events: ``by`` and due_at, once a ``trigger`` event is ``delay`` old and neither
    another one nor a ``cancelled_by`` event came in that time.

    Each key has at most one timer: a later trigger moves it, a cancelling event deletes it, so what is lost with a worker is
    read again from the checkpoint. By event time, an event of the key that comes when an action was due lets it go first, so actions do not depend
    on how events are cut into batches. ``clock``: ``eventtime`` counts by ``occurred_at`` (events later than ``late`` are dropped), ``processingtime`` by the
    wall clock. Actions are delivered at least once; their key and due_at tell repeats.
    """
    wait = delay // timedelta(microseconds=1)

    class Waiting(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.due = handle, handle.getValueState("due", "at long, last long")

        def _clear(self) -> None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            due, last = self.due.get() if self.due.exists() else (0, -1)
            gone = []
            for row in pd.concat(list(rows)).sort_values("version").to_dict("records"):
                if row["version"] <= last:
                    continue
                last = int(row["version"])
                if due and clock == "eventtime" and row["occurred_at"].value // 1000 >= due:
                    gone.append(due)
                    due = 0
                if row["event_type"] == cancelled_by:
                    due = 0
                elif row["event_type"] == trigger:
                    at = row["occurred_at"].value // 1000 if clock == "eventtime" else timerValues.getCurrentProcessingTimeInMs() * 1000
                    due = int(at + wait)
            self.due.update((int(due), int(last)))
            self._clear()
            if due:
                self.handle.registerTimer(-(-due // 1000))  # timers know milliseconds
            yield pd.DataFrame({by: pd.Series([key[0]] * len(gone), dtype=object), "due_at": pd.to_datetime(pd.Series(gone, dtype="int64"), unit="us")})

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            due, last = self.due.get()
            if due and expiredTimerInfo.getExpiryTimeInMs() * 1000 >= due:
                self.due.update((0, int(last)))
                yield pd.DataFrame({by: [key[0]], "due_at": pd.to_datetime([due], unit="us")})

        def close(self) -> None:
            pass

    kind = events.schema[by].dataType.simpleString()
    timed = events.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    timed = timed.withWatermark("occurred_at", late) if clock == "eventtime" else timed
    mode = "EventTime" if clock == "eventtime" else "ProcessingTime"
    return timed.select(by, "version", "event_type", "occurred_at").groupBy(by).transformWithStateInPandas(Waiting(), f"{by} {kind}, due_at timestamp", "Append", mode)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None, *by: str) -> DataFrame:
    """Events by window of ``occurred_at`` (a TIMESTAMP; local times are cast), dropping what is later than ``late``."""
    timed = events.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withWatermark("occurred_at", late)
    window = F.window("occurred_at", width, slide) if slide else F.window("occurred_at", width)
    return timed.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "events")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "stream_id") -> DataFrame:
    timed = events.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withWatermark("occurred_at", late)
    return timed.groupBy(F.session_window("occurred_at", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "events")


def once_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["event_id"])


def due(log: DataFrame, trigger: str, cancelled_by: str, delay: str, now: Column) -> DataFrame:
    """stream_id, due_at of streams whose latest ``trigger`` event is ``delay`` old, with no ``cancelled_by`` event: commands to give now."""
    state = log.groupBy("stream_id").agg(F.max(F.when(F.col("event_type") == trigger, F.col("occurred_at"))).alias("at"), F.bool_or(F.col("event_type") == cancelled_by).alias("over"))
    return state.withColumn("due_at", F.col("at") + F.expr(f"INTERVAL {delay}")).where(F.col("at").isNotNull() & ~F.col("over") & (F.col("due_at") <= now)).select("stream_id", "due_at")
