"""Positioned, filtered scans of a log, as lazy DataFrames.

Filters are plain comparisons on stored columns, so they reach the Parquet reader; order is by version or global version,
never by time or file name. Preconditions (a stream must exist, a position must not be beyond the head) cost one small
aggregate on the filtered stream, never a count of the result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.envelope import ANY, ENVELOPE, NO_STREAM, STREAM_EXISTS, Revision, StreamState
from tidelog.errors import InvalidRevision, StreamAlreadyExists, StreamNotFound
from tidelog.registry import any_of


class EventLog:
    """A snapshot of a log: a DataFrame with the envelope's columns (at least stream_id, version, global_version, event_type)."""

    def __init__(self, events: DataFrame) -> None:
        self.events = events

    # scans

    def load_all(self, state: StreamState = ANY) -> DataFrame:
        """The whole log in global order; after n with Revision(n), which must not lie beyond the head."""
        rows = self.events
        if isinstance(state, Revision):
            if state.code and state.code > self.last_position():
                raise InvalidRevision(f"position {state.code} is beyond the head of the log")
            rows = rows.where(F.col("global_version") > state.code)
        return rows.orderBy("global_version")

    def load_stream(self, stream_id: str) -> DataFrame:
        """One stream that must exist, in order."""
        return self.load_stream_from(stream_id, STREAM_EXISTS)

    def load_stream_from(self, stream_id: str, state: StreamState = ANY) -> DataFrame:
        """One stream in order. NO_STREAM and STREAM_EXISTS are preconditions; Revision(n) starts after version n."""
        rows = self.events.where(F.col("stream_id") == stream_id)
        if state is not ANY and state != ANY:
            head = self.head(stream_id)
            if isinstance(state, Revision):
                if state.code < 0 or state.code > head:
                    raise InvalidRevision(f"version {state.code} is beyond the head {head} of stream {stream_id!r}")
                rows = rows.where(F.col("version") > state.code)
            elif state == NO_STREAM:
                if head:
                    raise StreamAlreadyExists(f"stream {stream_id!r} exists")
            elif state == STREAM_EXISTS:
                if not head:
                    raise StreamNotFound(f"stream {stream_id!r} does not exist")
            else:
                raise InvalidRevision(f"unknown stream state {state!r}")
        return rows.orderBy("version")

    def poll(self, after: int, event_types: Iterable[str] = (), limit: int = 100) -> DataFrame:
        """The next batch of a reader at position ``after``; no types are all types."""
        return self.of_types(event_types).events.where(F.col("global_version") > after).orderBy("global_version").limit(limit)

    # heads

    def heads(self) -> DataFrame:
        """stream_id, head (last version), events."""
        return self.events.groupBy("stream_id").agg(F.max("version").alias("head"), F.count(F.lit(1)).alias("events"))

    def head(self, stream_id: str) -> int:
        return self.events.where(F.col("stream_id") == stream_id).agg(F.max("version")).first()[0] or 0

    def outcomes(self, state: Revision) -> DataFrame:
        """stream_id, outcome: what loading each stream after a revision gives, ``rows``, ``empty`` (at its head) or ``invalid_revision``
        (beyond it). The rule is that of ``load_stream_from``, for all streams in one aggregate."""
        beyond, at = F.col("head") < state.code, F.col("head") == state.code
        return self.heads().select("stream_id", F.when(beyond, "invalid_revision").when(at, "empty").otherwise("rows").alias("outcome"))

    def extent(self) -> DataFrame:
        """last_position, events: one row, for any number of events."""
        return self.events.agg(F.max("global_version").alias("last_position"), F.count(F.lit(1)).alias("events"))

    def exists(self, stream_id: str) -> bool:
        return not self.events.where(F.col("stream_id") == stream_id).limit(1).isEmpty()

    def last_position(self) -> int:
        return self.extent().first()["last_position"] or 0

    def existing(self, streams: DataFrame) -> DataFrame:
        """The rows of ``streams`` (stream_id) whose stream exists; a semi-join."""
        return streams.join(self.events.select("stream_id"), "stream_id", "left_semi")

    def missing(self, streams: DataFrame) -> DataFrame:
        """The rows of ``streams`` whose stream does not exist."""
        return streams.join(self.events.select("stream_id"), "stream_id", "left_anti")

    # filters

    def of_types(self, event_types: Iterable[str]) -> EventLog:
        """Only these stored types; none given: all."""
        names = list(event_types)
        return EventLog(self.events.where(F.col("event_type").isin(names))) if names else self

    def with_prefixes(self, prefixes: Iterable[str]) -> EventLog:
        """Only streams whose name begins with any of these; none given: all."""
        wanted = any_of([F.col("stream_id").startswith(p) for p in prefixes])
        return self if wanted is None else EventLog(self.events.where(wanted))

    def without_system_events(self) -> EventLog:
        """Without types that begin with ``$``."""
        return EventLog(self.events.where(~F.col("event_type").startswith("$")))

    def union(self, *others: EventLog) -> EventLog:
        """One log of several; global versions must be those of one sequence."""
        out = self.events
        for other in others:
            out = out.unionByName(other.events)
        return EventLog(out)

    def top_per_stream(self, n: int) -> DataFrame:
        """The last n events of each stream."""
        from pyspark.sql import Window

        latest = Window.partitionBy("stream_id").orderBy(F.desc("version"))
        return self.events.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= n).drop("rank")

    # driver side

    def iterate(self, rows: DataFrame | None = None) -> Iterator[Row]:
        """Rows one by one at the driver, a partition at a time."""
        return (self.events.orderBy("global_version") if rows is None else rows).toLocalIterator()


def envelope_defaults(rows: DataFrame) -> DataFrame:
    """Absent parts as the envelope defines them: an empty map, an empty aggregate, position 0."""
    empty = F.create_map().cast("map<string,string>")
    fill = {"metadata": empty, "aggregate_id": F.lit(""), "version": F.lit(0).cast("long"), "global_version": F.lit(0).cast("long")}
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in fill.items()})


def in_memory(spark: SparkSession, rows: list[dict]) -> EventLog:
    """A log of Python dicts; missing fields are null, metadata empty."""
    filled = [tuple(r.get(f, {} if f == "metadata" else None) for f in ENVELOPE.fieldNames()) for r in rows]
    return EventLog(spark.createDataFrame(filled, ENVELOPE))


def generated(spark: SparkSession, make: Callable[[int], Iterable[dict]], partitions: int, schema: str, batch: int = 1000) -> DataFrame:
    """Rows of a user's generator: ``make(i)`` gives the rows of partition i as dicts, until it ends. They are made on the executors, ``batch`` at a
    time; an error of the generator fails the read. A partition that is lost is made again, so a generator should give the same rows each time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            for i in ids["id"]:
                source = iter(make(int(i)))
                while chunk := list(itertools.islice(source, batch)):
                    yield pd.DataFrame(chunk, columns=names)

    names = StructType.fromDDL(schema).fieldNames()
    return spark.range(0, partitions, 1, partitions).mapInPandas(rows, schema)


def from_parquet(spark: SparkSession, *paths: str) -> EventLog:
    return EventLog(spark.read.schema(ENVELOPE).parquet(*paths))


#: What a JSON line of a log holds; versions and time as text survive other programs' number types.
JSON_SCHEMA = "event_id string, stream_id string, aggregate_id string, version long, global_version long, event_type string, data string, metadata map<string,string>, occurred_at timestamp, _corrupt_record string"


def from_json(spark: SparkSession, path: str) -> tuple[EventLog, DataFrame]:
    """A log of JSON lines, and the lines that could not be read; these are shown, not hidden."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    raw = lines.withColumn("r", F.from_json("value", JSON_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = raw.where("r._corrupt_record is null and r.event_type is not null").select("r.*").withColumnRenamed("data", "payload")
    bad = raw.where("r._corrupt_record is not null or r.event_type is null").select(F.col("value").alias("line"), "file_path")
    return EventLog(envelope_defaults(good).select(*ENVELOPE.fieldNames())), bad


def to_json(log: EventLog, path: str) -> None:
    """Export as JSON lines; payload as text in ``data``."""
    log.events.withColumnRenamed("payload", "data").write.option("ignoreNullFields", "false").json(path)


def from_jdbc(spark: SparkSession, url: str, table: str = "events", partitions: int = 1, upper: int | None = None, **options: str) -> EventLog:
    """A log in a relational table (id, event_id, stream_id, stream_position, event_type, payload, metadata, occurred_at),
    read in ranges of its id. The database's driver has to be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partitions > 1 and upper:
        reader = reader.option("partitionColumn", "id").option("lowerBound", 0).option("upperBound", upper).option("numPartitions", partitions)
    raw = reader.load()
    text = lambda c: F.decode(F.col(c), "UTF-8") if dict(raw.dtypes)[c] == "binary" else F.col(c).cast("string")
    meta = F.coalesce(F.from_json(text("metadata"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return EventLog(
        raw.select(
            F.lower(F.col("event_id").cast("string")).alias("event_id"), "stream_id", F.lit(None).cast("string").alias("aggregate_id"), F.col("stream_position").cast("long").alias("version"),
            F.col("id").cast("long").alias("global_version"), "event_type", text("payload").alias("payload"), meta.alias("metadata"), F.col("occurred_at").cast("timestamp").alias("occurred_at"),
        )
    )


def to_jdbc(log: EventLog, url: str, table: str = "events", **options: str) -> None:
    """Append a log to a relational table, in the columns that ``from_jdbc`` reads; metadata and payload as JSON text.

    The table's unique key on (stream_id, stream_position) refuses events that it has already.
    """
    rows = log.events.select(
        F.col("global_version").alias("id"), "event_id", "stream_id", F.col("version").alias("stream_position"), "event_type", "payload",
        F.to_json("metadata").alias("metadata"), "occurred_at",
    )
    kinds = "event_id VARCHAR(64), stream_id VARCHAR(255), event_type VARCHAR(255)"  # of a table that is not there yet
    rows.write.format("jdbc").option("url", url).option("dbtable", table).option("createTableColumnTypes", kinds).options(**options).mode("append").save()
