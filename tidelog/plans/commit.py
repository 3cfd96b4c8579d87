"""An append-only log of immutable Parquet files with atomic, expectation-checked commits.

``data/`` holds files that nobody reads until a manifest names them. Commit n is the file ``manifests/<n>.json``, created
only if absent, so of two writers one wins n and the other looks again. Readers read the files of manifests 1 to N: a batch is
visible as a whole or not at all, and a position is never visible before a lower one. Versions and global versions
are assigned against the head just read and stored as columns, so filters on them reach the scan; a writer that
loses the race assigns anew. ``chunks/<k>.json`` repeats ``CHUNK`` manifests on end, so that a long log is opened with few reads.

Heads are kept beside the data: a commit of few streams lists theirs in its manifest, another one writes them to ``heads/``, and
every ``DELTAS`` such commits all heads are written together. An append reads these and never the events.

Creating a manifest is a hard link on a local file system and a rename that refuses to overwrite elsewhere (atomic on HDFS).
Object stores without such a rename need their own conditional put.
"""

from __future__ import annotations

import json
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.envelope import ANY, ENVELOPE, NO_STREAM, STREAM_EXISTS, AppendResult, Revision, StreamState
from tidelog.errors import InvalidBatch, InvalidRevision, LogError, RevisionConflict, StoreClosed, StreamAlreadyExists, StreamNotFound
from tidelog.plans.scratch import keep
from tidelog.sources.logs import EventLog, in_memory


@dataclass
class Manifest:
    """Commit ``number``: its files, the last global version with it, events in it, and the heads of its streams
    (None: too many to list, they are in ``heads_at``, with ``all_heads`` those of every stream so far). A compaction has no events and
    replaces the files of all commits before it."""

    number: int
    files: list[str]
    position: int
    events: int
    heads: dict[str, int] | None = field(default_factory=dict)
    compacts: bool = False
    heads_at: str | None = None
    all_heads: bool = False


class CommitRefused(LogError):
    """Another writer took the number."""


def check_state(stream: str, expected: StreamState, head: int) -> None:
    """Raise unless a stream with this head is as expected."""
    if isinstance(expected, Revision):
        if expected.code != head:
            raise RevisionConflict(stream, expected.code, head)
    elif expected == NO_STREAM:
        if head:
            raise StreamAlreadyExists(f"stream {stream!r} exists")
    elif expected == STREAM_EXISTS:
        if not head:
            raise StreamNotFound(f"stream {stream!r} does not exist")
    elif expected != ANY:
        raise InvalidRevision(f"unknown stream state {expected!r}")


class LogStore:
    #: Streams of one commit whose heads its manifest lists; commits with a table of heads until all heads are written; manifests of a chunk.
    LISTED_HEADS, DELTAS, CHUNK = 100, 16, 64

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.closed = spark, path.rstrip("/"), False
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._local = self._fs.getScheme() == "file"
        for part in ("data", "manifests", "heads", "chunks"):
            self._fs.mkdirs(self._path(f"{self.path}/{part}"))
        self._seen: list[Manifest] = []

    def __enter__(self) -> LogStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """No reads or writes after this; closing again does nothing."""
        self.closed = True

    # manifests

    def manifests(self) -> list[Manifest]:
        """All commits so far; only new ones are read."""
        if self.closed:
            raise StoreClosed(self.path)
        while True:
            n = len(self._seen)
            chunk = self._text(self._chunk(n // self.CHUNK)) if n % self.CHUNK == 0 else None
            if chunk is not None:
                self._seen += [Manifest(**m) for m in json.loads(chunk)]
                continue
            text = self._text(self._name(n + 1))
            if text is None:
                return self._seen
            self._seen.append(Manifest(**json.loads(text)))

    def _text(self, name: str) -> str | None:
        """The content of a file, None if there is none."""
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _chunk(self, number: int) -> str:
        return f"{self.path}/chunks/{number:016d}.json"

    def _name(self, number: int) -> str:
        return f"{self.path}/manifests/{number:020d}.json"

    def _publish(self, manifest: Manifest) -> None:
        """Create the manifest's file, whole, unless it exists; a full chunk of manifests is written once more together."""
        if not self.create(self._name(manifest.number), json.dumps(asdict(manifest))):
            raise CommitRefused(self._name(manifest.number))
        if manifest.number % self.CHUNK == 0:
            known = self.manifests()[manifest.number - self.CHUNK : manifest.number]
            self.create(self._chunk(manifest.number // self.CHUNK - 1), json.dumps([asdict(m) for m in known]))

    def create(self, target: str, text: str) -> bool:
        """Create a file with its whole content, unless there is one: whether it was created."""
        if self._local:
            folder = os.path.dirname(target.removeprefix("file://").removeprefix("file:"))
            os.makedirs(folder, exist_ok=True)
            handle, temporary = tempfile.mkstemp(dir=folder, prefix=".new-")
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temporary, os.path.join(folder, os.path.basename(target)))
            except FileExistsError:
                return False
            finally:
                os.unlink(temporary)
            return True
        temporary = self._path(f"{target.rpartition('/')[0]}/.new-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if self._fs.exists(self._path(target)) or not self._fs.rename(temporary, self._path(target)):
            self._fs.delete(temporary, False)
            return False
        return True

    def _files(self, manifests: list[Manifest]) -> list[str]:
        start = max((i for i, m in enumerate(manifests) if m.compacts), default=0)
        return [f"{self.path}/data/{f}" for m in manifests[start:] for f in m.files]

    # reading

    def read(self, upto: int | None = None, after: int = 0) -> EventLog:
        """The log as of commit ``upto`` (now, if None); with ``after``, only the events of later commits."""
        known = self.manifests()[:upto]
        if after:
            files = [f"{self.path}/data/{f}" for m in known[after:] if not m.compacts for f in m.files]
        else:
            files = self._files(known)
        reader = self.spark.read.schema(ENVELOPE)
        return EventLog(reader.parquet(*files) if files else self.spark.createDataFrame([], ENVELOPE))

    def last_commit(self) -> int:
        return len(self.manifests())

    def position(self) -> int:
        """The last global version."""
        known = self.manifests()
        return known[-1].position if known else 0

    def head(self, stream_id: str) -> int:
        """Version of the stream's last event, 0 if there is none."""
        for m in reversed(self.manifests()):
            if m.heads is not None:
                if stream_id in m.heads:
                    return m.heads[stream_id]
            elif m.heads_at:
                found = self._heads_table([m.heads_at]).where(F.col("stream_id") == stream_id).agg(F.max("head")).first()[0]
                if found or m.all_heads:
                    return found or 0
        return 0

    def heads(self) -> DataFrame:
        """stream_id, head of all streams, from the tables of heads alone."""
        tables, listed = [], {}
        for m in reversed(self.manifests()):
            if m.heads is not None:
                listed |= {s: h for s, h in m.heads.items() if s not in listed}
            elif m.heads_at:
                tables.append(m.heads_at)
                if m.all_heads:
                    break
        few = self.spark.createDataFrame(list(listed.items()), self.HEADS)
        return self._heads_table(tables).unionByName(few).groupBy("stream_id").agg(F.max("head").alias("head")) if tables else few

    HEADS = "stream_id string, head long"

    def _heads_table(self, labels: list[str]) -> DataFrame:
        return self.spark.read.schema(self.HEADS).parquet(*(f"{self.path}/heads/{x}" for x in labels))

    def _write_heads(self, new: DataFrame, known: list[Manifest]) -> tuple[str, bool]:
        """Write the heads of a commit, with those of all streams if many tables have gathered since these were last written."""
        since = 0
        for m in reversed(known):
            since += m.heads_at is not None
            if m.all_heads:
                break
        every = since >= self.DELTAS
        rows = self.heads().unionByName(new).groupBy("stream_id").agg(F.max("head").alias("head")) if every else new
        label = uuid.uuid4().hex
        rows.sortWithinPartitions("stream_id").write.parquet(f"{self.path}/heads/{label}")
        return label, every

    # writing

    def append(self, rows: DataFrame | list[dict], expected: StreamState = ANY) -> AppendResult:
        """Append events of ONE stream, in the order of ``batch_pos`` (or of the list), if the stream is as expected.

        Columns: stream_id, event_type, payload; optional event_id, aggregate_id, metadata, occurred_at. Versions are
        assigned here, whatever the rows say. An empty batch succeeds and writes nothing.
        """
        if self.closed:
            raise StoreClosed(self.path)
        batch = self._batch(rows)
        info = batch.agg(F.count(F.lit(1)), F.min("stream_id"), F.max("stream_id"), F.count("stream_id")).first()
        count, stream, other, named = info
        if not count:
            return AppendResult(True, "", 0)
        if stream != other or named != count:
            raise InvalidBatch("the events of a batch belong to one stream")
        while True:
            known = list(self.manifests())
            head = self.head(stream)
            check_state(stream, expected, head)
            base = known[-1].position if known else 0
            own = Window.partitionBy("stream_id").orderBy("batch_pos")
            at = F.row_number().over(own).cast("long")
            files = self._write(batch.withColumns({"version": at + head, "global_version": at + base}))
            try:
                self._publish(Manifest(len(known) + 1, files, base + count, count, {stream: head + count}))
            except CommitRefused:
                continue  # the expectation is checked against the new head
            return AppendResult(True, stream, head + count)

    def append_all(self, rows: DataFrame, order: list[str], expected: DataFrame | None = None) -> DataFrame:
        """Append events of many streams in one commit. ``order`` is total on the whole batch.

        ``expected`` (stream_id, expected: a raw stream state) is checked for all streams first; if any fails, nothing is
        written and the first failure by name is raised, as ``append`` raises it. Returns the streams written with their heads. The batch
        is laid out once, in ranges of ``order``; both numberings are counted on that layout.
        """
        if self.closed:
            raise StoreClosed(self.path)
        p, by = "__part", [F.col(c).asc_nulls_last() for c in order]
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        laid = keep(self._batch(rows).repartitionByRange(parts, *by).withColumn(p, F.spark_partition_id()), "batch")
        counts = keep(laid.groupBy(p, "stream_id").agg(F.count(F.lit(1)).alias("__n")), "counts")
        count = counts.agg(F.sum("__n")).first()[0] or 0
        ahead = lambda w: F.coalesce(F.sum("__n").over(w.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        of_part = counts.groupBy(p).agg(F.sum("__n").alias("__n")).select(p, ahead(Window.partitionBy()).alias("__g"))  # one row a part
        own = Window.partitionBy(p)
        numbered = laid.withColumn("__i", F.row_number().over(own.orderBy(*by))).withColumn("__j", F.row_number().over(Window.partitionBy(p, "stream_id").orderBy(*by)))
        sizes = counts.groupBy("stream_id").agg(F.sum("__n").alias("__n"))
        while True:
            known = list(self.manifests())
            base = known[-1].position if known else 0
            heads = self.heads()
            if expected is not None:
                state = expected.join(heads, "stream_id", "left").withColumn("head", F.coalesce("head", F.lit(0)))
                wrong = state.where(((F.col("expected") >= 0) & (F.col("expected") != F.col("head"))) | ((F.col("expected") == -2) & (F.col("head") == 0)) | (F.col("expected") < -2))
                first = wrong.orderBy("stream_id").first()
                if first:
                    code = first["expected"]
                    check_state(first["stream_id"], Revision(code) if code > 0 else StreamState(code), first["head"])
            if not count:
                return heads.limit(0)
            touched = keep(sizes.join(heads, "stream_id", "left").select("stream_id", F.coalesce("head", F.lit(0)).alias("head"), "__n"), "touched")
            of_stream = counts.select(p, "stream_id", ahead(Window.partitionBy("stream_id")).alias("__v")).join(touched.drop("__n"), "stream_id")
            ready = numbered.join(of_part, p).join(of_stream, [p, "stream_id"])
            files = self._write(ready.withColumns({"version": F.col("__j") + F.col("__v") + F.col("head"), "global_version": F.col("__i") + F.col("__g") + base}))
            new = touched.select("stream_id", (F.col("head") + F.col("__n")).alias("head"))
            few = new.limit(self.LISTED_HEADS + 1).collect()
            manifest = Manifest(len(known) + 1, files, base + count, count, {r["stream_id"]: r["head"] for r in few})
            if len(few) > self.LISTED_HEADS:
                manifest.heads, (manifest.heads_at, manifest.all_heads) = None, self._write_heads(new, known)
            try:
                self._publish(manifest)
            except CommitRefused:
                continue
            return new

    def restore(self, events: DataFrame) -> None:
        """Fill an empty store with the numbered events of another log (as ``read`` gives them), as one commit sorted by stream and version."""
        if self.manifests():
            raise LogError(f"{self.path} is not empty")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        files = self._write(events.repartitionByRange(parts, "stream_id", "version").sortWithinPartitions("stream_id", "version"), raw=True)
        written = self.spark.read.schema(ENVELOPE).parquet(*(f"{self.path}/data/{f}" for f in files))
        position, count = written.agg(F.max("global_version"), F.count(F.lit(1))).first()
        label, _ = self._write_heads(written.groupBy("stream_id").agg(F.max("version").alias("head")), [])
        self._publish(Manifest(1, files, position or 0, count, None, heads_at=label, all_heads=True))

    def compact(self, streams_per_file: int = 0) -> int:
        """Rewrite all data as few files sorted by stream and version, whose statistics let a stream's scan skip the rest."""
        known = list(self.manifests())
        rows = self.read().events
        label = uuid.uuid4().hex
        self.heads().sortWithinPartitions("stream_id").write.parquet(f"{self.path}/heads/{label}")
        parts = max(1, sum(m.events for m in known) // 5_000_000)
        files = self._write(rows.repartitionByRange(parts, "stream_id", "version").sortWithinPartitions("stream_id", "version"), raw=True)
        self._publish(Manifest(len(known) + 1, files, self.position(), 0, None, compacts=True, heads_at=label, all_heads=True))
        return len(files)

    def _batch(self, rows: DataFrame | list[dict]) -> DataFrame:
        if isinstance(rows, list):
            fields = "batch_pos long, event_id string, stream_id string, aggregate_id string, event_type string, payload string, metadata map<string,string>, occurred_at timestamp"
            names = [f.split()[0] for f in fields.split(", ")]
            filled = [tuple(i if n == "batch_pos" else r.get(n) for n in names) for i, r in enumerate(rows)]
            rows = self.spark.createDataFrame(filled, fields)
        defaults = {
            "event_id": F.uuid(),
            "aggregate_id": F.col("stream_id"),
            "metadata": F.create_map().cast("map<string,string>"),
            "occurred_at": F.current_timestamp(),
        }
        out = rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in defaults.items()})
        return out if "batch_pos" in out.columns else out.withColumn("batch_pos", F.monotonically_increasing_id())

    def _write(self, rows: DataFrame, raw: bool = False) -> list[str]:
        """Write invisible files; names relative to ``data/``."""
        label = uuid.uuid4().hex
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in ENVELOPE.fields))
        (rows if raw else rows.sortWithinPartitions("stream_id", "version")).write.parquet(f"{self.path}/data/{label}")
        found = self._fs.listStatus(self._path(f"{self.path}/data/{label}"))
        return [f"{label}/{s.getPath().getName()}" for s in found if s.getPath().getName().endswith(".parquet")]

    def retrying(self, attempt: Callable[[], AppendResult], retries: int = 10, pause: float = 0.05, on: Iterable[type[Exception]] = (RevisionConflict,)) -> AppendResult:
        """Run ``attempt`` again after a conflict, with growing pauses."""
        for i in range(retries + 1):
            try:
                return attempt()
            except tuple(on):
                if i == retries:
                    raise
                time.sleep(pause * 2**i)
        raise AssertionError


class MemoryStore:
    """A small log in the driver's memory, for tests and tools: appends as ``LogStore`` does them, reads as a DataFrame."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.closed = spark, False
        self._rows: list[dict] = []
        self._heads: dict[str, int] = {}
        self._lock = threading.Lock()

    def close(self) -> None:
        self.closed = True

    def append(self, rows: list[dict], expected: StreamState = ANY) -> AppendResult:
        """All events of one stream, or none."""
        with self._lock:
            if self.closed:
                raise StoreClosed("memory")
            if not rows:
                return AppendResult(True, "", 0)
            streams = {r.get("stream_id") for r in rows}
            if len(streams) > 1 or None in streams:
                raise InvalidBatch("the events of a batch belong to one stream")
            stream = streams.pop()
            head = self._heads.get(stream, 0)
            check_state(stream, expected, head)
            now = datetime.now(timezone.utc)
            for i, r in enumerate(rows, 1):
                filled = {"event_id": str(uuid.uuid4()), "aggregate_id": stream, "metadata": {}, "occurred_at": now, "payload": None}
                filled |= {k: v for k, v in r.items() if v is not None}
                self._rows.append(filled | {"version": head + i, "global_version": len(self._rows) + 1})
            self._heads[stream] = head + len(rows)
            return AppendResult(True, stream, head + len(rows))

    def head(self, stream_id: str) -> int:
        with self._lock:
            return self._heads.get(stream_id, 0)

    def position(self) -> int:
        with self._lock:
            return len(self._rows)

    def read(self) -> EventLog:
        with self._lock:
            if self.closed:
                raise StoreClosed("memory")
            return in_memory(self.spark, list(self._rows))
