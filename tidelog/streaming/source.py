"""A log as a streaming source: ``spark.readStream.format("tidelog").option("path", ...)``.

The offset is the number of a commit. A micro-batch reads the Parquet files of the commits since the last one, a partition
for each file on the executors; files that no manifest names do not exist for it. ``commits_per_batch`` bounds
a micro-batch, ``start`` skips commits of a new stream. The options ``stream_id``, ``types`` (comma-separated) and ``after`` (a global version) are
filters that reach the Parquet reader, where row groups are skipped by their statistics. Rows travel as Arrow batches. The batch form
reads the whole log as of now; in the process that has a ``LogStore``, its ``read`` is the shorter way.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidelog.envelope import ENVELOPE


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _filesystem(path: str) -> tuple:
    """A file system and a path in it, from a local path or a URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def _manifests(path: str, known: int = 0) -> list[dict]:
    """Manifests after number ``known``, in order and without a gap."""
    files, root = _filesystem(path)
    out = []
    while True:
        name = f"{root}/manifests/{known + len(out) + 1:020d}.json"
        if files.get_file_info(name).type.name != "File":
            return out
        with files.open_input_stream(name) as f:
            out.append(json.loads(f.read()))


def _wanted(options: dict) -> object:
    """The filters of the options as one Arrow expression, None without any."""
    from pyarrow import compute as pc

    conditions = []
    if options.get("stream_id"):
        conditions.append(pc.field("stream_id") == options["stream_id"])
    if options.get("types"):
        conditions.append(pc.field("event_type").isin([t for t in options["types"].split(",") if t]))
    if options.get("after"):
        conditions.append(pc.field("global_version") > int(options["after"]))
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def _read(path: str, options: dict) -> Iterator:
    """Arrow batches of a file, in the envelope's columns."""
    import pyarrow as pa
    from pyarrow import dataset

    files, root = _filesystem(path)
    scan = dataset.dataset(root, filesystem=files, format="parquet").scanner(columns=ENVELOPE.fieldNames(), filter=_wanted(options), batch_size=8192)
    for batch in scan.to_batches():
        if batch.num_rows:
            at = batch.schema.get_field_index("occurred_at")
            yield batch.set_column(at, "occurred_at", batch.column(at).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")))


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.options = options["path"].rstrip("/"), dict(options)
        self.start, self.most = int(options.get("start", 0)), int(options.get("commits_per_batch", 0))
        self.known: list[dict] = []
        self.given: int | None = None

    def initialOffset(self) -> dict:
        return {"commit": self.start}

    def latestOffset(self) -> dict:
        self.known += _manifests(self.path, len(self.known))
        last = len(self.known)
        if self.most:
            last = min(last, (self.start if self.given is None else self.given) + self.most)
        self.given = last
        return {"commit": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known += _manifests(self.path, len(self.known))
        self.given = max(self.given or 0, end["commit"])
        return [_File(f"{self.path}/data/{f}") for m in self.known[start["commit"] : end["commit"]] if not m["compacts"] for f in m["files"]]

    def read(self, partition: _File) -> Iterator:
        return _read(partition.path, self.options)

    def commit(self, end: dict) -> None:
        pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.options = options["path"].rstrip("/"), dict(options)

    def partitions(self) -> list[InputPartition]:
        known = _manifests(self.path)
        first = max((i for i, m in enumerate(known) if m["compacts"]), default=0)
        return [_File(f"{self.path}/data/{f}") for m in known[first:] for f in m["files"]] or [_File("")]

    def read(self, partition: _File) -> Iterator:
        return _read(partition.path, self.options) if partition.path else iter([])


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self):  # noqa: ANN201
        return ENVELOPE

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
