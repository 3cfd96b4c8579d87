"""Named, filtered, resumable subscriptions to a LogStore.

The stream is the folder of manifests: a micro-batch is a range of commits, read as Parquet files with the filters pushed
into the scan. The checkpoint holds which manifests were seen, a cursor file holds, by micro-batch, up to which commit a batch
goes; a batch always starts where the one before ended, so order is that of the log however the file source lists its
files. A handler that raises leaves the batch to be delivered again, whole: at least once, so sinks go by batch id or global version.

A name runs once, in whatever process: who subscribes takes a lease, a numbered file that is created only if absent, renews it with the
next number while it delivers, and stops when another has taken it. Others wait until it is given back or has run out.
"""

from __future__ import annotations

import bisect
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.envelope import ENVELOPE
from tidelog.errors import DuplicateHandler, LeaseLost, SkippedEvent
from tidelog.plans.commit import LogStore
from tidelog.registry import any_of

Handler = Callable[[DataFrame, int], None]


@dataclass
class Subscription:
    name: str
    handler: Handler
    types: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    start: int = 0
    commits_per_batch: int = 100
    dead_letters: str | None = None
    lease_seconds: float = 60.0
    query: StreamingQuery | None = None
    errors: list[str] = field(default_factory=list)
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)


def matches(sub: Subscription) -> Column:
    """Whether a subscription wants an event: its types and prefixes; none are all."""
    types = F.col("event_type").isin(list(sub.types)) if sub.types else F.lit(True)
    wanted = any_of([F.col("stream_id").startswith(p) for p in sub.prefixes])
    return (types if wanted is None else types & wanted) & (F.col("global_version") > sub.start)


def fan_out(log: DataFrame, subscriptions: list[Subscription]) -> DataFrame:
    """Each event once for each subscription that wants it, with the subscription's ``name``; the log is read once."""
    names = F.array_compact(F.array(*(F.when(matches(s), s.name) for s in subscriptions)))
    return log.withColumn("name", F.explode(names))


class Subscriptions:
    """Subscriptions of one store; a name is active once."""

    def __init__(self, store: LogStore, folder: str | None = None) -> None:
        self.store, self.spark = store, store.spark
        self.folder = (folder or f"{store.path}/subscriptions").rstrip("/")
        self._active: dict[str, Subscription] = {}
        self._middleware: list[Callable[[Handler], Handler]] = []

    def use(self, *middleware: Callable[[Handler], Handler]) -> None:
        """Wrap the handlers of subscriptions that start from now on; the first one added is outermost."""
        self._middleware += middleware

    def listening(self) -> list[str]:
        """Names that run in this process."""
        return [n for n, s in self._active.items() if s.query and s.query.isActive]

    def errors(self) -> dict[str, list[str]]:
        """What went wrong, by name."""
        return {n: list(s.errors) for n, s in self._active.items() if s.errors}

    def subscribe(
        self,
        name: str,
        handler: Handler,
        types: Iterable[str] = (),
        prefixes: Iterable[str] = (),
        start: int = 0,
        commits_per_batch: int = 100,
        dead_letters: str | None = None,
        interval: str | None = None,
        lease_seconds: float = 60.0,
    ) -> Subscription:
        """Start delivering events to ``handler(events, batch_id)``.

        ``types`` and ``prefixes``: none are all. ``start``: a new subscription begins after this global version; one that
        resumes goes on where it was. With ``dead_letters``, batches that the handler fails on are written there and
        passed over. ``interval`` keeps the subscription running; without it, it ends when it has caught up. A name that runs in
        this or another process is refused; one whose process died is free ``lease_seconds`` after its last batch.
        """
        if handler is None:
            raise ValueError("a subscription needs a handler")
        if name in self._active and self._active[name].query and self._active[name].query.isActive:
            raise DuplicateHandler(f"subscription {name!r} is active")
        for layer in reversed(self._middleware):
            handler = layer(handler)
        sub = Subscription(name, handler, tuple(types), tuple(prefixes), start, commits_per_batch, dead_letters, lease_seconds)
        if not self._take(sub):
            raise DuplicateHandler(f"subscription {name!r} runs in another process")
        known = self._cursor(name)
        if known is None:
            self._move(name, -1, bisect.bisect_right([m.position for m in self.store.manifests()], start) if start else 0, start)
        else:
            sub.start = known["start"]
        manifests = (
            self.spark.readStream.schema("number long")
            .option("maxFilesPerTrigger", commits_per_batch)
            .option("maxFileAge", "36500d")
            .option("pathGlobFilter", "*.json")
            .json(f"{self.store.path}/manifests")
        )
        writer = manifests.writeStream.queryName(re.sub(r"\W", "_", name)).option("checkpointLocation", f"{self.folder}/{name}/checkpoint").foreachBatch(lambda df, batch: self._deliver(sub, df, batch))
        writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
        sub.query = writer.start()
        self._active[name] = sub
        return sub

    def run(self, name: str, handler: Handler, **options: object) -> Subscription:
        """Deliver what is there, and return."""
        sub = self.subscribe(name, handler, **options)
        try:
            sub.query.awaitTermination()
        finally:
            self._give_back(sub)
        return sub

    def run_forever(self, name: str, handler: Handler, attempts: int = 100, pause: float = 0.1, longest: float = 10.0, **options: object) -> list[str]:
        """Run, and start again after failures with growing pauses, until it ends by itself or ``attempts`` in a row fail without
        a batch handled between them; then the last error is raised. Returns the errors on the way."""
        failed, errors = 0, []
        while True:
            before, sub = self.position(name), None
            try:
                sub = self.subscribe(name, handler, **options)
                sub.query.awaitTermination()
                return errors
            except Exception as e:  # noqa: BLE001
                errors.append(str(e))
                failed = 1 if self.position(name) > before else failed + 1
                if failed >= attempts:
                    raise
            finally:
                if sub:
                    self._give_back(sub)
            time.sleep(min(longest, pause * 2 ** (failed - 1)))

    def unsubscribe(self, name: str) -> None:
        sub = self._active.pop(name, None)
        if sub:
            if sub.query:
                sub.query.stop()
            self._give_back(sub)

    def close(self) -> None:
        for name in list(self._active):
            self.unsubscribe(name)

    # leases: files 1, 2, 3 ... of who holds the name until when; the last one counts

    def _lease(self, name: str) -> tuple[int, dict]:
        folder = self.store._path(f"{self.folder}/{name}/lease")
        names = [s.getPath().getName() for s in self.store._fs.listStatus(folder)] if self.store._fs.exists(folder) else []
        last = max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)
        text = self.store._text(f"{self.folder}/{name}/lease/{last:012d}.json") if last else None
        return last, json.loads(text) if text else {"owner": "", "until": 0.0}

    def _take(self, sub: Subscription) -> bool:
        """Take or renew the lease: false if another holds it."""
        last, now = self._lease(sub.name)
        if now["owner"] != sub.owner and now["until"] > time.time():
            return False
        if now["owner"] == sub.owner and now["until"] - time.time() > sub.lease_seconds / 2:
            return True
        return self._write_lease(sub, last + 1, time.time() + sub.lease_seconds)

    def _write_lease(self, sub: Subscription, number: int, until: float) -> bool:
        folder = f"{self.folder}/{sub.name}/lease"
        self.store._fs.mkdirs(self.store._path(folder))
        taken = self.store.create(f"{folder}/{number:012d}.json", json.dumps({"owner": sub.owner, "until": until}))
        if taken and number > 2:
            self.store._fs.delete(self.store._path(f"{folder}/{number - 2:012d}.json"), False)
        return taken

    def _give_back(self, sub: Subscription) -> None:
        last, now = self._lease(sub.name)
        if now["owner"] == sub.owner and now["until"] > 0:
            self._write_lease(sub, last + 1, 0.0)

    def position(self, name: str) -> int:
        """The last commit that the subscription has handled."""
        cursor = self._cursor(name)
        return cursor["commit"] if cursor else 0

    def _deliver(self, sub: Subscription, manifests: DataFrame, batch: int) -> None:
        if not self._take(sub):
            raise LeaseLost(f"another process took subscription {sub.name!r}")
        cursor = self._cursor(sub.name, before=batch)
        low, high = cursor["commit"], manifests.agg(F.max("number")).first()[0] or 0
        if high > low:  # commits before a start position are never read
            rows = self.store.read(upto=high, after=low).events.where(matches(sub))
            try:
                sub.handler(rows.orderBy("global_version"), batch)
            except SkippedEvent:
                pass
            except Exception as e:
                sub.errors.append(str(e))
                if not sub.dead_letters:
                    raise
                rows.withColumn("subscription", F.lit(sub.name)).withColumn("batch_id", F.lit(batch)).withColumn("error", F.lit(str(e)[:2000])).write.mode("append").parquet(sub.dead_letters)
        self._move(sub.name, batch, max(low, high), sub.start)

    # cursors: one small file for each micro-batch, so that a batch that is delivered again starts where it did before

    def _file(self, name: str, batch: int) -> object:
        return self.store._path(f"{self.folder}/{name}/cursor/{batch + 1:012d}.json")

    def _move(self, name: str, batch: int, commit: int, start: int) -> None:
        out = self.store._fs.create(self._file(name, batch), True)
        out.write(bytearray(json.dumps({"batch": batch, "commit": commit, "start": start}), "utf-8"))
        out.close()

    def _cursor(self, name: str, before: int | None = None) -> dict | None:
        folder = self.store._path(f"{self.folder}/{name}/cursor")
        if not self.store._fs.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in self.store._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if before is not None:
            names = [n for n in names if int(n.split(".")[0]) <= before]
        if not names:
            return None
        return json.loads(self.store._text(f"{self.folder}/{name}/cursor/{names[-1]}"))


def processor(react: Callable[[Any], Iterable[Any]], dispatch: Callable[[Any], Any]) -> Handler:
    """A handler that turns events into commands and has them decided, in the order of the log.

    ``react(event)`` gives the commands of an event (none: passed over); ``dispatch`` is that of a command bus or a command handler. A command that a
    rule rejects counts as handled; any other error leaves the batch to come again, so commands should bear being given twice.
    """

    def handler(events: DataFrame, batch: int) -> None:
        for event in events.toLocalIterator():
            for command in react(event):
                try:
                    dispatch(command)
                except Exception as e:
                    if not getattr(e, "rejects", False):
                        raise

    return handler


def spooled(path: str) -> Handler:
    """A handler that leaves each batch as JSON lines in a folder of its own; the same batch again replaces it."""

    def handler(events: DataFrame, batch: int) -> None:
        events.write.mode("overwrite").json(f"{path}/batch={batch}")

    return handler


def drain_spool(spark: SparkSession, path: str, handler: Handler) -> int:
    """Give the complete batches of a spool to ``handler``, in order, and delete each once it is handled; how many.

    A handler that raises leaves its batch and those after it. A batch is moved away before it is deleted, so what a crash leaves of one that
    was handled is not given again: it is swept by the next call. Batches that are still being written are left alone.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path
    files = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where(path)):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(where(path))]
    for done in (n for n in names if n.startswith("done-")):
        files.delete(where(f"{path}/{done}"), True)
    handled = 0
    for batch in sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")):
        folder = f"{path}/batch={batch}"
        if not files.exists(where(f"{folder}/_SUCCESS")):
            continue
        handler(spark.read.schema(ENVELOPE).json(folder), batch)
        files.rename(where(folder), where(f"{path}/done-{batch}"))
        files.delete(where(f"{path}/done-{batch}"), True)
        handled += 1
    return handled
