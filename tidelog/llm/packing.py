"""Best-fit decreasing packing of tokenised documents into windows.

Every document is encoded once, cut into full windows and one remainder, and its pieces are written to the
shared folder. Best fit only looks at lengths, of which there are at most ``window``, so the driver plans it on
counts by length: a segment tree over remaining capacity finds the tightest open window for the next length, and all
windows in one state are filled at once. The plan says, for ranks of a length, which windows they go to; it has a
number of rows bounded by the window size (a few for each length and window state), not by the corpus. Pieces
are ranked by length without a global sort: tasks count as they encode, and the counts are summed up.

A null or empty text is the end id alone. Repeated rows are packed each, a null id is packed as any. An empty table has no pieces. Texts are
encoded whole, a slice at a time. Pieces of one length are interchangeable: among them the order of tasks and rows decides, and between
open windows of one capacity the one opened last. Extra columns are not carried, so their names may be any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.batches import bounded_batches
from tidelog.llm.bpe import WordBpe
from tidelog.llm.words import Hasher, chunks
from tidelog.plans.scratch import keep

WINDOW = 2048
END_ID = 1


class CapacityTree:
    """A segment tree over capacities 0 to n: which have open windows, and the least of these from l up."""

    def __init__(self, n: int) -> None:
        self.size = 1 << (n + 1).bit_length()
        self.open = [0] * (2 * self.size)

    def set(self, capacity: int, count: int) -> None:
        i = capacity + self.size
        self.open[i] = count
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] + self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:  # up, until a right neighbour has something, then down to its leftmost
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


@dataclass
class Plan:
    """Run j: pieces of ``length`` with ranks from ``rank`` go ``per`` to a window, from ``sequence`` on, at ``offset``."""

    sequences: int = 0
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)

    def run(self, length: int, rank: int, sequence: int, per: int, offset: int) -> None:
        for name, value in zip(("length", "rank", "sequence", "per", "offset"), (length, rank, sequence, per, offset), strict=True):
            getattr(self, name).append(value)


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """The packing that best fit finds when pieces come longest first."""
    plan, tree = Plan(), CapacityTree(window)
    opened: dict[int, list[tuple[int, int]]] = {}  # by remaining capacity: first window, how many

    def leave(capacity: int, first: int, many: int) -> None:
        if capacity and many:
            opened.setdefault(capacity, []).append((first, many))
            tree.set(capacity, len(opened[capacity]))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:  # only new windows are left
                capacity, first, many = window, plan.sequences, -(-left // (window // length))
                plan.sequences += many
            else:
                first, many = opened[capacity].pop()
                tree.set(capacity, len(opened[capacity]))
            per = capacity // length  # the window just used stays the tightest until it is full
            full = min(many, left // per)
            rest = left - full * per if full < many else 0
            plan.run(length, rank, first, per, window - capacity)
            leave(capacity - per * length, first, full)
            if rest:
                leave(capacity - rest * length, first + full, 1)
            leave(capacity, first + full + (rest > 0), many - full - (rest > 0))
            rank += full * per + rest
            left -= full * per + rest
    return plan


def encoded(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """doc_id and text to pieces; ``nth`` counts the pieces of a length in this task."""
    bpe, hasher = WordBpe(path), Hasher()
    task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
    for batch in batches:
        for part, data, offsets in chunks(batch):
            ids, total = bpe.texts(data, offsets, hasher, end_id)
            pieces = -(-total // window)
            doc = np.repeat(np.arange(len(total)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(total[doc] - start, window)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order)))) + seen[ordered]
            seen += np.bincount(length, minlength=window + 1)
            bounds = np.concatenate(([0], np.cumsum(length))).astype(np.int32) * 4
            binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(total[doc]), binary, pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)],
                names=["doc_id", "start", "length", "doc_tokens", "ids", "task", "nth"],
            )


def placed(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Replace ``rank`` (within the length) by sequence_id and offset."""
    length, rank, sequence, per, offset = (np.array(getattr(plan, k), np.int64) for k in ("length", "rank", "sequence", "per", "offset"))
    order = np.lexsort((rank, length))
    length, rank, sequence, per, offset = (x[order] for x in (length, rank, sequence, per, offset))
    where = {int(l): (int(a), int(b)) for l, a, b in zip(*np.unique(length, return_index=True), np.append(np.unique(length, return_index=True)[1][1:], len(length)), strict=True)}
    for batch in batches:
        own, nth = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        run = np.empty(len(own), np.int64)
        for l in np.unique(own):
            a, b = where[int(l)]
            mine = own == l
            run[mine] = a + np.searchsorted(rank[a:b], nth[mine], side="right") - 1
        i = nth - rank[run]
        columns = {name: batch.column(name) for name in batch.schema.names if name != "rank"}
        columns |= {"sequence_id": pa.array(sequence[run] + i // per[run]), "offset": pa.array(offset[run] + i % per[run] * own)}
        yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


class Packing:
    """pieces: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), in the shared folder."""

    def __init__(self, pieces: DataFrame, ranks: DataFrame, plan: Plan, window: int) -> None:
        self.pieces, self._ranks, self.plan, self.window = pieces, ranks, plan, window

    def placement(self, **extra: Column) -> DataFrame:
        """Each piece's sequence_id and offset, with columns made from the piece (such as a digest of its ids)."""
        slim = self.pieces.select("doc_id", "start", "length", "doc_tokens", "task", "nth", *(c.alias(n) for n, c in extra.items()))
        ranked = slim.join(self._ranks.hint("merge"), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before")).drop("task", "nth", "before")
        plan, fields = self.plan, [f for f in ranked.schema if f.name != "rank"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
        return ranked.mapInArrow(lambda batches: placed(batches, plan), schema)

    def sequences(self, pad_id: int = 0) -> DataFrame:
        """sequence_id, tokens (a window of ids, padded), doc_ids in order. A sequence is one window: bounded."""
        packed = self.placement(ids=F.col("ids")).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
        joined = F.aggregate("p", F.lit("").cast("string"), lambda acc, x: F.concat(acc, F.hex(x["ids"])))
        pad = F.lit(pad_id.to_bytes(4, "little").hex().upper())
        return packed.select("sequence_id", F.unhex(F.rpad(joined, self.window * 8, pad)).alias("tokens"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> Packing:
    """tokenizer: path of the vocabulary file, which executors have too."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    made = slim.mapInArrow(lambda batches: encoded(batches, tokenizer, window, end_id), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, task int, nth long")
    pieces = keep(made, "pieces")
    counts = keep(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most window rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return Packing(pieces, ranks, best_fit_decreasing(totals, window), window)
