"""Removal of passages of 50 words that an earlier document has, by a count-min prefilter.

1. Partition sketches. A window's cells are found from the least hash among the 10-word runs in it (its representative), a hash
   function of the window that neighbours mostly share: about 1 in 20 windows begins a new *run* of windows with one
   representative, and a run is counted once in each of ``ROWS`` rows of ``CELLS`` cells. Equal windows have equal representatives,
   so a cell counts at least the documents that a window occurs in.
2. The partition sketches are merged cell by cell, in a tree (by part of the sketch and a share of the partitions, then by part),
   into a sketch of fixed width, of which only *counted twice or more* is kept: ``ROWS * CELLS`` bits (16 MB), whatever the corpus.
3. A second pass looks every window's cells up and lets those through that all rows count twice or more; a window that repeats is never lost,
   the fuller the sketch is the more others come along.
4. What is left is grouped exactly. Runs with the same windows (128-bit hash) form a class, owned by its smallest doc_id; every
   other document of the class loses the whole run. Only the owner's runs whose representative occurs in several classes are looked at
   window by window (128-bit hash of the words), for windows that a smaller doc_id has in another class. Classes,
   representatives and windows of very many rows are dealt over several tasks.
5. Each document's removed windows are gathered and its words are written without them.

Words are runs of bytes other than space, tab and line breaks. A null text has none. A row whose doc_id is null
loses nothing and owns nothing. Rows that share a doc_id take nothing from each other; they are told apart by a
hash of the text. Among equal windows the smallest doc_id keeps its words, so there are no ties. Texts under 50 words are left alone, whole texts are
used, however long. Columns other than the text are carried as they are. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidelog.llm.batches import bounded_batches
from tidelog.llm.words import Hasher, Windows, Words, buffers, chunks, covered, mix, ranges
from tidelog.plans.scratch import keep
from tidelog.plans.skew import spread_join

WINDOW, GRAM = 50, 10
#: Rows of the sketch, cells of a row, and cells of the parts in which it is merged. Wider sketches let fewer windows through.
ROWS, CELLS, PART = 2, 1 << 26, 1 << 19
#: Values that a partition gathers before it hands its sketch on; shares of the partitions that are merged first.
GATHERED, SHARES = 1 << 22, 16
_SECOND = 0x9FB21C651E98DF25


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(x[i : i + width]), where all of it is inside; the rest of out is as if x went on with large values."""
    out, span = x.copy(), 1
    while span < width:
        step = min(span, width - span)
        out[:-step] = np.minimum(out[:-step], out[step:]) if step < len(out) else out[:-step]
        span += step
    return out


def runs_of(words: np.ndarray, first: np.ndarray, gram_windows: Windows, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one representative: text, first and last window (positions in words), representative."""
    at, _, keys = gram_windows(words, first, gram)
    grams = np.full(len(words), 2**64 - 1, np.uint64)
    grams[at] = keys
    least = sliding_min(grams, window - gram + 1)
    count = np.maximum(np.diff(first) - window + 1, 0)
    start = ranges(first[:-1], count)
    text = np.repeat(np.arange(len(count)), count)
    value = least[start]
    new = np.append(True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])) if len(start) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(start)) - 1
    return text[begin], start[begin], start[end] if len(begin) else start[:0], value[begin]


def cells_of(value: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each representative in a row of the sketch; ``cells`` is a power of two."""
    return mix(value ^ np.uint64(0x2545F4914F6CDD1D * (row + 1) & (2**64 - 1))) & np.uint64(cells - 1)


SKETCH = "row int, part int, share int, once binary, more binary"


def sketched(batches: Iterator[pa.RecordBatch], window: int, gram: int, cells: int) -> Iterator[pa.RecordBatch]:
    """The sketch of a partition's texts by parts: places of the cells counted once, and of those counted more often."""
    hasher, one = Hasher(), Windows()
    share, held, n = TaskContext.get().partitionId() % SHARES, [], 0

    def parts() -> pa.RecordBatch:
        out = []
        for row in range(ROWS):
            cell, count = np.unique(cells_of(np.concatenate(held), row, cells), return_counts=True)
            bounds = np.searchsorted(cell, np.arange(0, cells + 1, min(PART, cells)).astype(np.uint64))
            for part in np.flatnonzero(np.diff(bounds)):
                at, often = (cell[bounds[part] : bounds[part + 1]] % np.uint64(PART)).astype("<u4"), count[bounds[part] : bounds[part + 1]] > 1
                out.append((row, int(part), share, at[~often].tobytes(), at[often].tobytes()))
        return _rows(out, SKETCH)

    for batch in batches:
        for _, data, offsets in chunks(batch):
            w = Words(data, offsets)
            value = runs_of(hasher(data, w.starts, w.ends), w.first, one, window, gram)[3]
            held, n = [*held, value], n + len(value)
            if n > GATHERED:
                yield parts()
                held, n = [], 0
    if n:
        yield parts()


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of sketches summed cell by cell (counts stop at 2); a task holds its own parts of the fixed sketch, one byte a cell."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            if (r["row"], r["part"]) not in sums:
                sums[r["row"], r["part"]] = np.zeros(PART, np.uint8)
            cell = sums[r["row"], r["part"]]
            once = np.frombuffer(r["once"], "<u4")
            cell[once] = np.minimum(cell[once] + 1, 2)
            cell[np.frombuffer(r["more"], "<u4")] = 2
    for (row, part), cell in sums.items():
        yield _rows([(row, part, 0, np.flatnonzero(cell == 1).astype("<u4").tobytes(), np.flatnonzero(cell == 2).astype("<u4").tobytes())], SKETCH)


def passes(value: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which representatives the sketch (rows by bits of cells) counts twice or more in every row."""
    out = np.ones(len(value), bool)
    for row in range(len(twice)):
        cell = cells_of(value, row, twice.shape[1] * 8)
        out &= (twice[row][(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def repeated_runs(batches: Iterator[pa.RecordBatch], window: int, gram: int, sketch: object) -> Iterator[pa.RecordBatch]:
    """doc_id, text, fp to the runs that the sketch lets through: lo and hi count windows from 0; a, b hash all windows of the run."""
    hasher, one, two, twice = Hasher(), Windows(), Windows(_SECOND), sketch.value
    for batch in batches:
        for part, data, offsets in chunks(batch):
            w = Words(data, offsets)
            words = hasher(data, w.starts, w.ends)
            text, lo, hi, value = runs_of(words, w.first, one, window, gram)
            some = passes(value, twice)
            text, lo, hi, value = text[some], lo[some], hi[some], value[some]
            size = hi - lo + 1
            head, at = np.cumsum(size) - size, ranges(lo, size)
            place = ((np.arange(len(at)) - np.repeat(head, size)).astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
            of = lambda fold: np.add.reduceat(mix(fold.fold(words, window)[at] ^ place), head) if len(at) else np.empty(0, np.uint64)  # noqa: B023, E731
            where, signed = pa.array(text), lambda x: pa.array(x.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(where), part.column("fp").take(where), pa.array((lo - w.first[text]).astype(np.int32)), pa.array((hi - w.first[text]).astype(np.int32)), signed(value), signed(of(one)), signed(of(two))],
                names=["doc_id", "fp", "lo", "hi", "value", "a", "b"],
            )


def window_hashes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """doc_id, fp, text, spans (of windows) to one row for each window in a span, with the hash of its words."""
    hasher, one, two = Hasher(), Windows(), Windows(_SECOND)
    for batch in batches:
        for part, data, offsets in chunks(batch):
            w = Words(data, offsets)
            words = hasher(data, w.starts, w.ends)
            spans = part.column("spans")
            lists = np.diff(spans.offsets.to_numpy())
            text = np.repeat(np.arange(part.num_rows), lists)
            flat = spans.flatten()
            lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            size = hi.astype(np.int64) - lo + 1
            own = np.repeat(text, size)
            at = ranges(lo.astype(np.int64), size)
            start = at + w.first[own]
            signed = lambda x: pa.array(x.view(np.int64))
            a, b = one.fold(words, window)[start], two.fold(words, window)[start]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(own)), part.column("fp").take(pa.array(own)), pa.array(at.astype(np.int32)), signed(a), signed(b)], names=["doc_id", "fp", "at", "a", "b"])


def rewritten(batches: Iterator[pa.RecordBatch], text: str, columns: tuple[str, ...], window: int) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their __spans, words joined by one space; with n_words and n_removed."""
    for batch in batches:
        texts, spans, kept, n_words, n_removed = batch.column(text), batch.column("__spans").to_pylist(), [], [], []
        for i, own in enumerate(spans):
            data, _ = buffers(texts.slice(i, 1))
            words = data.tobytes().split()
            gone = 0
            if own:
                lo, hi = np.array([s["lo"] for s in own]), np.array([s["hi"] for s in own])
                out = covered(ranges(lo, hi - lo + 1), window, len(words))
                gone = int(out.sum())
            n_words.append(len(words))
            n_removed.append(gone)
            kept.append(b" ".join(words if not gone else [words[j] for j in np.flatnonzero(~out)]))
        arrays = [pa.array(kept, pa.binary()).cast(pa.string()) if c == text else batch.column(c) for c in columns]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*columns, "__n_words", "__n_removed"])


def sketch_of(slim: DataFrame, window: int, gram: int, cells: int) -> np.ndarray:
    """The merged sketch: for each row, a bit a cell, set where it is counted twice or more. Its size is that of the parameters."""
    partial = keep(slim.select("text").mapInArrow(lambda batches: sketched(batches, window, gram, cells), SKETCH), "sketches")
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = partial.repartition(parts, "row", "part", "share").mapInArrow(merged, SKETCH)
    whole = some.repartition(parts, "row", "part").mapInArrow(merged, SKETCH).select("row", "part", "more")
    twice = np.zeros((ROWS, max(1, cells // 8)), np.uint8)
    for r in whole.toLocalIterator():  # at most ROWS * CELLS / PART rows
        cell = np.frombuffer(r["more"], "<u4").astype(np.int64) + r["part"] * PART
        np.bitwise_or.at(twice[r["row"]], cell >> 3, (1 << (cell & 7)).astype(np.uint8))
    return twice


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """doc_id, fp (a hash of the text), spans: the windows of each document that a smaller doc_id has too."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null").withColumn("fp", F.xxhash64("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, fp long, "
    sketch = docs.sparkSession.sparkContext.broadcast(sketch_of(slim, window, gram, cells))
    found = slim.mapInArrow(lambda batches: repeated_runs(batches, window, gram, sketch), schema + "lo int, hi int, value long, a long, b long")
    runs = keep(found.withColumn("n", F.col("hi") - F.col("lo")), "repeated")
    same, rows = ["value", "a", "b", "n"], F.count(F.lit(1)).alias("__rows")
    classes = keep(runs.groupBy(*same).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"), rows), "classes")
    several = keep(classes.groupBy("value").agg(F.count(F.lit(1)).alias("k"), F.sum("__rows").alias("__rows")).where("k > 1").select("value", "__rows"), "several")

    salt = F.struct("doc_id", "lo")
    shared = spread_join(runs, classes.where("owner < other").drop("other"), same, "__rows", salt)
    whole = shared.where("doc_id > owner").select("doc_id", "fp", "lo", "hi")
    firsts = classes.select(*same, F.col("owner").alias("doc_id"))  # one row a class: the document that owns it
    owned = spread_join(firsts, several, ["value"], "__rows", F.struct("a", "b"), "left_semi").withColumn("__rows", F.lit(1))
    looked = spread_join(runs, owned, [*same, "doc_id"], "__rows", F.col("lo"), "left_semi").groupBy("doc_id", "fp").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    texts = looked.join(slim, ["doc_id", "fp"]).select("doc_id", "fp", "text", "spans")
    windows = keep(texts.mapInArrow(lambda batches: window_hashes(batches, window), schema + "at int, a long, b long"), "windows")
    owners = keep(windows.groupBy("a", "b").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"), rows).where("owner < other").drop("other"), "owners")
    single = spread_join(windows, owners, ["a", "b"], "__rows", F.struct("doc_id", "at")).where("doc_id > owner").select("doc_id", "fp", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return whole.unionByName(single).groupBy("doc_id", "fp").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def drop_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: str = "n_words", n_removed: str = "n_removed", window: int = WINDOW) -> DataFrame:
    """docs with texts rewritten, and the two counts, which replace columns of their names."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(n_words, n_removed)
    spans = repeated_spans(docs, doc_id, text, window).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.col("spans").alias("__spans"))
    columns = tuple(docs.columns)
    joined = docs.join(spans, (F.col(doc_id) == F.col("__id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__fp")), "left").select(*columns, "__spans")
    fields = [StructField(f.name, StringType() if f.name == text else f.dataType) for f in docs.schema.fields]
    schema = StructType([*fields, StructField("__n_words", LongType()), StructField("__n_removed", LongType())])
    out = joined.mapInArrow(lambda batches: rewritten(batches, text, columns, window), schema)
    return out.withColumnsRenamed({"__n_words": n_words, "__n_removed": n_removed})
