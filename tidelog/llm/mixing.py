"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the schedule takes point k of a golden-ratio sequence (k times the golden ratio modulo 1, in 64-bit integers) through the cumulative
target shares, which names a source; the slots of a source are ranked, and rank r takes block r of the source: its
documents, laid end to end in a shuffled order that depends on the seed alone, cut into blocks of equal tokens (words
here) and repeated while the schedule asks for more. A source takes slots until its target is reached and passes the later ones over; one
that is short of slots when the sizes are used up goes on along the same sequence, to its next points there, which are found by the
recursion of Euclid's algorithm and not by trying. So a slot has one source, its number is the place of its block in the mix, and as
golden-ratio points have discrepancy O(log N / N), every prefix of the schedule is near the target weights.

Sizes: words of a text (null or empty text: 0; such documents are in the result and take nothing). A null source is a
source of its own, last in order. Documents that share id, size and text are interchangeable; repeated rows each have a place. The last block
of a source ends at its target, so each source's words taken are its target but for a fraction of a word. Texts of any length are laid
out whole, over as many blocks as they need. Columns of other names are not read by ``mix`` and are kept by ``mix_documents``. An empty table gives an
empty mix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.batches import bounded_batches
from tidelog.plans.ranks import blocks_for, global_rank, rank_within
from tidelog.plans.scratch import drop, keep

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Times a source may be repeated.
EPOCHS = 3
#: Words of a block.
BLOCK_WORDS = 2048
#: Ranges of lines (sources x parts of the schedule) up to which texts find their parts by a broadcast; of more, Spark's own size check decides.
ROUTES = 200_000
#: Bits of a place in a line, for such ranges.
LINE_BITS = 31
#: The golden ratio's fraction in 64-bit integers: point k is k * GOLDEN modulo 2**64, of which the upper BITS are used.
GOLDEN, BITS = 0x9E3779B97F4A7C15, 62

WORD = r"[^\\x20\\x09-\\x0D]+"


def with_size(docs: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    return docs.withColumn(name, F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')"), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size to source, source_size, weight, target; targets sum to all sizes.

    Water filling: a source above its limit (epochs times its size) stops there and the rest is shared by
    weight among the others, until none is above. Each round is two sums over the table of sources.
    """
    ranked = global_rank(sizes, ["source"], "rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = keep(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(epochs))), "sources")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words for a weight of 1; it only rises, and so does the set of sources at their limit
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        spent, open_weight = table.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        new = (total - (spent or 0.0)) / open_weight
        if new <= level * (1 + 1e-12):
            break
        level = new
    return table.withColumn("target", F.least("most", F.col("weight") * F.lit(level))).select("source", "source_size", F.col("rank").alias("source_rank"), "weight", "target")


def line_order(seed: int, doc_id: Column, size: Column, fp: Column) -> Column:
    """The hash by which a source's line is shuffled: documents are laid out by it modulo the number of blocks, then by it."""
    return F.xxhash64(F.lit(seed), doc_id, size, fp)


def line_place(shuffled: Column, blocks: int) -> Column:
    """That order in an int of LINE_BITS bits, block above hash; neighbours may share one."""
    of_hash = LINE_BITS - blocks.bit_length()
    return (F.shiftleft(F.pmod(shuffled, F.lit(blocks)), of_hash) + F.shiftright(shuffled, 64 - of_hash) + (1 << (of_hash - 1))).cast("int")


class Mix:
    """documents: doc_id, source, size, source_size, target, taken, first_slot (null: not taken), one row for each row of the input;
    schedule: slot, source_rank, rank; fragments: what each slot holds, as word ranges of documents; copies: row, epoch, words
    and slot of each time a document is taken; lines: the documents in the order of their sources."""

    def __init__(self, documents: DataFrame, schedule: DataFrame, fragments: DataFrame, copies: DataFrame, lines: DataFrame, block_words: int) -> None:
        self.documents, self.schedule, self.fragments, self.copies, self.lines, self.block_words = documents, schedule, fragments, copies, lines, block_words


def first_multiple(a: int, m: int, low: int, high: int) -> int | None:
    """The least x >= 0 with low <= a * x mod m <= high (0 <= low <= high < m), in O(log m) steps."""
    if low == 0:
        return 0
    a %= m
    if a == 0:
        return None
    x = -(-low // a)
    if a * x <= high:
        return x
    y = first_multiple(m, a, -high % a, -low % a)
    return None if y is None else -(-(low + m * y) // a)


def next_point(after: int, low: int, high: int, golden: int = GOLDEN) -> int:
    """The first slot from ``after`` on whose point lies in [low, high), in units of the upper BITS."""
    m, shift = 1 << 64, 64 - BITS
    own = golden * after % m
    lo, hi = ((low << shift) - own) % m, ((high << shift) - 1 - own) % m
    found = 0 if lo > hi else first_multiple(golden, m, lo, hi)  # a range that wraps holds the point itself
    if found is None:
        raise ValueError("the sequence never comes to this range")
    return after + found


def schedule_slots(spark: SparkSession, sources: DataFrame, n_sources: int, total: int, block_words: int, golden: int = GOLDEN) -> DataFrame:
    """slot, source_rank, rank: which block of its repeated line each slot takes.

    The cumulative shares are cut at the borders of a grid, so that a point is looked up by equality on its
    cell; a cell holds few sources on average, whatever their sizes.
    """
    slots = -(-total // block_words)
    grid = max(12, (4 * n_sources).bit_length())
    units = sources.select("source_rank", "target", F.ceil("target").cast("long").alias("units"))
    whole = float(units.agg(F.sum("units")).first()[0] or 1)
    ahead = rank_within(units, [], [F.col("source_rank")], max(1, -(-n_sources // 20_000)), F.expr("source_rank div 20000"), "ahead", weight="units")
    border = lambda c: F.floor(c / F.lit(whole) * F.lit(float(1 << BITS))).cast("long")
    table = ahead.select("source_rank", "target", border(F.col("ahead")).alias("low"), border(F.col("ahead") + F.col("units")).alias("high"))
    table = keep(table.where("low < high"), "shares")
    cells = table.withColumn("cell", F.explode(F.sequence(F.shiftright("low", BITS - grid), F.shiftright(F.col("high") - 1, BITS - grid))))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            point = ((slot.astype(np.uint64) * np.uint64(golden)) >> np.uint64(64 - BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(point), pa.array(point >> (BITS - grid))], names=["slot", "point", "cell"])

    named = spark.range(slots).mapInArrow(points, "slot long, point long, cell long").join(cells, "cell").where("point >= low and point < high").select("slot", "source_rank")
    blocks = blocks_for(slots)
    ranked = keep(rank_within(named, ["source_rank"], [F.col("slot")], blocks, F.expr(f"slot div {max(1, -(-slots // blocks))}"), "rank"), "slots")
    need = table.select("source_rank", "low", "high", F.ceil(F.floor("target") / F.lit(block_words)).alias("need"))
    main = ranked.join(need.select("source_rank", "need"), "source_rank").where("rank < need").select("slot", "source_rank", "rank")
    have = ranked.groupBy("source_rank").agg(F.count(F.lit(1)).alias("have"))
    short = need.join(have, "source_rank", "left").withColumn("have", F.coalesce("have", F.lit(0)).cast("long")).where("have < need")

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():  # few points a source: the discrepancy bounds what is missing
                slot = slots - 1
                for rank in range(int(r.have), int(r.need)):
                    slot = next_point(slot + 1, int(r.low), int(r.high), golden)
                    out.append((slot, r.source_rank, rank))
            yield pd.DataFrame(out, columns=["slot", "source_rank", "rank"], dtype="int64")

    return main.unionByName(short.mapInPandas(further, "slot long, source_rank long, rank long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 0, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None, size: str | None = None, golden: int = GOLDEN) -> Mix:
    """``row``: a column that tells rows apart, to find them again by ``copies``; one is made if there is none. ``size``: a column with the
    sizes, if they are known."""
    spark: SparkSession = docs.sparkSession
    own = F.monotonically_increasing_id() if row is None else F.col(row)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"), own.alias("row"), *([] if size is None else [F.col(size).alias("size")]))
    slim = slim.withColumn("fp", F.xxhash64("text"))
    sized = keep((with_size(slim) if size is None else slim).drop("text"), "sizes")
    rows = sized.count()
    sources = keep(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), "targets")
    total, n_sources = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    schedule = keep(schedule_slots(spark, sources, n_sources, total, block_words, golden), "schedule")

    # Lines: the documents of a source in shuffled order, laid end to end.
    known = sources.withColumnRenamed("source", "__source")
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "weight")
    shuffled = line_order(seed, F.col("doc_id"), F.col("size"), F.col("fp"))
    order = [shuffled, F.col("doc_id"), F.col("size"), F.col("fp")]
    lines = keep(rank_within(placed, ["source_rank"], order, blocks_for(rows), shuffled, "line_start", weight="size"), "lines")

    # Block r of a repeated line is its words r * b to (r + 1) * b; the target ends the last one. Documents are
    # laid out once for each epoch that the target reaches and cut at block borders.
    b = block_words
    most = F.floor("target").cast("long")
    drop(sized)
    laid = (
        lines.where("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("at", F.col("epoch") * F.col("source_size") + F.col("line_start"))
        .withColumn("end", F.least(F.col("at") + F.col("size"), most))
        .where("at < end")
        .withColumn("rank", F.explode(F.expr(f"sequence(at div {b}, (end - 1) div {b})")))
    )
    cut = laid.select(
        "row", "doc_id", "source", "source_rank", "epoch", "rank",
        (F.greatest(F.col("at"), F.col("rank") * b) - F.col("at")).alias("word_start"),
        (F.least(F.col("end"), (F.col("rank") + 1) * b) - F.col("at")).alias("word_end"),
    )
    fragments = keep(schedule.join(cut, ["source_rank", "rank"]), "fragments")
    words = F.sum(F.col("word_end") - F.col("word_start"))
    copies = keep(fragments.groupBy("row", "epoch").agg(words.alias("words"), F.min("slot").alias("slot")), "copies")
    taken = copies.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    documents = lines.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    return Mix(documents, schedule, fragments, copies, lines, b)


def _leading_words(batches, text: str):  # noqa: ANN001, ANN202
    """Texts cut after their first __first words, where that is positive."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        first = batch.column("__first").to_pylist()
        out = [t if not k else t[: next(m.end() for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", t), 1) if i == k)] for t, k in zip(batch.column(at).to_pylist(), first, strict=True)]
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's text, followed by its places (rows with a __slot), to the row as often as it has places. A batch that is returned has a row once."""
    last = None
    for batch in batches:
        batch = batch if last is None else pa.concat_batches([last, batch])
        place = batch.column("__slot").is_valid().to_numpy(zero_copy_only=False)
        owner = np.maximum.accumulate(np.where(place, 0, np.arange(len(place))))
        row, at = batch.column("__row").to_numpy(), np.flatnonzero(place)
        if not np.array_equal(row[owner[at]], row[at]) or place[owner[at]].any():
            raise ValueError("a place in the mix without its text")
        nth = at - owner[at]
        for k in np.unique(nth):
            own = at[nth == k]
            text, there = batch.take(pa.array(owner[own])), batch.take(pa.array(own))
            for name in ("__slot", "__first"):
                text = text.set_column(i := batch.schema.get_field_index(name), batch.schema.field(i), there.column(name))
            yield text
        last = batch.slice(owner[-1], 1) if len(place) else last


def mix_documents(docs: DataFrame, **options: object) -> DataFrame:
    """docs as the mix takes them, in the order of the schedule: each as often as it is taken whole, and the one of a source that the
    target cuts once more, up to the cut. Documents without words are not taken. Columns are those of docs.

    Texts are shuffled once. The schedule is cut into parts of equal numbers of places; as a source's documents come in the order of their line, those of a
    source, epoch and part are a range of the line, and a text is sent to the parts whose ranges hold it. There it meets its places.
    """
    bounded_batches(docs.sparkSession)
    columns = docs.columns
    doc_id, text, source, seed = (options.get(k, v) for k, v in (("doc_id", "doc_id"), ("text", "text"), ("source", "source"), ("seed", 0)))
    known = with_size(docs.withColumn("__row", F.monotonically_increasing_id()), text, "__size")
    known = keep(known, "rows")  # written, so that a row keeps its number
    mixed = mix(known, row="__row", size="__size", **options)
    blocks = blocks_for(mixed.lines.count())
    line = line_place(line_order(seed, F.col("doc_id"), F.col("size"), F.col("fp")), blocks)
    of = mixed.copies.join(mixed.lines.select("row", "source", "size", line.alias("line")), "row")
    cut = F.when(F.col("words") < F.col("size"), F.col("words")).otherwise(F.lit(0))
    of = of.select(F.col("row").alias("__row"), F.col("slot").alias("__slot"), cut.alias("__first"), "source", "epoch", "line")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = keep(of.repartitionByRange(parts, "__slot", "__row").withColumn("__part", F.spark_partition_id()), "taken")
    route = of.groupBy("source", "epoch", "__part").agg(F.min("line").alias("__lo"), F.max("line").alias("__hi"))
    route = keep(route.select(F.col("source").alias("__source"), "epoch", "__part", "__lo", "__hi"), "route")
    for done in (mixed.schedule, mixed.fragments, mixed.copies, mixed.lines):
        drop(done)
    cell = lambda c: F.shiftright(c, LINE_BITS - min(16, parts.bit_length()))  # noqa: E731  so that a text is held against few ranges
    ranges = route.drop("epoch").withColumn("__cell", F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__hi")))))
    if route.count() <= ROUTES:
        ranges = F.broadcast(ranges)
    own = line_order(seed, F.col(doc_id), F.col("__size"), F.xxhash64(F.col(text).cast("string")))
    texts = known.where("__size > 0").withColumn("__line", line_place(own, blocks)).withColumn("__at", cell(F.col("__line")))
    here = F.col(source).cast("string").eqNullSafe(F.col("__source")) & (F.col("__at") == F.col("__cell")) & F.col("__line").between(F.col("__lo"), F.col("__hi"))
    texts = texts.join(ranges, here).select(*columns, "__row", "__part", F.lit(None).cast("long").alias("__slot"), F.lit(None).cast("long").alias("__first"))
    met = texts.unionByName(of.select("__row", "__part", "__slot", "__first"), allowMissingColumns=True)
    met = met.repartitionById(parts, "__part").drop("__part").sortWithinPartitions("__row", F.col("__slot").asc_nulls_first())
    laid = met.mapInArrow(lambda batches: _leading_words(_placed(batches), text), met.schema)
    out = laid.sortWithinPartitions("__slot", "__row").select(*columns)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
