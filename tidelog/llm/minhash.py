"""Near-duplicate documents by MinHash: minima, bands, signatures, full sets, components.

1. One pass hashes the 5-word shingles of each text; 128 universal hashes (multiply, add, modulo 2**64) give a signature,
   cut into 32 bands of 4. Documents with one shingle set form a class, represented by its smallest id.
2. Classes meet in the buckets of their bands. Two sets with similarity 0.75 miss each other with probability
   (1 - 0.75**4)**32 = 5e-6. A second pass keeps the sorted shingles of the classes that share a bucket, once each; a sketch of these
   keeps most other texts out of its shuffle.
3. Only components are asked for, so pairs that are connected already need no test. Rounds of stars test each member
   of a bucket against one centre, first by signature, then on the full sets; confirmed links give components, on the components
   of the rounds before alone.
4. Buckets that still hold several components are finished exactly: every member outside the bucket's largest
   component is compared with all others, block by block, and a block returns a spanning forest of its new links,
   never its pairs. No bucket is capped; a bucket of very many members is dealt over several tasks in every join.

Texts: A-Z lower-cased, words are runs of bytes other than space, tab and line breaks; a text of fewer than 5 words is one
shingle; without words or with a null text a document is in no group. Texts of any length are hashed whole, piece by piece. A null
doc_id links with nothing and is its own component (null). Rows that share a doc_id are one document, linked by any of its
texts. The smallest id of a group stays, so there are no ties. An empty table gives no rows. Other columns are not carried by
``near_duplicates`` and are kept, whatever their names, by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.batches import bounded_batches
from tidelog.llm.components import components
from tidelog.llm.words import Hasher, Windows, Words, chunks, fold_ascii, mix
from tidelog.plans.scratch import drop, keep
from tidelog.plans.sketch import sifted
from tidelog.plans.skew import spread_join

WIDTH = 5
HASHES, BANDS = 128, 32
#: Signature agreement below which a pair is not compared in full: 5 standard deviations under 0.75.
LEAST_AGREEING = 72
#: A block of the exact comparison: members, and shingles in all.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 60_000


def universal(n: int = HASHES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, windows: Windows, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = fold_ascii(data)
    w = Words(data, offsets)
    words = hasher(data, w.starts, w.ends)
    _, doc, keys = windows(words, w.first, width)
    cut = np.searchsorted(doc, np.arange(len(offsets)))
    count = np.diff(w.first)
    out = []
    for i, n in enumerate(count):
        if n >= width:
            out.append(np.unique(keys[cut[i] : cut[i + 1]]))
        elif n:  # the whole sequence; told from other lengths by the count
            out.append(windows.whole(words[w.first[i] : w.first[i + 1]]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """High halves of the minima. Shingles are handled in pieces, so that a long text needs little memory."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[i : i + 2048, None] * a + b).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, fp, n_shingles, set1, set2 (of the whole set), signature."""
    hasher, windows = Hasher(), Windows()
    a, b = universal()
    for batch in batches:
        for part, data, offsets in chunks(batch):
            sets = shingle_sets(data, offsets, hasher, windows)
            signatures = pa.array([signature(s, a, b).tobytes() if len(s) else None for s in sets], pa.binary())
            sums = [(int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))) for s in sets]
            both = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("fp"), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), signatures],
                names=["doc_id", "fp", "n_shingles", "set1", "set2", "signature"],
            )


def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, signature to one row a band."""
    for batch in batches:
        rows = [band_keys(np.frombuffer(s, np.uint32)) for s in batch.column("signature").to_pylist()]
        keys = np.concatenate(rows) if rows else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("cid").to_numpy(), BANDS)), pa.array(keys)], names=["cid", "key"])


def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, signature, text to cid, n_shingles, signature and the sorted shingles."""
    hasher, windows = Hasher(), Windows()
    for batch in batches:
        for part, data, offsets in chunks(batch):
            sets = shingle_sets(data, offsets, hasher, windows)
            yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array([len(s) for s in sets], pa.int64()), part.column("signature"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "n_shingles", "signature", "shingles"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, on sorted distinct hashes."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < 75 * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= 75 * (len(x) + len(y) - both)


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their signatures and shingles to the components of the pairs that are links: signatures first, then the full sets."""
    for batch in batches:
        ok = []
        for sa, sb, x, y in zip(*(batch.column(c) for c in ("signature_a", "signature_b", "shingles_a", "shingles_b")), strict=True):
            agree = int((np.frombuffer(sa.as_buffer(), np.uint32) == np.frombuffer(sb.as_buffer(), np.uint32)).sum())
            ok.append(agree >= LEAST_AGREEING and similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Members of two blocks of a bucket (side a: outside its largest component) to a spanning forest of links between components."""
    pdf = pdf.drop_duplicates(["side", "cid", "shingles"])
    sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
    every = np.concatenate(sets)
    _, column = np.unique(every, return_inverse=True)
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    flat = np.zeros((len(sets), int(column.max()) + 1), np.float32)
    flat[row, column] = 1
    a, b = np.flatnonzero(pdf["side"] == "a"), np.flatnonzero(pdf["side"] == "b")
    both = flat[a] @ flat[b].T
    link = 100 * both >= 75 * (size[a][:, None] + size[b][None, :] - both)
    comp = pdf["comp"].to_numpy()
    link &= comp[a][:, None] != comp[b][None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(link), strict=True):
        x, y = root(int(comp[a[i]])), root(int(comp[b[j]]))
        if x != y:
            parent[x] = y
            out.append((comp[a[i]], comp[b[j]]))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _with_component(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("comp", F.col("cid"))
    return members.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")


def _merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after links (u, v) between the components so far; a link's ends are components, so they are no nodes of ``comps``."""
    new = components(links)
    if comps is None:
        return new
    further = new.select(F.col("node").alias("__from"), F.col("component").alias("__to"))
    moved = comps.join(further, F.col("component") == F.col("__from"), "left").select("node", F.coalesce("__to", "component").alias("component"))
    return keep(moved.unionByName(new), "components")


def class_links(buckets: DataFrame, sets: DataFrame, rounds: int = 2) -> DataFrame | None:
    """buckets: key, cid; sets: cid, n_shingles, signature, shingles. Components of classes as node, component."""
    comps: DataFrame | None = None
    tested: DataFrame | None = None
    rows = F.count(F.lit(1)).alias("n")
    side = lambda s: sets.select(F.col("cid").alias(s), F.col("signature").alias(f"signature_{s}"), F.col("shingles").alias(f"shingles_{s}"))
    for t in range(rounds):
        members = _with_component(buckets, comps)
        order = F.col("cid") if t == 0 else F.xxhash64("cid", F.lit(t))
        centres = members.groupBy("key").agg(F.min_by("cid", order).alias("centre"), F.min_by("comp", order).alias("centre_comp"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), rows)
        centres = keep(centres.where("lo < hi").select("key", "centre", "centre_comp", "n"), "centres")
        if centres.isEmpty():
            return comps
        met = spread_join(members, centres, ["key"], "n", F.col("cid")).where("comp != centre_comp")
        first = F.col("cid") < F.col("centre")
        ends = [F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b"), F.when(first, F.col("comp")).otherwise(F.col("centre_comp")).alias("u"), F.when(first, F.col("centre_comp")).otherwise(F.col("comp")).alias("v")]
        pairs = met.select(*ends).distinct()
        pairs = keep(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = keep(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(confirmed, "u long, v long").distinct(), "links")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        comps = _merged(comps, found)
        drop(centres)
        drop(found)
    # What is left: buckets of several components. Equal buckets (of other bands) are compared once.
    members = _with_component(buckets, comps)
    every = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), rows, F.expr("bit_xor(xxhash64(cid))").alias("same")).where("lo < hi")
    mixed = keep(every.groupBy("n", "same").agg(F.min("key").alias("key")).select("key", "n"), "open")
    if mixed.isEmpty():
        return comps
    sizes = sets.groupBy("cid").agg(F.max("n_shingles").alias("n_shingles"))
    open_ = keep(spread_join(members, mixed, ["key"], "n", F.col("cid")).join(sizes, "cid"), "mixed")
    by = open_.groupBy("key", "comp").agg(rows, F.sum("n_shingles").alias("s"))
    bucket = by.groupBy("key").agg(F.max(F.struct("n", "comp", "s")).alias("t"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > t.n")
    need = lambda n, s: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK_MEMBERS)), F.ceil(s / F.lit(BLOCK_SHINGLES))).cast("int")
    rest = need(F.col("n") - F.col("t.n"), F.col("s") - F.col("t.s"))
    shape = keep(bucket.select("key", F.col("t.comp").alias("top"), "n", need(F.col("n"), F.col("s")).alias("nb"), rest.alias("na")), "shapes")
    dealt = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n)).cast("int")
    shaped = spread_join(open_, shape, ["key"], "n", F.col("cid"))
    a = shaped.where("comp != top").select("key", dealt("na", 1).alias("i"), F.explode(F.expr("sequence(0, nb - 1)")).alias("j"), F.lit("a").alias("side"), "cid", "comp")
    b = shaped.select("key", F.explode(F.expr("sequence(0, na - 1)")).alias("i"), dealt("nb", 2).alias("j"), F.lit("b").alias("side"), "cid", "comp")
    full = a.unionByName(b).join(sets.select("cid", "shingles"), "cid")
    return _merged(comps, keep(full.groupBy("key", "i", "j").applyInPandas(block_links, "u long, v long"), "links"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs. doc_id is cast to long."""
    return _near_duplicates(docs, doc_id, text)[0]


def _near_duplicates(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, list[DataFrame]]:
    """The rows, and the kept tables that they are read from; all others are deleted."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("fp", F.xxhash64("text"))
    prints = keep(slim.mapInArrow(fingerprints, "doc_id long, fp long, n_shingles long, set1 long, set2 long, signature binary"), "prints")
    of_set = ["n_shingles", "set1", "set2"]
    own = prints.where("n_shingles > 0 and doc_id is not null")
    classes = keep(own.groupBy(*of_set).agg(F.min("doc_id").alias("cid"), F.min_by("fp", "doc_id").alias("fp"), F.count(F.lit(1)).alias("n")), "classes")
    reps = keep(own.join(classes.select(F.col("cid").alias("doc_id"), "fp"), ["doc_id", "fp"], "left_semi").select(F.col("doc_id").alias("cid"), "fp", "signature").dropDuplicates(["cid", "fp"]), "reps")
    bands = keep(reps.select("cid", "signature").mapInArrow(banded, "cid long, key long"), "bands")
    shared = bands.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
    shared = keep(shared, "shared")
    buckets = keep(spread_join(bands, shared, ["key"], "n", F.col("cid")).select("key", "cid").distinct(), "buckets")
    candidates = keep(reps.join(buckets.select("cid").distinct(), "cid", "left_semi").withColumnRenamed("cid", "doc_id"), "candidates")
    for done in (reps, bands, shared):
        drop(done)
    found = sifted(slim, candidates, ["doc_id", "fp"], candidates.count())  # other texts are not shuffled
    texts = found.join(candidates, ["doc_id", "fp"]).dropDuplicates(["doc_id", "fp"]).select(F.col("doc_id").alias("cid"), "signature", "text")
    sets = keep(texts.mapInArrow(shingled, "cid long, n_shingles long, signature binary, shingles binary"), "sets")
    drop(candidates)
    comps = class_links(buckets, sets)
    for done in (buckets, sets):
        drop(done)
    joined = spread_join(prints.select("doc_id", *of_set, "fp"), classes.drop("fp"), of_set, "n", F.struct("doc_id", "fp"), "left").drop("fp")
    if comps is not None:
        joined = joined.join(comps, F.col("cid") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "cid", "doc_id"))
    else:
        joined = joined.withColumn("component_id", F.coalesce("cid", "doc_id"))
    shown = F.when(F.col("doc_id").isNull(), None).otherwise(F.col("component_id"))
    out = joined.select("doc_id", "n_shingles", shown.alias("component_id"), F.coalesce(F.col("doc_id") == shown, F.lit(True)).alias("kept"))
    return out, [prints, classes]


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the smallest id of each group; one row of each id that has one (of the text of the smallest hash). Rows
    without an id stay. Columns are those of docs."""
    known = keep(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")  # written, so that a row keeps its number
    found, tables = _near_duplicates(known, doc_id, text)
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    narrow = known.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("__id"), F.struct(F.xxhash64(text).alias("fp"), F.col("__row").alias("row")).alias("r"))
    chosen = narrow.join(kept, "__id", "left_semi").groupBy("__id").agg(F.min("r").alias("r")).select(F.col("r.row").alias("__row"))
    chosen = keep(chosen.unionByName(known.where(F.col(doc_id).isNull()).select("__row")), "chosen")
    for done in tables:
        drop(done)
    return known.join(chosen, "__row", "left_semi").select(*docs.columns)
