"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut in two halves; each half has a codebook (k-means on a bounded sample), and pairs of codewords form a
product grid of cells. A vector lives in its nearest cell and visits the first T cells in the order of the sum of both squared
distances (the multi-sequence order: cell (i, j) of the sorted halves cannot come before rank (i+1)(j+1), so the first T lie on
a staircase of about T ln T candidates). T is twice the least power of two that reaches ``TARGET_RECALL`` on average over sampled queries,
each against all rows, and at least ``LEAST_CELLS``, as a sample of queries sees few of the small groups. The measured recall is
``Index.recall``. If the target is not reached, more cells are tried, up to ``MOST_CELLS``; if these do not do either, the
vectors have no cells that tell them apart, and all are compared in blocks, which is exact.
A pair is found when either vector visits the cell of the other, is verified by cosine in double precision, and is
counted in one place only. A cell of any size is compared in blocks; a block returns counts by vector and a spanning forest of its
links, never pairs.

Codewords grow with the square root of the rows, up to an eighth of the sample, so a cell keeps about ``CELL_ROWS`` rows and the work grows
with the rows: with the default sample up to 400 million rows; give a larger one (``sample_rows``) for more.
Vectors that are null, zero, of another dimension than most (ties: the smaller), or with null or non-finite parts link with nothing; so
does a null vec_id (its component is null). Rows that share a vec_id are one vector with the links of any: a partner counts
once, however many rows either has. Other columns are not read, so their names may be any. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.batches import bounded_batches
from tidelog.llm.components import components
from tidelog.plans.scratch import keep
from tidelog.plans.skew import spread_join

COSINE = 0.9
#: Rows that codebooks are fitted on, queries that T is measured on, cells visited at least, tried first, and tried at most.
SAMPLE_ROWS, SAMPLE_QUERIES, LEAST_CELLS, FIRST_CELLS, MOST_CELLS = 20_000, 1024, 16, 128, 2048
TARGET_RECALL = 0.995
CELL_ROWS = 64
BLOCK = 1024


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    cells: int = 1
    recall: float = 1.0


def unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can be compared, and their vectors of length 1, in double precision."""
    good, out = [], []
    lists = column.to_pylist() if column.null_count or column.values.null_count else None
    if lists is None:
        size = np.diff(column.offsets.to_numpy())
        fits = np.flatnonzero(size == dim)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        begin = np.cumsum(size) - size
        x = flat[begin[fits][:, None] + np.arange(dim)] if len(fits) else np.empty((0, dim))
        good = fits
    else:
        good = np.array([i for i, v in enumerate(lists) if v is not None and len(v) == dim and None not in v], np.int64)
        x = np.array([lists[i] for i in good], np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        largest = np.abs(x).max(axis=1, initial=0.0)
        fine = np.isfinite(largest) & (largest > 0)
        x = x[fine] / largest[fine][:, None]  # no overflow or underflow in the norm
        out = x / np.linalg.norm(x, axis=1)[:, None]
    return np.asarray(good, np.int64)[fine], out


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([squared(x[a : a + 2048], centres).argmin(axis=1) for a in range(0, len(x), 2048)])
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[count > 0] = sums[count > 0] / count[count > 0][:, None]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]


def traversal(x: np.ndarray, index: Index, most: int) -> np.ndarray:
    """The first ``most`` cells of each vector, nearest first; cells are numbered i * codewords + j."""
    h = x.shape[1] // 2
    k1, k2 = len(index.first), len(index.second)
    d1, d2 = squared(x[:, :h], index.first), squared(x[:, h:], index.second)
    o1, o2 = np.argsort(d1, axis=1)[:, :most], np.argsort(d2, axis=1)[:, :most]
    i, j = np.meshgrid(np.arange(o1.shape[1]), np.arange(o2.shape[1]), indexing="ij")
    stair = (i + 1) * (j + 1) <= most
    i, j = i[stair], j[stair]
    rows = np.arange(len(x))[:, None]
    total = d1[rows, o1][:, i] + d2[rows, o2][:, j]
    order = np.argsort(total, axis=1, kind="stable")[:, : min(most, k1 * k2)]
    return (o1[rows, i[order]] * k2 + o2[rows, j[order]]).astype(np.int64)


def measured_shares(vectors: DataFrame, index: Index, queries: np.ndarray, dim: int, most: int) -> np.ndarray:
    """For T = 1, 2, 4 ... most: the share of the queries' links among all rows that are found with T cells, averaged over queries."""
    seen = traversal(queries, index, most)
    levels = most.bit_length() + 1  # ranks below 1, 2, 4 ... most, and not at all

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(queries) * levels, np.int64)
        for batch in batches:
            _, y = unit(batch.column(0), dim)
            for a in range(0, len(y), BLOCK):
                part = y[a : a + BLOCK]
                q, r = np.nonzero(queries @ part.T >= COSINE)
                for b in range(0, len(q), BLOCK):
                    own, rows = q[b : b + BLOCK], r[b : b + BLOCK]
                    rows, which = np.unique(rows, return_inverse=True)
                    other = traversal(part[rows], index, most)[which]
                    one, two = seen[own] == other[:, :1], other == seen[own][:, :1]
                    rank = np.minimum(np.where(one.any(1), one.argmax(1), most), np.where(two.any(1), two.argmax(1), most))
                    level = np.where(rank < most, np.ceil(np.log2(rank + 1)).astype(np.int64), levels - 1)
                    found += np.bincount(own * levels + level, minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["at", "n"])

    counts = np.zeros(len(queries) * levels, np.int64)
    for row in vectors.select("embedding").mapInArrow(ranks, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # queries by levels at most
        counts[row["at"]] = row["n"]
    counts = counts.reshape(len(queries), levels)
    linked = counts[counts.sum(axis=1) > 1]  # each query finds itself
    return (np.cumsum(linked[:, :-1], axis=1) / linked.sum(axis=1)[:, None]).mean(axis=0) if len(linked) else np.ones(levels - 1)


def fit_index(vectors: DataFrame, rows: int, dim: int, sample_rows: int = SAMPLE_ROWS) -> Index:
    """vectors: vec_id, embedding. Codebooks from a bounded sample, then T from sampled queries against all rows."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("embedding")).limit(sample_rows).select("embedding").toArrow().column(0).combine_chunks()
    _, x = unit(sample, dim) if len(sample) else (None, np.empty((0, dim)))
    h = dim // 2
    exact = Index(np.zeros((1, h)), np.zeros((1, dim - h)))
    if len(x) < 2:
        return exact
    k = max(1, min(len(x) // 8, round(math.sqrt(rows / CELL_ROWS))))
    index = Index(kmeans(x[:, :h], k), kmeans(x[:, h:], k))
    queries, most = x[:SAMPLE_QUERIES], 1 << (min(FIRST_CELLS, k * k).bit_length() - 1)
    while True:
        share = measured_shares(vectors, index, queries, dim, most)
        enough = np.flatnonzero(share >= TARGET_RECALL)
        if len(enough):
            level = min(max(int(enough[0]) + 1, LEAST_CELLS.bit_length() - 1), len(share) - 1)
            index.cells, index.recall = 1 << level, float(share[level])
            return index
        if most * 4 > min(MOST_CELLS, k * k):
            return exact
        most *= 4


def placed(batches: Iterator[pa.RecordBatch], index: Index, dim: int) -> Iterator[pa.RecordBatch]:
    """One row as resident of the nearest cell, and one as visitor of each cell of the traversal (the nearest too)."""
    t = index.cells
    many = max(16, min(2048, (1 << 21) // (t * t.bit_length())))
    for batch in batches:
        for a in range(0, batch.num_rows, many):
            part = batch.slice(a, many)
            good, x = unit(part.column("embedding"), dim)
            cells = traversal(x, index, t)
            n, t_own = cells.shape
            at = np.concatenate((np.arange(n), np.repeat(np.arange(n), t_own)))
            raw = part.column("embedding").take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            vector, visits = [v.tobytes() for v in raw], [c.tobytes() for c in cells] + [None] * (n * t_own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((cells[:, 0], cells.ravel()))),
                    pa.array(np.concatenate((np.ones(n, bool), np.zeros(n * t_own, bool)))),
                    part.column("vec_id").take(pa.array(good[at])),
                    part.column("several").take(pa.array(good[at])),
                    pa.array(cells[at, 0]),
                    pa.array(visits, pa.binary()),
                    pa.array(vector, pa.binary()).take(pa.array(at)),
                ],
                names=["cell", "resident", "vec_id", "several", "home", "visits", "vector"],
            )


def block_links(pdf: pd.DataFrame, dim: int, kind: str) -> pd.DataFrame:
    """Residents and visitors of one block: u, v null, n links of u; or u, v of a spanning forest, n = 0; or, where u or v is an id with
    several vectors, whose links may be found in several blocks, the link u, v itself, n = -1."""
    r, q = pdf[pdf["resident"]], pdf[~pdf["resident"]]
    if r.empty or q.empty:
        return pd.DataFrame({"u": [], "v": [], "n": []}).astype({"u": "int64", "v": "Int64", "n": "int64"})

    def matrix(rows: pd.DataFrame) -> np.ndarray:
        flat = pa.array(np.frombuffer(b"".join(rows["vector"]), kind))
        return unit(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), flat), dim)[1]

    i, j = np.nonzero(matrix(r) @ matrix(q).T >= COSINE)
    rid, qid = r["vec_id"].to_numpy(), q["vec_id"].to_numpy()
    home, other = r["home"].to_numpy(), q["home"].to_numpy()
    visits = np.frombuffer(b"".join(r["visits"]), np.int64).reshape(len(r), -1)
    # A pair that each would find in the other's cell counts in the lower cell; within one cell, once.
    mutual = (visits[i] == other[j][:, None]).any(axis=1)
    first = np.where(home[i] == other[j], rid[i] < qid[j], ~mutual | (home[i] < other[j]))
    mine = first & (rid[i] != qid[j])
    i, j = i[mine], j[mine]
    twice = r["several"].to_numpy()[i] | q["several"].to_numpy()[j]
    ids = np.unique(np.concatenate((rid[i], qid[j])))
    a, b = np.searchsorted(ids, rid[i]), np.searchsorted(ids, qid[j])
    count = np.bincount(np.concatenate((a[~twice], b[~twice])), minlength=len(ids)).astype(np.int64)
    single = pd.DataFrame({"u": np.concatenate((rid[i][twice], qid[j][twice])), "v": pd.array(np.concatenate((qid[j][twice], rid[i][twice])), "Int64")}).drop_duplicates().assign(n=-1)
    label = np.arange(len(ids))
    while True:  # least label over links, until nothing changes
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    counts = pd.DataFrame({"u": ids, "v": pd.array([None] * len(ids), "Int64"), "n": count})
    forest = pd.DataFrame({"u": ids[moved], "v": pd.array(ids[label[moved]], "Int64"), "n": np.zeros(int(moved.sum()), np.int64)})
    return pd.concat([counts, forest, single]).astype({"u": "int64", "n": "int64"})


def one_row_each(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, several: equal rows once; whether the id has other vectors too. Only ids that repeat are compared."""
    again = keep(vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    if again.isEmpty():
        return vectors.withColumn("several", F.lit(False))
    part = lambda how: spread_join(vectors, again, ["vec_id"], "n", F.xxhash64("embedding"), how)
    different = keep(part("left_semi").dropDuplicates(["vec_id", "embedding"]), "different")
    several = different.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 1).alias("several"))
    return part("left_anti").withColumn("several", F.lit(False)).unionByName(spread_join(different, several, ["vec_id"], "n", F.xxhash64("embedding")))


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of the table. vec_id is cast to long."""
    return indexed_duplicates(table, vec_id, embedding, sample_rows)[0]


def indexed_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, Index | None]:
    """The rows of ``near_duplicates``, and the index that they were found by, with its measured recall (None: nothing to index)."""
    bounded_batches(table.sparkSession)
    kind = "float32" if "float" in table.schema[embedding].dataType.simpleString() else "float64"  # vectors travel as they are
    slim = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if kind == "float32" else "array<double>").alias("embedding"))
    vectors = slim.where("vec_id is not null and embedding is not null")
    shape = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    own = slim.select("vec_id")
    if shape is None or shape["dim"] < 1:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")), None
    dim = shape["dim"]
    vectors = one_row_each(vectors.where(F.size("embedding") == dim))
    index = fit_index(vectors, shape["n"], dim, sample_rows)
    rows = keep(vectors.mapInArrow(lambda batches: placed(batches, index, dim), "cell long, resident boolean, vec_id long, several boolean, home long, visits binary, vector binary"), "cells")
    sizes = rows.groupBy("cell").agg(F.count(F.when(F.col("resident"), 1)).alias("nr"), F.count(F.when(~F.col("resident"), 1)).alias("nq")).where("nr > 0 and nq > 1")
    sizes = keep(sizes.select("cell", F.ceil(F.col("nr") / BLOCK).cast("int").alias("rb"), F.ceil(F.col("nq") / BLOCK).cast("int").alias("qb"), (F.col("nr") + F.col("nq")).alias("n")), "blocks")
    dealt = spread_join(rows, sizes, ["cell"], "n", F.col("vec_id"))
    salt = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    rest = ["resident", "vec_id", "several", "home", "visits", "vector"]
    r = dealt.where("resident").select("cell", salt("rb").alias("i"), every("qb").alias("j"), *rest)
    q = dealt.where("not resident").select("cell", every("rb").alias("i"), salt("qb").alias("j"), *rest)
    found = keep(r.unionByName(q).groupBy("cell", "i", "j").applyInPandas(lambda pdf: block_links(pdf, dim, kind), "u long, v long, n long"), "links")
    apart = found.where("n = -1").select("u", "v").distinct().select("u", F.lit(1).cast("long").alias("n"))
    links = found.where("v is null").select("u", "n").unionByName(apart).groupBy(F.col("u").alias("__id")).agg(F.sum("n").alias("n_links"))
    comps = components(found.where("n = 0 and v is not null").select("u", "v"))
    out = own.join(links, F.col("vec_id") == F.col("__id"), "left").join(comps, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    return out, index
