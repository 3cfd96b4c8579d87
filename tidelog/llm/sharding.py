"""Karmarkar-Karp differencing: indivisible groups to shards of near-equal bytes.

A group (all documents of one text) is a partial partition with its bytes in one shard. The two partial
partitions with the largest spread are combined in opposite order, again and again, until one is left. Groups are
dealt by hash into parts of bounded size; each part is differenced in one task and leaves one partial partition,
and those are differenced again, on executors while there are many, then on the driver. A group's documents
are never looked at one by one, so a hot group is one row; the shard of a document comes back by a join.

A null text counts as an empty one. Repeated rows belong to the group of their text, rows of one id or none to those of theirs. Texts of any
length count by their bytes alone. Among equal spreads the partial partition made first comes first, among equal bins the lower one, so
reruns agree. Other columns are not read, so their names may be any. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.plans.ranks import blocks_for, rank_within
from tidelog.plans.scratch import keep
from tidelog.plans.skew import spread_join

SHARDS = 24
#: Groups of one part at most, on average; parts combined in one task or on the driver.
PART_GROUPS = 20_000
COMBINED = 1_000


def difference(partials: list[list[int]]) -> list[list[int]]:
    """For each partial partition, the final shard of each of its bins."""
    shards = len(partials[0])
    # A node is (partial, bin), or a pair of nodes; None is an empty bin.
    heap = []
    for i, sums in enumerate(partials):
        bins = sorted(((s, j) for j, s in enumerate(sums)), key=lambda x: (-x[0], x[1]))
        heap.append((bins[-1][0] - bins[0][0], i, [s for s, _ in bins], [(i, j) for _, j in bins]))
    heapq.heapify(heap)
    serial = len(partials)
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        both = sorted(((x + y, k) for k, (x, y) in enumerate(zip(a, reversed(b), strict=True))), key=lambda x: (-x[0], x[1]))
        nodes = [(na[k], nb[shards - 1 - k]) for _, k in both]
        heapq.heappush(heap, (both[-1][0] - both[0][0], serial, [s for s, _ in both], nodes))
        serial += 1
    out = [[0] * shards for _ in partials]
    for shard, node in enumerate(heap[0][3]):
        stack = [node]
        while stack:
            x, y = stack.pop()
            if isinstance(x, int):
                out[x][y] = shard
            else:
                stack += [x, y]
    return out


def group_part(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Groups of one part (key, bytes) to bins."""
    pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
    found = difference([[int(b)] + [0] * (shards - 1) for b in pdf["bytes"]])
    return pd.DataFrame({"key": pdf["key"], "part": pdf["part"], "bin": [x[0] for x in found], "bytes": pdf["bytes"]})


def combine_parts(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    """part, bin, bytes to the bin that each becomes."""
    table = pdf.pivot_table(index="part", columns="bin", values="bytes", fill_value=0, aggfunc="sum").reindex(columns=range(shards), fill_value=0).sort_index()
    found = difference(table.astype(int).values.tolist())
    return pd.DataFrame([(p, b, s) for p, row in zip(table.index, found, strict=True) for b, s in enumerate(row)], columns=["part", "bin", "to"])


def shard_groups(groups: DataFrame, shards: int = SHARDS, part_groups: int = PART_GROUPS, combined: int = COMBINED) -> DataFrame:
    """key, bytes (one row a group) to key, shard."""
    spark = groups.sparkSession
    groups = keep(groups, "groups")
    parts = max(1, -(-groups.count() // part_groups))
    dealt = groups.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("long"))
    kind = groups.schema["key"].dataType.simpleString()
    own = keep(dealt.groupBy("part").applyInPandas(lambda pdf: group_part(pdf, shards), f"key {kind}, part long, bin int, bytes long"), "parts")
    sums = own.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes"))
    while parts > combined:  # on executors, so many parts at a time
        sums = keep(sums, "sums")
        step = sums.withColumn("next", F.expr(f"part div {combined}")).groupBy("next").applyInPandas(lambda pdf: combine_parts(pdf, shards).assign(next=pdf["next"].iloc[0]), "part long, bin int, to int, next long")
        step = keep(step, "combined")
        own = own.join(step, ["part", "bin"]).select("key", F.col("next").alias("part"), F.col("to").alias("bin"), "bytes")
        sums = sums.join(step, ["part", "bin"]).groupBy(F.col("next").alias("part"), F.col("to").alias("bin")).agg(F.sum("bytes").alias("bytes"))
        parts = -(-parts // combined)
    last = sums.toPandas()  # at most COMBINED parts by shards
    if last.empty:
        return own.select("key", F.col("bin").alias("shard"))
    final = spark.createDataFrame(combine_parts(last, shards).astype({"part": "int64", "bin": "int32", "to": "int32"}), "part long, bin int, to int")
    return own.join(F.broadcast(final), ["part", "bin"]).select("key", F.col("to").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (0, 1, 2 ... in the shard)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(body.cast("binary")).alias("key"))
    slim = keep(slim, "sizes")
    rows = slim.count()
    groups = keep(slim.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "texts")
    to = keep(shard_groups(groups.drop("n"), shards, **limits).join(groups.select("key", "n"), "key"), "shards")
    joined = spread_join(slim, to, ["key"], "n", F.col("doc_id")).select("doc_id", "size", "text_crc32", "shard")
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return rank_within(joined, ["shard"], order, blocks_for(rows), F.xxhash64("doc_id", "text_crc32", "size"), "slot")
