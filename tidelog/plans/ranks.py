"""Gapless ranks of whole tables without a window over one partition.

Rows are dealt into blocks, counted per block, and every block gets the number of rows before it: the only
thing that is ordered as a whole is the table of block counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, keys: list[str], order: list[Column], blocks: int, block: Column, name: str, weight: str | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... within ``keys``, by block (``block`` modulo ``blocks``), then ``order``.

    With ``weight``, the sum of that column over the rows before instead. A key that holds a third of all rows
    is spread over all its blocks. ``order`` must be total within a block for the result to be the same in each run.
    """
    b, n, base = f"__{name}_block", f"__{name}_n", f"__{name}_base"
    dealt = df.withColumn(b, F.pmod(block, F.lit(blocks)).cast("int"))
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = dealt.groupBy(*keys, b).agg(amount.alias(n))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, b]]
    own = Window.partitionBy(*keys, b).orderBy(*order)
    within = F.row_number().over(own).cast("long") - 1 if weight is None else F.coalesce(F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn(name, within)
    joined = ranked.alias("l").join(bases.alias("r"), on, "left")
    kept = [F.col(f"l.{c}") for c in df.columns]
    return joined.select(*kept, (F.col(f"l.{name}") + F.coalesce(F.col(f"r.{base}"), F.lit(0))).cast("long").alias(name))


def blocks_for(rows: int, per_block: int = 20_000, least: int = 256) -> int:
    """Blocks to deal rows into: their number depends on the rows alone, so reruns agree."""
    return max(least, -(-rows // per_block))


def global_rank(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... over the whole table by the columns ``order``, nulls last.

    The table is written range-partitioned (so that what follows reads one fixed layout), counted per part,
    and ranked within parts. Parts with equal order columns stay together, so ``order`` should be near a key.
    """
    from tidelog.plans.scratch import keep

    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_last() for c in order]
    p, base = f"__{name}_part", f"__{name}_base"
    laid = keep(df.repartitionByRange(parts, *by).withColumn(p, F.spark_partition_id()), "rank")
    counts = laid.groupBy(p).count()
    before = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    bases = counts.select(F.col(p).alias(f"{p}_r"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    ranked = laid.withColumn(name, F.row_number().over(Window.partitionBy(p).orderBy(*by)).cast("long") - 1)
    return ranked.join(bases, F.col(p) == F.col(f"{p}_r")).select(*df.columns, (F.col(name) + F.col(base)).alias(name))


def rank_sorted(df: DataFrame, keys: list[str], order: list[str | Column], name: str, parts: int | None = None, weight: str | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... within ``keys`` by ``order``, nulls last. With ``weight``, the sum of that column up to and with the row.

    Rows are written range-partitioned by keys and order together, so a hot key is cut where its own order allows,
    then counted (or summed) by key and part. A column among ``order`` says itself which way it goes.
    """
    from tidelog.plans.scratch import keep

    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    p, n, base = f"__{name}_part", f"__{name}_n", f"__{name}_base"
    laid = keep(df.repartitionByRange(parts, *(F.col(k).asc_nulls_last() for k in keys), *by).withColumn(p, F.spark_partition_id()), "ranges")
    counts = laid.groupBy(*keys, p).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias(n))
    before = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, p, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(*keys, p).orderBy(*by)
    ranked = laid.withColumn(name, F.row_number().over(within).cast("long") - 1 if weight is None else F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, p]]
    kept = [F.col(f"l.{c}") for c in df.columns]
    return ranked.alias("l").join(bases.alias("r"), on).select(*kept, (F.col(f"l.{name}") + F.col(f"r.{base}")).alias(name))
