"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets that keys are judged by: bounds what the driver sees of them.
BUCKETS = 4096


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, salt: Column, how: str = "inner", least: int = 256) -> DataFrame:
    """rows joined with ``keyed`` on ``keys``, where ``keyed`` has one row a key and in ``weight`` the number of rows of its key.

    A key with more rows than an average task of the shuffle gets (and than ``least``) is dealt over several tasks: its rows
    by ``salt``, and its row of ``keyed`` copied to each. Which keys these are is known by hash bucket: at most
    ``BUCKETS`` numbers at the driver, whatever the number of keys; other keys of such a bucket are copied too, which does no harm.
    ``weight`` is not in the result. ``how``: inner, left, left_semi or left_anti.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    most = keyed.groupBy(bucket.alias("b")).agg(F.sum(weight).alias("all"), F.max(weight).alias("most")).collect()
    share = max(least, sum(r["all"] for r in most) // parts)
    copies = {r["b"]: min(8 * parts, -(-r["most"] // share)) for r in most if r["most"] > share}
    keyed = keyed.drop(weight)
    if not copies:
        return rows.join(keyed, keys, how)
    table = F.create_map(*(F.lit(x) for pair in sorted(copies.items()) for x in pair))
    n = F.coalesce(F.element_at(table, bucket), F.lit(1))
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), n.cast("long")).cast("int"))
    right = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
