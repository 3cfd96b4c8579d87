"""FNV-1a on columns. Spark's own hashes are faster, but shards must be those that other programs compute."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of 32-bit FNV-1a.
OFFSET_BASIS = 2166136261
PRIME = 16777619


def fnv1a_32(text: Column | str) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as BIGINT."""
    text = F.col(text) if isinstance(text, str) else text
    digits = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, 2), 16, 10).cast("long")
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(OFFSET_BASIS).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))


def shard(text: Column | str, shards: int) -> Column:
    """The shard of a key; at least one shard."""
    return F.pmod(fnv1a_32(text), F.lit(max(1, shards))).cast("long")
