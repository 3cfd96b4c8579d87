"""Sketches of key sets that are small enough to be sent to every task, whatever the number of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a sketch for each key, and at most (16 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 27
#: Bits of a row of a sketch: those of bitmap_construct_agg.
ROW = 32_768


def sifted(rows: DataFrame, keyed: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows without most of those whose keys are not in ``keyed``, which has n rows; none of the others is lost.

    Each key sets one bit of a bitmap that is broadcast, so wide rows that a join would drop are not shuffled for it. With 16 bits
    a key a sixteenth of them comes through; of over 8 million keys the bitmap is full earlier, more rows come through, and the join that follows decides on all.
    """
    bits = min(MOST_BITS, max(ROW, 1 << (BITS_A_KEY * n - 1).bit_length()))
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits)).cast("int")
    sketch = keyed.select(bit.alias("__bit")).groupBy(F.expr(f"__bit div {ROW}").cast("int").alias("__row_of_bits")).agg(F.expr(f"bitmap_construct_agg(__bit % {ROW})").alias("__bits"))
    asked = rows.withColumn("__bit", bit).withColumn("__row_of_bits", F.expr(f"__bit div {ROW}").cast("int"))
    byte = f"cast(conv(hex(substring(__bits, __bit % {ROW} div 8 + 1, 1)), 16, 10) as int)"
    return asked.join(F.broadcast(sketch), "__row_of_bits").where(f"shiftright({byte}, cast(__bit % 8 as int)) & 1 = 1").select(*rows.columns)
