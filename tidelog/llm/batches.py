"""Arrow batches of texts, bounded in bytes: what an executor's JVM and each of its Python workers hold at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes per batch to 8 MB; a smaller one stays. The limit holds from then on, as plans are run later."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(SETTING))
    if not 0 < now <= BYTES:
        spark.conf.set(SETTING, str(BYTES))
