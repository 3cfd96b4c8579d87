"""Intermediate tables in the folder that driver and executors share.

``keep`` writes a DataFrame once and reads it back: lineage is cut, what follows reads one committed
attempt of every task, and a lost executor costs nothing that was written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, a local session gets a temporary one, as in tests; on a cluster, where the
    driver's own disk is not shared, that is an error."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} has to name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidelog-scratch/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back with its columns and types."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.parquet(path) if partition_by else spark.read.schema(df.schema).parquet(path)
    out._tidelog_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a kept table that nothing reads any more."""
    path = getattr(df, "_tidelog_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def sweep(spark: SparkSession, older_than_hours: float = 24.0) -> int:
    """Delete kept tables that were last touched so long ago; how many. Run it when no query that uses them is left."""
    import time

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidelog-scratch")
    files = root.getFileSystem(conf)
    if not files.exists(root):
        return 0
    old = [s.getPath() for s in files.listStatus(root) if s.getModificationTime() < (time.time() - older_than_hours * 3600) * 1000]
    for path in old:
        files.delete(path, True)
    return len(old)
