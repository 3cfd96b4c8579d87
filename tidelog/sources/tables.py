"""The tables of a test folder as event logs.

Versions are stored columns of a log; they are computed here because these tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def user_log(spark: SparkSession, folder: str) -> DataFrame:
    """Streams ``user-<id>``: a version counts a user's events by time; event ids are the global order from 0."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(
        F.concat(F.lit("event-"), F.col("event_id")).alias("event_id"),
        F.concat(F.lit("user-"), F.col("user_id")).alias("stream_id"),
        F.col("user_id").cast("string").alias("aggregate_id"),
        F.row_number().over(own).cast("long").alias("version"),
        (F.col("event_id") + 1).alias("global_version"),
        "event_type",
        F.col("props").alias("payload"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"),
        F.col("ts").alias("occurred_at"),
        "value",
    )


def conversation_log(spark: SparkSession, folder: str) -> DataFrame:
    """Streams ``conv-<id>``: a turn is an event whose type is its role."""
    return table(spark, folder, "conversations").select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("stream_id"), (F.col("turn") + 1).alias("version"), F.col("role").alias("event_type"), F.col("text").alias("payload"))


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    """Streams ``order-<key>``: OrderCreated, then ItemAdded for each line; lines have no key, so all columns order them."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.lit("OrderCreated").alias("event_type"), F.lit(0).alias("kind"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("supp"),
        F.lit(0.0).alias("qty"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("occurred_at"),
    )
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.lit("ItemAdded").alias("event_type"), F.lit(1).alias("kind"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("occurred_at"),
    )
    own = Window.partitionBy("k").orderBy("kind", "line", "part", "supp", "qty", "price", "occurred_at")
    return orders.unionByName(items).select(F.concat(F.lit("order-"), F.col("k")).alias("stream_id"), F.row_number().over(own).cast("long").alias("version"), "event_type", "part", "qty", "price", "occurred_at")
