"""The queries of this subpackage and their SQL, by the names under which the entry module registers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidelog.llm.packing import pack

    packed = pack(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packed.placement(ids_crc32=F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.pii import KINDS, find, listed

    found = find(_docs(spark, sf_dir))

    def of(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.mixing import mix

    return mix(_docs(spark, sf_dir)).documents.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.chat import conversations

    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.substrings import drop_repeated

    out = drop_repeated(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.embeddings import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.minhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.sharding import shard_documents

    out = shard_documents(_docs(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.quality import apply_policy, ledger

    book = apply_policy(apply_policy(ledger(_docs(spark, sf_dir)), "base", "__base"), "v1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("__base")).alias("base_failed"), "kept", "failures")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of a policy rejects, alone and with others, from one ledger of failure bits."""
    from tidelog.llm.quality import ablations, ledger

    return ablations(ledger(_docs(spark, sf_dir)), "v1")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.toxicity import learn, score

    docs = _docs(spark, sf_dir)
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("n_hits")


QUERIES = {f.__name__: f for f in (op1_packing, op2_pii, op3_mixing, op4_chat_formatting, op5_substring_dedup, op6_embedding_dedup, op7_minhash, op8_sharding, op9_quality_rules, op10_toxicity, quality_ablations)}
