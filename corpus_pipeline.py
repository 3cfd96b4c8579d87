"""A corpus in five stages: quality rules, near-duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes each
stage's rows to the shared folder and reads them again for the next. All stages but the last keep the columns of documents, whatever others
there are and whatever their names.

Null or empty texts fail the quality rules, so later stages see none; should they get any, near-duplicates keeps them (they are in no group), redaction
and packing leave them empty, and mixing takes none. Rows without an id are in no group and go on; of rows that share one, one goes on. Of a
group the smallest id stays, so there are no ties; of equal rows one stays. Long texts are handled whole. An empty table gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.minhash import drop_near_duplicates
from tidelog.llm.mixing import mix_documents
from tidelog.llm.packing import pack
from tidelog.llm.pii import redact
from tidelog.llm.quality import filter_documents
from tidelog.plans.scratch import keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of policy v1."""
    return filter_documents(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in windows of 2048 tokens."""
    import public_tokenizers

    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.placement(ids_crc32=F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: The vocabulary's ids and the hashed order of the mix are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
