"""Documents through quality rules, near-dedup, decontamination, pseudonyms and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to
the folder that driver and executors share and rereads as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, decontamination, near_copies, pii, quality_rules
from gleanery.llm.queries import tokenizer_path
from gleanery.llm.shared import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by fingerprints and sketches of five-word shingles."""
    return near_copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that quote an item of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced; addresses may change in length, and n_chars with them."""
    out, n = pii.pseudonymised(docs, pii.key_of(spark))
    return out.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).drop(n)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and digests of them and of the decoded text."""
    out, names = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    return out


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminated), ("pseudonyms", pseudonyms), ("tokens", tokens)]

#: Fingerprint components, Feistel networks and BPE have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{k}")
    return docs
