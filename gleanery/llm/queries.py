"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, decontamination_sql, masked_lm, pii, quality_model, quality_rules, quality_sql, sharding, simhash, substring_dedup, warc
from .shared import table, unsigned_hex


def tokenizer_path() -> str:
    """The public vocabulary file that op10 uses by default."""
    return public_tokenizers.path("word_bpe_49k.json")


def op1_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.scored(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated(table(spark, sf_dir, "documents"))


def op7_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark))
    return out.select("doc_id", "text", n)


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archived(table(spark, sf_dir, "pages"), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.clustered(table(spark, sf_dir, "documents"))
    return out.select("doc_id", unsigned_hex("fp").alias("fingerprint"), "component_id")


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))
    return out.select("doc_id", *names.values())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_weak_labels, op2_decontamination, op3_masked_lm, op4_quality_rules, op5_sampled_splitters, op6_collinear_chaining, op7_feistel_pii, op8_warc_zstd, op9_simhash, op10_bpe_tree)
}

ORACLES: dict[str, str] = {
    "op2_decontamination": decontamination_sql.OP2,
    "op4_quality_rules": quality_sql.OP4,
    "op8_warc_zstd": """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first
      FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages))""",
}
