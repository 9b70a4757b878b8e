"""Queries over keys, labels, notes and index rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation, memory
from .catalog import query, table
from .text_queries import part_text


@query("SELECT p_partkey, '#' || lpad(lower(to_hex(p_partkey * 7919 % 16777216)), 6, '0') AS color FROM part")
def color_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.color_hex(F.col("p_partkey") * 7919 % 16777216).alias("color"))


@query("SELECT c_custkey, left('mem-' || trim(regexp_replace(lower(c_name), '[^a-z0-9-]+', '-', 'g'), '-') || '-' || lower(c_mktsegment), 24) AS name FROM customer")
def tenant_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.tenant_name("mem", F.col("c_name"), F.lower("c_mktsegment"), 24).alias("name"))


@query("SELECT conv_id, turn, '[t' || turn || '] ' || role || ': ' || left(text, 40) AS line FROM conversations")
def observation_lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.observation_line(F.col("turn"), F.col("role"), F.substring("text", 1, 40)).alias("line"))


@query(f"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '{X.EMAIL}', '<email>', 'g'), '{X.IBAN}', '<iban>', 'g'), '{X.PHONE}', '<phone>', 'g') AS text, strftime(TIMESTAMP '2025-01-31', '%Y-%m-%d') AS expires FROM conversations WHERE role = 'user'")
def notes_with_ttl(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    as_of = F.lit("2025-01-01 00:00:00")
    made = memory.notes(c.select("conv_id", "turn", "text"), "text", as_of)
    keyed = c.select("conv_id", "turn", X.redacted(F.col("text")).alias("text"))
    return keyed.join(made.select("text", F.date_format("expires_at", "yyyy-MM-dd").alias("expires")).distinct(), "text").select("conv_id", "turn", "text", "expires")


@query("SELECT p_partkey AS id, p_brand AS document, CASE WHEN p_brand <> 'Brand#1' THEN 'on ' || p_brand END AS created_at FROM part")
def index_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    chunks = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("document"), part_text().alias("text"))
    dates = p.select(F.col("p_brand").alias("document")).distinct().where("document <> 'Brand#1'").withColumn("created_at", F.concat(F.lit("on "), "document"))
    out = memory.index_documents(chunks, dates)
    return out.select(F.decode(F.unbase64(F.translate("id", "-_", "+/")), "UTF-8").cast("long").alias("id"), "document", "created_at")


@query("SELECT page_id, length(html) < 2000 AND page_id % 10 >= 3 AS ocr FROM pages")
def ocr_decision(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.needs_ocr(F.length("html"), F.col("page_id") % 10 / 10, 2000).alias("ocr"))


@query("WITH t AS (SELECT conv_id, sum(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END) AS n FROM conversations GROUP BY 1) SELECT round(avg(n), 6) AS mean_tokens, round(median(n), 6) AS median_tokens FROM t")
def context_size(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("tokens", X.estimated_tokens(F.col("text")))
    return evaluation.context_tokens(c, "conv_id", "tokens").select(X.rounded(F.col("mean_tokens"), 6).alias("mean_tokens"), X.rounded(F.col("median_tokens"), 6).alias("median_tokens"))


@query("SELECT p_partkey AS id, p_brand || CASE WHEN p_size % 2 = 0 THEN ' p.' || p_size ELSE '' END AS citation, CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE p_size::DOUBLE END AS score FROM part")
def memory_items(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_brand").alias("document"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("page_start"), F.lit(None).cast("int").alias("page"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")).alias("reranker_score"), F.col("p_size").cast("double").alias("score"),
    )
    return memory.item(p).select("id", "citation", "score")


@query()
def normalized_lines(spark, sf_dir):
    """NFKC of lines, which the oracle's SQL does not have."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", X.normalized_line(F.col("line")).alias("line"))
