"""Queries over several memories: facts, lessons, budgets and routes together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory, ranking, recall, search
from .catalog import query, table
from .search_queries import QUESTION, bm25_sql

MIXED = QUESTION + " LT107 type"
BUDGET = 400
_FACTS = "f AS (SELECT 'fact|PART' || p_partkey || '|has' AS doc_id, 'part ' || p_partkey || ' has ' || p_type || ' LT' || (100 + p_size) AS text FROM part WHERE p_size = 7)"


def part_facts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("subject"), F.lit("has").alias("predicate"), F.concat("p_type", F.lit(" LT"), (F.col("p_size") + 100).cast("string")).alias("object"), F.lit("parts.pdf").alias("document"))


@query(f"WITH {_FACTS}, {bm25_sql('which type has LT107', True, 'f')} SELECT id, 'fact' AS kind, round(score, 6) AS score FROM bm25 WHERE score > 0 ORDER BY bm25.score DESC, id LIMIT 5")
def recall_facts(spark, sf_dir):
    return recall.recalled_facts(part_facts(spark, sf_dir), "which type has LT107").select("id", "kind", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_FACTS}, a AS (WITH {bm25_sql(MIXED, True, 'f')} SELECT id, score FROM bm25 WHERE score > 0 ORDER BY score DESC, id LIMIT 5),
  b AS (WITH {bm25_sql(MIXED)} SELECT id, score FROM bm25 WHERE score > 0 ORDER BY score DESC, id LIMIT 20),
  items AS (SELECT row_number() OVER (ORDER BY source, score DESC, id) AS n, id, greatest(1, ceil(length(text) / 4))::BIGINT AS cost FROM (
    SELECT 0 AS source, a.id, score, text FROM a JOIN f ON f.doc_id = a.id UNION ALL SELECT 1, 'doc|' || lpad(b.id::VARCHAR, 8, '0'), score, text FROM b JOIN documents d ON d.doc_id = b.id)),
  packed AS (SELECT 0::BIGINT AS n, 0::BIGINT AS used, NULL::VARCHAR AS id UNION ALL
    SELECT p.n + 1, CASE WHEN used + cost <= {BUDGET} THEN used + cost ELSE used END, CASE WHEN used + cost <= {BUDGET} THEN i.id END FROM packed p JOIN items i ON i.n = p.n + 1)
  SELECT (row_number() OVER (ORDER BY n) - 1)::INT AS place, id FROM packed WHERE id IS NOT NULL""")
def hybrid_recall(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc|"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"), "text", F.lit("chunk").alias("kind"), F.col("source").alias("document"))
    sources = {"facts": recall.recalled_facts(part_facts(spark, sf_dir), MIXED), "semantic": search.recall(d, MIXED, k=20, mode="keyword")}
    return recall.hybrid(MIXED, sources, BUDGET).select("place", "id")


@query("SELECT 'report-src3-' || max(doc_id % 5 + 2020) || '.pdf' AS document FROM documents WHERE source = 'src3'")
def apply_lessons(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select(F.concat(F.lit("report-"), "source", F.lit("-"), (F.col("doc_id") % 5 + 2020).cast("string"), F.lit(".pdf")).alias("document"))
    rows = [(["emissions", "report"], ["REPORT-src3-*.pdf"], True), (["torque", "brake"], ["report-src4-*.pdf"], False), (["report"], ["none-?.pdf"], False)]
    lessons = spark.createDataFrame(rows, "trigger array<string>, prefer_documents array<string>, prefer_latest boolean")
    return recall.applied_lessons(lessons, "emissions of the latest report", known)


SYSTEM, GOAL, CONTEXT = "You answer from documents.", "find the values", 160
_HEAD = sum(-(-len(s) // 4) for s in (SYSTEM, f"Goal: {GOAL}"))
_COST = "CASE WHEN length(coalesce(line, '')) = 0 THEN 0 ELSE greatest(1, ceil(length(line) / 4)) END"


@query(f"""WITH turns AS (SELECT conv_id, turn, text AS line FROM conversations WHERE role = 'user'), notes AS (SELECT conv_id, turn, '[t' || turn || '] ' || role || ': ' || text AS line FROM conversations WHERE role <> 'user'),
  t AS (SELECT *, {_HEAD} + sum({_COST}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS running FROM turns), tk AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS s, max(running) AS used FROM t WHERE running <= {CONTEXT} GROUP BY conv_id),
  n AS (SELECT notes.*, coalesce(used, {_HEAD}) + sum({_COST}) OVER (PARTITION BY notes.conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS running FROM notes LEFT JOIN tk USING (conv_id)), nk AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS s FROM n WHERE running <= {CONTEXT} GROUP BY conv_id)
  SELECT conv_id, '{SYSTEM}' || chr(10) || 'Goal: {GOAL}' || chr(10) || 'Observations:' || coalesce(chr(10) || nk.s, '') || chr(10) || 'Recent turns:' || coalesce(chr(10) || tk.s, '') AS context
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN tk USING (conv_id) LEFT JOIN nk USING (conv_id)""")
def two_leg_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("[t"), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(": "), "text")
    turns, notes = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("line")), c.where("role <> 'user'").select("conv_id", "turn", line.alias("line"))
    return recall.context(SYSTEM, GOAL, turns, notes, ["conv_id"], "turn", "line", CONTEXT)


@query("SELECT 'audit' AS kind, 'forget {\"document\":\"' || n_name || '\",\"removed\":' || n_regionkey || '}' AS text FROM nation")
def audit_rows(spark, sf_dir):
    details = table(spark, sf_dir, "nation").select(F.col("n_name").alias("document"), F.col("n_regionkey").alias("removed"))
    return memory.audited("forget", details, F.lit("2025-01-01")).select("kind", "text")


@query("""SELECT 'PART' || p_partkey || '|brand' AS fact_key, CASE WHEN p_partkey % 8 = 0 THEN 'new' ELSE p_brand END AS object, CASE WHEN p_partkey % 8 = 0 THEN '2025-01-01' ELSE '2024-01-01' END AS valid_from,
  CASE WHEN p_partkey % 8 = 0 THEN p_brand ELSE '' END AS history, CASE WHEN p_partkey % 8 = 0 THEN 'b.pdf' ELSE 'a.pdf' END AS document FROM part""")
def stored_facts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    fact = lambda rows, obj, day, doc: rows.select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("subject"), F.lit("brand").alias("predicate"), obj.alias("object"), day.alias("valid_from"), F.lit(0.9).alias("confidence"), F.lit(doc).alias("document"), F.lit(1).alias("n"))
    old = fact(p, F.col("p_brand"), F.lit("2024-01-01"), "a.pdf").drop("n").withColumn("history", F.array().cast("array<string>"))
    new = fact(p.where("p_partkey % 4 = 0"), F.lit("new"), F.when(F.col("p_partkey") % 8 == 0, "2025-01-01").otherwise("2020-01-01"), "b.pdf")
    return recall.stored(old, new, ["n"]).select("fact_key", "object", "valid_from", F.array_join("history", ",").alias("history"), "document")


@query()
def ranked_answer(spark, sf_dir):
    """The best sentence of the best documents for a question; tests hold it against a plain version."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    few = ranking.ranked(ranking.bm25(d, QUESTION, "doc_id"), 5, "doc_id")
    items = few.select(F.col("doc_id").alias("id"), "text", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("citation"), (F.col("rank") - 1).alias("rank"))
    return recall.answered(items, QUESTION)
