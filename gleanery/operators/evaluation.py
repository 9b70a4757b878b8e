"""Retrieval quality over a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(results: DataFrame, expected: DataFrame, question: str, document: str, rank: str, k: int) -> DataFrame:
    """One row: questions, hit_at_k and mrr. expected has question and document; misses count as 0."""
    best = results.where(F.col(rank) <= k).join(expected, [question, document]).groupBy(question).agg(F.min(rank).alias("first"))
    each = expected.select(question).distinct().join(best, question, "left")
    return each.agg(F.count("*").alias("questions"), F.avg(F.col("first").isNotNull().cast("double")).alias("hit_at_k"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def context_tokens(results: DataFrame, question: str, tokens: str) -> DataFrame:
    """One row: mean tokens of context a question, and the median."""
    each = results.groupBy(question).agg(F.sum(tokens).alias("n"))
    return each.agg(F.avg("n").alias("mean_tokens"), F.median("n").alias("median_tokens"))


def record(scores: DataFrame, path: str) -> None:
    """Append to a scoreboard of CSV files."""
    scores.write.mode("append").option("header", True).csv(path)
