"""One search over an index table, in the modes keyword, vector, hybrid, semantic and fresh.

An index has a key, searchable text columns and, as far as a mode needs them, an embedding,
created_at and entities. The filter comes first, so statistics are those of the rows it leaves. Each
leg keeps as many rows as are asked for, POOL at least, and only those legs meet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import filters, ranking

MODES = ("keyword", "vector", "hybrid", "semantic", "fresh")
POOL = 50


def entities_of(question: str) -> list[str]:
    """What functions.text.entities() finds, for a question that is a plain string."""
    found = (re.sub("[^A-Z0-9]", "", m.upper()) for p in X.ENTITY_PATTERNS.values() for m in re.findall(p, question))
    return sorted({e for e in found if len(e) >= 3})


def documents_filter(names: list[str]) -> str | None:
    """A filter for these documents, with names that may hold commas and quotes."""
    if not names:
        return None
    return "search.in(document, '" + "|".join(names).replace("'", "''") + "', '|')"


def newer_than(iso: str) -> str:
    return f"created_at ge {iso}"


def both_filters(*clauses: str | None) -> str | None:
    some = [c for c in clauses if c]
    return " and ".join(f"({c})" for c in some) if some else None


def search(index: DataFrame, mode: str = "hybrid", question: str | None = None, vector: list[float] | None = None, where: str | None = None, top: int = POOL,
           key: str = "id", fields: tuple[str, ...] = ("text",), order_by: str | None = None, as_of: Column | None = None, even: float = 0.0) -> DataFrame:
    """The first rows of the index without its embedding, with score, reranker_score and rank.

    Without a question, or with '*', and without a vector each row scores 1. order_by names a
    column, and 'desc' after it, that decides instead of the score, null like an empty text.
    Scores that are all equal count as even when the pool is ranked again.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rows = index.where(filters.odata(index, where)) if where else index
    legs = []
    if mode != "vector" and question and question != "*":
        texts = rows.select("*", F.concat_ws(" ", *fields).alias("__text"))
        scored = ranking.bm25(texts, question, key, "__text")
        if mode == "fresh":
            boost = ranking.profile_boost(F.col("created_at"), F.col("entities"), entities_of(question), as_of if as_of is not None else F.current_timestamp())
            scored = scored.withColumn("score", F.col("score") * boost)
        legs.append(ranking.top(scored.where("score > 0").select(key, "score"), max(top, POOL), key))
    if mode != "keyword" and vector is not None:
        legs.append(ranking.nearest(rows, vector, top, key))
    if not legs:
        scores = rows.select(key, F.lit(1.0).alias("score"))
    elif len(legs) == 1:
        scores = legs[0]
    else:
        scores = ranking.fused([leg.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key))) for leg in legs], key)  # a leg's rows are few
    names = [c for c in index.columns if c != "embedding"]
    found = rows.select(*names).join(F.broadcast(scores) if legs else scores, key)  # max(top, POOL) + top rows at most
    found = found.withColumn("reranker_score", F.lit(None).cast("double"))
    if mode == "semantic" and legs:
        pool = ranking.top(found.drop("reranker_score").withColumn("__text", F.concat_ws(" ", *fields)), POOL, key)
        again = ranking.reranked(pool, question or "", key, "__text", even).select(F.col(key).alias("__key"), F.col("score").alias("__again"))
        found = found.join(F.broadcast(again), F.col(key) == F.col("__key"), "left").withColumn("reranker_score", F.col("__again")).drop("__key", "__again")
    order = [F.desc_nulls_last("reranker_score"), F.desc("score"), F.col(key)]
    if order_by:
        column, *way = order_by.split()
        by = F.coalesce(F.col(column).cast("string"), F.lit(""))
        order = [by.desc() if way and way[0].lower() == "desc" else by.asc(), *order]
    first = found.orderBy(*order).limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def recall(index: DataFrame, question: str, vector: list[float] | None = None, k: int = 5, mode: str = "hybrid", documents: list[str] | None = None, where: str | None = None, **more) -> DataFrame:
    """The first k memories for a question, within the named documents if there are any."""
    return search(index, mode, question, vector, both_filters(documents_filter(documents or []), where), k, **more)


def get_document(index: DataFrame, value, key: str = "id") -> DataFrame:
    return index.where(F.col(key) == F.lit(value))
