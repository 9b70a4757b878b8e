"""A directed graph of labelled edges: src, predicate, dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MAX_MENTIONS = 5


def edges(pairs: DataFrame, src: Column, predicate: Column, dst: Column) -> DataFrame:
    """Distinct edges between normalised names, without empty ends and loops."""
    e = pairs.select(X.normalized_entity(src).alias("src"), predicate.alias("predicate"), X.normalized_entity(dst).alias("dst"))
    return e.where("src <> '' AND dst <> '' AND src <> dst").distinct()


def from_facts(facts: DataFrame) -> DataFrame:
    """Each entity of a fact's subject to each of its object."""
    e = facts.select("predicate", F.explode(X.entities(F.col("subject"))).alias("s"), "object").select("predicate", "s", F.explode(X.entities(F.col("object"))).alias("t"))
    return edges(e, F.col("s"), F.col("predicate"), F.col("t"))


def comentions(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Pairs of the first MAX_MENTIONS entities of each chunk."""
    found = F.slice(X.entities(F.col(text)), 1, MAX_MENTIONS)
    pairs = F.flatten(F.transform(found, lambda a: F.transform(F.filter(found, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    e = chunks.select(F.explode(pairs).alias("p"))
    return edges(e, F.col("p.a"), F.lit("mentioned_with"), F.col("p.b"))


def both_ways(e: DataFrame) -> DataFrame:
    """Edges with their reverses, whose predicates start with ~."""
    return e.unionByName(e.select(F.col("dst").alias("src"), F.concat(F.lit("~"), "predicate").alias("predicate"), F.col("src").alias("dst")))


def neighbours(e: DataFrame, starts: list[str], comention_edges: bool = True) -> DataFrame:
    out = both_ways(e).where(F.col("src").isin(starts))
    return out if comention_edges else out.where(~F.col("predicate").endswith("mentioned_with"))


def two_hops(e: DataFrame, starts: list[str], comention_edges: bool = True) -> DataFrame:
    """src, p1, mid, p2, dst without ways back to the start; only the first hop's ends are joined."""
    ways = both_ways(e)
    if not comention_edges:
        ways = ways.where(~F.col("predicate").endswith("mentioned_with"))
    first = neighbours(e, starts, comention_edges).select("src", F.col("predicate").alias("p1"), F.col("dst").alias("mid"))
    second = ways.select(F.col("src").alias("mid"), F.col("predicate").alias("p2"), "dst")
    return first.join(second, "mid").where("dst <> src").select("src", "p1", "mid", "p2", "dst").distinct()


def mermaid(paths: DataFrame) -> DataFrame:
    """Distinct lines of a flow chart for paths of two hops."""
    line = lambda a, p, b: F.concat(a, F.lit(" -->|"), p, F.lit("| "), b)
    return paths.select(F.explode(F.array(line(F.col("src"), F.col("p1"), F.col("mid")), line(F.col("mid"), F.col("p2"), F.col("dst")))).alias("line")).distinct()
