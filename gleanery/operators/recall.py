"""Recall over several memories: facts, graph, lessons and chunks, by a question's route and a budget of tokens."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import facts, graph, memory, ranking, search

ITEM = ("id", "kind", "text", "document")


def route(question: str) -> list[str]:
    """The memories to ask, the most trusted first; functions.text.routes() for a plain string."""
    has = bool(search.entities_of(question))
    if has and re.search(X.MULTI_HOP, question):
        return ["graph", "facts", "semantic"]
    if re.search(X.TEMPORAL, question):
        return ["facts", "fresh"]
    if re.search(X.EXPERIENCE, question):
        return ["episodic", "semantic"]
    return ["facts", "semantic"] if has else ["semantic"]


def stored(table: DataFrame, arrivals: DataFrame, order: list[str]) -> DataFrame:
    """The table of facts after more facts arrive: one row for each key, folded in order.

    Both have subject, predicate, object, valid_from, confidence and document; the table also has its
    history. The names are those of a key's first fact, the document is that of its object.
    """
    counts = [F.lit(n).alias(c) for c, n in (("adds", 1), ("updates", 0), ("noops", 0))]
    keyed = lambda t: t.withColumn("fact_key", facts.fact_key(F.col("subject"), F.col("predicate")))
    old, new = keyed(table), keyed(arrivals)
    out = facts.folded(old.select("*", *counts), new, ["fact_key"], order).drop("adds", "updates", "noops")
    names = ["fact_key", "subject", "predicate", "object", "document"]
    both = old.select(*names, F.lit(0).alias("__new"), *(F.lit(None).cast(new.schema[c].dataType).alias(c) for c in order)).unionByName(new.select(*names, F.lit(1).alias("__new"), *order))
    place = F.struct("__new", *order)
    first = both.groupBy("fact_key").agg(F.min_by(F.struct("subject", "predicate"), place).alias("n")).select("fact_key", "n.*")
    documents = both.groupBy("fact_key", "object").agg(F.min_by("document", place).alias("document"))
    return out.join(first, "fact_key").join(documents, ["fact_key", "object"])


def recalled_facts(table: DataFrame, question: str, k: int = 5) -> DataFrame:
    """ITEM and score: facts about the question's entities by keywords, or by keywords alone where it has none.

    Rows without a common word are left out, as in any keyword search.
    """
    said = facts.fact_text(F.col("subject"), F.col("predicate"), F.col("object"))
    rows = table.select(F.concat(F.lit("fact|"), facts.fact_key(F.col("subject"), F.col("predicate"))).alias("id"), F.lit("fact").alias("kind"), said.alias("text"), "document", F.array_union(X.entities(said), F.array(X.normalized_entity(F.col("subject")))).alias("entities"))
    wanted = search.entities_of(question)
    if wanted:
        rows = rows.where(F.arrays_overlap("entities", X.strings(wanted)))
    return ranking.top(ranking.bm25(rows, question, "id").where("score > 0").select(*ITEM, "score"), k, "id")


def recalled_paths(edges: DataFrame, question: str, comention_edges: bool = True) -> DataFrame:
    """ITEM and score for each path of two edges from an entity of the question."""
    paths = graph.two_hops(edges, search.entities_of(question), comention_edges)
    text = F.concat_ws("; ", F.concat_ws(" ", "src", "p1", "mid"), F.concat_ws(" ", "mid", "p2", "dst"))
    return paths.select(F.concat(F.lit("path:"), text).alias("id"), F.lit("graph").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("document"), F.lit(1.0).alias("score")).distinct()


def hybrid(question: str, sources: dict[str, DataFrame], budget: int = 1200) -> DataFrame:
    """kind, id, text, place: what fits the budget, in order of trust and then of rank.

    sources: by name of route, rows of ITEM and score, the first k of each; those that are
    missing are not asked. An item that does not fit, or that came before, is passed over.
    """
    asked = [(n, sources[s]) for n, s in enumerate(route(question)) if s in sources]
    if not asked:
        raise ValueError("no memory for this question")
    ranked = [s.select(*ITEM, F.lit(n).alias("__source"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("__rank")) for n, s in asked]  # k rows each
    items = reduce(DataFrame.unionByName, ranked).withColumn("__all", F.lit(1)).withColumn("__cost", X.estimated_tokens(F.col("text")))
    kept = memory.packed(items, ["__all"], ["__source", "__rank"], "id", "__cost", budget).select(F.posexplode("kept").alias("place", "id"))
    one = items.groupBy("id").agg(F.min_by(F.struct("kind", "text", "document"), F.struct("__source", "__rank")).alias("x"))
    return kept.join(one, "id").select("place", "id", "x.kind", "x.text", "x.document")


def applied_lessons(lessons: DataFrame, task: str, known: DataFrame, name: str = "document") -> DataFrame:
    """The known documents that lessons for this task prefer; of each family the newest if a lesson asks for it.

    lessons has trigger and prefer_documents (arrays of strings) and prefer_latest. A preferred
    document is a glob, compared in lower case.
    """
    now = F.lit(task)
    matching = lessons.where(memory.lesson_matches(F.col("trigger"), now))
    globs = matching.select(F.explode("prefer_documents").alias("glob")).distinct()
    pattern = F.lower("glob")
    for part, by in ((r"([.+^$(){}|\\])", r"\\$1"), (r"\[!", "[^"), (r"\?", "."), (r"\*", ".*")):
        pattern = F.regexp_replace(pattern, part, by)
    pattern = F.concat(F.lit("(?s)^"), pattern, F.lit("$"))
    found = known.select(name).distinct().join(F.broadcast(globs.select(pattern.alias("__glob"))), F.expr(f"rlike(lower({name}), __glob)"), "left_semi")  # as many globs as lessons that match
    latest = matching.agg(F.coalesce(F.bool_or("prefer_latest"), F.lit(False)).alias("__latest"))
    newest = memory.newest_of_families(found, name).select(F.col(name).alias("__newest"))
    marked = found.crossJoin(F.broadcast(latest)).join(newest, F.col(name) == F.col("__newest"), "left")  # one row of latest
    return marked.where(~F.col("__latest") | F.col("__newest").isNotNull()).select(name)


def context(system: str, goal: str, turns: DataFrame, observations: DataFrame, group: list[str], t: str, line: str, budget: int) -> DataFrame:
    """group and the packed context: the newest turns that fit, then the newest observations that still do.

    Raises ValueError if the system's text and the goal alone do not fit.
    """
    cost = lambda s: max(1, -(-len(s) // X.TOKEN_CHARS)) if s else 0
    head = [system, f"Goal: {goal}"]
    spent = sum(map(cost, head))
    if spent > budget:
        raise ValueError("system prompt and goal do not fit in the budget")
    price = X.estimated_tokens(F.col(line))
    said = memory.newest_within(turns, group, [F.desc(t)], price, budget, spent)
    joined = lambda rows, name: rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(t, line))).alias("__rows"), F.max("running").alias("__used")).select(*group, F.transform("__rows", lambda r: r[line]).alias(name), "__used")
    kept_turns = joined(said, "turns")
    every = observations.select(*group).union(turns.select(*group)).distinct()
    used = every.join(kept_turns, group, "left").select(*group, F.coalesce("turns", F.array().cast("array<string>")).alias("turns"), F.coalesce("__used", F.lit(spent)).alias("__spent"))
    seen = observations.join(used.select(*group, "__spent"), group)
    notes = joined(memory.newest_within(seen, group, [F.desc(t)], price, budget, F.col("__spent")).drop("__spent"), "notes").drop("__used")
    both = used.join(notes, group, "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
    text = F.array_join(F.concat(F.array(*map(F.lit, head)), F.array(F.lit("Observations:")), F.col("notes"), F.array(F.lit("Recent turns:")), F.col("turns")), "\n")
    return both.select(*group, text.alias("context"))


def answered(items: DataFrame, question: str, key: str = "id", rank: str = "rank") -> DataFrame:
    """One row: the sentence that says most of the question, with its citation; later items count a little less.

    items has text, citation and rank from 0. Where nothing scores above 0 there is no citation.
    """
    asked = F.lit(question)
    each = items.select(rank, key, "citation", F.posexplode(X.sentences(F.col("text"))).alias("at", "sentence"))
    shared = lambda f: F.size(F.array_intersect(f(asked), f(F.col("sentence"))))
    numbers = F.when(F.col("sentence").rlike("[0-9]"), 0.5).otherwise(0.0) + F.when(F.size(X.quantities(F.col("sentence"))) > 0, 2.0).otherwise(0.0)
    scored = each.withColumn("score", F.round(shared(X.content_words) + shared(X.entities) + numbers - F.col(rank) * 0.1, 6)).where("score > 0")
    best = scored.agg(F.max_by(F.struct("sentence", "citation", "score"), F.struct("score", (-F.col(rank)).alias("r"), (-F.col("at")).alias("a"))).alias("b"))
    return best.select(F.coalesce("b.sentence", F.lit("not found in the documents")).alias("answer"), F.col("b.citation").alias("citation"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def items_json(items: DataFrame, key: str = "id") -> DataFrame:
    """One row: the items as a JSON array, for tools that take text."""
    return items.agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", key, "text", "citation")))).alias("items"))


def run_pass(questions: DataFrame, lessons: DataFrame, known: DataFrame, ask, name: str = "document") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answer each question with the lessons so far; episodes, the lessons after it, and one row of success_rate.

    questions has id, question and expected_documents, a reviewed set of a few rows that the
    driver goes through, as each lesson counts for the next question. ask(question, documents) returns a
    DataFrame with a citation, '<document> p.<page>' or a document's name; documents is None where no lesson applies.
    """
    spark = questions.sparkSession
    episodes = []
    for q in questions.orderBy("id").collect():
        wanted = [r[0] for r in applied_lessons(lessons, q.question, known, name).orderBy(name).collect()]
        cited = [r[0] for r in ask(q.question, wanted or None).select("citation").collect() if r[0]]
        episode = spark.createDataFrame([(q.id, q.question, q.expected_documents, cited)], EPISODE).withColumn("success", succeeded(F.col("citations"), F.col("expected_documents")))
        ok = episode.first().success
        episodes.append((q.id, q.question, q.expected_documents, cited, ok))
        if not ok:
            lessons = spark.createDataFrame(lessons.unionByName(reflected(episode)).dropDuplicates(["trigger"]).collect(), LESSON)
    done = spark.createDataFrame(episodes, EPISODE + ", success boolean")
    return done, lessons, done.agg(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("success_rate"))


EPISODE = "id string, question string, expected_documents array<string>, citations array<string>"
LESSON = "trigger array<string>, prefer_documents array<string>, prefer_latest boolean, evidence string"


def succeeded(citations: Column, expected: Column) -> Column:
    """Whether a cited document is an expected one, in any case."""
    names = F.transform(citations, lambda c: F.lower(F.split(c, " p\\.")[0]))
    return F.arrays_overlap(names, F.transform(expected, F.lower))


def reflected(episodes: DataFrame) -> DataFrame:
    """LESSON of each failed episode: its telling words, the families of the expected documents, and whether it asks for the newest."""
    failed = episodes.where("NOT success")
    families = F.array_sort(F.array_distinct(F.transform("expected_documents", X.family)))
    latest = F.lower("question").rlike(r"\b(latest|most recent|current|newest|this year)\b")
    return failed.select(memory.trigger(F.col("question")).alias("trigger"), families.alias("prefer_documents"), latest.alias("prefer_latest"), F.col("id").alias("evidence"))


def lesson_text(trigger: Column, prefer_documents: Column, prefer_latest: Column) -> Column:
    where = F.when(F.size(prefer_documents) > 0, F.array_join(prefer_documents, ", ")).otherwise("any document")
    return F.concat(F.lit("For tasks about "), F.array_join(trigger, " "), F.lit(": look in "), where, F.when(prefer_latest, ", newest first").otherwise(""))
