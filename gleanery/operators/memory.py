"""Keyed tables of memories: upserts, deletes, expiry, audit, budgets and lessons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def merged(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Fields that new has overwrite, nulls included; the others stay. Of several keys all must be equal."""
    keys = [key] if isinstance(key, str) else key
    own = [c for c in new.columns if c not in keys]
    same = reduce(lambda a, b: a & b, (F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys))
    both = old.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), same, "full_outer")
    pick = lambda c: F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in own else F.col(f"o.{c}").alias(c)
    return both.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), *(pick(c) for c in old.columns if c not in keys))


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def changed(sources: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Sources that the manifest does not have with the same values; nulls equal nulls."""
    m = manifest.select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return sources.join(m, same, "left_anti")


def live(rows: DataFrame, now: Column, expires_at: str = "expires_at") -> DataFrame:
    return rows.where(~F.coalesce(F.col(expires_at) < now, F.lit(False)))


def packed(items: DataFrame, group: list[str], order: list[str], item: str, cost: str, budget: int) -> DataFrame:
    """Items that fit, in order; one that does not fit is passed over, and so are repeats."""
    each = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("__item"), F.col(cost).cast("long").alias("__cost"))))

    def step(s: Column, x: Column) -> Column:
        fits = (s["used"] + x["__cost"] <= budget) & ~F.array_contains(s["kept"], x["__item"])
        more = F.struct((s["used"] + x["__cost"]).alias("used"), F.concat(s["kept"], F.array(x["__item"])).alias("kept"))
        return F.when(fits, more).otherwise(s)

    kind = items.schema[item].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("kept"))
    return items.groupBy(*group).agg(each.alias("e")).select(*group, F.aggregate("e", start, step).alias("s")).select(*group, "s.used", "s.kept")


def newest_within(items: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int, spent: Column | int = 0) -> DataFrame:
    """Items from the newest on until the first that does not fit."""
    running = F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return items.withColumn("running", running + spent).where(F.col("running") <= budget)


def reflected(log: DataFrame, group: list[str], t: str, text: str, priority: Column, cost: Column, budget: int) -> DataFrame:
    """Without repeats and, beyond the budget, without the lowest and oldest; one item stays."""
    norm = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+", " ")
    first = F.row_number().over(Window.partitionBy(*group, norm).orderBy(t))
    one = log.withColumn("__first", first).where("__first = 1").drop("__first")
    by = Window.partitionBy(*group).orderBy(priority.desc(), F.desc(t))
    kept = one.withColumn("__sum", F.sum(cost).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__rank", F.row_number().over(by))
    return kept.where((F.col("__sum") <= budget) | (F.col("__rank") == 1)).drop("__sum", "__rank")


def trigger(task: Column) -> Column:
    """The four longest content words, ties in alphabetical order."""
    ws = F.transform(F.array_distinct(X.content_words(task)), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(ws), 1, 4), lambda s: s["w"])


def lesson_matches(trigger_words: Column, task: Column, overlap: int = 2) -> Column:
    shared = F.size(F.array_intersect(trigger_words, X.content_words(task)))
    return shared >= F.least(F.lit(overlap), F.size(trigger_words))


def newest_of_families(documents: DataFrame, name: str) -> DataFrame:
    """Per family of names the one with the greatest digit groups, compared as text."""
    digits = F.regexp_extract_all(F.col(name), F.lit("[0-9]+"), 0)
    return documents.groupBy(X.family(F.col(name)).alias("family")).agg(F.max_by(name, F.struct(digits, F.col(name))).alias(name))


def notes(rows: DataFrame, text: str, as_of: Column, ttl_days: int | None = 30) -> DataFrame:
    """Notes as memories: personal data masked, entities found, and an expiry."""
    clean = X.redacted(F.col(text))
    expires = F.lit(None).cast("timestamp") if ttl_days is None else as_of.cast("timestamp") + F.make_dt_interval(F.lit(ttl_days))
    return rows.select(
        X.safe_key(F.concat(F.lit("note|"), clean)).alias("id"), F.lit("note").alias("kind"), clean.alias("text"), as_of.cast("timestamp").alias("created_at"), X.entities(clean).alias("entities"), expires.alias("expires_at"),
    )


def audited(op: str, details: DataFrame, as_of: Column) -> DataFrame:
    """Audit rows for an operation: one for each row of details, with its columns as JSON."""
    detail = F.to_json(F.struct(*details.columns), {"ignoreNullFields": "false"})
    key = X.safe_key(F.concat_ws("|", F.lit("audit"), as_of.cast("string"), F.lit(op), detail))
    return details.select(key.alias("id"), F.lit("audit").alias("kind"), F.concat_ws(" ", F.lit(op), detail).alias("text"), as_of.cast("timestamp").alias("created_at"), detail.alias("attributes"))


def forgotten(tables: dict[str, DataFrame], names: DataFrame, column: str = "document") -> dict[str, DataFrame]:
    """Each table without the rows of the named documents; audit rows stay."""
    out = {}
    for name, rows in tables.items():
        kept = without(rows, names, column)
        out[name] = kept.unionByName(rows.join(names, column, "left_semi").where("kind = 'audit'")) if "kind" in rows.columns else kept
    return out


def index_documents(chunks: DataFrame, dates: DataFrame) -> DataFrame:
    """Chunks as index rows: safe key, the document's date, sorted entities."""
    return chunks.join(dates, "document", "left").select(X.safe_key(F.col("id")).alias("id"), "text", "document", F.col("created_at"), X.entities(F.col("text")).alias("entities"))


def item(rows: DataFrame) -> DataFrame:
    """Search rows as memory items: the reranker's score before the plain one, and a citation."""
    score = F.coalesce("reranker_score", "score", F.lit(0.0))
    page = F.coalesce("page_start", "page")
    return rows.select("id", "text", "document", page.alias("page"), score.alias("score"), X.citation(F.col("document"), page).alias("citation"))
