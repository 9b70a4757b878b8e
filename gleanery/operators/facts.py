"""Facts from tables and sentences, and their consolidation per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

TABLE_CONFIDENCE, QUANTITY_CONFIDENCE, AFFECTS_CONFIDENCE = 0.95, 0.6, 0.7
FACT = "array<struct<subject:string,predicate:string,object:string>>"


def cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def table_facts(text: Column) -> Column:
    """Facts of pipe tables: one fold over the lines with the header of the table they are in."""

    def step(state: Column, line: Column) -> Column:
        row = cells(line)
        header, facts = state["header"], state["facts"]
        names = F.transform(row, lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", ""))
        n = F.least(F.size(header), F.size(row))
        new = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.struct(row[0].alias("subject"), F.get(header, k).alias("predicate"), F.get(row, k).alias("object")))
        new = F.filter(new, lambda f: f["predicate"].isNotNull() & (F.length(f["object"]) > 0)).cast(FACT)
        keep = F.struct(header.alias("header"), facts.alias("facts"))
        return (
            F.when(line.startswith("|---"), keep).when(~line.startswith("|"), F.struct(F.lit(None).cast("array<string>").alias("header"), facts.alias("facts")))
            .when(header.isNull(), F.struct(names.alias("header"), facts.alias("facts"))).otherwise(F.struct(header.alias("header"), F.concat(facts, new).alias("facts")))
        )

    start = F.struct(F.lit(None).cast("array<string>").alias("header"), F.array().cast(FACT).alias("facts"))
    return F.aggregate(F.split(text, "\r?\n"), start, step)["facts"]


def subject_before(text: Column) -> Column:
    """Up to four words before the end, back to a stop word or verb; such words at the end are skipped."""
    plain = X.strings(X.STOP_WORDS + X.VERBS)

    def step(s: Column, w: Column) -> Column:
        weak, n = F.array_contains(plain, F.lower(w)), F.size(s["phrase"])
        closed = s["closed"] | (weak & (n > 0)) | (n == 4)
        return F.struct(closed.alias("closed"), F.when(closed | weak, s["phrase"]).otherwise(F.concat(F.array(w), s["phrase"])).alias("phrase"))

    found = F.reverse(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_-]+"), 0))
    start = F.struct(F.lit(False).alias("closed"), F.array().cast("array<string>").alias("phrase"))
    return F.lower(F.array_join(F.aggregate(found, start, step)["phrase"], " "))


def quantity_facts(sentence: Column) -> Column:
    """Each value with a unit, under the words before it."""
    values, pieces = X.quantities(sentence), F.split(sentence, X.bounded(X.QUANTITY), -1)

    def fact(value: Column, k: Column) -> Column:
        before = F.array_join(F.zip_with(F.slice(pieces, 1, k + 1), F.concat(F.slice(values, 1, k), F.array(F.lit(""))), lambda p, v: F.concat(p, v)), "")
        unit = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(value, X.bounded(X.QUANTITY), 2)), "%", "percent"), " ", "_")
        return F.struct(subject_before(before).alias("subject"), F.concat(F.lit("value_"), unit).alias("predicate"), value.alias("object"))

    return F.filter(F.transform(values, fact), lambda f: F.length(f["subject"]) > 0).cast(FACT)


def affects_facts(sentence: Column) -> Column:
    """Each campaign with each model of the sentence."""
    found = X.entities(sentence)
    campaigns = F.filter(found, lambda e: e.rlike("^[0-9]{2}V[0-9]{3,6}$"))
    models = F.filter(found, lambda e: ~e.rlike("^[0-9]{2}V[0-9]{3,6}$") & ~e.rlike("^[0-9]+$"))
    return F.flatten(F.transform(campaigns, lambda c: F.transform(models, lambda m: F.struct(c.alias("subject"), F.lit("affects").alias("predicate"), m.alias("object"))))).cast(FACT)


def extracted(chunks: DataFrame, text: str = "text") -> DataFrame:
    """The columns of chunks without the text, with subject, predicate, object and confidence."""
    rest = [c for c in chunks.columns if c != text]
    said = F.filter(X.sentences(F.col(text)), lambda s: ~s.startswith("|"))
    with_confidence = lambda facts, c: F.transform(facts, lambda f: F.struct(f["subject"].alias("subject"), f["predicate"].alias("predicate"), f["object"].alias("object"), F.lit(c).alias("confidence")))
    every = F.concat(
        with_confidence(table_facts(F.col(text)), TABLE_CONFIDENCE), with_confidence(F.flatten(F.transform(said, quantity_facts)), QUANTITY_CONFIDENCE), with_confidence(F.flatten(F.transform(said, affects_facts)), AFFECTS_CONFIDENCE),
    )
    return chunks.select(*rest, F.explode(every).alias("fact")).select(*rest, "fact.*")


def fact_key(subject: Column, predicate: Column) -> Column:
    name = X.normalized_entity(subject)
    return F.concat_ws("|", F.when(F.length(name) > 0, name).otherwise(F.lower(subject)), predicate)


def flat(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def consolidated(facts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: object, valid_from, confidence, history and the counts of each operation.

    facts has object, valid_from (ISO text or null) and confidence. Arrivals are folded in order:
    an equal object keeps the larger confidence; another one replaces it unless it is older.
    """
    cols = [*order, "object", "valid_from", "confidence"]
    arrivals = F.array_sort(F.collect_list(F.struct(*cols)))
    texts = "array<string>"

    def step(s: Column, a: Column) -> Column:
        def state(object, valid_from, confidence, history, add=0, update=0, noop=0):
            return F.struct(
                object.alias("object"), valid_from.alias("valid_from"), confidence.alias("confidence"), history.alias("history"),
                (s["adds"] + add).alias("adds"), (s["updates"] + update).alias("updates"), (s["noops"] + noop).alias("noops"),
            )

        old = (s["object"], s["valid_from"])
        newer = F.coalesce(a["valid_from"], F.lit("")) >= F.coalesce(s["valid_from"], F.lit(""))
        return (
            F.when(s["adds"] == 0, state(a["object"], a["valid_from"], a["confidence"], s["history"], add=1))
            .when(flat(s["object"]) == flat(a["object"]), state(*old, F.greatest(s["confidence"], a["confidence"]), s["history"], noop=1))
            .when(newer, state(a["object"], a["valid_from"], a["confidence"], F.concat(s["history"], F.array(s["object"])), update=1))
            .otherwise(state(*old, s["confidence"], s["history"], noop=1))
        )

    none = F.lit(None).cast("string")
    start = F.struct(
        none.alias("object"), none.alias("valid_from"), F.lit(None).cast("double").alias("confidence"), F.array().cast(texts).alias("history"),
        F.lit(0).alias("adds"), F.lit(0).alias("updates"), F.lit(0).alias("noops"),
    )
    return facts.groupBy(*key).agg(arrivals.alias("a")).select(*key, F.aggregate("a", start, step).alias("s")).select(*key, "s.*")


def folded(now: DataFrame, arrivals: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """A table that consolidated() made, after more arrivals: only its current rows and these are folded."""
    state = ["object", "valid_from", "confidence"]
    old = now.select(*key, *state, F.lit(0).alias("__new"), *(F.lit(None).cast(arrivals.schema[c].dataType).alias(c) for c in order))
    out = consolidated(old.unionByName(arrivals.select(*key, *state, F.lit(1).alias("__new"), *order)), key, ["__new", *order])
    before = now.select(*(F.col(k).alias(f"__{k}") for k in key), *(F.col(c).alias(f"__{c}") for c in ("history", "adds", "updates", "noops")))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    both = out.join(before, reduce(lambda a, b: a & b, same), "left")
    more = lambda c: (F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c)
    history = F.concat(F.coalesce("__history", F.array().cast("array<string>")), F.col("history")).alias("history")
    return both.select(*key, *state, history, F.coalesce("__adds", "adds").alias("adds"), more("updates"), more("noops"))


def fact_text(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.concat_ws(" ", subject, F.replace(predicate, F.lit("_"), F.lit(" ")), obj)
