"""Quality rules with thresholds that follow each language and source.

Every document gets integer measures. A histogram per (language, source) and measure is the
quantile sketch: a value falls into the bucket of its leading six binary digits, so quantiles
are off by at most 1/32, and sketches merge by adding counts. Counts are whole numbers and
addition has no order, so a lost task computed anew gives the same thresholds.

A group's fence for a measure is its median plus or minus SPREAD times the distance between
the median and the quantile on the *other* side, at least the measure's slack. Junk on one side
of a distribution does not move the other side, so fences hold with a good deal of junk in a
group. Groups with fewer than MIN_GROUP rows borrow the merged sketch of their language, and
beyond that of the whole table.

Cases. Null or empty text: no words, base_failed. Null language or source: a group like any
other. Repeated rows: each is counted and returned. Empty table: empty result. The measures
are computed from whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import WHITESPACE, prefixed, small_batches, staged

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
NOT_IN_WORDS = WHITESPACE + bytes(range(0x80, 0xC0))  # white space, and bytes that continue a code point
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_GROUP, SPREAD = 100, 6
#: measure, its SQL, side (1: too much is bad, -1: too little), slack
FEATURES = (
    ("symbols", "1000 * n_symbols div n_words", 1, 100),
    ("repeats", "1000 * n_repeat_words div n_words", 1, 300),
    ("dup_lines", "1000 * n_dup_lines div n_lines", 1, 400),
    ("upper", "1000 * n_upper div word_chars", 1, 150),
    ("long_words", "100 * word_chars div n_words", 1, 200),
    ("short_words", "100 * word_chars div n_words", -1, 200),
)
LONG = 50_000  # words; above, windows are counted in arrays, which take less memory


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in windows of three words that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    if n > LONG:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
        pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        _, back, count = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        hit = count[back] > 1
    else:
        grams = list(zip(words, words[1:], words[2:]))
        if len(set(grams)) == n:
            return 0
        count = Counter(grams)
        hit = np.fromiter((count[g] > 1 for g in grams), bool, n)
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= hit
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, NOT_IN_WORDS)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
    )


def with_measures(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The table with a long column for each of MEASURES, and the names those got."""
    names = prefixed(docs, *MEASURES)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[m], T.LongType()) for m in MEASURES)])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(at), pa.binary())
            rows = [measure(x.as_py() or b"") for x in texts]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names.values()])

    return small_batches(docs).mapInArrow(run, schema), names


def bucket(value: Column) -> Column:
    """The value with all but its six leading binary digits zero."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def base_failed(n: dict[str, str]) -> Column:
    return (F.col(n["n_words"]) < MIN_WORDS) | (100 * F.col(n["n_repeat_words"]) > MAX_REPEAT_PERCENT * F.col(n["n_words"]))


def feature(sql: str, n: dict[str, str]) -> Column:
    for name, real in n.items():
        sql = sql.replace(name, f"`{real}`")
    return F.expr(f"CASE WHEN `{n['n_words']}` > 0 THEN {sql} END")


def sketches(measured: DataFrame, n: dict[str, str], lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable histograms: lang, source, feature, bucket, n. All documents with a word count."""
    each = measured.where(F.col(n["n_words"]) > 0).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), bucket(feature(sql, n)).alias("bucket")) for f, sql, _, _ in FEATURES))).alias("x"),
    )
    return each.groupBy("lang", "source", "x.feature", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): fence_<feature> for each feature.

    The sketch has a bounded number of buckets for each group, whatever the number of rows.
    """
    levels = {
        2: sketch.select("lang", "source", "feature", "bucket", "n"),
        1: sketch.groupBy("lang", "feature", "bucket").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("source"), "feature", "bucket", "n"),
        0: sketch.groupBy("feature", "bucket").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "feature", "bucket", "n"),
    }
    key = ["lang", "source", "feature"]
    quantiles = {}
    for k, s in levels.items():
        s = s.withColumn("total", F.sum("n").over(Window.partitionBy(*key))).withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("bucket")))
        at = [F.min(F.when(F.col("upto") * 100 >= q * F.col("total"), F.col("bucket"))).alias(f"q{q}") for q in (10, 50, 90)]
        quantiles[k] = s.groupBy(*key).agg(F.max("total").alias("total"), *at)
    side = F.create_map(*(F.lit(x) for f, _, s, _ in FEATURES for x in (f, s)))[F.col("feature")]
    slack = F.create_map(*(F.lit(x) for f, _, _, k in FEATURES for x in (f, k)))[F.col("feature")]
    q2, q1, q0 = (quantiles[k].alias(f"l{k}") for k in (2, 1, 0))
    picked = q2.join(q1, F.col("l2.lang").eqNullSafe(F.col("l1.lang")) & (F.col("l2.feature") == F.col("l1.feature"))).join(q0, F.col("l2.feature") == F.col("l0.feature"))

    def of(c: str) -> Column:
        return F.when(F.col("l2.total") >= MIN_GROUP, F.col(f"l2.{c}")).when(F.col("l1.total") >= MIN_GROUP, F.col(f"l1.{c}")).otherwise(F.col(f"l0.{c}")).alias(c)

    picked = picked.select("l2.lang", "l2.source", "l2.feature", *(of(f"q{q}") for q in (10, 50, 90)))
    fence = F.when(side == 1, F.col("q50") + F.greatest(slack, SPREAD * (F.col("q50") - F.col("q10")))).otherwise(F.col("q50") - F.greatest(slack, SPREAD * (F.col("q90") - F.col("q50"))))
    return picked.groupBy("lang", "source").agg(*(F.max(F.when(F.col("feature") == f, fence)).alias(f"fence_{f}") for f, *_ in FEATURES))


def judged(measured: DataFrame, fence: DataFrame, n: dict[str, str], lang: str = "lang", source: str = "source") -> tuple[DataFrame, str, str]:
    """The measured table with the columns base_failed and kept, and the names these got."""
    own = prefixed(measured, "base_failed", "kept", *(f"fence_{f}" for f, *_ in FEATURES))
    right = fence.select(F.col("lang").alias("__fence_lang"), F.col("source").alias("__fence_source"), *(F.col(f"fence_{f}").alias(own[f"fence_{f}"]) for f, *_ in FEATURES))
    both = measured.join(right, F.col(lang).eqNullSafe(F.col("__fence_lang")) & F.col(source).eqNullSafe(F.col("__fence_source")), "left")
    inside = F.lit(True)
    for f, sql, side, _ in FEATURES:
        v, limit = feature(sql, n), F.col(own[f"fence_{f}"])
        inside = inside & (v <= limit if side == 1 else v >= limit)
    failed = base_failed(n)
    out = both.withColumn(own["base_failed"], failed).withColumn(own["kept"], ~failed & F.coalesce(inside, F.lit(False)))
    return out.drop("__fence_lang", "__fence_source", *(own[f"fence_{f}"] for f, *_ in FEATURES)), own["base_failed"], own["kept"]


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the measures, base_failed and kept; texts are read once."""
    measured, n = with_measures(docs.select("doc_id", "lang", "source", "text"))
    measured = staged(measured.drop("text"), "quality")
    out, failed, kept = judged(measured, staged(fences(sketches(measured, n)), "fences"), n)
    return out.select("doc_id", "lang", "source", *MEASURES, F.col(failed).alias("base_failed"), F.col(kept).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text passes, with the columns of docs.

    The sketches come from one scan and the verdicts from a second one, so no text is shuffled.
    """
    slim, n = with_measures(docs.select("lang", "source", "text"))
    fence = staged(fences(sketches(slim.drop("text"), n)), "fences")
    measured, n = with_measures(docs)
    out, _, kept = judged(measured, fence, n)
    return out.where(F.col(kept)).select(*docs.columns)
