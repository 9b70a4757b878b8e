"""Short, equal and nearly equal chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

MIN_CHARS, THRESHOLD = 60, 0.97
BITS, BUCKET, MISS = 12, 256, 1.2e-5  # signs a table, rows a bucket that more signs keep to, and how likely a pair at the threshold meets in no table
CHUNK, PRODUCTS = 256, 1 << 22  # leaders compared at once, and products held


def long_enough(chunks: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    return chunks.where(F.length(text) >= min_chars)


def first_of_equal(chunks: DataFrame, order: str, text: str = "text") -> DataFrame:
    """The first row of each normalised text; a minimum is aggregated, so no group is sorted."""
    keyed = chunks.withColumn("__key", X.dedup_key(F.col(text)))
    first = keyed.groupBy("__key").agg(F.min(order).alias("__first"))
    return keyed.join(first, "__key").where(F.col(order) == F.col("__first")).drop("__key", "__first")


def tables_of(rows: int, threshold: float) -> tuple[int, int]:
    """How many tables under how many signs, so that buckets stay small however many rows there are."""
    bits = max(BITS, math.ceil(math.log2(max(rows, 1) / BUCKET)))
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return (1 if meet == 1 else math.ceil(math.log(MISS) / math.log1p(-meet))), bits


def blockers(matrix: np.ndarray, places: np.ndarray, kept: int, threshold: float) -> np.ndarray:
    """For each vector of a bucket one that is similar and earlier, or kept; -1 where there is none.

    The first `kept` vectors are kept already, the others are in order, with equal places for equal keys. A vector
    that none before it blocks is a leader, and only leaders are compared with all, so many vectors that
    are all similar cost one comparison each. A last step compares leaders with the blocked ones before them.
    """
    out = np.full(len(matrix), -1)
    left = np.arange(kept, len(matrix))

    def first(rows: np.ndarray, by: np.ndarray, always: bool) -> np.ndarray:
        """For each row the first similar one of by, or -1."""
        found = np.full(len(rows), -1)
        step = max(1, PRODUCTS // max(1, len(by)))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            near = matrix[some] @ matrix[by].T >= threshold
            if not always:
                near &= places[by][None, :] < places[some][:, None]
            has = near.any(1)
            found[k : k + step][has] = by[near.argmax(1)[has]]
        return found

    for k in range(0, kept, CHUNK):
        by = first(left, np.arange(k, min(k + CHUNK, kept)), True)
        out[left[by >= 0]] = by[by >= 0]
        left = left[by < 0]
    open_ = left  # what kept vectors drop blocks no other
    leaders = []
    while len(left):
        head, left = left[:CHUNK], left[CHUNK:]
        by = first(head, head, False)
        out[head[by >= 0]] = by[by >= 0]
        led = head[by < 0]
        leaders.append(led)
        by = first(left, led, False)
        out[left[by >= 0]] = by[by >= 0]
        left = left[by < 0]
    if leaders:
        led, blocked = np.concatenate(leaders), open_[out[open_] >= 0]
        for k in range(0, len(blocked), CHUNK):
            led = led[out[led] < 0]
            by = first(led, blocked[k : k + CHUNK], False)
            out[led[by >= 0]] = by[by >= 0]
    return out


def blocked_pairs(vectors: DataFrame, order: str, embedding: str, threshold: float, tables: int, bits: int, again: bool) -> DataFrame:
    """low, high: for each unit vector that is not kept and each bucket of it a similar one that is kept or smaller, if there is any.

    Vectors have a column `kept`. Each enters every table under its signs towards random hyperplanes, so only vectors that
    share a bucket are compared, by all bits. After the first round buckets of kept vectors alone are left out.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = matrix_of(batch.column(2))
            if planes is None:
                planes = np.random.default_rng(5).normal(size=(matrix.shape[1], tables * bits))
            signs = ((matrix @ planes) >= 0).reshape(len(matrix), tables, bits)
            codes = signs @ (1 << np.arange(bits)) + (np.arange(tables) << bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "buckets"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, kept, lists in buckets_of(batches):
            if len(keys) > 1 and kept < len(keys):
                places = np.asarray(keys.dictionary_encode().indices)  # sorted keys, so codes are in order
                by = blockers(matrix_of(lists), places, kept, threshold)
                high = np.flatnonzero(by >= 0)
                if len(high):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(by[high])), keys.take(pa.array(high))], ["low", "high"])

    kind = vectors.schema[order].dataType
    slim = vectors.select("kept", order, embedding)
    schema = T.StructType([*slim.schema.fields, T.StructField("buckets", T.ArrayType(T.LongType()))])
    each = slim.mapInArrow(hashed, schema).select(F.explode("buckets").alias("bucket"), "kept", order, embedding)
    if again:
        each = each.join(each.where("NOT kept").select("bucket").distinct(), "bucket", "left_semi")
    dealt = each.repartition("bucket").sortWithinPartitions("bucket", F.desc("kept"), order)
    return dealt.mapInArrow(compared, T.StructType([T.StructField("low", kind), T.StructField("high", kind)])).distinct()


def matrix_of(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).astype(np.float64, copy=False).reshape(len(lists), -1)


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int, pa.Array]]:
    """keys, number of kept ones and vectors of each bucket in sorted rows of bucket, kept, key and vector."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[pa.Array, int, pa.Array]:
        one = pa.Table.from_batches(held).combine_chunks()
        keys, lists = (one.column(k).combine_chunks() for k in (2, 3))
        return keys, int(np.asarray(one.column(1)).sum()), lists

    for batch in batches:
        bucket = np.asarray(batch.column(0))
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        for start, end in zip(starts, [*starts[1:], len(bucket)]):
            if held and held[0].column(0)[0].as_py() != bucket[start]:
                yield whole()
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield whole()


def written(rows: DataFrame) -> DataFrame:
    """Kept by the session: in spark.checkpoint.dir where that is set."""
    return rows.checkpoint() if rows.sparkSession.conf.get("spark.checkpoint.dir", None) else rows.persist()


def greedy_kept(rows: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """Rows that a scan in order keeps, dropping each row that a kept one is similar to.

    Rounds over the pairs: a row without an undecided smaller partner is kept, and its larger
    partners go. Chains of similar rows set the number of rounds, not the number of rows.
    """
    pairs, dropped = written(pairs), None
    left = pairs
    while not left.isEmpty():
        kept = left.select(F.col("low").alias("id")).distinct().join(left.select(F.col("high").alias("id")).distinct(), "id", "left_anti")
        gone = left.join(kept.withColumnRenamed("id", "low"), "low", "left_semi").select(F.col("high").alias("id")).distinct().persist()
        dropped = gone if dropped is None else dropped.union(gone)
        left = left.join(kept.withColumnRenamed("id", "low"), "low", "left_anti").join(gone.withColumnRenamed("id", "low"), "low", "left_anti").join(gone.withColumnRenamed("id", "high"), "high", "left_anti").persist()
    return rows if dropped is None else rows.join(dropped.withColumnRenamed("id", order), order, "left_anti")


def near_distinct(vectors: DataFrame, order: str, embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Rows that a scan in order keeps, dropping each row whose unit vector reaches the threshold with a kept one.

    In each round a row without a similar undecided row before it is kept, and what such rows block goes. Rounds
    follow chains of similar rows, and each compares the undecided rows with those that share a bucket.
    """
    left = written(vectors.select(F.lit(False).alias("kept"), order, embedding).where(F.col(embedding).isNotNull()))
    tables, bits = tables_of(left.count(), threshold)
    all_, dropped = left, None
    while True:
        pairs = written(blocked_pairs(left, order, embedding, threshold, tables, bits, dropped is not None))
        blocked = pairs.select(F.col("high").alias(order)).distinct()
        sure = pairs.join(blocked.withColumnRenamed(order, "low"), "low", "left_anti")
        gone = written(sure.select(F.col("high").alias(order)).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        open_ = written(blocked.join(gone, order, "left_anti"))
        if open_.isEmpty():
            return vectors.join(dropped, order, "left_anti")
        left = all_.join(dropped, order, "left_anti").drop("kept").join(open_.withColumn("__open", F.lit(True)), order, "left").withColumn("kept", F.col("__open").isNull()).drop("__open")


def report(chunks: DataFrame, order: str, text: str = "text") -> DataFrame:
    """One row: input, dropped_short, dropped_exact, kept."""
    short = F.length(text) < MIN_CHARS
    counts = chunks.agg(F.count("*").alias("input"), F.sum(short.cast("long")).alias("dropped_short"), F.countDistinct(F.when(~short, X.dedup_key(F.col(text)))).alias("kept"))
    return counts.select("input", "dropped_short", (F.col("input") - F.col("dropped_short") - F.col("kept")).alias("dropped_exact"), "kept")


def full_report(chunks: DataFrame, order: str, text: str = "text", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row: input, dropped_short, dropped_exact, dropped_near, kept, reduction."""
    exact = first_of_equal(long_enough(chunks, text), order, text)
    kept = near_distinct(exact.select(order, embedding), order, embedding, threshold)
    one = report(chunks, order, text).withColumnRenamed("kept", "__exact").crossJoin(kept.agg(F.count("*").alias("kept")))  # one row each
    share = F.when(F.col("input") > 0, 1 - F.col("kept") / F.col("input")).otherwise(0.0)
    return one.select("input", "dropped_short", "dropped_exact", (F.col("__exact") - F.col("kept")).alias("dropped_near"), "kept", F.round(share, 6).alias("reduction"))
