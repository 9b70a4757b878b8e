"""Shards of near-equal size by sampled splitters.

Records are ordered by (hash of the text, id). A size-weighted sample of keys gives quantile
boundaries for RANGES ranges per shard; what falls into each range is then counted exactly, and
ranges over OVERFULL of a shard are divided again by a denser sample of their own keys. Whole
ranges go to shards by their place in the running total of bytes, so a shard is off by about
half a range at either end. First boundaries lie between texts, so equal texts share a shard,
unless their group is itself overfull; such a group is divided by id.

A key is drawn by a hash, not by a random number, so a lost task draws the same keys again. The
sample has about RANGES * DRAWS rows per shard, whatever the number of records. A slot is the
range's offset in its shard plus the row's place in the range, so no task sorts a whole shard.

Cases. Null text: size 8, checksum 0, like an empty text. Null id: before all others. Repeated
rows: each gets a slot of its own; rows with one key cannot be divided, so a range of a single
key may stay overfull. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import prefixed, staged

SHARDS, RANGES, DRAWS, OVERFULL = 24, 128, 8, 0.02
RECORD_BYTES = 8
LOWEST = -(2**63)
ROUNDS = 8


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h, k, size, text_crc32: what is needed to place a record, without its text."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole = isinstance(docs.schema[doc_id].dataType, T.IntegralType)
    k = F.col(doc_id).cast("long") if whole else F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id))  # ids of other types by their hash
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("h"), F.coalesce(k, F.lit(LOWEST)).alias("k"),
        (F.octet_length(t).cast("long") + RECORD_BYTES).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
    )


def drawn(keys: DataFrame, step: float, seed: int) -> list[tuple[int, int, int]]:
    """(h, k, draws), sorted: each key once for every step of its size, and for the rest by chance."""
    chance = F.pmod(F.xxhash64("h", "k", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = F.floor(F.col("size") / F.lit(step) + chance).cast("long")
    return sorted((r.h, r.k, r.n) for r in keys.select("h", "k", n.alias("n")).where("n > 0").groupBy("h", "k").agg(F.sum("n").alias("n")).collect())


def quantiles(sample: list[tuple[int, int, int]], every: int) -> list[tuple[int, int]]:
    """A boundary before each key at which another so many draws have passed."""
    out, passed, due = [], 0, every
    for h, k, n in sample:
        if passed >= due:
            out.append((h, k))
            due = (passed // every + 1) * every
        passed += n
    return out


class Splitters:
    """Sorted boundaries; range r holds the keys from boundary r - 1 up to, not including, r."""

    def __init__(self, bounds: list[tuple[int, int]]):
        self.bounds = sorted(set(bounds))
        self.h = np.array([b[0] for b in self.bounds], np.int64)
        self.k = np.array([b[1] for b in self.bounds], np.int64)

    def find(self, h: np.ndarray, k: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        out = low.astype(np.int64)
        for at in np.unique(low[high > low]):  # few: the hashes that boundaries name
            rows = np.nonzero((low == at) & (high > at))[0]
            out[rows] = at + np.searchsorted(self.k[at : high[rows[0]]], k[rows], "right")
        return out


def with_range(df: DataFrame, splitters: Splitters, shard: np.ndarray | None = None, offset: np.ndarray | None = None, grown: dict[str, str] | None = None) -> DataFrame:
    """df, which has h and k, with its range and, once they are known, shard and offset."""
    names = grown or {n: n for n in ("range", "shard", "offset")}
    fields = [T.StructField(names["range"], T.LongType())]
    if shard is not None:
        fields += [T.StructField(names["shard"], T.IntegerType()), T.StructField(names["offset"], T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = splitters.find(*(b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("h", "k")))
            new = [pa.array(r)] if shard is None else [pa.array(r), pa.array(shard[r].astype(np.int32)), pa.array(offset[r])]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def planned(keys: DataFrame, shards: int = SHARDS) -> tuple[Splitters, np.ndarray, np.ndarray]:
    """The splitters, and the shard and offset of each range. keys is read several times."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return Splitters([]), np.zeros(1, np.int64), np.zeros(1, np.int64)
    step = total / (shards * RANGES * DRAWS)
    bounds = [(h, LOWEST) for h, _ in quantiles(drawn(keys, step, 0), DRAWS)]
    limit, whole = OVERFULL * total / shards, set()
    for turn in range(ROUNDS + 1):
        split = Splitters(bounds)
        n = len(split.bounds) + 1
        size, rows = np.zeros(n), np.zeros(n, np.int64)
        ranged = with_range(keys, split)
        for r in ranged.groupBy("range").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect():  # a row for each range
            size[r.range], rows[r.range] = r.s, r.n
        edges = [(LOWEST, LOWEST), *split.bounds]
        over = [r for r in range(n) if size[r] > limit and rows[r] > 1 and edges[r] not in whole]
        if not over or turn == ROUNDS:
            break
        dense = drawn(ranged.where(F.col("range").isin(over)), limit / 8, turn + 1)
        more = set(quantiles(dense, 4)) - set(split.bounds)
        found = split.find(np.array([m[0] for m in more], np.int64), np.array([m[1] for m in more], np.int64)) if more else []
        whole |= {edges[r] for r in set(over) - set(map(int, found))}
        bounds = [*split.bounds, *more]
    before = np.cumsum(size) - size
    shard = np.minimum((before + size / 2) * shards // size.sum(), shards - 1).astype(np.int64)
    upto = np.cumsum(rows) - rows
    first = np.searchsorted(shard, shard, "left")
    return split, shard, upto - upto[first]


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row."""
    keys = staged(keyed(docs), "keys")
    placed = with_range(keys, *planned(keys, shards))
    slot = F.col("offset") + F.row_number().over(Window.partitionBy("range").orderBy("h", "k", "text_crc32")) - 1
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the whole records below path/shard=N/, sorted by slot within each file."""
    split, shard, offset = planned(staged(keyed(docs, doc_id, text), "keys"), shards)
    own = prefixed(docs, "h", "k", "range", "shard", "offset")
    if own["h"] != "h" or own["k"] != "k":
        raise ValueError("columns h and k are taken by the splitters; rename them first")
    t = F.coalesce(F.col(text), F.lit(""))
    full = docs.withColumn("h", F.xxhash64(t)).withColumn("k", F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)))
    placed = with_range(full, split, shard, offset, own)
    ordered = placed.repartition(F.col(own["range"])).sortWithinPartitions(own["shard"], own["range"], "h", "k")
    ordered.drop("h", "k", own["range"], own["offset"]).write.partitionBy(own["shard"]).parquet(path)
