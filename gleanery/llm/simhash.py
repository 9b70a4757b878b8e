"""SimHash fingerprints, BK-trees over shards of them, and the components of the links.

Distinct fingerprints are dealt to shards so that any two within the radius share a shard:
64 bits are cut into blocks, and a pair that differs in r bits agrees on at least
blocks - r of them, so every choice of that many blocks is one key. Each shard builds a BK-tree
(children keyed by the Hamming distance to the parent) and each of its fingerprints follows only
the edges within the radius. A tree holds about MAX_SHARD fingerprints at most: keys with more are
cut again, and they alone, over the bits that their members may still differ in, which keeps every
pair; what is still larger after DEPTH cuts is dealt to blocks, and each two blocks share a tree.
Trees are built in the tasks that hold their rows
and are not broadcast from the driver: they hold fingerprints of the whole corpus, which has no
proven bound.

A shard reports a forest rather than all its pairs (each fingerprint and the smallest one of
its part), which has the same components. Parts of different shards are joined by rounds of
star contraction, whose tables are written to the shared folder.

Cases. Null or empty text: fingerprint zero, linked like any other. Fewer words than a shingle:
the whole sequence is the one shingle. Rows with equal texts, and repeated rows, share a
fingerprint and so a component. A component without a non-null id has a null component id.
Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import prefixed, small_batches, staged

SEED, WIDTH, RADIUS = 42, 4, 4
MAX_SHARD, DEPTH = 4096, 3
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
HOT_SHARE = 1000
FLUSH = 1 << 18  # shingles whose bits are summed at once


def shingles(text: bytes, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The hashes of all shingles, FLUSH at a time."""
    words = text.translate(LOWER).split()
    if not words:
        return
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    stops = (ends[-n:] - 1).tolist()
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, FLUSH):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + FLUSH], stops[k : k + FLUSH])], np.uint64)


def majority(parts: Iterator[np.ndarray]) -> int:
    """As a signed long, the bits that are set in over half of the hashes."""
    total, n = np.zeros(64, np.int64), 0
    for h in parts:
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n).view(">i8")[0])


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The SimHash as a signed long."""
    return majority(shingles(text, width))


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = WIDTH) -> tuple[DataFrame, str]:
    """The table without its text and with a fingerprint, and that column's name."""
    rest = [c for c in docs.columns if c != text]
    name = prefixed(docs, "fp")["fp"]
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py() or b"", width) for x in pc.cast(batch.column(len(rest)), pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(fps, pa.int64())], [*rest, name])

    return small_batches(docs).select(*rest, text).mapInArrow(run, schema), name


class BKTree:
    """A BK-tree over 64-bit values that also keeps the parts they form."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children, self.part = radius, [], [], []

    def root(self, k: int) -> int:
        part = self.part
        while part[k] != k:
            part[k] = part[part[k]]
            k = part[k]
        return k

    def near(self, value: int) -> list[int]:
        """The nodes within the radius; only edges whose distance allows one are followed."""
        found, todo, radius = [], [0] if self.values else [], self.radius
        values, children = self.values, self.children
        while todo:
            k = todo.pop()
            d = (values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            kids = children[k]
            if kids:
                if len(kids) <= 2 * radius:
                    todo += [c for e, c in kids.items() if -radius <= e - d <= radius]
                else:
                    todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found

    def add(self, value: int) -> None:
        """Link the value to what is near it, then hang it below the nodes it is reached by."""
        new = len(self.values)
        near = self.near(value)
        if self.values:
            k = 0
            while (e := (self.values[k] ^ value).bit_count()) in self.children[k]:
                k = self.children[k][e]
            self.children[k][e] = new
        self.values.append(value)
        self.children.append({})
        self.part.append(new)
        for k in near:
            a, b = self.root(k), self.root(new)
            if a != b:  # the earlier, and so smaller, value stays the root
                self.part[max(a, b)] = min(a, b)

    def forest(self) -> Iterator[tuple[int, int]]:
        for k, v in enumerate(self.values):
            if (r := self.root(k)) != k:
                yield v, self.values[r]


def masks_of(bits: int, radius: int, blocks: int) -> list[int]:
    """Masks of which any two values that agree outside bits and differ in at most radius of them share one."""
    places = [k for k in range(64) if bits >> k & 1]
    blocks = min(blocks, len(places))
    if blocks <= radius:  # so few bits are left that they may all differ
        return [~bits & (2**64 - 1)]
    cut = [sum(1 << int(p) for p in part) for part in np.array_split(places, blocks)]
    return [(~bits & (2**64 - 1)) | sum(c) for c in combinations(cut, blocks - radius)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def blocks_for(n: int, radius: int) -> int:
    """The number of blocks: more, and so longer keys, for more fingerprints."""
    blocks = radius + 1
    while n > 64 << (64 * (blocks - radius) // blocks) and comb(blocks + 1, radius) <= 70:
        blocks += 1
    return blocks


def _edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key = BKTree(radius), None

        def out(trees: list[BKTree]) -> Iterator[pa.RecordBatch]:
            pairs = [p for t in trees for p in t.forest()]
            if pairs:
                a, b = (pa.array([signed(x) for x in c], pa.int64()) for c in zip(*pairs))
                yield pa.RecordBatch.from_arrays([a, b], ["u", "v"])

        for batch in batches:
            done = []
            for *now, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if len(tree.values) > 1:
                        done.append(tree)
                    tree, key = BKTree(radius), now
                tree.add(fp & (2**64 - 1))
            yield from out(done)
        yield from out([tree])

    return run


def linked(fps: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD, depth: int = DEPTH) -> DataFrame:
    """u, v: a forest for each shard of the distinct fingerprints in the column fp."""
    spark = fps.sparkSession
    full = 2**64 - 1
    masks = masks_of(full, radius, blocks_for(fps.count(), radius))
    level = fps.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    rows = None
    for turn in range(depth + 1):
        over = staged(level.groupBy("mask", "value").count().where(F.col("count") > max_shard), "hot-shards")
        hot = [r.mask for r in over.select("mask").distinct().collect()]  # the first masks and, each turn, radius + 1 for each hot one
        small = level.join(over.select("mask", "value"), ["mask", "value"], "left_anti").select("mask", "value", F.lit(0).cast("long").alias("part"), "fp") if hot else level.select("mask", "value", F.lit(0).cast("long").alias("part"), "fp")
        rows = small if rows is None else rows.union(small)
        if not hot:
            break
        large = level.join(over, ["mask", "value"])
        if turn == depth:  # blocks against blocks
            n = F.ceil(F.col("count") * 2 / max_shard)
            block = F.pmod(F.xxhash64("fp"), n)
            other = large.withColumn("n", n).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).where("block <> other")
            rows = rows.union(other.select("mask", "value", (F.least("block", "other") * F.col("n") + F.greatest("block", "other")).alias("part"), "fp"))
            break
        split = spark.createDataFrame([(m, signed(f)) for m in hot for f in masks_of(full & ~(m & full), radius, radius + 1)], "mask long, finer long")
        level = staged(
            large.join(F.broadcast(split), "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("value")).distinct(), "hot-fingerprints",
        )
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(n, "mask", "value", "part").sortWithinPartitions("mask", "value", "part", F.col("fp")).mapInArrow(_edges(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """u, v: each node of the edges that is not the smallest of its component, and the smallest one.

    Alternating star contraction: the larger neighbours of a node, then the smaller ones, move to
    the least node known to their centre. A round shuffles edges by node; the minimum is
    combined before the shuffle, and a node with very many edges is a skewed join that adaptive
    execution splits.
    """
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = staged(small.where("u <> v").distinct(), "small-star")
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last == mark:
            return now


def clustered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp, root and component_id for every row; root is the same in a component."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    prints, fp = with_fingerprint(slim, width=width)
    prints = staged(prints, "fingerprints")
    nodes = staged(prints.groupBy(fp).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    links = components(linked(nodes.select("fp"), radius))
    members = links.union(links.select("v", "v").distinct()).toDF("fp", "root")
    roots = members.join(nodes, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    of = members.join(roots, "root").select("fp", "root", "component_id")
    nodes = nodes.join(of, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    return with_hot(prints, staged(nodes, "nodes"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def with_hot(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """rows joined with the one node of their key, of which n is the number of rows.

    The keys of over 1/HOT_SHARE of the rows, fewer than HOT_SHARE by that, are broadcast, so their
    rows stay where they are.
    """
    least = (nodes.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = F.broadcast(nodes.where(F.col("n") > least).drop("n")) if least else None
    if hot is None:
        return rows.join(nodes.drop("n"), key)
    rest = rows.join(hot.select(key), key, "left_anti").join(nodes.where(F.col("n") <= least).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)
