"""Groups of near copies for the pipeline: BK-trees of fingerprints over shards of like sketches.

Two texts whose sets of word shingles have a Jaccard similarity of 0.8 differ in about ten bits of
their SimHash, and blocks of 64 bits that both share are then too short to be keys. So shards are
keyed by the shingles themselves: SKETCH minima of rehashed shingle hashes are taken, of which
BANDS runs of ROWS are keys, and two such texts share one with a probability of 0.99. In a shard
the fingerprints form a BK-tree, of which only edges within RADIUS are followed; a text found so is
linked if LEAST of both sketches' minima agree, an estimate of the similarity with a standard error of 0.04 at 0.8.

Equal texts are one node. A key of more than MAX_SHARD nodes is dealt to parts at random and each
part gets its tree. The nodes that are then outside the largest component of their key, the rest,
meet all parts in blocks. So each two nodes of a key have met or are linked already, and a large group
of near copies costs in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prefixed, small_batches, staged
from .simhash import MAX_SHARD, BKTree, components, majority, shingles, with_hot

WIDTH, RADIUS = 5, 18
SKETCH, BANDS, ROWS, LEAST = 120, 12, 5, 0.75
AT_ONCE = 2048  # shingles that are rehashed together
_RNG = np.random.default_rng(42)
FACTORS, TERMS = _RNG.integers(0, 2**63, (SKETCH, 1), np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 2**63, (SKETCH, 1), np.uint64)


def sketch(text: bytes, width: int = WIDTH) -> tuple[int, np.ndarray, np.ndarray]:
    """The fingerprint, the keys of the bands and a byte of each minimum; a text without words is like any other."""
    least, parts = np.full((SKETCH, 1), 2**64 - 1, np.uint64), list(shingles(text, width))
    for h in parts:
        for k in range(0, len(h), AT_ONCE):
            least = np.minimum(least, (FACTORS * h[k : k + AT_ONCE] + TERMS).min(1, keepdims=True))
    minima = least[:, 0]
    keys = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        keys = (keys ^ minima[k : BANDS * ROWS : ROWS]) * FACTORS[k] + TERMS[:BANDS, 0]
        keys ^= keys >> np.uint64(31)
    return majority(iter(parts)), keys.view(np.int64), (minima >> np.uint64(13)).astype(np.uint8)


def sketched(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, node, fp, keys, minima of each row of doc_id, node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sketch(x.as_py() or b"", width) for x in pc.cast(b.column(2), pa.binary())]
            if made:
                fps, keys, minima = zip(*made)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(made) + 1, BANDS, np.int32)), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), lists, pa.array([m.tobytes() for m in minima], pa.binary())], ["doc_id", "node", "fp", "keys", "minima"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, fp long, keys array<long>, minima binary")


class SketchTree(BKTree):
    """A BK-tree whose nodes are linked only where their sketches agree."""

    def __init__(self, radius: int, least: float):
        super().__init__(radius)
        self.least, self.names, self.minima = least * SKETCH, [], np.zeros((64, SKETCH), np.uint8)

    def near(self, value: int) -> list[int]:
        found = np.array(super().near(value), np.int64)
        return found[(self.minima[found] == self.latest).sum(1) >= self.least].tolist()

    def put(self, name: int, value: int, minima: bytes) -> None:
        n, self.latest = len(self.values), np.frombuffer(minima, np.uint8)
        if n == len(self.minima):
            self.minima = np.concatenate([self.minima, np.zeros_like(self.minima)])
        self.add(value)
        self.minima[n] = self.latest
        self.names.append(name)

    def links(self) -> Iterator[tuple[int, int]]:
        for k, name in enumerate(self.names):
            if (r := self.root(k)) != k:
                yield name, self.names[r]


def forests(rows: DataFrame, radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """u, v: links that join the like nodes of each (key, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = SketchTree(radius, least), None
        for b in batches:
            pairs = []
            for key, part, node, fp, minima in zip(*(c.to_pylist() for c in b.columns)):
                if (key, part) != of:
                    pairs += tree.links()
                    tree, of = SketchTree(radius, least), (key, part)
                tree.put(node, fp & (2**64 - 1), minima)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["u", "v"])
        if pairs := list(tree.links()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["u", "v"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("key", "part", "node", "fp", "minima").repartition(n, "key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(run, "u long, v long")


def near_links(nodes: DataFrame, max_shard: int = MAX_SHARD) -> DataFrame:
    """u, v: each node of node, fp, keys, minima that is in a group but not its smallest, and the smallest one."""
    pairs = nodes.select("node", F.explode("keys").alias("key"))
    shared = pairs.groupBy("key").count().where("count > 1").withColumnRenamed("count", "of")
    shared = staged(pairs.join(shared, "key"), "shared-keys")  # most documents are alone and go no further
    rows = shared.join(nodes.select("node", "fp", "minima"), "node")
    half = max(max_shard // 2, 1)
    parts = F.when(F.col("of") > max_shard, F.ceil(F.col("of") / half)).otherwise(F.lit(1))
    dealt = F.pmod(F.xxhash64("node", "key"), parts)
    links = staged(components(forests(rows.withColumn("part", dealt))), "near-links")
    hot = shared.where(F.col("of") > max_shard)
    if hot.isEmpty():
        return links
    placed = hot.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = staged(placed, "hot-keys")
    sizes = placed.groupBy("key", "root").count()
    most = sizes.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"), (F.sum("count") - F.max("count")).alias("n_rest")).where("n_rest > 0")
    blocks = F.ceil(F.col("n_rest") / half)
    both = staged(placed.join(most, "key").withColumn("parts", F.ceil(F.col("of") / half)).withColumn("blocks", blocks), "hot-rest")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    whole = both.select("key", "node", "blocks", F.pmod(F.xxhash64("node", "key"), F.col("parts")).alias("p"), every("blocks").alias("b"))
    rest = both.where("root <> most").select("key", "node", "blocks", F.pmod(F.xxhash64("key", "node"), F.col("blocks")).alias("b"), every("parts").alias("p"))
    met = whole.select("key", "node", (F.col("p") * F.col("blocks") + F.col("b")).alias("part")).union(rest.select("key", "node", (F.col("p") * F.col("blocks") + F.col("b")).alias("part"))).distinct()
    more = forests(met.join(nodes.select("node", "fp", "minima"), "node"))
    return components(links.union(more))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, max_shard: int = MAX_SHARD) -> DataFrame:
    """doc_id, node, root for every row: node is a hash of the text, root is the same in a group."""
    node = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    slim = small_batches(docs).select(F.col(doc_id).alias("doc_id"), node.alias("node"), F.col(text).alias("text"))
    rows = staged(sketched(slim, width), "sketches")
    nodes = staged(rows.groupBy("node").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("fp", "keys", "minima"))), "nodes")
    links = near_links(nodes, max_shard)
    roots = nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    return with_hot(rows.select("doc_id", "node"), staged(roots, "roots"), "node")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of docs without all but one of each group of near copies: that with the smallest id.

    A null id is the largest. Of rows with equal ids and texts one stays. Null and empty texts are
    equal. Empty table: empty result. Ids and hashes are compared; the texts meet the kept ids in
    a semi-join.
    """
    rows = staged(grouped(docs, doc_id, text, width), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x")
    kept = staged(rows.groupBy("root").agg(first).select(F.col("x.doc_id").alias("__kept_id"), F.col("x.node").alias("__kept_node")), "kept")
    node = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    out = docs.join(kept, F.col(doc_id).eqNullSafe(F.col("__kept_id")) & (node == F.col("__kept_node")), "left_semi")
    if rows.groupBy("doc_id", "node").count().where("count > 1").isEmpty():
        return out
    mark = prefixed(docs, "__node")["__node"]
    return out.withColumn(mark, node).dropDuplicates([doc_id, mark]).drop(mark)
