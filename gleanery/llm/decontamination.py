"""Benchmark decontamination: a BM25 index of the test items, searched by block-max WAND.

The index holds the items, and every passage of every training document is a query. A passage
is a window of two blocks of words, moved by one block; a block has as many words as the longest
item, MIN_BLOCK at least, so each item that a document quotes lies whole in some passage. An
item's score is its BM25 sum over the passage's distinct terms divided by the sum over all of
its own terms, so 1 means that all its terms occur; all items of THRESHOLD or more are
retrieved. Postings are cut into blocks of ITEMS_BLOCK items that have the same limits for all
terms. A term's greatest contribution to a block, summed over the passage's terms, bounds every
score in it; blocks below the threshold are passed over whole, and within the others WAND goes
from pivot to pivot by the block's greatest contributions.

A retrieved item counts when its question and its answer both share OVERLAP of their word
three-grams with the words around the passage. An item has one text; its answer is its last
sentence or line if that has MIN_ANSWER words, else its last third.

The items are sent to the tasks; more than PART_BYTES of them are dealt to several indexes by
id, and documents pass through one after the other, each index leaving the driver and the tasks
before the next one comes. BM25's statistics and the passage length are those of all items, so results do not depend
on the number of indexes.

Cases. Null or empty text of a document: no passage. Null or empty items: never found. Items
with equal texts are all found. Repeated rows are searched each. No items: nothing is found.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import small_batches, staged

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, GRAM = 0.6, 0.5, 3
MIN_BLOCK, MIN_ANSWER = 64, 5
ITEMS_BLOCK = 8
PART_BYTES = 32 << 20
EPSILON = 1e-9
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FOLD = bytes.maketrans(bytes(range(65, 91)) + PUNCTUATION, bytes(range(97, 123)) + b" " * len(PUNCTUATION))


def terms(text: bytes) -> list[bytes]:
    """Words without ASCII punctuation, ASCII letters in lower case."""
    return text.translate(FOLD).split()


def parted(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """An item's question and answer."""
    words = terms(text)
    for mark in (b"\n", b". ", b"? ", b"! "):
        head, _, tail = text.strip().rpartition(mark)
        last = terms(tail)
        if head and len(last) >= MIN_ANSWER and len(last) < len(words):
            return terms(head), last
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def grams(words: list[bytes], n: int = GRAM) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[k:] for k in range(n))))


def side(words: list[bytes]) -> tuple[int, set[tuple[bytes, ...]]]:
    """The grams of an item's question or answer; shorter ones where it has fewer words."""
    n = max(1, min(GRAM, len(words)))
    return n, grams(words, n)


class Postings:
    """A term's items and contributions, with the greatest one overall and for each block it is in."""

    __slots__ = ("items", "weights", "most", "blocks", "block_most", "starts")

    def __init__(self, pairs: list[tuple[int, float]]):
        self.items, self.weights = [p[0] for p in pairs], [p[1] for p in pairs]
        self.most = max(self.weights)
        blocks, self.starts = np.unique(np.array(self.items) // ITEMS_BLOCK, return_index=True)
        self.blocks, self.block_most = blocks, np.maximum.reduceat(self.weights, self.starts)


@dataclass
class Statistics:
    """Of all items with words: their number, words, the longest, and in how many a term is."""

    n: int
    words: int
    longest: int
    df: dict[bytes, int]

    @classmethod
    def of(cls, counts: list[Counter]) -> "Statistics":
        lengths = [n for c in counts if (n := sum(c.values()))]
        return cls(len(lengths), sum(lengths), max(lengths, default=0), Counter(t for c in counts for t in c))


class Index:
    """Items are known by their places in the given list."""

    def __init__(self, texts: list[bytes], known: "Statistics | None" = None):
        counts = [Counter(terms(t)) for t in texts]
        lengths = [sum(c.values()) for c in counts]
        known = known or Statistics.of(counts)
        self.longest, mean, df = known.longest, known.words / max(known.n, 1), known.df
        raw = [
            {t: log(1 + (known.n - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean)) for t, n in c.items()}
            for c, length in zip(counts, lengths)
        ]
        pairs: dict[bytes, list[tuple[int, float]]] = {}
        for k, weights in enumerate(raw):
            total = sum(weights.values())
            for t, w in weights.items():
                pairs.setdefault(t, []).append((k, w / total))
        self.terms = {t: Postings(p) for t, p in pairs.items()}
        self.most = {t: p.most for t, p in self.terms.items()}
        sides = [parted(t) for t in texts]
        self.question, self.answer = [side(q) for q, _ in sides], [side(a) for _, a in sides]

    def search(self, found: set[bytes], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All items whose contributions of the found terms reach the threshold."""
        least, out = threshold - EPSILON, []
        lists = [p for p in map(self.terms.get, sorted(found)) if p is not None]
        if not lists:
            return out
        bounds = np.bincount(np.concatenate([p.blocks for p in lists]), np.concatenate([p.block_most for p in lists]))
        for block in np.nonzero(bounds >= least)[0].tolist():
            out += self.within(block, lists, least)
        return out

    def within(self, block: int, lists: list[Postings], least: float) -> list[tuple[int, float]]:
        """WAND over one block, with the block's greatest contributions."""
        out, cursors = [], []  # a cursor: item, place, end, the block's greatest contribution, postings
        for p in lists:
            k = int(np.searchsorted(p.blocks, block))
            if k < len(p.blocks) and p.blocks[k] == block:
                start = int(p.starts[k])
                end = int(p.starts[k + 1]) if k + 1 < len(p.starts) else len(p.items)
                cursors.append([p.items[start], start, end, float(p.block_most[k]), p])
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= least:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            whole = cursors[0][0] == pivot
            if whole:
                score = sum(c[4].weights[c[1]] for c in cursors if c[0] == pivot)
                if score >= least:
                    out.append((pivot, score))
            target, left = pivot + whole, []
            for c in cursors:
                if c[0] < target:
                    c[1] = bisect_left(c[4].items, target, c[1], c[2])
                    if c[1] == c[2]:
                        continue
                    c[0] = c[4].items[c[1]]
                left.append(c)
            cursors = left
        return out

    def hits(self, text: bytes) -> dict[int, tuple[float, float, float]]:
        """Verified items of a document: score, question and answer overlap, best passage first."""
        words = terms(text)
        block = max(MIN_BLOCK, self.longest)
        known = self.most
        blocks = [known.keys() & set(words[k : k + block]) for k in range(0, len(words), block)]
        bounds = [sum(map(known.__getitem__, b)) for b in blocks]
        best: dict[int, tuple[float, float, float]] = {}
        least = THRESHOLD - EPSILON
        for k in range(max(1, len(blocks) - 1) if blocks else 0):
            if sum(bounds[k : k + 2]) < least:
                continue
            for item, score in self.search(set().union(*blocks[k : k + 2])):
                around = words[max(0, (k - 1) * block) : (k + 3) * block]
                q, a = (len(g & grams(around, n)) / len(g) if g else 0.0 for n, g in (self.question[item], self.answer[item]))
                if q >= OVERLAP and a >= OVERLAP:
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (round(score, 6), round(q, 6), round(a, 6)))
        return best


def parts(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", limit: int = PART_BYTES) -> list[DataFrame]:
    """The benchmark, divided by id where it is too large for one index."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    n = ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / limit)
    return [items] if n <= 1 else [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def counted(items: DataFrame) -> tuple[DataFrame, tuple[int, int, int]]:
    """term and df over all items; the number of items with words, of their words, and of those of the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in pc.cast(b.column(0), pa.binary()):
                words = terms(x.as_py())
                if words:
                    distinct = list(set(words))
                    yield pa.RecordBatch.from_arrays([pa.array([None, *distinct], pa.binary()), pa.array([len(words), *[0] * len(distinct)], pa.int64())], ["term", "length"])

    rows = staged(items.select("text").mapInArrow(run, "term binary, length long"), "item-terms")
    r = rows.where("term IS NULL").agg(F.count("*").alias("n"), F.sum("length").alias("words"), F.max("length").alias("longest")).first()
    return rows.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")), (r.n, r.words or 0, r.longest or 0)


def searcher(part: DataFrame, df: DataFrame | None = None, sizes: tuple[int, int, int] = (0, 0, 0)) -> tuple[Callable[[], tuple[list, Index]], Broadcast]:
    """Sends the items of a part, bounded by PART_BYTES, with the statistics of all; what it returns builds their index in a task."""
    rows = sorted(((r.item_id, r.text.encode()) for r in part.collect()), key=lambda r: (r[0] is None, str(type(r[0])), r[0] or 0, r[1]))
    known = None
    if df is not None:
        spark = part.sparkSession
        own = spark.createDataFrame([(bytearray(t),) for t in {t for _, text in rows for t in terms(text)}], "term binary")
        known = Statistics(*sizes, {bytes(r.term): r.df for r in df.join(own, "term").collect()})  # the terms of this part
    sent = part.sparkSession.sparkContext.broadcast((rows, known))
    return lambda: ([r[0] for r in sent.value[0]], Index([r[1] for r in sent.value[0]], sent.value[1])), sent


def each_index(benchmark: DataFrame) -> Iterator[tuple[Callable[[], tuple[list, Index]], bool]]:
    """What builds each index in a task, and whether it is the only one; the one before leaves all memories."""
    every = parts(benchmark)
    if len(every) == 1:
        yield searcher(every[0])[0], True
        return
    df, sizes = counted(benchmark.select(F.col("text")).where("text IS NOT NULL"))
    for part in every:
        index_of, sent = searcher(part, df, sizes)
        yield index_of, False
        sent.destroy()


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified item; ids keep their types."""
    slim, out = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), None
    kinds = T.StructType([slim.schema["doc_id"], benchmark.schema["item_id"], *(T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap"))])
    arrow = to_arrow_schema(kinds)
    for index_of, only in each_index(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index_of=index_of) -> Iterator[pa.RecordBatch]:
            ids, index = index_of()
            for b in batches:
                rows = [(d, ids[k], *v) for d, t in zip(b.column(0).to_pylist(), pc.cast(b.column(1), pa.binary())) for k, v in sorted(index.hits(t.as_py() or b"").items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], arrow.names)

        found = slim.mapInArrow(run, kinds)
        found = found if only else staged(found, "leaks")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, in one pass without a shuffle for each index."""
    at = small_batches(docs).columns.index(text)
    for index_of, only in each_index(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index_of=index_of) -> Iterator[pa.RecordBatch]:
            _, index = index_of()
            for b in batches:
                yield b.filter(pa.array([not index.hits(t.as_py() or b"") for t in pc.cast(b.column(at), pa.binary())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = docs if only else staged(docs, "clean")
    return docs
