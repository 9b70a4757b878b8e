"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Equal texts become one class, whose representative has the smallest id; a row 'copy' links
   each other member to it. What follows sees representatives alone.
2. A seed is the hash of SEED_WORDS words; of every WINDOW seeds in a row the smallest is taken,
   so any shared run of SEED_WORDS + WINDOW - 1 words shares a seed.
3. Seeds meet by hash. A seed of up to FEW places makes all their pairs. Places of shared seeds also
   meet by the RUN words from them: up to three places of such a run make all their pairs, and of
   more those with the same MIN_WORDS words are one class: each is joined with the first. So of
   every MIN_WORDS equal words each place has a common partner, and members of a class are left
   out of what follows. Places of more frequent seeds meet by two of them, NEAR to FAR words from
   one another: up to FEW places of such a pair make all their pairs, and of more each is joined
   with the first, which represents the documents that prove to have a passage in common with it;
   each other document is joined with all. So documents with a chain are linked, or both are
   linked with one that represents them. In a document a place of a frequent seed, and one of
   equal words, meets the last one that is MIN_WORDS before it.
4. The matches of two documents are chained: a chain's score is SEED_WORDS a seed less GAP a
   word skipped on either side, and a Fenwick tree over the second document's places has the
   best chain that ends before a match.
5. Chains are aligned: the words around both sides are fetched, exact runs are extended, gaps
   between them are aligned by edit distance, and the ends grow as long as the texts agree. A row
   'passage' is a part of MIN_WORDS words or more on either side of which MIN_IDENTITY or more
   are equal.

Words are split at ASCII white space, with ASCII letters in lower case. Matches of a pair are
bounded by the seeds of one of the two texts, and are the only thing a task gathers. Places that
chains ask for are rounded out to SNAP words, so a much-asked document gives few slices.

Cases. Null, empty and short texts: no seeds; equal ones, null like empty, are copies if they
have MIN_WORDS words. Null id: a document that is larger than all others. Repeated rows are
copies of each other. Empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WHITESPACE, small_batches, staged_alone, unstaged

SEED_WORDS, WINDOW = 6, 10
GAP, MIN_CHAIN = 0.15, 26
MIN_WORDS, MIN_IDENTITY = 50, 0.8
RUN = MIN_WORDS - WINDOW + 1  # a shared run of MIN_WORDS words has a seed with RUN of them from its place
FEW = 16  # a seed of up to so many places makes all their pairs
NEAR, FAR = MIN_CHAIN - SEED_WORDS, 45  # words between two seeds that meet together
MARGIN, SNAP, MAX_GAP, LOOK = 48, 64, 80, 6
LARGEST = 2**63 - 1
CHUNK = 1 << 16  # bytes of text that are hashed at a time
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SKIPS = sorted(((p, q) for p in range(LOOK + 1) for q in range(LOOK + 1) if p or q), key=lambda s: (max(s), sum(s)))
RESULT = "kind string, doc_id long, start long, stop long, partner_id long, partner_start long, partner_stop long, n_equal long, identity double"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


class Hashes:
    """64-bit hashes of words: sums of a number for each byte, ASCII letters in lower case, times a power for its place."""

    def __init__(self):
        with np.errstate(over="ignore"):
            self.powers, self.undo = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK - 1, f, np.uint64)])) for f in (MULTIPLIER, np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))))
        self.numbers = np.array([xxhash.xxh64_intdigest(bytes([c]).translate(LOWER)) for c in range(256)], np.uint64)
        self.in_word = np.array([c not in WHITESPACE for c in range(256)])

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin, and their hashes. The text ends with white space."""
        data, low, found = np.frombuffer(text, np.uint8), 0, [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        while low < len(data):
            inside = self.in_word[data[low : low + CHUNK]]
            n = len(inside) - int(np.argmin(inside[::-1]))  # to the last white space
            if inside[n - 1]:  # there is none: a word of CHUNK bytes or more
                word = re.compile(rb"[^\x20\x09-\x0D]+").match(text, low)[0]
                found.append((np.array([low]), np.array([xxhash.xxh64_intdigest(word.translate(LOWER))], np.uint64)))
                low += len(word)
                continue
            edges = np.flatnonzero(np.diff(inside[:n].view(np.int8), prepend=np.int8(0)))
            upto = np.zeros(n + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(self.numbers[data[low : low + n]] * self.powers[:n], out=upto[1:])
                found.append((edges[::2] + low, mixed((upto[edges[1::2]] - upto[edges[::2]]) * self.undo[edges[::2]])))
            low += n
        return tuple(map(np.concatenate, zip(*found)))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MULTIPLIER
    return h ^ (h >> np.uint64(32))


class Words:
    """The texts of a batch as one array of word hashes, with WINDOW empty places after each text."""

    def __init__(self, texts: Iterable[bytes | None], known: Hashes):
        texts = [t or b"" for t in texts]
        begin, hashes = known.of(b"\n".join([*texts, b""]))
        self.sizes = np.diff(np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
        ends = np.cumsum(self.sizes + WINDOW)
        self.offsets = ends - self.sizes - WINDOW
        self.doc = np.repeat(np.arange(len(texts)), self.sizes + WINDOW)
        self.place = np.arange(len(self.doc)) - self.offsets[self.doc]
        self.hashes = np.zeros(len(self.doc), np.uint64)
        self.hashes[self.place < self.sizes[self.doc]] = hashes

    def left(self, at: np.ndarray) -> np.ndarray:
        """How many words there are from each place to the end of its text."""
        return self.sizes[self.doc[at]] - self.place[at]

    def minimisers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash of the seed at each place, the places where WINDOW seeds begin, and that of the smallest of each."""
        n, everywhere = len(self.doc) - SEED_WORDS + 1, np.arange(len(self.doc))
        if n < 1:
            return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(SEED_WORDS):
                h = (h ^ self.hashes[k : n + k]) * MULTIPLIER
                h ^= h >> np.uint64(29)
        seeds = self.left(everywhere) - SEED_WORDS + 1  # from each place to the end of its text
        h = np.concatenate([h, np.zeros(len(self.doc) - n, np.uint64)])
        h[seeds < 1] = np.iinfo(np.uint64).max
        least, low, width = everywhere, h, 1
        while width < WINDOW:  # the first smallest of width places from each, twice as wide each time
            step = min(width, WINDOW - width)
            less = low[step:] < low[:-step]
            least, low, width = np.where(less, least[step:], least[:-step]), np.minimum(low[step:], low[:-step]), width + step
        starts = np.flatnonzero((seeds[: len(least)] >= WINDOW) | ((self.place[: len(least)] == 0) & (seeds[: len(least)] > 0)))
        return h, starts, least[starts]

    def runs(self, at: np.ndarray, width: int) -> np.ndarray:
        """Hashes of width words from each place."""
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.doc), MULTIPLIER)]))
            undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.doc), np.uint64(pow(int(MULTIPLIER), -1, 1 << 64)))]))
            upto = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * powers[:-1])])
            return mixed((upto[at + width] - upto[at]) * undo[at])

    def repeats(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the values h at ascending places: how many equal ones come before in the text, and the place
        in the text of the last one that is MIN_WORDS or more before, or -1."""
        order = np.argsort(h, kind="stable")
        s, d, k = h[order], self.doc[at][order], np.arange(len(h))
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])[: len(h)]
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        key = group * (len(self.doc) + MIN_WORDS) + at[order]
        last = np.searchsorted(key, key - MIN_WORDS, "right") - 1
        rank, before = np.empty(len(h), np.int32), np.empty(len(h), np.int32)
        rank[order] = k - first[group]
        before[order] = np.where(last >= first[group], self.place[at[order][last]], -1)
        return rank, before


def with_seeds(reps: DataFrame) -> DataFrame:
    """doc, key, place, before, g for the chosen seeds of each text.

    key is the hash of the seed, before the last place of an equal one that is MIN_WORDS before it or -1, and g the
    hash of the RUN words from the place, null where the text ends before. A row without key for each text has its number
    of words as place and its h1 as g.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in batches:
            text = Words(pc.cast(b.column(1), pa.binary()).to_pylist(), known)
            h, _, least = text.minimisers()
            chosen = np.zeros(len(text.doc), bool)
            chosen[least] = True
            at = np.flatnonzero(chosen)
            ends = text.left(at) < RUN
            g = text.runs(np.where(ends, 0, at), min(RUN, len(text.doc)))
            doc = b.column(0).to_numpy(zero_copy_only=False)[text.doc[at]]
            cols = [doc, h[at].view(np.int64), text.place[at].astype(np.int32), text.repeats(h[at], at)[1]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(g.view(np.int64), mask=ends)], ["doc", "key", "place", "before", "g"])
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), none.cast(pa.int64()), pa.array(text.sizes.astype(np.int32)), none.cast(pa.int32()), b.column(2)], ["doc", "key", "place", "before", "g"])

    return reps.select("doc", "text", "h1").mapInArrow(run, "doc long, key long, place int, before int, g long")


def texts_of(reps: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of asked, one for each doc, with the text: texts are dealt out once, by what tells representatives, and are not sorted."""
    asked = asked.join(classes.selectExpr("rep AS doc", "h1", "h2"), "doc")
    return reps.join(asked.hint("shuffle_hash"), ["h1", "h2", "doc"])


def with_runs(reps: DataFrame, classes: DataFrame, runs: DataFrame) -> DataFrame:
    """doc, k, rank, start, place, before: for the places asked for, the MIN_WORDS words around them.

    Each place of a text belongs to one seed, the smallest of the WINDOW that begin there, so the
    words alone decide it; k is the hash of MIN_WORDS words from start, rank the number of equal ones before
    in the document, place that of their seed, and before as in with_seeds().
    """
    asked = runs.groupBy("doc").agg(F.collect_set("place").alias("places"))
    both = texts_of(reps, classes, asked).select("doc", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in batches:
            text = Words(pc.cast(b.column(1), pa.binary()).to_pylist(), known)
            wanted = np.zeros(len(text.doc), bool)
            wanted[pc.list_flatten(b.column(2)).to_numpy() + text.offsets[pc.list_parent_indices(b.column(2)).to_numpy()]] = True
            _, starts, least = text.minimisers()
            chosen = wanted[least] & (text.left(starts) >= MIN_WORDS)
            starts, least = starts[chosen], least[chosen]
            k = text.runs(starts, min(MIN_WORDS, len(text.doc)))
            rank, last = text.repeats(k, starts)
            before = np.where(last < 0, -1, last + least - starts).astype(np.int32)
            doc = b.column(0).to_numpy(zero_copy_only=False)[text.doc[starts]]
            cols = (doc, k.view(np.int64), rank, text.place[starts].astype(np.int32), text.place[least].astype(np.int32), before)
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["doc", "k", "rank", "start", "place", "before"])

    return both.mapInArrow(run, "doc long, k long, rank int, start int, place int, before int")


def with_pairs(met: DataFrame, covered: DataFrame, tasks: int) -> DataFrame:
    """doc, key, x, x2: two seeds of a text, NEAR to FAR words from one another, of which one is frequent or both are.

    key is the hash of both. Seeds in words that are covered, doc from low to high + MIN_WORDS, stand for nothing new.
    """
    rows = met.selectExpr("doc", "place", f"n > {FEW} AS hot", "key", "CAST(NULL AS INT) AS high")
    rows = rows.union(covered.selectExpr("doc", "low", "false", "0L", "high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, 1):
            doc, place, hot, key = (c.to_numpy(zero_copy_only=False) for c in b.columns[:4])
            cover = b.column(4).is_valid().to_numpy(zero_copy_only=False)
            to = np.where(cover, b.column(4).fill_null(0).to_numpy().astype(np.int64) + MIN_WORDS, 0)
            new = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
            far = 1 << 32  # farthest end so far in the document
            reach = np.maximum.accumulate(new * far + to) - new * far
            keep = ~cover & (place + SEED_WORDS > reach)
            doc, place, hot, key = (c[keep] for c in (doc, place, hot, key.view(np.uint64)))
            found = []
            for step in range(1, len(doc)):
                apart = place[step:].astype(np.int64) - place[:-step]
                inside = (doc[step:] == doc[:-step]) & (apart <= FAR)
                if not inside.any():
                    break
                k = np.flatnonzero(inside & (apart >= NEAR) & (hot[step:] | hot[:-step]))
                with np.errstate(over="ignore"):
                    found.append((doc[k], mixed(key[k] * MULTIPLIER + key[k + step]).view(np.int64), place[k], place[k + step]))
            if found:
                cols = [np.concatenate(c) for c in zip(*found)]
                order = np.lexsort((cols[3], cols[1], cols[2], cols[0]))  # of equal pairs from a place the nearest
                doc, key, x = (c[order] for c in cols[:3])
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (x[1:] != x[:-1])])[: len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(c[order][new]) for c in cols], ["doc", "key", "x", "x2"])

    return rows.repartition(tasks, "doc").sortWithinPartitions("doc", "place", F.col("high").asc_nulls_last()).mapInArrow(run, "doc long, key long, x int, x2 int")


def whole_groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Batches with all rows of a group; rows that agree in the first n columns come one after another."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        same = np.logical_and.reduce([c.to_numpy() == c[-1].as_py() for c in b.columns[:n]])
        cut = b.num_rows - int(same.sum())
        if cut or (rest and any(rest[-1].column(k)[-1] != b.column(k)[0] for k in range(n))):
            yield pa.concat_batches([*rest, b.slice(0, cut)]) if cut else pa.concat_batches(rest)
            rest = []
        rest.append(b.slice(cut))
    if rest:
        yield pa.concat_batches(rest)


def ordered(links: DataFrame) -> DataFrame:
    """a, b, x, y and steps of 0 from doc, place and their partner o."""
    first = F.struct("doc", "place") < F.struct("o.doc", "o.place")
    pick = lambda p, q: F.when(first, p).otherwise(q)
    return links.select(pick(F.col("doc"), F.col("o.doc")).alias("a"), pick(F.col("o.doc"), F.col("doc")).alias("b"), pick(F.col("place"), F.col("o.place")).alias("x"), pick(F.col("o.place"), F.col("place")).alias("y"), F.lit(0).alias("dx"), F.lit(0).alias("dy"))


def matches(reps: DataFrame, classes: DataFrame, seeds: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """a, b, x, y, dx, dy: a seed of document a at place x that is in document b at place y; a < b, or a = b and x < y.

    Where dx and dy are not 0, the seeds at x + dx and y + dy are equal as well. The second table is for others():
    key, doc, x, x2, first, the places of the pairs of seeds that have more than FEW, of which only the first made pairs.
    The last ones are the tables that only the first reads.
    """
    at, apart = F.struct("doc", "place"), (F.col("doc") != F.col("o.doc")) | (F.abs(F.col("place") - F.col("o.place")) >= MIN_WORDS)
    inside = lambda t, *more: t.where("before >= 0").select("doc", "place", F.struct("doc", F.col("before").alias("place")).alias("o"), *more)
    several = staged_alone(seeds.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")  # most seeds are alone and go no further
    met = staged_alone(seeds.join(several.hint("shuffle_hash"), "key").select("key", "doc", "place", "before", "g", "n"), "shared-seeds")
    unstaged(seeds, several)
    rare = met.where(f"n <= {FEW}").groupBy("key").agg(F.sort_array(F.collect_list(at)).alias("all"))
    rare = rare.select("all", F.posexplode("all").alias("k", "one")).where("k > 0").select("one.doc", "one.place", F.explode(F.expr("slice(all, 1, k)")).alias("o"))
    single = ordered(rare.where(apart).union(inside(met.where(f"n > {FEW}"))))

    # runs of RUN words; up to three places of one make all their pairs
    shared = met.select("doc", "place", "g").where("g IS NOT NULL")
    groups = shared.groupBy("g").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("doc", "place") for f in (F.min, F.max)), F.min_by("place", "doc").alias("of_min"), F.max_by("place", "doc").alias("of_max")).where("n > 1")
    end = lambda f: F.struct(F.col(f"{f}_doc").alias("doc"), F.when(F.col("min_doc") == F.col("max_doc"), F.col(f"{f}_place")).otherwise(F.col(f"of_{f}")).alias("place"))
    groups = staged_alone(groups.select("g", "n", end("min").alias("low"), end("max").alias("high")), "groups")  # so that large ones can be split
    runs = staged_alone(shared.join(groups.hint("shuffle_hash"), "g"), "runs")
    unstaged(groups)
    few = runs.where("n <= 3").select("doc", "place", F.explode(F.array("low", "high")).alias("o")).where(apart)
    # places of others meet by all their MIN_WORDS words, each with the first
    keys = staged_alone(with_runs(reps, classes, runs.where("n > 3").select("doc", "place")), "keys")
    first = keys.groupBy("k", "rank").agg(F.count("*").alias("n"), F.min("doc").alias("doc"), F.min_by("place", "doc").alias("place")).where("n > 1")
    first = staged_alone(first.select("k", "rank", F.struct("doc", "place").alias("o")), "first")
    many = keys.join(first.hint("shuffle_hash"), ["k", "rank"]).select("doc", "place", "o", "start").where(apart).union(inside(keys, "start"))
    many = staged_alone(many.groupBy("doc", "place", "o").agg(F.min("start").alias("low"), F.max("start").alias("high")), "members")
    unstaged(keys, first)
    long = ordered(few.union(many.select("doc", "place", "o"))).distinct().withColumns({"dx": F.lit(NEAR), "dy": F.lit(NEAR)})

    # places of frequent seeds that are no members meet by two seeds: up to FEW of them all with all, more with the first
    pairs = staged_alone(with_pairs(met, many.select("doc", "low", "high"), tasks), "pairs")
    common = pairs.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc", "x", "x2")).alias("f"), F.max("doc").alias("high")).where("f.doc < high")
    common = staged_alone(common.drop("high"), "shared-pair-keys")
    again = staged_alone(pairs.join(common.hint("shuffle_hash"), "key"), "shared-pairs")
    unstaged(pairs, common)
    crowds = again.where(f"n > {FEW}")
    star = crowds.where("doc > f.doc").selectExpr("f.doc AS a", "doc AS b", "f.x", "x AS y", "f.x2 - f.x AS dx", "x2 - x AS dy")
    some = again.where(f"n <= {FEW}")
    return single.union(long).union(star).union(met_by_two(some, some)), crowds.selectExpr("key", "doc", "x", "x2", "f.doc AS first"), [met, runs, many]


def met_by_two(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows as those of matches() from places of pairs of seeds, each of one with each of other in another document."""
    one, other = one.selectExpr("key", "doc AS a", "x", "x2 - x AS dx"), other.selectExpr("key", "doc AS b", "x AS y", "x2 - x AS dy")
    return one.join(other, "key").where("a < b").select("a", "b", "x", "y", "dx", "dy")


def others(crowds: DataFrame, found: DataFrame) -> DataFrame:
    """What the first of a crowd does not represent: documents without a passage in common with it meet all of the crowd."""
    members = found.selectExpr("doc_id AS doc", "partner_id AS first").distinct()
    alone = staged_alone(crowds.where("doc <> first").join(members, ["doc", "first"], "left_anti").select("key", "doc", "x", "x2"), "others")
    return met_by_two(alone, crowds).union(met_by_two(crowds, alone))


class Fenwick:
    """Prefix maxima of (value, match)."""

    def __init__(self, n: int):
        self.tree = [(float("-inf"), -1)] * (n + 1)

    def put(self, k: int, item: tuple[float, int]) -> None:
        k += 1
        tree, n = self.tree, len(self.tree)
        while k < n:
            if item > tree[k]:
                tree[k] = item
            k += k & -k

    def best(self, k: int) -> tuple[float, int]:
        """Of all places before k."""
        out, tree = (float("-inf"), -1), self.tree
        while k > 0:
            if tree[k] > out:
                out = tree[k]
            k -= k & -k
        return out


def chains(points: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Disjoint chains of ascending matches, best first, each of MIN_CHAIN words at least."""
    points = sorted(set(points), key=lambda p: (p[0], -p[1]))  # equal x: later y first, so they do not chain
    score, back = scored_straight(points) if len({x - y for x, y in points}) == 1 else scored(points)
    out, used = [], bytearray(len(points))
    for k in sorted(range(len(points)), key=score.__getitem__, reverse=True):
        if used[k]:
            continue
        chain = []
        while k >= 0 and not used[k]:
            used[k] = 1
            chain.append(points[k])
            k = back[k]
        first, last = chain[-1], chain[0]
        if min(last[0] - first[0], last[1] - first[1]) + SEED_WORDS >= MIN_CHAIN:
            out.append(chain[::-1])
    return out


def scored(points: list[tuple[int, int]]) -> tuple[list[float], list[int]]:
    """The score of the best chain to each match, and the match before it or -1."""
    places = {y: k for k, y in enumerate(sorted({y for _, y in points}))}
    tree, score, back = Fenwick(len(places)), [], []
    for k, (x, y) in enumerate(points):
        value, j = tree.best(places[y])
        gain = 0.0
        if j >= 0:
            px, py = points[j]
            overlap = max(0, SEED_WORDS - min(x - px, y - py))
            gain = value - GAP * (x + y) + 2 * GAP * SEED_WORDS - overlap
        if gain <= 0:
            gain, j = 0.0, -1
        score.append(SEED_WORDS + gain)
        back.append(j)
        tree.put(places[y], (score[k] + GAP * (x + y), k))
    return score, back


def scored_straight(points: list[tuple[int, int]]) -> tuple[list[float], list[int]]:
    """As scored(), of matches on one diagonal, where the best chain is always that of the match before."""
    score, back, s, before = [], [], 0.0, None
    for k, (x, y) in enumerate(points):
        gain = 0.0
        if k:
            gain = s + GAP * (before[0] + before[1]) - GAP * (x + y) + 2 * GAP * SEED_WORDS
            if x - before[0] < SEED_WORDS:
                gain -= SEED_WORDS - x + before[0]
        back.append(k - 1 if gain > 0 else -1)
        s = SEED_WORDS + gain if gain > 0 else float(SEED_WORDS)
        score.append(s)
        before = x, y
    return score, back


def chained(links: DataFrame, tasks: int) -> DataFrame:
    """a, b, xs, ys: the chains of each pair, from its matches; written, for aligned() reads it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 2):
            a, b, x, y, dx, dy = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            wide = np.logical_and(*(np.maximum.reduceat(c + d, starts) - np.minimum.reduceat(c, starts) + SEED_WORDS >= MIN_CHAIN for c, d in ((x, dx), (y, dy))))
            rows = []
            for s, e in zip(starts[wide].tolist(), np.append(starts, len(a))[1:][wide].tolist()):
                ends, far = np.flatnonzero(dx[s:e]) + s, np.flatnonzero(np.minimum(dx[s:e], dy[s:e]) > NEAR) + s
                xs, ys = (np.concatenate([c[s:e], c[ends] + d[ends], c[far] + NEAR]) for c, d in ((x, dx), (y, dy)))
                rows += [(int(a[s]), int(b[s]), [p for p, _ in c], [q for _, q in c]) for c in chains(list(zip(xs.tolist(), ys.tolist())))]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["a", "b", "xs", "ys"])

    return staged_alone(links.repartition(tasks, "a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long, xs array<int>, ys array<int>"), "chains")


def edits(a: list, b: list) -> list[tuple[int, int, int]]:
    """An alignment as (value, words of a, words of b) of its parts in order: 1 a run's word, -4 an edit."""
    n, m, tail = len(a), len(b), []
    if not n or not m or max(n, m) > MAX_GAP:
        return [(-4 * max(n, m), n, m)] if n or m else []
    while n and m and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    if n < len(a):
        tail.append((len(a) - n, len(a) - n, len(a) - n))
    if not n or not m or n == m == 1:
        return [(-4 * max(n, m), n, m), *tail] if n or m else tail
    cost = [list(range(m + 1))]
    for i in range(n):
        row, last, word = [i + 1], cost[-1], a[i]
        left = i + 1
        for j in range(m):
            best = last[j] if word == b[j] else last[j] + 1
            if last[j + 1] < best:
                best = last[j + 1] + 1
            if left < best:
                best = left + 1
            row.append(best)
            left = best
        cost.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            out.append((1 if a[i - 1] == b[j - 1] else -4, 1, 1))
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            out.append((-4, 1, 0))
            i -= 1
        else:
            out.append((-4, 0, 1))
            j -= 1
    return out[::-1] + tail


def agreeing(a: list, b: list, i: int, j: int) -> int:
    """How many words are equal from a[i] and b[j]."""
    n, most = 0, min(len(a) - i, len(b) - j)
    while n + 32 <= most and a[i + n : i + n + 32] == b[j + n : j + n + 32]:
        n += 32
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def grown(a: list, b: list) -> list[tuple[int, int, int]]:
    """Parts as those of edits() along the beginnings of a and b for as long as they agree again within LOOK words."""
    out, i, j = [], 0, 0
    while True:
        if n := agreeing(a, b, i, j):
            out.append((n, n, n))
            i, j = i + n, j + n
        one, other = a[i : i + LOOK + 4], b[j : j + LOOK + 4]
        for p, q in SKIPS:
            if p + 4 <= len(one) and q + 4 <= len(other) and one[p] == other[q] and one[p : p + 4] == other[q : q + 4]:
                out.append((-4 * max(p, q), p, q))
                i, j = i + p, j + q
                break
        else:
            return out


def passages(a: list[bytes], b: list[bytes], chain: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Parts (a from, a to, b from, b to, equal words) of the alignment along a chain."""
    x0, y0 = chain[0]
    head = grown(a[:x0][::-1], b[:y0][::-1])[::-1]
    ops, i, j = list(head), x0, y0
    for x, y in chain:
        if x < i or y < j:  # inside what an exact run has covered, or off its diagonal
            if x + SEED_WORDS <= i or y + SEED_WORDS <= j or x - i != y - j:
                continue
            x, y = i, j
        ops += edits(a[i:x], b[j:y])
        n = agreeing(a, b, x, y)
        if n:
            ops.append((n, n, n))
        i, j = x + n, y + n
    ops += grown(a[i:], b[j:])
    at = [(x0 - sum(o[1] for o in head), y0 - sum(o[2] for o in head))]
    for _, p, q in ops:
        at.append((at[-1][0] + p, at[-1][1] + q))
    out, todo = [], [(0, len(ops))]
    while todo:  # the best part, then what is left on both sides of it
        low, high = todo.pop()
        best, total, since, found = 0, 0, low, None
        for k in range(low, high):
            total += ops[k][0]
            if total <= 0:
                total, since = 0, k + 1
            elif total > best:
                best, found = total, (since, k + 1)
        if found is None:
            continue
        s, e = found
        (a1, b1), (a2, b2) = at[s], at[e]
        equal = sum(o[0] for o in ops[s:e] if o[0] > 0)
        if min(a2 - a1, b2 - b1) >= MIN_WORDS and equal >= MIN_IDENTITY * max(a2 - a1, b2 - b1):
            out.append((a1, a2, b1, b2, equal))
        if best >= MIN_CHAIN:
            todo += [(low, s), (e, high)]
    return sorted(out)


def sliced(reps: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, low, high, words for each wanted (doc, low, high); each text is cut up once."""
    asked = wanted.groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    both = texts_of(reps, classes, asked).select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, x, spans in zip(b.column(0).to_pylist(), pc.cast(b.column(1), pa.binary()), b.column(2).to_pylist()):
                words = words_of(x.as_py() or b"")
                cut = [(doc, s["low"], s["high"], b" ".join(words[s["low"] : s["high"]])) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["doc", "low", "high", "words"])

    return both.mapInArrow(run, "doc long, low int, high int, words binary")


def aligned(reps: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Rows 'passage' of RESULT, a with its smaller partner and the other way round."""
    low = lambda p: (F.floor(F.greatest(F.array_min(p) - MARGIN, F.lit(0)) / SNAP) * SNAP).cast("int")
    high = lambda p: (F.ceil((F.array_max(p) + SEED_WORDS + MARGIN) / SNAP) * SNAP).cast("int")
    found = found.select("a", "b", "xs", "ys", low("xs").alias("al"), high("xs").alias("ah"), low("ys").alias("bl"), high("ys").alias("bh"))
    wanted = found.select(F.col("a").alias("doc"), F.col("al").alias("low"), F.col("ah").alias("high")).union(found.select("b", "bl", "bh"))
    slices = staged_alone(sliced(reps, classes, wanted), "slices")
    of_a = slices.select(F.col("doc").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah"), F.col("words").alias("aw"))
    of_b = slices.select(F.col("doc").alias("b"), F.col("low").alias("bl"), F.col("high").alias("bh"), F.col("words").alias("bw"))
    whole = found.join(of_a, ["a", "al", "ah"]).join(of_b, ["b", "bl", "bh"]).select("a", "b", "xs", "ys", "al", "bl", "aw", "bw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, xs, ys, al, bl, aw, bw in zip(*(c.to_pylist() for c in batch.columns)):
                for a1, a2, b1, b2, n in passages(aw.split(), bw.split(), [(x - al, y - bl) for x, y in zip(xs, ys)]):
                    share = round(n / max(a2 - a1, b2 - b1), 6)
                    rows.append(("passage", a, a1 + al, a2 + al, b, b1 + bl, b2 + bl, n, share))
                    rows.append(("passage", b, b1 + bl, b2 + bl, a, a1 + al, a2 + al, n, share))
            if rows:
                kinds = (pa.string(), *[pa.int64()] * 7, pa.float64())
                names = [f.split()[0] for f in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return whole.mapInArrow(run, RESULT)


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of RESULT, with places in words of the text: copies and fuzzy passages."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(LARGEST))
    t = F.coalesce(F.col(text), F.lit(""))
    slim = small_batches(docs).select(doc.alias("doc"), t.alias("text"))
    same = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    keys = staged_alone(slim.select("doc", *same), "texts")
    classes = staged_alone(keys.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.count("*").alias("members")), "classes")
    # MIN_WORDS words and white space between them
    long = slim.where(F.octet_length("text") >= 2 * MIN_WORDS - 1).select("doc", "text", *same)
    reps = long.join(classes.select("h1", "h2", F.col("rep").alias("doc")).hint("shuffle_hash"), ["h1", "h2", "doc"], "left_semi")
    seeds = staged_alone(with_seeds(reps), "seeds")
    own = F.when(F.col("doc") == LARGEST, None).otherwise(F.col("doc"))
    sizes = seeds.where(f"key IS NULL AND place >= {MIN_WORDS}").select(F.col("doc").alias("rep"), F.col("g").alias("h1"), F.col("place").cast("long").alias("n_words")).distinct()
    repeating = staged_alone(classes.where("members > 1").join(sizes, ["rep", "h1"]), "repeating")
    # of rows that share the representative's id, all but one are copies
    members = keys.join(repeating, ["h1", "h2"]).groupBy("rep", "doc", "n_words").count()
    members = members.select("rep", "doc", "n_words", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("k")).where("doc <> rep OR k > 1")
    whole = F.lit(0).cast("long")
    copies = members.select(F.lit("copy").alias("kind"), own.alias("doc_id"), whole.alias("start"), F.col("n_words").alias("stop"), F.col("rep").alias("partner_id"), whole.alias("partner_start"), F.col("n_words").alias("partner_stop"), F.col("n_words").alias("n_equal"), F.lit(1.0).alias("identity"))
    links, crowds, read = matches(long, classes, seeds, tasks)
    found = chained(links, tasks)
    unstaged(*read)
    lost = lambda c: F.when(F.col(c) == LARGEST, None).otherwise(F.col(c)).alias(c)
    fuzzy = staged_alone(aligned(long, classes, found), "passages")
    rest = aligned(long, classes, chained(others(crowds, fuzzy), tasks)).join(fuzzy, [f.split()[0] for f in RESULT.split(", ")[1:7]], "left_anti").select(fuzzy.columns)
    return copies.union(fuzzy).union(rest).select("kind", lost("doc_id"), "start", "stop", lost("partner_id"), "partner_start", "partner_stop", "n_equal", "identity")
