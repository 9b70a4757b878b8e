"""A quality classifier from weak labels.

Heuristic labellers vote on each document: good, bad, or nothing. Each looks at one statistic and
votes bad from one cutoff on and good up to another. Some statistics count telling words: insults of
a fixed list, or words and beginnings of words that stand out in the bad ones of a sample of
labelled documents; that sample also sets the cutoffs, and is all that labels do. Where there are none,
cutoffs are fixed and only the list tells. How often each pattern of votes occurs is counted over all
documents (a pattern is one of 3 ** labellers, so the counts are few), and expectation-maximisation
on the counts, begun at the labelled ones, estimates each labeller's accuracy in either class and
each pattern's posterior. Toxicity is a second model of the same kind with labellers of its
own, as a document may be well written and toxic.

The posteriors, and never a given label, train a linear scorer over hashed words and beginnings of
words; that scores all documents. Its sample is drawn from all documents, stratified by both
posteriors so that rare classes are present, SAMPLE_ROWS and SAMPLE_BYTES at most in expectation, and
each row weighs what it stands for. A document is kept if it scores as good and not toxic.

Samples are drawn by a hash of id and text, and training runs in one task over a bounded sample in a
fixed order, so a lost task gives the same model again.

Cases. Null or empty text: no words; labellers of rates abstain, and the score is that of the
length alone. Null labels: none. Several labels of one document: the largest. Repeated rows:
each counted and returned. Empty table: empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import measure
from .shared import small_batches, staged

GOOD, BAD, NONE = 0, 1, 2
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 64 << 20
PREFIXES = (4, 6)  # bytes
BITS, STEPS, RATE, DECAY = 18, 150, 0.1, 1e-4
MIN_DOCS = 4  # of the sample that a word must be in to get a weight or to tell
MIN_RATIO = 2.0  # log of the ratio of a word's frequencies in both classes, for toxicity and for telling words
PRECISION, SUPPORT = 0.97, 5  # of a cutoff for bad, and the fewest labelled documents beyond it
CACHE_WORDS = 500_000
#: Words by which the labellers know running text, and insults, in four languages.
FUNCTION_WORDS = frozenset("the of and to in a is it that for on with as are was be by this from or an he der die und das den von zu mit ist im des nicht ein eine auf la le les de des et un une en que pour dans est el los las y del se por con para".encode().split())
INSULTS = frozenset(
    (
        "idiot stupid moron loser scum trash pathetic worthless disgusting clown dumb imbecile filthy vermin bastard bitch asshole "
        "dummkopf arschloch schwachkopf trottel abschaum widerlich miststück connard salaud imbécile crétin ordure minable dégoûtant "
        "idiota estúpido imbécil basura asqueroso gilipollas cabrón escoria"
    ).encode().split()
)
STRIP = b".,;:!?\"'()[]{}#*$%&|<>"


class Kept(dict):
    """What a function makes of each word, kept for words that come again."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: bytes):
        if len(self) > CACHE_WORDS:
            self.clear()
        out = self[word] = self.make(word)
        return out


@dataclass
class Facts:
    """What labellers and features look at."""

    words: list[bytes]
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_upper: int
    lowered: list[bytes] = field(default_factory=list)
    distinct: set[bytes] = field(default_factory=set)
    heads: tuple[Counter, ...] = ()  # for each of PREFIXES the beginnings of longer words, with the number of these

    @classmethod
    def of(cls, text: bytes) -> "Facts":
        lowered = [w.strip(STRIP) for w in text.lower().split()]
        distinct = set(lowered)
        return cls(text.split(), *measure(text), lowered, distinct, tuple(Counter([w[:k] for w in distinct if len(w) > k]) for k in PREFIXES))

    def rates(self) -> tuple[tuple[str, float], ...]:
        n = max(self.n_words, 1)
        return (
            ("symbols", self.n_symbols / n), ("repeats", self.n_repeat_words / n), ("dup_lines", self.n_dup_lines / max(self.n_lines, 1)), ("upper", self.n_upper / max(self.word_chars, 1)),
            ("word_length", self.word_chars / n / 10), ("function_words", sum(map(FUNCTION_WORDS.__contains__, self.lowered)) / n),
        )


@dataclass(frozen=True)
class Telling:
    """Words and beginnings of words that stand out in bad documents; no words where there are no labels."""

    words: frozenset[bytes] = frozenset()
    short: frozenset[bytes] = frozenset()
    long: frozenset[bytes] = frozenset()

    def rates(self, facts: Facts) -> tuple[float, float, float]:
        """How many of a text's distinct words each of the three knows, in proportion."""
        n = max(len(facts.distinct), 1)
        known = (sum(map(heads.__getitem__, heads.keys() & told)) for heads, told in zip(facts.heads, (self.short, self.long)))
        return len(facts.distinct & self.words) / n, *(k / n for k in known)


Cutoffs = tuple[float | None, float | None]  # good up to the first, bad from the second on

#: For each labeller its fixed cutoffs, on a statistic that is larger in worse documents, and the words it needs.
QUALITY: tuple[tuple[Cutoffs, int], ...] = (
    ((0.05, 0.3), 5), ((0.2, 0.6), 20), ((None, 0.4), 20), ((0.1, 0.3), 20), ((0.18, 0.7), 20), ((-0.1, -0.01), 20), ((-6.6, None), 1), ((None, 0.1), 5), ((None, None), 20), ((None, None), 20),
)
TOXIC: tuple[tuple[Cutoffs, int], ...] = (((0.0, 2.0), 1), ((0.0, 0.004), 1), ((None, None), 5), ((None, None), 5), ((None, None), 5))


def statistics(f: Facts, telling: tuple[Telling, Telling]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """What the labellers of both models look at."""
    r = dict(f.rates())
    bad_words, bad_short, _ = telling[0].rates(f)
    n, insults = max(f.n_words, 1), sum(map(INSULTS.__contains__, f.lowered)) if not INSULTS.isdisjoint(f.distinct) else 0
    quality = (
        r["symbols"], r["repeats"], r["dup_lines"], r["upper"], abs(r["word_length"] - 0.52), -r["function_words"], -log2(n), f.words.count(b"|") / n, bad_words, bad_short,
    )
    return quality, (insults, insults / n, *telling[1].rates(f))


def vote(value: float, cutoffs: Cutoffs) -> int:
    good, bad = cutoffs
    return BAD if bad is not None and value >= bad else GOOD if good is not None and value <= good else NONE


@dataclass(frozen=True)
class Jury:
    """The labellers of both models."""

    telling: tuple[Telling, Telling] = (Telling(), Telling())
    cutoffs: tuple[tuple[Cutoffs, ...], tuple[Cutoffs, ...]] = (tuple(c for c, _ in QUALITY), tuple(c for c, _ in TOXIC))

    def votes(self, facts: Facts) -> tuple[int, int]:
        """The pattern numbers of both models, in base three."""
        out = [0, 0]
        for k, (values, cutoffs, kinds) in enumerate(zip(statistics(facts, self.telling), self.cutoffs, (QUALITY, TOXIC))):
            for value, cutoff, (_, least) in zip(values, cutoffs, kinds):
                out[k] = out[k] * 3 + (vote(value, cutoff) if facts.n_words >= least else NONE)
        return out[0], out[1]


def learned_cutoffs(x: np.ndarray, bad: np.ndarray, fixed: Cutoffs) -> Cutoffs:
    """From labelled documents: bad from where PRECISION of those beyond are, good up to where few are."""
    if bad.sum() < SUPPORT or (~bad).sum() < SUPPORT:
        return fixed
    values, first, counts = np.unique(x, return_inverse=True, return_counts=True)
    n_bad = np.bincount(first, bad, len(values))
    beyond, beyond_bad = np.cumsum(counts[::-1])[::-1], np.cumsum(n_bad[::-1])[::-1]
    upto, upto_bad = np.cumsum(counts), np.cumsum(n_bad)
    sure = np.flatnonzero((beyond_bad >= PRECISION * beyond) & (beyond >= SUPPORT))
    high = float(values[sure[0]]) if len(sure) else None
    clean = np.flatnonzero((upto_bad <= 0.5 * bad.mean() * upto) & (upto >= SUPPORT))
    clean = clean[clean < sure[0]] if len(sure) else clean
    return float(values[clean[-1]]) if len(clean) else None, high


class Seen:
    """In how many documents, and bad ones, each word and each beginning is."""

    def __init__(self):
        self.total, self.n_bad, self.counts = 0, 0, [(Counter(), Counter()) for _ in range(1 + len(PREFIXES))]

    def add(self, f: Facts, bad: bool) -> None:
        self.total, self.n_bad = self.total + 1, self.n_bad + bad
        for (docs, of_bad), found in zip(self.counts, (f.distinct, *map(list, f.heads))):
            docs.update(found)
            if bad:
                of_bad.update(found)


def told(*parts: Seen) -> Telling:
    """The words and beginnings whose share of documents in both classes differs by MIN_RATIO."""
    n_bad, n_good = sum(p.n_bad for p in parts), sum(p.total - p.n_bad for p in parts)
    out = []
    for w in range(1 + len(PREFIXES)):
        found = set()
        for x in set().union(*(p.counts[w][1] for p in parts)):
            docs, k = (sum(p.counts[w][c][x] for p in parts) for c in (0, 1))
            if docs >= MIN_DOCS and log((k + 0.5) / (n_bad + 1)) - log((docs - k + 0.5) / (n_good + 1)) >= MIN_RATIO:
                found.add(x)
        out.append(frozenset(found))
    return Telling(*out)


def jury_of(rows: list[tuple[bytes, int, int]]) -> Jury:
    """Labellers from texts with their labels for quality and toxicity, of which either may be missing.

    Telling words for the cutoffs come from the other half of the documents, so their rates are
    those of unseen ones. Texts are measured twice, as the words of all of them take much memory.
    """
    halves = [[Seen(), Seen()] for _ in (QUALITY, TOXIC)]
    for j, (text, *gold) in enumerate(rows):
        facts = Facts.of(text)
        for k, g in enumerate(gold):
            if g != NONE:
                halves[k][j % 2].add(facts, g == BAD)
    other = [tuple(told(halves[k][1 - h]) for k in (0, 1)) for h in (0, 1)]
    values, sizes = ([], []), []
    for j, (text, *_) in enumerate(rows):
        facts = Facts.of(text)
        sizes.append(facts.n_words)
        for of, v in zip(values, statistics(facts, other[j % 2])):
            of.append(v)
    cutoffs, n_words = [], np.array(sizes)
    for k, kinds in enumerate((QUALITY, TOXIC)):
        gold, table = np.array([g[k] for _, *g in rows]), np.array(values[k], float)
        use = [(gold != NONE) & (n_words >= least) for _, least in kinds]
        cutoffs.append(tuple(learned_cutoffs(table[u, c], gold[u] == BAD, fixed) for c, (u, (fixed, _)) in enumerate(zip(use, kinds))))
    return Jury(tuple(told(*h) for h in halves), tuple(cutoffs))


def ballots(pattern: int, n: int) -> list[int]:
    return [pattern // 3 ** (n - 1 - k) % 3 for k in range(n)]


@dataclass
class LabelModel:
    """posterior: pattern to the probability of bad; accuracy: of each labeller's votes in (good, bad)."""

    posterior: dict[int, float]
    accuracy: list[tuple[float, float]]
    prior: float


def fitted(counts: dict[tuple[int, int], int], n: int, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over counts of (pattern, label).

    Labels, where there are any, only begin it: a pattern starts at the share of bad ones among its
    labelled documents, drawn towards a majority vote that favours good. From then on all documents
    count alike.
    """
    if not counts:
        return LabelModel({}, [(0.5, 0.5)] * n, 0.5)
    total, given = Counter(), Counter()
    for (p, gold), k in counts.items():
        total[p] += k
        if gold != NONE:
            given[p, gold] += k
    keys = sorted(total)
    v = np.array([ballots(p, n) for p in keys])
    weight = np.array([total[p] for p in keys], float)
    is_bad, is_good = (v == BAD).sum(1), (v == GOOD).sum(1)
    bad = np.clip((2 * is_bad + 0.1) / (2 * is_bad + is_good + 1), 0.01, 0.99)
    seen, seen_bad = (np.array([sum(given[p, g] for g in gs) for p in keys], float) for gs in ((GOOD, BAD), (BAD,)))
    bad = (seen_bad + 2 * bad) / (seen + 2)
    cast = np.stack([v == k for k in range(3)], 2).astype(float)  # key, labeller, vote
    for _ in range(rounds):
        mass = np.stack([weight * (1 - bad), weight * bad])  # class, key
        table = np.einsum("cp,pnk->cnk", mass, cast) + 0.5
        table /= table.sum(2, keepdims=True)
        prior = (mass.sum(1) + 1) / (weight.sum() + 2)
        logs = np.log(prior)[:, None] + np.einsum("cnk,pnk->cp", np.log(table), cast)
        new = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))
        done, bad = np.abs(new - bad).max() < 1e-9, new
        if done:
            break
    voted = table[:, :, :2] / table[:, :, :2].sum(2, keepdims=True)
    return LabelModel(dict(zip(keys, bad.tolist())), [(float(voted[0, k, GOOD]), float(voted[1, k, BAD])) for k in range(n)], float(prior[1]))


def slot(name: bytes) -> int:
    return zlib.crc32(name) & ((1 << BITS) - 1)


def bins(facts: Facts) -> list[int]:
    """One-hot features of the rates and the length."""
    out = [slot(b"\x00%s:%d" % (name.encode(), min(int(value * 20), 40))) for name, value in facts.rates()]
    return [*out, slot(b"\x00length:%d" % min(facts.n_words.bit_length(), 12))]


def scale(n_words: int, mean: bool) -> float:
    """What the sum over a document's hashed words is multiplied by."""
    return 5 / max(n_words, 1) if mean else 3 / max(n_words, 1) ** 0.5


@dataclass
class Scorer:
    """Weights of hashed features; the last is the constant. Words of a document count once."""

    weights: np.ndarray
    mean: bool

    def logit(self, words: np.ndarray, shape: list[int]) -> float:
        words = words[self.weights[words] != 0]
        return float(self.weights[words].sum()) * scale(len(words), self.mean) + float(self.weights[np.array(shape, np.int64)].sum()) + float(self.weights[-1])


def trained(rows: list[tuple[np.ndarray, list[int], float, float]], mean: bool) -> Scorer:
    """Logistic regression on soft labels by Adam steps over all rows (words, shape, label, weight) at once.

    Words in fewer than MIN_DOCS rows get no weight, nor, unless words are averaged, those whose
    frequencies in the two classes are alike: a few telling words must not be outweighed by many.
    The rarer class counts for more, by the square root of the imbalance.
    """
    size = (1 << BITS) + 1
    w = np.zeros(size, np.float64)
    if not rows:
        return Scorer(w.astype(np.float32), mean)
    bad, docs = np.zeros(size), np.zeros(size)
    for words, _, label, _ in rows:
        docs[words] += 1
        bad[words] += label
    total = sum(r[2] for r in rows)
    ratio = np.log((bad + 0.5) / (total + 1)) - np.log((docs - bad + 0.5) / (len(rows) - total + 1))
    use = (docs >= MIN_DOCS) & (mean | (np.abs(ratio) >= MIN_RATIO))
    kept = [r[0][use[r[0]]].astype(np.int32) for r in rows]
    at = np.concatenate([np.concatenate([k, np.array(s, np.int32), [size - 1]]) for k, (_, s, _, _) in zip(kept, rows)]).astype(np.int64)
    x = np.concatenate([np.concatenate([np.full(len(k), scale(len(k), mean)), np.ones(len(s) + 1)]) for k, (_, s, _, _) in zip(kept, rows)]).astype(np.float32)
    counts = np.array([len(k) + len(s) + 1 for k, (_, s, _, _) in zip(kept, rows)])
    starts, y = np.cumsum(counts) - counts, np.array([r[2] for r in rows])
    weight = np.array([r[3] for r in rows])
    weight /= weight.mean()
    share = min(max(float((weight * y).mean()), 1e-3), 1 - 1e-3)
    importance = weight * np.where(y > 0.5, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5)
    m, v = np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[at] * x, starts), -30, 30)))
        g = np.bincount(at, weights=np.repeat((p - y) * importance, counts) * x, minlength=size) / len(rows) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
    return Scorer(w.astype(np.float32), mean)


def slots_of() -> tuple[Kept, Kept]:
    """The slots of words and of beginnings, as they come."""
    return Kept(slot), Kept(lambda head: slot(b"\x00" + head))


def features(facts: Facts, slots: tuple[Kept, Kept]) -> tuple[np.ndarray, list[int]]:
    """The distinct slots of a text's words and beginnings, and those of its shape."""
    words, heads = (s.__getitem__ for s in slots)
    found = set(map(words, facts.distinct)).union(*(map(heads, h) for h in facts.heads))
    return np.sort(np.fromiter(found, np.int64, len(found))), bins(facts)


def gold_of(labels: DataFrame) -> DataFrame:
    """label_id, gold_q, gold_t: one row for each labelled document."""
    code = lambda good, bad: F.when(bad, BAD).when(good, GOOD).otherwise(NONE)
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    return one.select("label_id", code(F.col("q") == 1, F.col("q") == 0).alias("gold_q"), code(F.col("t") == 0, F.col("t") == 1).alias("gold_t"))


def below(share: float):
    """Whether the hash of a row's id and text falls into a share of all hashes."""
    return F.xxhash64("doc_id", "h", F.lit(7)) <= min(int(-(2**63) + min(1.0, share) * 2**64), 2**63 - 1)


def bounded(rows: DataFrame, texts: str = "text") -> DataFrame:
    """About SAMPLE_BYTES of rows at most."""
    size = rows.agg(F.sum(F.octet_length(texts))).first()[0] or 0
    return rows if size <= SAMPLE_BYTES else rows.where(below(SAMPLE_BYTES / size))


def jury(docs: DataFrame, gold: DataFrame) -> Jury:
    """The labellers, from a sample of labelled documents; one task sees it."""
    n = gold.count()
    if not n:
        return Jury()
    few = gold.where(F.xxhash64("label_id", F.lit(7)) <= min(int(-(2**63) + min(1.0, SAMPLE_ROWS / n) * 2**64), 2**63 - 1))
    known = staged(docs.join(F.broadcast(few), F.col("doc_id") == F.col("label_id")).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "text", "gold_q", "gold_t"), "labelled")  # about SAMPLE_ROWS ids, so they may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += [(x.as_py() or b"", q, t) for x, q, t in zip(pc.cast(b.column(0), pa.binary()), b.column(1).to_pylist(), b.column(2).to_pylist())]
        of = jury_of(rows)
        plain = [[[*map(sorted, (t.words, t.short, t.long))] for t in of.telling], of.cutoffs]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(plain)], pa.binary())], ["jury"])

    one = bounded(known).repartition(1).sortWithinPartitions(F.xxhash64("doc_id", "h"), "h").select("text", "gold_q", "gold_t")
    made = one.mapInArrow(run, "jury binary").first()
    if made is None:  # no labelled document is in the table
        return Jury()
    telling, cutoffs = pickle.loads(bytes(made.jury))
    return Jury(tuple(Telling(*map(frozenset, t)) for t in telling), cutoffs)


def voted(docs: DataFrame, of: Jury) -> DataFrame:
    """doc_id, the text's hash and bytes, and the patterns of both models for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for b in batches:
            rows = [of.votes(Facts.of(x.as_py() or b"")) for x in pc.cast(b.column(3), pa.binary())]
            if rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, pa.int32()) for c in zip(*rows))], ["doc_id", "h", "size", "q", "t"])

    sized = docs.select("doc_id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    return sized.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, size long, q int, t int")


def label_models(votes: DataFrame, gold: DataFrame) -> tuple[LabelModel, LabelModel]:
    """Both models, each from counts of its patterns and labels over all documents."""
    seen = votes.join(gold, F.col("doc_id") == F.col("label_id"), "left")
    models = []
    for pattern, label, kinds in (("q", "gold_q", QUALITY), ("t", "gold_t", TOXIC)):
        rows = seen.groupBy(pattern, F.coalesce(label, F.lit(NONE)).alias("gold")).count().collect()  # 3 ** labellers patterns at most
        models.append(fitted({(r[pattern], r.gold): r["count"] for r in rows}, len(kinds)))
    return models[0], models[1]


def scorers(docs: DataFrame, votes: DataFrame, quality: LabelModel, toxic: LabelModel) -> tuple[Scorer, Scorer]:
    """Both scorers, trained in one task on a bounded sample of all documents and their posteriors."""
    spark, none = docs.sparkSession, np.zeros((1 << BITS) + 1, np.float32)
    classes = votes
    for c, model in (("q", quality), ("t", toxic)):  # 3 ** labellers patterns at most, so they may be broadcast
        rows = [(p, v, 0 if v < 0.1 else 2 if v > 0.9 else 1) for p, v in model.posterior.items()]
        classes = classes.join(F.broadcast(spark.createDataFrame(rows, f"{c} int, bad_{c} double, class_{c} int")), c)
    strata = classes.groupBy("class_q", "class_t").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    if not strata:
        return Scorer(none, True), Scorer(none, False)
    share = {(r.class_q, r.class_t): min(1.0, SAMPLE_ROWS / len(strata) / r.n, SAMPLE_BYTES / len(strata) / max(r.size, 1)) for r in strata}
    drawn = F.lit(False)
    weight = F.lit(1.0)
    for (q, t), s in share.items():
        inside = (F.col("class_q") == q) & (F.col("class_t") == t)
        drawn, weight = drawn | (inside & below(s)), F.when(inside, 1 / s).otherwise(weight)
    few = staged(classes.where(drawn).select("doc_id", "h", "bad_q", "bad_t", weight.alias("weight")).dropDuplicates(["doc_id", "h"]), "drawn")  # about SAMPLE_ROWS, so they may be broadcast
    few = few.toDF("drawn_id", "drawn_h", "bad_q", "bad_t", "weight")
    sample = docs.join(F.broadcast(few), F.col("doc_id").eqNullSafe(F.col("drawn_id")) & (F.col("h") == F.col("drawn_h"))).dropDuplicates(["doc_id", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, data = slots_of(), ([], [])
        for b in batches:
            for x, q, t, w in zip(pc.cast(b.column(0), pa.binary()), *(c.to_pylist() for c in b.columns[1:])):
                words, shape = features(Facts.of(x.as_py() or b""), slots)
                data[0].append((words, shape, q, w))
                data[1].append((words, [], t, w))
        made = [trained(d, mean).weights.tobytes() for d, mean in zip(data, (True, False))]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(made, pa.binary())], ["k", "weights"])

    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", "h"), "h").select("text", "bad_q", "bad_t", "weight")
    weights = {r.k: np.frombuffer(bytes(r.weights), np.float32) for r in one.mapInArrow(run, "k int, weights binary").collect()}
    return Scorer(weights[0], True), Scorer(weights[1], False)


def classified(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, quality_posterior, quality_score, toxic_posterior, toxic_score, kept for every row.

    Posteriors are the label models' for the document's votes alone, scores the linear scorers'.
    """
    spark = docs.sparkSession
    slim = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    gold = staged(gold_of(labels if labels is not None else spark.createDataFrame([], f"doc_id {kind}, quality int, toxic int")), "labels")
    of = jury(slim, gold)
    votes = staged(voted(slim, of), "votes")
    models = label_models(votes, gold)
    both = scorers(slim, votes, *models)
    sent = spark.sparkContext.broadcast([of, *((m.posterior, m.prior, s.weights.tobytes()) for m, s in zip(models, both))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, (post_q, prior_q, wq), (post_t, prior_t, wt) = sent.value
        quality, toxic, slots = Scorer(np.frombuffer(wq, np.float32), True), Scorer(np.frombuffer(wt, np.float32), False), slots_of()
        for b in batches:
            rows = []
            for x in pc.cast(b.column(1), pa.binary()):
                facts = Facts.of(x.as_py() or b"")
                words, shape = features(facts, slots)
                q, t = of.votes(facts)
                sq, st = (1 / (1 + exp(-max(-30.0, min(30.0, s)))) for s in (quality.logit(words, shape), toxic.logit(words, [])))
                rows.append((round(1 - post_q.get(q, prior_q), 6), round(1 - sq, 6), round(post_t.get(t, prior_t), 6), round(st, 6), sq < 0.5 and st < 0.5))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.float64()] * 4 + [pa.bool_()])]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "quality_posterior", "quality_score", "toxic_posterior", "toxic_score", "kept"])

    return slim.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, quality_posterior double, quality_score double, toxic_posterior double, toxic_score double, kept boolean")
