"""Masked pseudo-likelihood scores from a bidirectional window network.

Words are hashed to VOCAB tokens. A token is predicted from WINDOW tokens on either side: their
vectors, one table for each place, are added, go through tanh, and a softmax gives the token's
class; within its class a token has its share of the corpus counts. Classes hold tokens of
neighbouring frequency and about equal mass. A document's score is the sum over its tokens of
log p(token | both sides).

Each text becomes tokens once, which are written; all that follows reads those. Counts cover every
token of all documents. The network is trained in numpy by each task on its
own rows: in each of ROUNDS rounds every ROUNDS-th token of each document, from an offset that
the document's tokens decide and that moves by one a round, so every token is predicted once. Parameters are averaged between the rounds by the number of examples,
in fixed point, so their order does not matter. What is gathered is a set of parameters from
each task, so it grows with the input; sums are taken in two steps, salted by task, so that no
task adds up more than its share, and the model itself has a fixed size.

Cases. Null or empty text: no tokens, a sum of zero and a null mean. Repeated rows: each counted
and returned. Empty table: empty result. Texts are processed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, staged

VOCAB, WINDOW, HIDDEN, CLASSES = 4096, 2, 24, 128
ROUNDS, RATE, BATCH = 2, 0.05, 512
SAFE = 80.0  # exp of this, CLASSES times, and of its negative are 32-bit floats
BLOCK, SALTS, UNIT = 8192, 32, 1 << 20
CACHE_WORDS, TOKENS_AT_ONCE = 500_000, 1 << 14
OFFSETS = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Tokens(dict):
    """Word to token, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        out = self[word] = zlib.crc32(word) % VOCAB
        return out

    def of(self, text: bytes) -> np.ndarray:
        words = text.translate(LOWER).split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's class, and log p(token | class) by add-one counts."""
    mass = counts + 1.0
    order = np.argsort(-mass, kind="stable")
    before = np.cumsum(mass[order]) - mass[order]
    of = np.empty(VOCAB, np.int64)
    of[order] = np.minimum(before * CLASSES / mass.sum(), CLASSES - 1).astype(np.int64)
    return of, np.log(mass / np.bincount(of, mass, CLASSES)[of])


class Network:
    """A window network; row VOCAB of each table of vectors stands for what lies outside the text."""

    SHAPES = {"vectors": (2 * WINDOW, VOCAB + 1, HIDDEN), "bias": (HIDDEN,), "out": (HIDDEN, CLASSES), "out_bias": (CLASSES,)}

    def __init__(self, flat: np.ndarray | None = None):
        sizes = {k: int(np.prod(s)) for k, s in self.SHAPES.items()}
        if flat is None:
            flat = np.random.default_rng(1).normal(0, 0.1, sum(sizes.values()))
            flat[-CLASSES:] = 0
        self.flat = np.array(flat, np.float32)
        at = 0
        for k, shape in self.SHAPES.items():
            setattr(self, k, self.flat[at : at + sizes[k]].reshape(shape))
            at += sizes[k]
        self.last = self.flat[-(HIDDEN + 1) * CLASSES :].reshape(HIDDEN + 1, CLASSES)  # out, and out_bias as its last row
        self.seen = np.full(self.flat.shape, 1e-3, np.float32)  # squared gradients

    @staticmethod
    def contexts(tokens: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The neighbours of the tokens at some places of texts that follow each other: one row for each of OFFSETS."""
        place = np.arange(len(tokens)) + WINDOW * (np.repeat(np.arange(len(lengths)), lengths) + 1)
        wide = np.full(len(tokens) + WINDOW * (len(lengths) + 1), VOCAB, np.int32)
        wide[place] = tokens
        return np.stack([wide[place[at] + o] for o in OFFSETS])

    def forward(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden values and a one, for the bias, and the logits."""
        hidden = np.take(self.vectors[0], ctx[0], axis=0)
        hidden += self.bias
        for k in range(1, 2 * WINDOW):
            hidden += np.take(self.vectors[k], ctx[k], axis=0)
        wide = np.ones((len(hidden), HIDDEN + 1), np.float32)
        np.tanh(hidden, out=wide[:, :HIDDEN])
        return wide, wide @ self.last

    @staticmethod
    def in_range(logits: np.ndarray) -> np.ndarray:
        """The logits; where exp could leave the range of floats, with 0 as each row's largest."""
        if len(logits) and not (logits.max() < SAFE and logits.min() > -SAFE):
            logits -= logits.max(1, keepdims=True)
        return logits

    @staticmethod
    def exps(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits, in their place, and its sums by row."""
        np.exp(logits, out=logits)
        return logits, logits @ np.ones(CLASSES, np.float32)

    def log_probs(self, ctx: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """In pieces of BATCH, so that logits stay in the processor's cache."""
        out = np.empty(len(classes), np.float32)
        for k in range(0, len(classes), BATCH):
            own = classes[k : k + BATCH]
            logits = self.in_range(self.forward(ctx[:, k : k + BATCH])[1])
            chosen = logits[np.arange(len(own)), own]
            out[k : k + BATCH] = chosen - np.log(self.exps(logits)[1])
        return out

    def step(self, ctx: np.ndarray, classes: np.ndarray) -> None:
        """An AdaGrad step on the mean negative log-probability."""
        n = len(classes)
        wide, logits = self.forward(ctx)
        p, sums = self.exps(self.in_range(logits))
        p *= (1 / (sums * np.float32(n**0.5)))[:, None]
        p[np.arange(n), classes] -= np.float32(1 / n**0.5)
        hidden = wide[:, :HIDDEN]
        back = p @ self.out.T
        back *= 1 - hidden * hidden
        tables = 2 * WINDOW * (VOCAB + 1)
        rows = (ctx + np.arange(2 * WINDOW)[:, None] * (VOCAB + 1)).ravel()
        order = np.argsort(rows.astype(np.uint16) if tables <= 1 << 16 else rows, kind="stable")  # 16 bits are sorted by radix
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        each = np.take(back, order % n, axis=0).view(np.complex64)  # two numbers are added at once
        g, rows = np.add.reduceat(each, first, axis=0).view(np.float32), rows[first]
        table, seen = self.vectors.reshape(-1, HIDDEN), self.seen[: tables * HIDDEN].reshape(-1, HIDDEN)
        new = np.take(seen, rows, axis=0)
        new += g * g
        seen[rows] = new
        g *= RATE
        g /= np.sqrt(new, out=new)
        table[rows] -= g
        for part, g in ((self.flat[tables * HIDDEN : tables * HIDDEN + HIDDEN], back.sum(0)), (self.last.reshape(-1), (wide.T @ p).ravel())):
            at = tables * HIDDEN + (HIDDEN if g.size > HIDDEN else 0)
            seen = self.seen[at : at + g.size]
            seen += g * g
            part -= RATE * g / np.sqrt(seen)


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id and tokens, of 16 bits each, for every row of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokens.of(x.as_py() or b"").astype("<u2").tobytes() for x in pc.cast(b.column(1), pa.binary())], pa.binary())], ["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens binary")


def pieces(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tokens of texts that follow each other, and the texts' lengths, about TOKENS_AT_ONCE together."""
    held, size = [], 0
    for x in batch.column(k):
        held.append(np.frombuffer(x.as_py(), "<u2"))
        size += len(held[-1])
        if size >= TOKENS_AT_ONCE:
            yield np.concatenate(held).astype(np.int32), np.array([len(h) for h in held])
            held, size = [], 0
    if held:
        yield np.concatenate(held).astype(np.int32), np.array([len(h) for h in held])


def targets(tokens: np.ndarray, lengths: np.ndarray, turn: int) -> np.ndarray:
    """The places that a round predicts; over all rounds each once."""
    starts = np.cumsum(lengths) - lengths
    sums = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    offsets = (sums[starts + lengths] - sums[starts] + turn) % ROUNDS
    return np.flatnonzero((np.arange(len(tokens)) - np.repeat(starts + offsets, lengths)) % ROUNDS == 0)


def token_counts(rows: DataFrame) -> np.ndarray:
    """How often each token occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCAB, np.int64)
        for b in batches:
            for tokens, _ in pieces(b, 0):
                total += np.bincount(tokens, minlength=VOCAB)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(VOCAB, dtype=np.int32)), pa.array(total)], ["token", "n"])

    out = np.zeros(VOCAB, np.int64)
    for r in rows.select("tokens").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # VOCAB rows
        out[r.token] = r.n
    return out


def summed(parts: DataFrame) -> DataFrame:
    """block, salt, n, data: blocks of fixed-point parameters added up within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            for block, salt, n, data in zip(*(c.to_pylist() for c in b.columns)):
                have = total.setdefault((block, salt), [0, 0])
                have[0] += n
                have[1] = have[1] + np.frombuffer(data, np.int64)
        for (block, salt), (n, data) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([n], pa.int64()), pa.array([data.tobytes()], pa.binary())], ["block", "salt", "n", "data"])

    return parts.mapInArrow(run, "block int, salt int, n long, data binary")


def trained(rows: DataFrame, counts: np.ndarray) -> np.ndarray:
    """The parameters after all rounds over the tokens."""
    spark = rows.sparkSession
    of, _ = classes_of(counts)
    flat = Network().flat
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(flat.tobytes())

        def run(batches: Iterator[pa.RecordBatch], turn=turn, sent=sent) -> Iterator[pa.RecordBatch]:
            net, n = Network(np.frombuffer(sent.value, np.float32)), 0
            ctx, cls = np.zeros((2 * WINDOW, 0), np.int32), np.zeros(0, np.int64)
            for b in batches:
                for tokens, lengths in pieces(b, 0):
                    at = targets(tokens, lengths, turn)
                    ctx, cls = np.concatenate([ctx, net.contexts(tokens, lengths, at)], 1), np.concatenate([cls, of[tokens[at]]])
                    done = len(cls) - len(cls) % BATCH
                    for k in range(0, done, BATCH):
                        net.step(ctx[:, k : k + BATCH], cls[k : k + BATCH])
                    n += done
                    ctx, cls = ctx[:, done:], cls[done:]
            if len(cls):
                net.step(ctx, cls)
                n += len(cls)
            if n:
                fixed = np.rint(net.flat.astype(np.float64) * UNIT).astype(np.int64) * n
                salt = TaskContext.get().partitionId() % SALTS
                for k in range(0, len(fixed), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([salt], pa.int32()), pa.array([n], pa.int64()), pa.array([fixed[k : k + BLOCK].tobytes()], pa.binary())], ["block", "salt", "n", "data"])

        parts = rows.select("tokens").mapInArrow(run, "block int, salt int, n long, data binary")
        once = summed(parts.repartition(tasks, "block", "salt")).withColumn("salt", F.lit(0))
        blocks = sorted(staged(summed(once.repartition(tasks, "block")), "parameters").collect(), key=lambda r: r.block)  # the size of the model
        if blocks:
            flat = np.concatenate([np.frombuffer(bytes(r.data), np.int64) / r.n / UNIT for r in blocks]).astype(np.float32)
    return flat


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood and its mean for every row."""
    slim = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = staged(tokenised(slim), "tokens")
    counts = token_counts(rows)
    sent = slim.sparkSession.sparkContext.broadcast((trained(rows, counts).tobytes(), counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, counts = sent.value
        net = Network(np.frombuffer(flat, np.float32))
        of, within = classes_of(counts)
        for b in batches:
            out = []
            for tokens, lengths in pieces(b, 1):
                ctx, cls = net.contexts(tokens, lengths, np.arange(len(tokens))), of[tokens]
                logs = np.concatenate([net.log_probs(ctx[:, k : k + TOKENS_AT_ONCE], cls[k : k + TOKENS_AT_ONCE]).astype(np.float64) for k in range(0, len(tokens), TOKENS_AT_ONCE)] or [np.zeros(0)]) + within[tokens]
                sums, ends = np.concatenate([[0.0], np.cumsum(logs)]), np.cumsum(lengths)
                out += zip(lengths.tolist(), (sums[ends] - sums[ends - lengths]).tolist())
            if out:
                n, s = zip(*out)
                cols = [pa.array(n, pa.int64()), pa.array([round(x, 4) for x in s]), pa.array([round(x / k, 6) if k else None for k, x in out], pa.float64())]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return rows.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_tokens long, log_likelihood double, mean_log_likelihood double")
