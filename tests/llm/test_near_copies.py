import random

import numpy as np
import pytest

from gleanery.llm import near_copies as N

VOCAB = [f"w{k}" for k in range(3000)]
SCHEMA = "doc_id long, text string, node string"


def sets(words, width=5):
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b)


def copy_of(rng, words, similarity):
    """A copy with random words replaced, down to about the similarity."""
    out, places = list(words), rng.sample(range(len(words)), len(words))
    for p in places:
        new = [*out[:p], "changed%d" % rng.randrange(10**9), *out[p + 1 :]]
        if jaccard(words, new) < similarity:
            return out
        out = new
    return out


def test_recall_of_near_copies(spark):
    rng = random.Random(3)
    rows, pairs, clean = [], [], []
    for k in range(300):
        words = [rng.choice(VOCAB) for _ in range(rng.randrange(40, 400))]
        rows.append((10 * k, words))
        if k < 200:
            other = copy_of(rng, words, rng.uniform(0.8, 0.98))
            rows.append((10 * k + 1, other))
            pairs.append(jaccard(words, other))
        else:
            clean.append(10 * k)
            rows.append((10 * k + 2, [rng.choice(VOCAB) if rng.random() < 0.5 else w for w in words]))
    kept = {r.doc_id for r in N.keep_one(spark.createDataFrame([(d, " ".join(w), "x") for d, w in rows], SCHEMA)).collect()}
    caught = [10 * k + 1 not in kept for k in range(200)]
    assert np.mean(caught) >= 0.97, np.mean(caught)
    assert np.mean([c for c, j in zip(caught, pairs) if j < 0.85]) >= 0.9
    assert {10 * k for k in range(300)} <= kept and {d + 2 for d in clean} <= kept


@pytest.mark.parametrize("max_shard", [6, 4096])
def test_hot_keys(spark, max_shard):
    """One group of near copies larger than a shard, with outsiders that share its keys only."""
    rng = random.Random(5)
    base = [rng.choice(VOCAB) for _ in range(120)]
    rows = [(k, " ".join(copy_of(rng, base, 0.9)), "x") for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = N.grouped(docs, max_shard=max_shard).collect()
    assert len(out) == 60 and len({r.root for r in out}) == 1


def test_rest_meets_every_part(spark):
    """Nodes of one key: a large group, and pairs outside of it that the first deal parts."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, N.SKETCH).astype(np.uint8)
    near = lambda b: np.where(rng.random(N.SKETCH) < 0.05, rng.integers(0, 256, N.SKETCH), b).astype(np.uint8).tobytes()
    rows = [(k, k % 3, [7], near(base)) for k in range(40)]
    for k in range(10):
        other = rng.integers(0, 256, N.SKETCH).astype(np.uint8)
        rows += [(100 + k, 0, [7], near(other)), (200 + k, 0, [7], near(other))]
    nodes = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in rows], "node long, fp long, keys array<long>, minima binary")
    got = {r.u: r.v for r in N.near_links(nodes, 8).collect()}
    assert got == {**{k: 0 for k in range(1, 40)}, **{200 + k: 100 + k for k in range(10)}}


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "one two", "d"), (4, "one two", "d"), (None, "ONE  two", "e"), (None, "solo", "f"), (5, "w " * 70_000, "g"), (6, "É é", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = N.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 4, None, 5, 6], key=repr)
    assert N.keep_one(df.limit(0)).count() == 0


def plain_groups(texts):
    """The smallest place of each text's group, by comparing all pairs of sketches."""
    made, part = [N.sketch(t.encode()) for t in texts], list(range(len(texts)))

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for i, (f, keys, minima) in enumerate(made):
        for j in range(i):
            g, other, also = made[j]
            if set(keys) & set(other) and ((f ^ g) & (2**64 - 1)).bit_count() <= N.RADIUS and (minima == also).mean() >= N.LEAST:
                a, b = root(i), root(j)
                part[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(texts))]


def test_documents_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    groups = plain_groups([texts[d] for d in ids])
    kept = {r.doc_id for r in N.keep_one(docs).collect()}
    assert kept == {d for k, d in enumerate(ids) if groups[k] == k}
    words = [texts[d].lower().split() for d in ids]
    for i in range(len(ids)):
        for j in range(i):
            if len(words[i]) < 2 * len(words[j]) + 9 and len(words[j]) < 2 * len(words[i]) + 9 and jaccard(words[i], words[j]) >= 0.9:
                assert groups[i] == groups[j]
