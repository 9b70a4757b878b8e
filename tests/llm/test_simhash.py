import random
import re

import numpy as np
import pytest
import xxhash

from gleanery.llm import simhash


def brute_print(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(values, radius):
    a, part = np.array(values, np.uint64), list(range(len(values)))

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a ^ a[i]) <= radius)[0].tolist():
            x, y = root(i), root(j)
            part[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(a))]


def held(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = simhash.clustered(df, **more).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    classes = brute_classes(prints, 4)
    ids = {}
    for (d, _, _), c in zip(rows, classes):
        ids.setdefault(c, []).append(d)
    want = [(d, p, min((x for x in ids[c] if x is not None), default=None)) for (d, _, _), p, c in zip(rows, prints, classes)]
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in out), key=repr) == sorted(want, key=repr)
    return df


def test_documents_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, "x") for r in docs.collect()]
    odd = [(900, None, "a"), (901, "", "b"), (902, "  \n ", "c"), (903, "one two", "d"), (903, "one two", "d"), (None, "ONE two", "e"), (None, "solo", "f"), (904, "w " * 70_000, "g"), (905, "É é", None)]
    df = held(spark, rows + odd)
    assert simhash.clustered(df.limit(0)).count() == 0


@pytest.mark.parametrize("max_shard", [4, 64])
def test_hot_shards_are_cut_again(spark, max_shard):
    rng = random.Random(max_shard)
    values = [0, 2**64 - 1]
    for _ in range(6):
        base = rng.getrandbits(64)
        values += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 9))) for _ in range(60)]
    values += [rng.getrandbits(64) for _ in range(100)]
    values = sorted(set(values))
    edges = simhash.linked(spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long"), 4, max_shard)
    got = {r.u: r.v for r in simhash.components(edges).collect()}
    classes = brute_classes(values, 4)
    label = [got.get(simhash.signed(v), simhash.signed(v)) for v in values]
    assert len({*zip(classes, label)}) == len(set(classes)) == len(set(label))


def test_every_close_pair_shares_a_mask():
    rng = random.Random(1)
    for blocks in range(5, 9):
        masks = simhash.masks_of(2**64 - 1, 4, blocks)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(1000, 1001)], "u long, v long")
    got = {r.u: r.v for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 1001: 1000}
