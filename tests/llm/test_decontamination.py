import random

import duckdb
import pytest

from gleanery.llm import decontamination as d
from gleanery.llm.decontamination_sql import OP2
from gleanery.llm.queries import op2_decontamination


def brute(index, found, threshold):
    n = {}
    for t in found:
        if (p := index.terms.get(t)) is not None:
            for k, w in zip(p.items, p.weights):
                n[k] = n.get(k, 0) + w
    return sorted(k for k, s in n.items() if s >= threshold - d.EPSILON)


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.5, 0.8, 1.0])
def test_wand_finds_what_brute_force_finds(threshold):
    rng = random.Random(int(threshold * 100))
    words = [b"w%d" % k for k in range(400)]
    skewed = lambda n: b" ".join(words[min(399, int(rng.expovariate(0.02)))] for _ in range(n))
    index = d.Index([skewed(rng.randrange(0, 30)) for _ in range(700)])
    for _ in range(150):
        found = set(skewed(rng.randrange(1, 120)).split())
        got = index.search(found, threshold)
        assert [k for k, _ in got] == brute(index, found, threshold)
    whole = next(k for k, (_, q) in enumerate(index.question) if q)
    assert index.terms and any(k == whole for k, _ in index.search(set(index.terms), 1.0))


def test_documents(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()}
    items = [(r.item_id, b" ".join(d.terms(r.text.encode()))) for r in bench.collect()]
    texts = {r.doc_id: b" " + b" ".join(d.terms(r.text.encode())) + b" " for r in docs.collect()}
    exact = {(k, i) for k, t in texts.items() for i, x in items if b" " + x + b" " in t}
    assert exact and found == exact  # the documents quote whole items
    kept = d.clean(docs, bench)
    assert {r.doc_id for r in kept.collect()} == texts.keys() - {k for k, _ in exact} and kept.schema == docs.schema


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = sorted(map(tuple, op2_decontamination(spark, sf).collect()))
    assert got == sorted(con.sql(OP2).fetchall()) and got


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta y"), (2, "alpha"), (3, "delta gamma beta alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    assert [r.doc_id for r in d.leaks(docs, bench).collect()] == [1]


def test_several_indexes(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()}
    split = d.parts(bench, limit=2000)
    assert len(split) > 2 and sum(p.count() for p in split) == bench.count()
    real, d.parts = d.parts, lambda b: real(b, limit=2000)
    try:
        assert {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()} == one
    finally:
        d.parts = real


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta. iota kappa lambda mu nu xi omicron pi"
    edited = item.replace("gamma", "other").replace("xi", "none")
    filler = " ".join(f"f{k}" for k in range(1000))
    rows = [
        (1, f"{filler} {item} {filler}", "a"), (2, f"{filler} {edited} {filler}", "b"), (3, item.split(".")[0], "c"), (4, None, "d"), (5, "", "e"),
        (1, f"{filler} {item} {filler}", "a"), (None, item.upper(), "f"), (6, " ".join(reversed(item.split())), "g"), (7, filler * 20, "h"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, item), (14, filler)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()), key=repr)
    want = [(k, i) for k in (1, 1, 2, None) for i in (10, 13)] + [(k, 14) for k in (1, 1, 2, 7)]
    assert got == sorted(want, key=repr)
    assert sorted(r.score for r in d.clean(docs, bench).collect()) == ["c", "d", "e", "g"]
    assert d.leaks(docs, bench.limit(0)).count() == 0 and d.leaks(docs.limit(0), bench).count() == 0


def test_results_do_not_depend_on_the_number_of_indexes(spark, sf):
    """Scores, borderline items and passages too, for items of very different lengths; and ids that are strings."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("concat('d', doc_id) AS doc_id", "text")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("concat('i', item_id) AS item_id", "text")
    texts = [r.text.split() for r in bench.limit(6).collect()]
    partly = [(f"p{k}", " ".join(w[: 3 * len(w) // 4]) + " other words here") for k, w in enumerate(texts)]
    docs = docs.union(spark.createDataFrame(partly, "doc_id string, text string"))
    bench = bench.union(spark.createDataFrame([("long", " ".join(sum(texts, [])))], "item_id string, text string"))
    whole = sorted(map(tuple, d.leaks(docs, bench).collect()))
    kept = sorted(r.doc_id for r in d.clean(docs, bench).collect())
    real, d.parts = d.parts, lambda b: real(b, limit=2000)
    try:
        assert len(d.parts(bench)) > 2
        assert sorted(map(tuple, d.leaks(docs, bench).collect())) == whole and whole
        assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == kept
    finally:
        d.parts = real
