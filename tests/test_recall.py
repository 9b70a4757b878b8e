import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.operators import ranking, recall, search

QUESTIONS = ("which parts fit models affected by recall 23V083?", "latest torque of LT300", "what did we learn last time", "weight of LT300", "how long is it", "WHAT part needs campaign 12V-345")


def test_routes_of_strings_and_columns(spark):
    rows = spark.createDataFrame([(q,) for q in QUESTIONS], "q string").select("q", X.routes(F.col("q")).alias("r"), X.entities(F.col("q")).alias("e")).collect()
    for r in rows:
        assert recall.route(r.q) == r.r and search.entities_of(r.q) == r.e


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 16)).astype(np.float32)
    v[7] = v[3]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(1000, None), (1001, [1.0, 2.0]), (1002, [float("nan")] * 16), (1003, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    for k in (1, 2, 10, 499):
        got = [(r.id, r.score) for r in ranking.nearest(df, v[3].tolist(), k, "id").collect()]
        s = v.astype(float) @ v[3].astype(float) / (np.linalg.norm(v.astype(float), axis=1) * np.linalg.norm(v[3].astype(float)))
        want = sorted(range(500), key=lambda i: (-round(s[i], 12), i))[:k]
        assert [d for d, _ in got][:2] == want[:2] and {d for d, _ in got} <= {*want, 1003} and abs(got[0][1] - 1) < 1e-6
    assert ranking.nearest(df.limit(0), v[3].tolist(), 3, "id").count() == 0


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        (1, "brake torque is 55 Nm on LT300", "manual.pdf", "2023-01-05", ["LT300"], [1.0, 0.0]), (2, "emissions fell to 20 percent", "report-2024.pdf", "2024-03-14", [], [0.0, 1.0]),
        (3, "emissions fell to 20 percent", "report-2025.pdf", "2025-03-12", [], [0.0, 1.0]), (4, "nothing of note", "it's, odd.pdf", None, [], [0.6, 0.8]),
    ]
    return spark.createDataFrame(rows, "id long, text string, document string, created_at string, entities array<string>, embedding array<double>")


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_modes(index):
    assert ids(search.search(index, "keyword", "emissions percent")) == [2, 3]
    assert ids(search.search(index, "vector", vector=[1.0, 0.0], top=2)) == [1, 4]
    assert ids(search.search(index, "fresh", "emissions percent", as_of=F.lit("2025-06-01")))[0] == 3
    assert ids(search.search(index, "hybrid", "emissions", [0.0, 1.0], top=3))[:2] == [2, 3]
    assert ids(search.search(index, "semantic", "torque", [0.0, 1.0], top=4))[0] in (1, 2)
    assert ids(search.search(index, "keyword", "*", order_by="document desc")) == [3, 2, 1, 4]
    assert ids(search.search(index, "keyword", "nowhere")) == []
    with pytest.raises(ValueError):
        search.search(index, "other")


def test_filters_of_recall(index):
    assert ids(recall_of(index, documents=["it's, odd.pdf"])) == [4]
    assert ids(recall_of(index, where=search.newer_than("2024-06-01"))) == [3]
    assert search.documents_filter([]) is None and search.both_filters(None, None) is None
    assert search.get_document(index, 2).first().document == "report-2024.pdf"


def recall_of(index, **more):
    return search.recall(index, "*", k=5, mode="keyword", **more)


def test_semantic_pool_keeps_the_rest(spark):
    rows = [(k, f"word{k % 7} shared text {k}", [1.0, float(k)]) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<double>")
    out = search.search(df, "semantic", "shared word3", [1.0, 0.0], top=80).collect()
    assert len(out) == 80 and sum(r.reranker_score is not None for r in out) == 50
    assert [r.rank for r in sorted(out, key=lambda r: r.rank)] == list(range(1, 81))
    assert all(r.reranker_score is not None for r in out if r.rank <= 50)


def test_hybrid_packs_in_order_of_trust(spark):
    facts = spark.createDataFrame([("LT300", "torque", "55 Nm", "a.pdf"), ("LT400", "torque", "60 Nm", "b.pdf")], "subject string, predicate string, object string, document string")
    chunks = spark.createDataFrame([("c1", "chunk", "x" * 400, "c.pdf", 2.0), ("c2", "chunk", "short", "d.pdf", 1.0)], "id string, kind string, text string, document string, score double")
    found = recall.recalled_facts(facts, "torque of LT300")
    out = recall.hybrid("torque of LT300", {"facts": found, "semantic": chunks}, 20).orderBy("place").collect()
    assert [r.id for r in out] == ["fact|LT300|torque", "c2"] and out[0].document == "a.pdf"
    assert recall.recalled_facts(facts, "some torque").count() == 2  # no entity: by keywords alone


def test_lessons(spark):
    known = spark.createDataFrame([(d,) for d in ("sustainability-report-2024.pdf", "sustainability-report-2025.pdf", "manual.pdf", "a+b.pdf")], "document string")
    schema = "trigger array<string>, prefer_documents array<string>, prefer_latest boolean"
    names = lambda rows, task: sorted(r.document for r in recall.applied_lessons(spark.createDataFrame(rows, schema), task, known).collect())
    family = "sustainability-report-*.pdf"
    assert names([(["emissions", "value"], [family], True)], "most recent emissions value") == ["sustainability-report-2025.pdf"]
    assert names([(["emissions", "value"], [family], False)], "emissions value") == ["sustainability-report-2024.pdf", "sustainability-report-2025.pdf"]
    assert names([(["emissions", "value"], [family], True)], "torque") == []
    assert names([(["emissions"], ["A+B.pdf", "[l-m]anua?.pdf"], False)], "emissions") == ["a+b.pdf", "manual.pdf"]


def test_context_error_and_budget(spark):
    turns = spark.createDataFrame([(1, k, f"turn {k} " + "x" * 30) for k in range(10)], "c int, t int, line string")
    notes = spark.createDataFrame([(1, k, f"note {k} " + "y" * 20) for k in range(30)], "c int, t int, line string")
    text = recall.context("system", "goal", turns, notes, ["c"], "t", "line", 120).first().context
    assert sum(-(-len(s) // 4) for s in text.split("\n") if s not in ("Observations:", "Recent turns:")) <= 120 and "turn 9" in text
    assert text.index("Goal: goal") < text.index("Observations:") < text.index("Recent turns:") < text.index("turn 9")
    with pytest.raises(ValueError):
        recall.context("x" * 500, "goal", turns, notes, ["c"], "t", "line", 120)


def test_answer(spark):
    items = [(0, "a", "m p.1", "The brake needs care. Torque is 55 Nm."), (1, "b", "n", "Torque of the brake is 60 Nm."), (2, "c", "o", "Other words.")]
    df = spark.createDataFrame(items, "rank int, id string, citation string, text string")
    words = lambda s: {w for w in re.findall(r"[^\W_]+", s.lower()) if len(w) > 1 and w not in X.STOP_WORDS}
    best = max(((len(words("brake torque") & words(s)) + 0.5 * bool(re.search("[0-9]", s)) + 2 * bool(re.search(X.QUANTITY, s)) - 0.1 * r, -r, s, c) for r, _, c, t in items for s in re.split(r"(?<=[.!?])\s+", t)))
    got = recall.answered(df, "brake torque").first()
    assert (got.answer, got.citation) == (best[2], best[3]) and abs(got.score - best[0]) < 1e-6
    assert recall.answered(df, "zebra").first().citation == "m p.1"  # a quantity alone scores
    assert recall.answered(df.where("rank = 2"), "zebra").first().answer == "not found in the documents"


def test_paths(spark):
    edges = spark.createDataFrame([("23V083", "affects", "LT300"), ("123456", "fits", "LT300")], "src string, predicate string, dst string")
    out = recall.recalled_paths(edges, "parts for 23V083").collect()
    assert [r.text for r in out] == ["23V083 affects LT300; LT300 ~fits 123456"]
    assert recall.recalled_paths(edges, "no entity").count() == 0


def test_two_passes_learn(spark):
    known = spark.createDataFrame([("report-2024.pdf",), ("report-2025.pdf",), ("manual.pdf",)], "document string")
    questions = spark.createDataFrame([("q1", "What is the most recent emissions value?", ["Report-2025.pdf"]), ("q2", "What is the current emissions total value?", ["report-2025.pdf"])], "id string, question string, expected_documents array<string>")

    def ask(question, documents):
        return spark.createDataFrame([((documents or ["manual.pdf"])[0] + " p.1",)], "citation string")

    none = spark.createDataFrame([], recall.LESSON)
    first, lessons, rate = recall.run_pass(questions.where("id = 'q1'"), none, known, ask)
    assert rate.first().success_rate == 0.0 and lessons.first().prefer_documents == ["Report-*.pdf"] and lessons.first().prefer_latest
    episodes, _, rate = recall.run_pass(questions, lessons, known, ask)
    assert rate.first().success_rate == 1.0 and {r.citations[0] for r in episodes.collect()} == {"report-2025.pdf p.1"}
    text = lessons.select(recall.lesson_text(F.col("trigger"), F.col("prefer_documents"), F.col("prefer_latest"))).first()[0]
    assert text == "For tasks about emissions value: look in Report-*.pdf, newest first"
    assert recall.items_json(spark.createDataFrame([(1, "a", "t", "c")], "rank int, id string, text string, citation string")).first().items.startswith('[{"rank":1')
