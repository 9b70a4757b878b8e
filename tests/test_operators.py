"""Golden cases, truth tables and invariants of the library's operators."""


import re

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.functions import vectors as V
from gleanery.operators import dedup, facts, filters, graph, memory, ranking
from gleanery.sources import readers


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("op", ["eq", "ne", "gt", "ge", "lt", "le"])
@pytest.mark.parametrize("field,literal", [("n", "5"), ("s", "'m'"), ("s", "5"), ("n", "null")])
@pytest.mark.parametrize("negated", [False, True])
def test_filter_truth_table(spark, op, field, literal, negated):
    rows = [(None, None), (5, "m"), (4, "a"), (6, "z"), (5, "5")]
    df = spark.createDataFrame(rows, "n int, s string")
    text = f"{field} {op} {literal}"
    got = [r.x for r in df.select(filters.odata(df, f"not ({text})" if negated else text).alias("x")).collect()]
    want = []
    for n, s in rows:
        v = n if field == "n" else s
        w = None if literal == "null" else float(literal) if literal == "5" else "m"
        if isinstance(w, float) and v is not None:
            try:
                v = float(v)
            except ValueError:
                v = None
        if op in ("eq", "ne"):
            r = (v == w) if op == "eq" else (v != w)
        else:
            r = v is not None and w is not None and {"gt": v > w, "ge": v >= w, "lt": v < w, "le": v <= w}[op]
        want.append(r != negated)
    assert got == want


@pytest.mark.parametrize("bad", ["n eq", "n foo 3", "(n eq 3", "n eq 3 n", "missing eq 1", "n/any(t: t eq 3)", ""])
def test_bad_filters(spark, bad):
    with pytest.raises(ValueError):
        filters.odata(spark.createDataFrame([(1,)], "n int"), bad)


def test_names_are_literal(spark):
    df = spark.createDataFrame([("a,b",), ("o'neil",), ("c",)], "d string")
    assert df.where(filters.documents_in(F.col("d"), [])).count() == 0
    assert df.where(filters.documents_in(F.col("d"), ["a,b", "o'neil"])).count() == 2
    assert df.where(filters.odata(df, "d eq 'o''neil'")).count() == 1


def test_text_functions(spark):
    assert value(spark, X.entities(F.lit("Recall 23V-083 and 23V083, model LT-300, part 12-3456, in 2024"))) == ["123456", "2024", "23V083", "LT300"]
    assert value(spark, X.quantities(F.lit("125 Nm or 1,200 km, 7.5 % and 3 apples"))) == ["125 Nm", "1,200 km"]
    assert value(spark, X.sentences(F.lit("One here. Two here!\n|---|\nno\nThree"))) == ["One here.", "Two here!", "Three"]
    assert value(spark, X.redacted(F.lit("Call +49 170 1234567 or a@b.co now"))) == "Call <phone> or <email> now"
    assert value(spark, X.family(F.lit("report-2025.pdf"))) == "report-*.pdf"
    assert value(spark, X.pdf_date(F.lit("D:20230229000000"))) is None
    assert [value(spark, X.estimated_tokens(F.lit(t))) for t in ("", "a", "abcd", "abcde")] == [0, 1, 1, 2]
    for q, want in {
        "Which parts fit models affected by recall 23V083?": ["graph", "facts", "semantic"], "What is the latest emission value?": ["facts", "fresh"],
        "What did we learn last time?": ["episodic", "semantic"], "Torque of LT-300": ["facts", "semantic"], "How do brakes work?": ["semantic"],
    }.items():
        assert value(spark, X.routes(F.lit(q))) == want
    for glob, name, hit in (("recall-*.pdf", "RECALL-1.pdf", True), ("a?c", "abc", True), ("a[!b]c", "abc", False), ("a.c", "abc", False), ("x*", "yx", False)):
        assert bool(re.match(X.glob_pattern(glob), name.lower())) == hit
    assert value(spark, X.markdown_table(F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("1"))))) == "|a\\|b|c|\n|---|---|\n|1||"


def test_near_duplicates_in_order(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.999, 0.0447]), (2, [0.0, 1.0]), (3, [0.02, 0.9998]), (4, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert sorted(r.id for r in dedup.near_distinct(df, "id").collect()) == [0, 2, 4]
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 6), (6, 7)], "low long, high long")
    left = dedup.greedy_kept(spark.range(1, 9), pairs, "id")
    assert sorted(r.id for r in left.collect()) == [1, 3, 4, 6, 8]  # a chain is not a class


def test_consolidation(spark):
    cases = [
        [("125 Nm", "2023", 0.5), ("125  NM", None, 0.9)], [("1", "2023", 0.5), ("2", "2024", 0.6), ("3", "2022", 0.9)], [("1", "2023", 0.5), ("2", None, 0.5)], [("1", None, 0.5), ("2", None, 0.5), ("1", "2020", 0.1)],
    ]
    rows = [(k, i, *c) for k, case in enumerate(cases) for i, c in enumerate(case)]
    df = spark.createDataFrame(rows, "k int, i int, object string, valid_from string, confidence double")
    got = {r.k: (r.object, r.confidence, r.history, r.adds, r.updates, r.noops) for r in facts.consolidated(df, ["k"], ["i"]).collect()}
    assert got == {0: ("125 Nm", 0.9, [], 1, 0, 1), 1: ("2", 0.6, ["1"], 1, 1, 1), 2: ("1", 0.5, [], 1, 0, 1), 3: ("1", 0.1, ["1", "2"], 1, 2, 0)}


def test_fact_extraction(spark):
    text = "| Part No. | Fits | Note |\n|---|---|---|\n| 12-3456 | LT-300 | |\ntext\n|not|a table|\nThe caliper mounting bolts must be tightened to 125 Nm. Recall 23V083 affects LT-300 and XR200."
    got = {(r.subject, r.predicate, r.object) for r in facts.extracted(spark.createDataFrame([(1, text)], "id int, text string")).collect()}
    assert got == {("12-3456", "fits", "LT-300"), ("caliper mounting bolts", "value_nm", "125 Nm"), ("23V083", "affects", "LT300"), ("23V083", "affects", "XR200")}


def test_two_hops_do_not_return(spark):
    e = spark.createDataFrame([("23V083", "affects", "LT300"), ("P1", "fits", "LT300"), ("P1", "mentioned_with", "X9"), ("LT300", "mentioned_with", "X9")], "src string, predicate string, dst string")
    plain = graph.two_hops(e, ["23V083"], comention_edges=False).collect()
    assert [(r.p1, r.mid, r.p2, r.dst) for r in plain] == [("affects", "LT300", "~fits", "P1")]
    assert {r.dst for r in graph.two_hops(e, ["23V083"]).collect()} == {"P1", "X9"}


def test_memory_tables(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, s string, t string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, s string")
    assert sorted(map(tuple, memory.merged(old, new, "id").collect())) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]
    assert memory.without(old, new, "id").count() == 1
    items = spark.createDataFrame([(0, k, f"m{k % 3}", c) for k, c in enumerate([5, 9, 4, 1, 1])], "g int, k int, m string, c int")
    r = memory.packed(items, ["g"], ["k"], "m", "c", 10).first()
    assert (r.used, r.kept) == (10, ["m0", "m2", "m1"])  # 9 does not fit, m0 repeats, a later m1 fits


def test_ranking_invariants(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["red car", "red red car", "blue boat", "", None])], "id int, text string")
    got = {r.id: r.score for r in ranking.bm25(docs, "red car", "id").collect()}
    assert got[1] > got[0] > 0 and got[2] == got[3] == got[4] == 0
    assert ranking.bm25(docs, "the of", "id").where("score <> 0").count() == 0
    batch = ranking.bm25_batch(docs, spark.createDataFrame([(9, "red car")], "q int, question string"), "id", "q")
    assert {r.id: round(r.score, 9) for r in batch.collect()} == {k: round(v, 9) for k, v in got.items() if v}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "id int, embedding array<float>")
    assert [round(r.score, 6) for r in ranking.knn(v, [1.0, 0.0]).orderBy("id").collect()] == [1.0, 0.6, 0.0]
    assert value(spark, V.quantized(F.array(F.lit(0.5), F.lit(3.0)), F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(1.0), F.lit(3.0)))) == [128 / 255, 3.0]


def test_plans_prune_and_take(spark, sf):
    from gleanery import plans

    plan = plans.QUERIES["bm25_top"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "source" not in plan.split("ReadSchema")[1]
    where = plans.QUERIES["sql_where"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(" in where


def test_chunks():
    text = "[[page 1]]\nOne two three.\n\nFour five.\n[[page 2]]\n" + "Long sentence here. " * 20
    out = list(readers.chunks_of(text, 60, 20))
    assert out[0] == (1, 1, "One two three.\n\nFour five.") and all(len(t) <= 62 + 20 for *_, t in out)
    assert out[1][0] == 1 and out[1][2].startswith("Four five.")  # carried over
    assert list(readers.chunks_of("", 60, 0)) == [] and [len(t) for *_, t in readers.chunks_of("x" * 150, 60, 0)] == [60, 60, 30]


def test_round_trips(spark, sf, tmp_path):
    part = spark.read.parquet(f"{sf}/part.parquet")
    for fmt, write in (("csv", "csv"), ("tsv", "csv"), ("ndjson", "json"), ("orc", "orc"), ("parquet", "parquet")):
        path = str(tmp_path / fmt)
        part.write.format(write).options(header="true", sep="\t" if fmt == "tsv" else ",").save(path)
        back = readers.read_table(spark, path, fmt)
        assert sorted(map(tuple, back.selectExpr("cast(p_partkey as long)", "p_name", "cast(p_retailprice as double)").collect())) == sorted(map(tuple, part.select("p_partkey", "p_name", "p_retailprice").collect()))
    import pyarrow.feather

    pyarrow.feather.write_feather(part.toPandas(), str(tmp_path / "p.feather"))
    assert readers.read_table(spark, str(tmp_path / "p.feather"), "arrow").count() == part.count()
    (tmp_path / "a.txt").write_bytes("﻿é".encode())
    (tmp_path / "b.txt").write_bytes("é".encode("cp1252"))
    assert {r.source: r.text for r in readers.read_text(spark, str(tmp_path / "*.txt")).collect()} == {"a.txt": "é", "b.txt": "é"}
    assert [readers.format_of(n) for n in ("x.TXT", "y.layout.json", "z.json", "w")] == ["text", None, "json", None]
    chunks = readers.chunked(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text"))
    readers.write_store(chunks, str(tmp_path / "store"), "hash-64")
    assert readers.open_store(spark, str(tmp_path / "store"), "hash-64").count() == chunks.count()
    with pytest.raises(ValueError):
        readers.open_store(spark, str(tmp_path / "store"), "other")


def test_streams(spark, sf, tmp_path):
    from gleanery.streaming import streams

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    live = streams.new_files(spark, str(tmp_path / "events"), events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    q = streams.windowed(live, late="100 days").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").selectExpr("sum(n)").first()[0] == events.count()
    facts_in = live.selectExpr("user_id", "event_type", "ts", "event_id", "cast(floor(value / 40) as string) AS object", "date_format(ts, 'yyyy-MM-dd') AS valid_from", "0.5D AS confidence")
    streams.fact_table(facts_in, str(tmp_path / "facts"), str(tmp_path / "cp"), ["user_id", "event_type"], ["ts", "event_id"]).awaitTermination()
    key, order = ["user_id", "event_type"], ["ts", "event_id"]
    got = streams.current_facts(spark, str(tmp_path / "facts"))
    assert got.count() == events.select("user_id", "event_type").distinct().count()
    # a later batch is folded into the table, as if all had come together
    late = events.selectExpr("event_id + 1000000 AS event_id", "ts + interval 900 days AS ts", "user_id", "event_type", "value + 100 AS value", "props").where("event_id % 3 = 0")
    late.repartition(1).write.mode("append").parquet(str(tmp_path / "events"))
    streams.fact_table(facts_in, str(tmp_path / "facts"), str(tmp_path / "cp"), key, order).awaitTermination()
    every = spark.read.schema(events.schema).parquet(str(tmp_path / "events")).selectExpr("user_id", "event_type", "ts", "event_id", "cast(floor(value / 40) as string) AS object", "date_format(ts, 'yyyy-MM-dd') AS valid_from", "0.5D AS confidence")
    whole = {tuple(r) for r in facts.consolidated(every, key, order).selectExpr(*key, "object", "valid_from", "cast(history as string)", "adds", "updates", "noops").collect()}
    now = {tuple(r) for r in streams.current_facts(spark, str(tmp_path / "facts")).selectExpr(*key, "object", "valid_from", "cast(history as string)", "adds", "updates", "noops").collect()}
    assert now == whole and streams.versions(spark, str(tmp_path / "facts"))[-1] >= 1
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    turns.write.parquet(str(tmp_path / "turns"))
    live = streams.new_files(spark, str(tmp_path / "turns"), "conv_id long, turn long, role string, text string")
    q = streams.observation_log(live, 100).writeStream.format("memory").queryName("log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    n = {r.action: r["count"] for r in spark.table("log").groupBy("action").count().collect()}
    assert n["kept"] == turns.where("text <> ''").count() and 0 < n["evicted"] < n["kept"]




def test_documents_with_metadata(spark, tmp_path):
    (tmp_path / "recall.txt").write_text("[[page 1]]\nThe bolts need 125 Nm.\n\nMore text.\n[[page 2]]\nEnd.")
    (tmp_path / "plain.txt").write_text("No pages here.")
    (tmp_path / "recall.metadata.json").write_text('{"source": {"file": "Recall 23V.pdf", "pdf_metadata": {"creationDate": "D:20230220000000"}}}')
    (tmp_path / "broken.metadata.json").write_text("{")
    got = {r.source: (r.document, r.created_at, r.source_format, r.page_start, r.page_end, r.id) for r in readers.text_documents(spark, str(tmp_path)).collect()}
    assert got == {"recall.txt": ("Recall 23V.pdf", "2023-02-20", "pdf-text", 1, 2, "recall.txt#0.0"), "plain.txt": ("plain.pdf", None, "text", None, None, "plain.txt#0.0")}


def test_governance(spark):
    chunks = spark.createDataFrame([("a.pdf", 1), ("b.pdf", 2)], "document string, n int")
    memories = spark.createDataFrame([("a.pdf", "fact"), ("a.pdf", "audit"), ("b.pdf", "fact")], "document string, kind string")
    gone = memory.forgotten({"chunks": chunks, "memories": memories}, spark.createDataFrame([("a.pdf",)], "document string"))
    assert gone["chunks"].count() == 1 and {tuple(r) for r in gone["memories"].collect()} == {("b.pdf", "fact"), ("a.pdf", "audit")}
    audit = memory.audited("forget", spark.createDataFrame([("a.pdf", None)], "document string, removed int"), F.lit("2025-01-01 00:00:00")).first()
    assert audit.kind == "audit" and audit.text == 'forget {"document":"a.pdf","removed":null}'
    assert value(spark, X.normalized_line(F.lit("ﬁne\u00ad  x\u00a0y "))) == "fine x y"
    assert [value(spark, X.duration_days(F.lit(v))) for v in ("P730D", "P1Y")] == [730, 365]


def test_ocr_quality_rounds_as_sql(spark, tmp_path):
    """41 of 640 characters: the binary quotient lies below the tie that its decimal digits show."""
    import duckdb

    from gleanery import plans

    texts = ["a" * 41 + " " + "1x" * 299 + "z", "", " \n", None, "abc  12\u0085 12", "abc\x0bdef abc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(plans.ORACLES["ocr_quality"]).fetchall())
    assert want[0] == (0, 0.064062)
    assert sorted(map(tuple, plans.QUERIES["ocr_quality"](spark, str(tmp_path)).collect())) == want


def test_upsert_adds_parts_of_their_own(spark, tmp_path):
    """The table already has the number that an added part gets."""
    import duckdb

    from gleanery import plans

    rows = [(k, f"n{k}", "b") for k in (8, 12, 16, 17, 1_000_016, 1_000_017)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(map(repr, con.sql(plans.ORACLES["upsert_merge"]).fetchall()))
    got = plans.QUERIES["upsert_merge"](spark, str(tmp_path)).select("p_partkey", "p_name", "p_brand")
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_profile_lines_end_words_and_trim_as_sql(spark, tmp_path):
    """In SQL an accented letter ends a word, and all spaces of Unicode are trimmed."""
    import duckdb

    from gleanery import plans

    texts = ["Ouréier la", "our_x", "mý", "I٣", "\x0bmy x", "\x0c my x", "Our x　", "we ", "wet", "Are x ​", None]
    rows = [(k, 1 + 2 * k, "user", t) for k, t in enumerate(texts)] + [(99, 2, "user", " x  "), (99, 3, "agent", "my x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.sql(plans.ORACLES["user_profile_lines"]).fetchall())
    assert (0, 1, "Ouréier la") in want
    assert sorted(map(tuple, plans.QUERIES["user_profile_lines"](spark, str(tmp_path)).collect())) == want


def test_word_bounds_are_those_of_sql(spark):
    import duckdb

    texts = ["éLT-300 and mý 2024é", "5 kmé, 7 kg", "againé", "x_LT-300 5 km_", "éDE02 1203 0000 0000 2020 51é"]
    for column, pattern in ((X.quantities, X.QUANTITY), (lambda c: F.regexp_extract_all(c, F.lit(X.bounded(X.IBAN)), F.lit(0)), X.IBAN), (lambda c: F.regexp_extract_all(c, F.lit(X.bounded(X.EXPERIENCE)), F.lit(0)), X.EXPERIENCE)):
        for t in texts:
            assert value(spark, column(F.lit(t))) == duckdb.execute("SELECT regexp_extract_all(?, ?)", [t, pattern]).fetchone()[0]
    assert value(spark, X.entities(F.lit(texts[0]))) == ["2024", "LT300"]


def test_equal_scores_rank_again_as_in_sql(spark, sf, tmp_path):
    """No document has a word of the question: SQL's division gives NaN, an operator's default 0."""
    import duckdb

    from gleanery import plans

    spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.lit("nothing of it")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("search_semantic", "semantic_rerank", "rank_documents", "search_hybrid"):
        df, out = plans.QUERIES[name](spark, str(tmp_path)), con.sql(plans.ORACLES[name])
        want = sorted(repr(r) for r in out.fetchall())
        assert sorted(repr(tuple(r[c] for c in out.columns)) for r in df.collect()) == want and want
    docs = spark.createDataFrame([(1, "a b", 1.0), (2, "a b", 1.0)], "id int, text string, score double")
    assert {r.score for r in ranking.reranked(docs, "zz", "id").collect()} == {0.0}


def test_near_duplicates_in_crowds(spark):
    """Chains, equal keys and a crowd: as a scan in order decides, with few pairs for the crowd."""
    import numpy as np

    rng = np.random.default_rng(2)
    crowd = rng.normal(size=16) + rng.normal(size=(900, 16)) * 0.02
    turn = [[np.cos(0.2 * k), np.sin(0.2 * k), *[0.0] * 14] for k in range(12)]  # each similar to the next alone
    m = np.concatenate([crowd, turn, rng.normal(size=(400, 16)), np.zeros((2, 16))])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    m = m[rng.permutation(len(m))]
    near, kept = m @ m.T >= 0.97, []
    for k in range(len(m)):
        if not near[k, kept].any():
            kept.append(k)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)] + [(5000, None)], "id long, embedding array<double>").repartition(5)
    assert sorted(r.id for r in dedup.near_distinct(df, "id").collect()) == [*kept, 5000]
    tables, bits = dedup.tables_of(len(m), 0.97)
    assert (tables, bits) == (24, 12) and dedup.tables_of(1 << 24, 0.97)[1] == 16
    pairs = dedup.blocked_pairs(df.where("id < 5000").withColumn("kept", F.lit(False)), "id", "embedding", 0.97, tables, bits, False)
    assert 900 <= pairs.count() < 900 * tables < 900 * 899 / 2
    same = dedup.blockers(np.tile(m[0], (3, 1)), np.array([0, 0, 1]), 0, 0.97)
    assert same.tolist() == [-1, -1, 0]  # equal keys do not block each other
