import json

import pytest
from pyspark.sql import functions as F

from gleanery.operators import dedup, layout
from gleanery.sources import readers

SCHEMA = "document string, page int, width double, height double, blocks array<struct<type: string, lines: array<struct<text: string, bbox: array<double>>>>>"


def line(text, y, x=10.0):
    return (text, [x, y, x + 50, y + 5])


def pages(n, head="Running head", document="d"):
    out = []
    for k in range(1, n + 1):
        out.append((document, k, 100.0, 100.0, [("text", [line(head, 1.0)]), ("image", []), ("text", [line(f"Body {'abc'[k % 3]}", 30.0), line("more", 40.0)]), ("text", [line(f"Page {k} of {n}", 95.0)])]))
    return out


def test_running_lines_stay_once(spark):
    df = spark.createDataFrame(pages(4) + pages(2, document="short"), SCHEMA)
    out = {(r.document, r.page): r.text for r in layout.assembled(df).collect()}
    assert out["d", 1] == "Running head\n\nBody b\nmore" and out["d", 2] == "Body c\nmore"
    assert out["short", 2] == "Running head\n\nBody c\nmore\n\nPage 2 of 2"  # of two pages nothing is running
    assert {r.key for r in layout.running_lines(df, page_numbers=False).collect()} == {"running head"}
    kept = {(r.document, r.page): r.text for r in layout.assembled(df, keep_running=True).collect()}
    assert kept["d", 3].startswith("Running head") and kept["d", 3].endswith("Page 3 of 4")


def test_tables_replace_their_lines(spark):
    blocks = [("text", [line("before", 20.0), line("cell a", 30.0), line("cell b", 36.0), line("after", 60.0)]), ("text", [line("end", 80.0)])]
    df = spark.createDataFrame([("d", 1, 100.0, 100.0, blocks), ("d", 2, 100.0, 100.0, [])], SCHEMA)
    tables = spark.createDataFrame([("d", 1, 0, [0.0, 28.0, 100.0, 45.0], "|a|"), ("d", 2, 0, [0.0, 0.0, 9.0, 9.0], "|z|")], "document string, page int, n int, bbox array<double>, markdown string")
    out = {r.page: r.text for r in layout.assembled(df, tables).collect()}
    assert out == {1: "before\n\n|a|\n\nafter\n\nend", 2: "|z|"}


def test_coverage(spark):
    df = spark.createDataFrame(pages(1), SCHEMA)
    images = spark.createDataFrame([("d", 1, [0.0, 0.0, 50.0, 100.0]), ("d", 1, [-20.0, 0.0, 10.0, 10.0])], "document string, page int, bbox array<double>")
    assert abs(layout.coverage(df, images).first().coverage - 0.51) < 1e-9
    assert layout.coverage(df, images.limit(0)).first().coverage == 0.0


def plain_pieces(paragraph, size):
    import re

    if len(paragraph) <= size:
        return [paragraph]
    ready, waiting = [], ""
    for part in (p.strip() for p in re.split(r"(?<=[.!?;])\s+|\n", paragraph)):
        n = 0
        while len(part) - n > size:
            ready.append(part[n : n + size])
            n += size
        part = part[n:]
        if not part:
            continue
        if waiting and len(waiting) + 1 + len(part) > size:
            ready.append(waiting)
            waiting = part
        else:
            waiting = f"{waiting} {part}" if waiting else part
    return ready + [waiting] * bool(waiting)


def test_pieces_and_chunks_against_a_plain_version():
    import random

    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["ab", "c", ". ", "! ", "\n", " ", "longer word", "x" * 45]) for _ in range(rng.randrange(1, 60))).strip()
        size, overlap = rng.choice([20, 40, 80]), rng.choice([0, 15, 60])
        if not text:
            continue
        pieces = readers.short_pieces(text, size)
        assert pieces == plain_pieces(text, size) and (len(text) <= size or max(map(len, pieces)) <= size)
        lengths, made = [len(p) for p in pieces], list(readers.ranges([len(p) for p in pieces], size, 2, overlap))
        assert made[0][0] == 0 and made[-1][1] == len(pieces)
        for (a, b), (c, d) in zip(made, made[1:]):
            assert a <= c <= b < d and sum(lengths[c:b]) <= overlap and (c == a or sum(lengths[c - 1 : b]) > overlap)
            assert sum(lengths[a:b]) + 2 * (b - a) + lengths[b] > size  # nothing more would have fitted


def test_tables_by_row(spark):
    df = spark.range(0, 90, 1, 4).selectExpr("id", "CASE WHEN id % 10 = 0 THEN ' ' ELSE concat('row ', id, '. ', repeat('word ', cast(id % 7 * 20 AS int))) END AS text")
    got = readers.table_chunks(df, ["text"], "t.csv", "csv", 100).collect()
    assert {r.record for r in got} == {k for k in range(90) if k % 10}
    assert all(len(r.text) <= 100 and json.loads(r.attributes)["id"] == r.record for r in got)
    assert max(r.chunk for r in got) > 2


def test_sources(spark, tmp_path):
    for name in ("b.csv", "a.txt", "c.pdf", "x.layout.json"):
        (tmp_path / name).write_text("k\n1\n")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "d.csv").write_text("k\n")
    found = readers.discover(spark, [str(tmp_path), str(tmp_path / "a.txt"), str(tmp_path / "out")], [str(tmp_path / "out")])
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.txt", "b.csv"]
    (tmp_path / "golden.jsonl").write_text('{"id": "q1", "question": "how?", "expected_documents": ["a.pdf"], "type": "fact"}\n')
    assert readers.golden(spark, str(tmp_path / "golden.jsonl")).first().expected_documents == ["a.pdf"]
    files = readers.read_text(spark, str(tmp_path / "*.txt"))
    manifest = spark.createDataFrame([("a.txt", "0" * 64), ("b.csv", "")], "file string, sha256 string")
    assert [r.file for r in readers.drifted(files, manifest).collect()] == ["a.txt"]


def test_store_of_mixed_dimensions(spark, tmp_path):
    rows = spark.createDataFrame([("s", "x", [1.0, 2.0]), ("t", "y", [1.0, 2.0])], "source string, text string, embedding array<double>")
    readers.write_store(rows, str(tmp_path / "a"), "m")
    df, meta = readers.snapshot(spark, str(tmp_path / "a"), "m")
    assert meta == {"model": "m", "dimension": 2, "chunks": 2, "documents": 2} and df.count() == 2
    readers.write_store(rows.withColumn("embedding", F.when(F.col("source") == "s", F.array(F.lit(1.0))).otherwise(F.col("embedding"))), str(tmp_path / "b"), "m")
    with pytest.raises(ValueError):
        readers.open_store(spark, str(tmp_path / "b"), "m")


def test_full_report(spark):
    long = "words that are long enough to stay in the collection of all chunks "
    rows = [(0, long + "a", [1.0, 0.0]), (1, long + "b", [0.99995, 0.01]), (2, long + "A", [1.0, 0.0]), (3, "short", [0.0, 1.0]), (4, long + "c", [0.0, 1.0])]
    r = dedup.full_report(spark.createDataFrame(rows, "id long, text string, embedding array<double>"), "id").first()
    assert (r.input, r.dropped_short, r.dropped_exact, r.dropped_near, r.kept, r.reduction) == (5, 1, 1, 1, 2, 0.6)
