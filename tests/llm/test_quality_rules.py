import random
import re

import duckdb
import pytest

from gleanery.llm import quality_rules, quality_sql
from gleanery.llm.queries import op4_quality_rules


def brute(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + j for k, x in enumerate(g) if g.count(x) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines), sum("A" <= c <= "Z" for c in text)


def test_measures(monkeypatch):
    rng = random.Random(2)
    for long in (10**9, 3):
        monkeypatch.setattr(quality_rules, "LONG", long)
        for _ in range(300):
            text = "".join(rng.choice(["a ", "b ", "é ", "Ab", "\n", "#", " ", "\t", "\x0b", "\x1c", "|", "aa "]) for _ in range(rng.randrange(60)))
            assert quality_rules.measure(text.encode()) == brute(text)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    got = sorted(map(tuple, op4_quality_rules(spark, f"/root/testdata/{sf}").collect()))
    assert got == sorted(con.sql(quality_sql.OP4).fetchall())


def test_odd_rows(spark):
    clean = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"{clean} {k}", "en", "s", 1) for k in range(150)] + [(200, None, "en", "s", 2), (201, "", None, None, 3), (None, clean, None, "s", 4), (202, "word " * 60_000, "en", "s", 5), (203, clean.replace(" ", "## "), "en", "s", 6), (150, f"{clean} 0", "en", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.kept for r in kept.collect()) == [1] * 150 + [4, 7]
    assert quality_rules.keep_good(df.limit(0)).count() == 0 and quality_rules.rules(df.limit(0)).count() == 0
    failed = {r.doc_id for r in quality_rules.rules(df).collect() if r.base_failed}
    assert failed == {200, 201, 202}


def test_junk_in_a_hot_source_is_found(spark):
    clean = [(k, " ".join(f"w{(k * 7 + j) % 997}" for j in range(100)), "en", "hot") for k in range(300)]
    junk = [(1000 + k, " ".join(f"w{(k * 5 + j) % 997}$%" for j in range(100)), "en", "hot") for k in range(200)]
    out = quality_rules.rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in out if r.kept} == set(range(300))
