import zlib

from gleanery.llm import sharding

COLUMNS = "doc_id long, text string, size string"


def held(rows, out, shards):
    assert len(rows) == len(out)
    want = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=repr) == want
    by = {}
    for r in out:
        assert 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    return {s: sum(r["size"] for r in rs) for s, rs in by.items()}


def test_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    size = held(rows, sharding.sharded(docs).collect(), 24)
    mean = sum(size.values()) / 24
    most = max(len(t.encode()) + 8 for _, t in rows)
    assert len(size) == 24 and all(abs(s - mean) <= max(0.02 * mean, most) for s in size.values())


def test_hot_group_is_divided_and_small_groups_are_not(spark):
    rows = [(k, "same text " * 20) for k in range(3000)] + [(10_000 + k, f"text {k // 3} " * 20) for k in range(6000)]
    out = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = held(rows, out, 24)
    mean = sum(size.values()) / 24
    assert all(abs(s - mean) <= 0.03 * mean for s in size.values())
    of = {}
    for r in out:
        of.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in of.values()) <= 3  # the hot one, and what shares a range with it


def test_odd_rows(spark):
    rows = [(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, None, None), (3, "x" * 100_000, "c"), (None, "y", "d")] * 3
    df = spark.createDataFrame(rows, COLUMNS)
    held(rows, sharding.sharded(df).collect(), 24)
    assert sharding.sharded(df.limit(0)).count() == 0
    assert sharding.sharded(df).collect() is not None


def test_written_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("source", "shard")
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.doc_id, r.shard) for r in sharding.sharded(docs).collect()}
    assert {(r.doc_id, r._shard) for r in back.collect()} == want
    assert sorted(back.select(*docs.columns).collect()) == sorted(docs.collect())


def test_ids_that_are_strings(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("concat('d', doc_id) AS doc_id", "text")
    out = sharding.sharded(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.collect())
    for shard in range(sharding.SHARDS):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
