"""The pipeline against a plain version of each stage's decisions."""

import hashlib
from array import array

import corpus_pipeline
import duckdb
from gleanery.llm import decontamination, pii, quality_sql
from gleanery.llm.queries import tokenizer_path
from tokenizers import Tokenizer

from .test_near_copies import plain_groups
from .test_pii import replaced


def test_run(spark, sf, monkeypatch):
    monkeypatch.setattr(pii, "key_of", lambda spark: "k")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    good = {r[0] for r in con.sql(quality_sql.OP4).fetchall() if r[-1]}
    docs = {d: t for d, t in con.sql("SELECT doc_id, text FROM documents").fetchall() if d in good}
    ids = sorted(docs)
    classes = plain_groups([docs[d] for d in ids])
    kept = [d for k, d in enumerate(ids) if classes[k] == k]  # ids ascend, so the root is the smallest
    fold = lambda t: b" " + b" ".join(decontamination.terms(t.encode())) + b" "
    items = [fold(t) for (t,) in con.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    clean = [d for d in kept if not any(i in fold(docs[d]) for i in items)]
    library = Tokenizer.from_file(tokenizer_path())
    want = {}
    for d in clean:
        got = library.encode(replaced(docs[d]), add_special_tokens=False).ids
        want[d] = (len(got), hashlib.sha256(array("I", got).tobytes()).hexdigest(), hashlib.sha256(library.decode(got, skip_special_tokens=False).encode()).hexdigest())
    out = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert out == want and 0 < len(out) < len(docs)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
