import random
import time

import numpy as np

from gleanery.llm import substring_dedup as d

rng = random.Random(11)
VOCAB = [f"w{k}" for k in range(5000)]
fresh = lambda n: [rng.choice(VOCAB) for _ in range(n)]


def test_chain_is_best_by_brute_force():
    def best(points):
        points = sorted(set(points))
        score = {}
        for x, y in points:
            score[x, y] = d.SEED_WORDS
            for px, py in points:
                if px < x and py < y:
                    gap = d.GAP * ((x - px) + (y - py) - 2 * d.SEED_WORDS) + max(0, d.SEED_WORDS - min(x - px, y - py))
                    score[x, y] = max(score[x, y], score[px, py] + d.SEED_WORDS - gap)
        return max(score.values())

    for _ in range(200):
        points = [(rng.randrange(60) * 3, rng.randrange(60) * 3) for _ in range(rng.randrange(2, 25))]
        points = [p for k, p in enumerate(points) if all(abs(p[0] - q[0]) >= 6 and abs(p[1] - q[1]) >= 6 for q in points[:k])]
        tree_best = 0
        for c in d.chains(points):
            s = d.SEED_WORDS
            for (px, py), (x, y) in zip(c, c[1:]):
                assert px < x and py < y
                s += d.SEED_WORDS - d.GAP * ((x - px) + (y - py) - 2 * d.SEED_WORDS)
            tree_best = max(tree_best, s)
        expected = best(points)
        assert not tree_best or abs(tree_best - expected) < 1e-6 or tree_best < expected  # short chains are left out
        long_enough = d.chains(points)
        if long_enough and tree_best < expected:
            assert expected < d.MIN_CHAIN  # what is better covers too few words


def test_planted_passages(spark):
    rows, spans = [], {}
    passage, hot = fresh(60), fresh(120)
    fuzzy = list(passage)
    for k in (13, 30, 47):
        fuzzy[k] = "edit"
    for k in range(40):
        before, after = fresh(rng.randrange(5, 200)), fresh(rng.randrange(5, 200))
        middle = passage if k == 3 else fuzzy if k == 7 else hot if k >= 10 else []
        rows.append((k, " ".join(before + middle + after)))
        spans[k] = (len(before), len(before) + len(middle))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, " ".join(fresh(30))), (103, ""), (104, None), (None, rows[0][1]), (105, rows[12][1].upper())]
    out = d.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    copies = {(r.doc_id, r.partner_id) for r in out if r.kind == "copy"}
    assert copies == {(100, 0), (101, 0), (None, 0)}
    pairs = {(r.doc_id, r.partner_id) for r in out if r.kind == "passage"}
    assert (3, 7) in pairs and (7, 3) in pairs
    assert {a for a, _ in pairs} == {3, 7, 105, *range(10, 40)}
    assert all((b, a) in pairs for a, b in pairs)
    for r in out:
        if r.kind == "passage" and r.doc_id in spans and r.partner_id in spans:
            low, high = spans[r.doc_id]
            assert abs(r.start - low) <= 2 and abs(r.stop - high) <= 2, r
            assert r.identity >= d.MIN_IDENTITY and (r.doc_id in (3, 7) or r.n_equal >= 119)
    assert len(pairs) <= 6 * 40  # no pairs of all documents of a group


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: d.words_of(r.text.encode()) for r in docs.collect()}
    out = d.repeated(docs).collect()
    linked = {}
    for r in out:
        linked.setdefault(r.doc_id, set()).add(r.partner_id)
        linked.setdefault(r.partner_id, set()).add(r.doc_id)
        if r.kind == "passage":
            equal = set(texts[r.doc_id][r.start : r.stop]) & set(texts[r.partner_id][r.partner_start : r.partner_stop])
            assert equal and r.stop - r.start >= d.MIN_WORDS
    grams = {}
    for k, w in texts.items():
        for i in range(len(w) - d.MIN_WORDS):
            grams.setdefault(tuple(w[i : i + d.MIN_WORDS + 1]), set()).add(k)
    assert {k for g in grams.values() if len(g) > 1 for k in g} <= linked.keys()  # every exact passage of over 50 words


def test_edges(spark):
    same = " ".join(fresh(70))
    rows = [(1, same, "a"), (1, same, "a"), (2, "The " * 4000, "b"), (3, "The " * 4100, "c"), (4, "x", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    out = d.repeated(df).collect()
    assert [(r.doc_id, r.partner_id) for r in out if r.kind == "copy"] == [(1, 1)]
    assert d.repeated(df.limit(0)).count() == 0


def test_passages_of_frequent_lines(spark):
    lines = [fresh(20) for _ in range(12)]
    rows = [(k, fresh(30) + lines[k % 12] + fresh(30)) for k in range(240)]  # each line alone in 20 documents
    core = fresh(42)  # with other words around it in others
    rows += [(k, fresh(60) + core + fresh(60)) for k in (0 - 5, 1000, 1001, 1002, 5000)]
    sides = fresh(8)
    for k in range(4):
        passage = sum(rng.sample(lines, 3), []) if k else sides + core
        rows += [(400 + 10 * k + j, fresh(rng.randrange(20, 90)) + passage + fresh(40)) for j in (0, 1)]
    rng.shuffle(rows)
    out = d.repeated(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")).collect()
    linked = {(r.doc_id, r.partner_id) for r in out}
    assert {(400 + 10 * k, 401 + 10 * k) for k in range(4)} <= linked
    texts, grams = dict(rows), {}
    for k, w in rows:
        for i in range(len(w) - d.MIN_WORDS + 1):
            grams.setdefault(tuple(w[i : i + d.MIN_WORDS]), set()).add(k)
    for gram, of in grams.items():
        if len(of) > 1:
            partners = [{r.partner_id for r in out if r.doc_id == k} | {k} for k in of]
            assert set.intersection(*partners) & of, (of, gram)


def test_repeats_within_documents_and_of_lines(spark):
    line, passage, other = fresh(10), fresh(60), fresh(60)
    rows = [
        (1, fresh(30) + line * 100 + fresh(30)), (2, fresh(50) + line * 100 + fresh(10)), (3, ["the"] * 4000), (4, ["the"] * 4100),
        (5, fresh(20) + passage + fresh(100) + passage + fresh(20)), (6, fresh(10) + other + fresh(70)), (7, other + fresh(70) + other + fresh(5)),
    ]
    out = d.repeated(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")).collect()
    longest = {}
    for r in out:
        longest[r.doc_id, r.partner_id] = max(longest.get((r.doc_id, r.partner_id), 0), r.stop - r.start)
    assert longest[1, 2] >= 1000 and longest[3, 4] >= 4000 and longest[5, 5] >= 60
    found = {(r.doc_id, r.start // 30 * 30) for r in out if {r.doc_id, r.partner_id} <= {5, 6, 7}}
    assert found >= {(5, 0), (5, 180), (6, 0), (7, 0), (7, 120)}
    assert len(out) < 200


def test_fuzzy_passages_of_frequent_lines(spark):
    edited = lambda parts: sum(([*p, *fresh(1)] for p in parts), fresh(1))
    lines = [fresh(20) for _ in range(12)]
    rows = [(k, fresh(30) + lines[k % 12] + fresh(30)) for k in range(480)]  # each line alone in 40 documents
    rows += [(700 + k, fresh(40) + edited(lines[3:7]) + fresh(40)) for k in (0, 1)]
    core = [fresh(15) for _ in range(3)]  # with an edit between them 47 words, too few for a passage
    rows += [(k, fresh(40) + edited(core) + fresh(40)) for k in (*range(-30, 0), *range(1000, 1030))]
    ends = [fresh(5), fresh(5)]
    rows += [(800 + k, fresh(40) + edited([ends[0], *core, ends[1]]) + fresh(40)) for k in (0, 1)]
    crowd = [fresh(18) for _ in range(6)]  # near copies, in which no 41 words in a row are equal
    rows += [(2000 + k, edited(crowd)) for k in range(40)]
    rng.shuffle(rows)
    out = d.repeated(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")).collect()
    linked = {(r.doc_id, r.partner_id) for r in out}
    assert {(700, 701), (701, 700), (800, 801), (801, 800)} <= linked
    assert {a for a, _ in linked} == {700, 701, 800, 801, *range(2000, 2040)}
    assert all((2000, k) in linked for k in range(2001, 2040))  # a class by its first, not all 780 pairs


def test_words_of_a_batch():
    texts = [fresh(n) for n in (0, 3, 6, 9, 15, 16, 40)] + [fresh(4) * 30, ["the"] * 90, fresh(7) * 20 + fresh(5) * 20]
    batch = d.Words([" ".join(t).encode() for t in texts], d.Hashes())
    h, starts, least = batch.minimisers()
    runs = batch.runs(np.arange(len(batch.doc) - 12), 12)
    for k, t in enumerate(texts):
        here = slice(batch.offsets[k], batch.offsets[k] + max(len(t) - d.SEED_WORDS + 1, 0))
        seeds = h[here].tolist()
        assert len({tuple(t[i : i + d.SEED_WORDS]) for i in range(len(seeds))}) == len(set(seeds))
        expected = [min(range(i, min(i + d.WINDOW, len(seeds))), key=seeds.__getitem__) for i in range(max(len(seeds) - d.WINDOW + 1, min(len(seeds), 1)))]
        assert batch.place[least[batch.doc[starts] == k]].tolist() == expected
        at = np.arange(here.start, here.stop)
        rank, before = batch.repeats(h[at], at)
        assert rank.tolist() == [seeds[:i].count(s) for i, s in enumerate(seeds)]
        assert before.tolist() == [max((j for j in range(i - d.MIN_WORDS + 1) if seeds[j] == s), default=-1) for i, s in enumerate(seeds)]
        grams = {}
        for i in range(len(t) - 11):
            grams.setdefault(tuple(t[i : i + 12]), set()).add(int(runs[here.start + i]))
        assert all(len(g) == 1 for g in grams.values()) and len(set.union(set(), *grams.values())) == len(grams)


def test_shuffles_go_when_tables_are_written(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size())} if files.size() else set()

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    passage, before, setting = fresh(60), shuffled(), spark.conf.get(key)
    out = d.repeated(spark.createDataFrame([(k, " ".join(fresh(20) + passage + fresh(20))) for k in range(30)], "doc_id long, text string"))
    left = set()
    for _ in range(50):  # files are deleted in the background
        left = {f for f in shuffled() - before if f.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(key) == setting
    assert {r.partner_id for r in out.collect() if r.doc_id == 29} == {0}


def test_hashes_of_words_of_any_length():
    words = [b"a", b"aa", b"z" * (d.CHUNK - 1), b"z" * d.CHUNK, b"y" * (d.CHUNK + 9), "é".encode(), *(w.encode() for w in VOCAB)]
    text = b"\x0b".join([*words, b"A", *words[::-1], b"\x1cZ", *words[2:5], b"AA"]).replace(b"z", b"Z", 7) + b" \n"
    starts, hashes = d.Hashes().of(text)
    split = d.words_of(text)
    assert [text[s : s + 1].lower() for s in starts.tolist()] == [w[:1] for w in split]
    assert len({*zip(split, hashes.tolist())}) == len({*split}) == len({*hashes.tolist()})
