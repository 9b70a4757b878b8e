import random

import numpy as np

from gleanery.llm import masked_lm, quality_model


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(3)
    truth, counts = [0.95, 0.8, 0.7, 0.6], {}
    for _ in range(20_000):
        bad = rng.random() < 0.3
        pattern = 0
        for a in truth:
            vote = quality_model.NONE if rng.random() < 0.2 else int(bad) if rng.random() < a else 1 - int(bad)
            pattern = pattern * 3 + vote
        counts[(pattern, quality_model.NONE)] = counts.get((pattern, quality_model.NONE), 0) + 1
    model = quality_model.fitted(counts, 4)
    assert abs(model.prior - 0.3) < 0.03
    assert all(abs((g + b) / 2 - a) < 0.05 for (g, b), a in zip(model.accuracy, truth))


def plain_em(votes, golds, n):
    """Posteriors of bad by EM over single documents, without patterns."""
    start = {}
    for v, g in zip(votes, golds):
        if g != quality_model.NONE:
            start.setdefault(v, []).append(g == quality_model.BAD)
    bad = []
    for v in votes:
        up, down = v.count(quality_model.BAD), v.count(quality_model.GOOD)
        majority = min(max((2 * up + 0.1) / (2 * up + down + 1), 0.01), 0.99)
        seen = start.get(v, [])
        bad.append((sum(seen) + 2 * majority) / (len(seen) + 2))
    for _ in range(100):
        table = [[[0.5] * 3 for _ in range(n)] for _ in range(2)]
        for v, b in zip(votes, bad):
            for k, x in enumerate(v):
                table[0][k][x] += 1 - b
                table[1][k][x] += b
        prior = (sum(bad) + 1) / (len(bad) + 2)
        new = []
        for v in votes:
            p = [1 - prior, prior]
            for c in (0, 1):
                for k, x in enumerate(v):
                    p[c] *= table[c][k][x] / sum(table[c][k])
            new.append(p[1] / (p[0] + p[1]))
        moved, bad = max(abs(a - b) for a, b in zip(new, bad)), new
        if moved < 1e-9:
            break
    return bad


def test_posteriors_against_plain_em(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    given = {r.doc_id: r for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    code = lambda x, bad: quality_model.NONE if x is None else quality_model.BAD if x == bad else quality_model.GOOD
    gold = {d: (code(given[d].quality, 0), code(given[d].toxic, 1)) if d in given else (quality_model.NONE,) * 2 for d in texts}
    slim = docs.selectExpr("doc_id", "xxhash64(text) AS h", "text")
    jury = quality_model.jury(slim, quality_model.gold_of(labels))
    out = {r.doc_id: r for r in quality_model.classified(docs, labels).collect()}
    ids = sorted(texts)
    patterns = [jury.votes(quality_model.Facts.of(texts[d].encode())) for d in ids]
    for k, (kinds, column) in enumerate(((quality_model.QUALITY, "quality_posterior"), (quality_model.TOXIC, "toxic_posterior"))):
        want = plain_em([tuple(quality_model.ballots(p[k], len(kinds))) for p in patterns], [gold[d][k] for d in ids], len(kinds))
        got = [1 - out[d].quality_posterior if k == 0 else out[d].toxic_posterior for d in ids]
        assert np.abs(np.array(want) - got).max() < 1e-4


def test_labels_do_not_train_the_scorer(spark, sf):
    """With the same votes and posteriors, a document's own label changes nothing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "xxhash64(text) AS h", "text")
    votes = quality_model.voted(docs, quality_model.Jury())
    models = quality_model.label_models(votes, quality_model.gold_of(spark.read.parquet(f"{sf}/labels.parquet")))
    a = quality_model.scorers(docs, votes, *models)
    b = quality_model.scorers(docs, votes, *models)
    assert all(np.array_equal(x.weights, y.weights) for x, y in zip(a, b))  # no label is passed; the sample is the same again
    assert np.abs(a[0].weights).sum() > 0


def test_cutoffs():
    rng = np.random.default_rng(2)
    bad = rng.random(4000) < 0.2
    x = np.where(bad, rng.normal(3, 1, 4000), rng.normal(0, 1, 4000))
    low, high = quality_model.learned_cutoffs(x, bad, (None, None))
    assert bad[x >= high].mean() >= quality_model.PRECISION and bad[x <= low].mean() <= 0.1 and low < high
    assert quality_model.learned_cutoffs(x, np.zeros(4000, bool), (0.1, 0.2)) == (0.1, 0.2)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = {r.doc_id: r for r in labels.where("doc_id % 4 = 0").collect()}
    out = {r.doc_id: r for r in quality_model.classified(docs, labels.where("doc_id % 4 <> 0")).collect()}
    assert len(out) == docs.count()
    right = [(out[d].quality_score >= 0.5) == (r.quality == 1) for d, r in held.items()]
    assert np.mean(right) > 0.93
    clean = [out[d].kept for d, r in held.items() if r.quality == 1 and not r.toxic]
    assert np.mean(clean) > 0.93


def test_odd_rows(spark):
    rows = [(1, None, "a"), (None, "", "b"), (2, "some plain text", "c"), (2, "some plain text", "c"), (3, "x " * 50_000, "d"), (4, "éß", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for x in (None, labels, labels.limit(0)):
        assert quality_model.classified(df, x).count() == len(rows)
    assert quality_model.classified(df.limit(0), labels).count() == 0
    got = masked_lm.scored(df).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 1, 3, 3, 50_000]
    assert all((r.mean_log_likelihood is None) == (r.n_tokens == 0) for r in got)
    assert masked_lm.scored(df.limit(0)).count() == 0


def test_pseudo_likelihood_knows_order(spark):
    rng = random.Random(5)
    cycle = "one two three four five six seven eight nine ten".split()
    line = lambda n: " ".join((cycle * 30)[k : k + n] if (k := rng.randrange(10)) is not None else [])
    rows = [(k, line(60)) for k in range(1500)]
    plain = [(10_000 + k, line(60)) for k in range(20)]
    mixed = [(20_000 + k, " ".join(rng.sample(t.split(), 60))) for k, (_, t) in enumerate(plain)]
    out = {r.doc_id: r for r in masked_lm.scored(spark.createDataFrame(rows + plain + mixed, "doc_id long, text string")).collect()}
    ordered, shuffled = (np.mean([out[d].mean_log_likelihood for d, _ in x]) for x in (plain, mixed))
    assert ordered > shuffled + 0.5 and ordered > -2.0  # the unigram model has about -2.3


def test_network_gradient():
    net = masked_lm.Network()
    rng = np.random.default_rng(0)
    ctx, cls = rng.integers(0, masked_lm.VOCAB, (4, 64)), rng.integers(0, 4, 64)
    before = net.log_probs(ctx, cls).mean()
    for _ in range(30):
        net.step(ctx, cls)
    assert net.log_probs(ctx, cls).mean() > before + 1


def test_brute_force_score(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat"), (2, "a b c d e f g a b c")] * 5, "doc_id long, text string")
    tokens = masked_lm.tokenised(df)
    counts = masked_lm.token_counts(tokens)
    net = masked_lm.Network(masked_lm.trained(tokens, counts))
    of, within = masked_lm.classes_of(counts)
    assert counts.sum() == 5 * 16
    for r in masked_lm.scored(df).collect():
        t = masked_lm.Tokens().of(dict([(1, b"the cat sat on the mat"), (2, b"a b c d e f g a b c")])[r.doc_id])
        total = 0.0
        for i in range(len(t)):
            h = net.bias.astype(float).copy()
            for k, o in enumerate((-2, -1, 1, 2)):
                h += net.vectors[k][t[i + o] if 0 <= i + o < len(t) else masked_lm.VOCAB]
            z = np.tanh(h) @ net.out + net.out_bias
            total += z[of[t[i]]] - np.log(np.exp(z).sum()) + within[t[i]]
        assert abs(total - r.log_likelihood) < 1e-3


def test_every_token_is_predicted_in_training():
    rng = np.random.default_rng(4)
    for lengths in ([1], [0, 3, 0], [5, 1, 64, 0, 7], []):
        lengths = np.array(lengths, int)
        tokens = rng.integers(0, masked_lm.VOCAB, lengths.sum()).astype(np.int32)
        places = [masked_lm.targets(tokens, lengths, turn) for turn in range(masked_lm.ROUNDS)]
        assert sorted(np.concatenate(places)) == list(range(len(tokens)))
        own = [masked_lm.targets(t, np.array([len(t)]), 0) for t in np.split(tokens, np.cumsum(lengths)[:-1])] if len(lengths) else []
        starts = np.cumsum(lengths) - lengths
        assert sorted(np.concatenate([o + s for o, s in zip(own, starts)] or [[]])) == sorted(places[0])  # a document's places are its own


def test_contexts_stay_within_a_text():
    tokens, lengths = np.array([1, 2, 3, 4, 5, 6], np.int32), np.array([2, 0, 4])
    pad = masked_lm.VOCAB
    got = masked_lm.Network.contexts(tokens, lengths, np.array([0, 1, 2, 5]))
    assert got.T.tolist() == [[pad, pad, 2, pad], [pad, 1, pad, pad], [pad, pad, 4, 5], [4, 5, pad, pad]]


def test_network_step_is_adagrad_on_softmax():
    """Against a plain reckoning in 64 bits, also for logits whose exp leaves the range of floats, and within the processor's cache."""
    rng = np.random.default_rng(4)
    for scale in (1.0, 400.0):
        net = masked_lm.Network()
        net.last[...] *= np.float32(scale)
        flat, seen = net.flat.astype(float), net.seen.astype(float)
        wide = masked_lm.VOCAB + 1
        ctx, cls = rng.integers(0, 40, (4, 700)).astype(np.int32), rng.integers(0, masked_lm.CLASSES, 700)
        vectors, bias, last = flat[: 4 * wide * 24].reshape(4 * wide, 24), flat[4 * wide * 24 :][:24], flat[-25 * 128 :].reshape(25, 128)
        rows = ctx + np.arange(4)[:, None] * wide
        hidden = np.tanh(bias + vectors[rows].sum(0))
        logits = hidden @ last[:24] + last[24]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            want = np.log(p[np.arange(700), cls])
        got = net.log_probs(ctx, cls)
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-4, atol=1e-4 * scale)
        p[np.arange(700), cls] -= 1
        p /= 700**0.5
        back = (p @ last[:24].T) * (1 - hidden * hidden)
        grad = np.zeros_like(flat)
        np.add.at(grad[: 4 * wide * 24].reshape(-1, 24), rows, back[None])
        grad[4 * wide * 24 :][:24], grad[-25 * 128 :] = back.sum(0), np.concatenate([hidden.T @ p, p.sum(0)[None]]).ravel()
        seen += grad * grad
        net.step(ctx, cls)
        moved = masked_lm.RATE * grad / np.sqrt(seen)
        assert np.abs(net.flat - (flat - moved)).max() < 2e-3 * masked_lm.RATE * max(1, scale / 40)


def test_logits_stay_in_the_cache():
    """What is scored at once holds pieces of BATCH rows only."""
    import tracemalloc

    net, n = masked_lm.Network(), 1 << 16
    ctx, cls = np.zeros((4, n), np.int32), np.zeros(n, np.int64)
    tracemalloc.start()
    net.log_probs(ctx, cls)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * masked_lm.CLASSES  # a quarter of all logits
