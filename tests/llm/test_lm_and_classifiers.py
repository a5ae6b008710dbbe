from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_texts import prose
from pyspark.sql import functions as F

from treecat.llm import interpolated_lm as lm, ordinal_toxicity as tox, pairwise_quality as pq
from treecat.llm.labelled import labelled_texts, order_statistics



def HELD():
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0

FULL_MASS = 1e-9


def tokens(text):
    return [*(text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split(), b"</>"]


def counted(rows):
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            before = b"<>"
            for w in tokens(t):
                uni[w] += 1
                bi[before, w] += 1
                ctx[before] += 1
                before = w
    return uni, bi, ctx


@pytest.fixture
def corpus(odd_rows):
    rng = random.Random(1)
    return [(10 + i, prose(rng, rng.randrange(1, 120))) for i in range(150)] + odd_rows


@pytest.mark.parametrize("most", [0, 10**9])
def test_scores_match_brute_force(spark, docs, corpus, monkeypatch, most):
    monkeypatch.setattr(lm, "BATCH_TOKENS", 2_000)
    kept = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a, **k: kept.setdefault("w", learn(*a, **k)))
    found = lm.interpolated_scores(docs(corpus, extra=True), HELD(), most_listed=most).collect()
    uni, bi, ctx = counted(corpus)
    n, v, weights = sum(uni.values()), len(uni), kept["w"]
    assert len(found) == len(corpus) and {r["train_tokens"] for r in found} == {n}

    def model(text):
        out, before = 0.0, b"<>"
        for w in tokens(text):
            c = ctx[before]
            l2, l1, l0 = weights[int(np.frexp(float(c))[1])]
            out += math.log10(l2 * (bi[before, w] / c if c else 0) + l1 * uni[w] / n + l0 / (v + 1))
            before = w
        return out

    def want(i, t):
        known = sum(w in uni for w in tokens(t))
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        return (i is None, i or 0, i is None or zlib.crc32(str(i).encode()) % 10 == 0, len(tokens(t)), known, round(base, 5), round(model(t), 5))

    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in found)
    assert got == sorted(want(i, t) for i, t in corpus)


def test_model_beats_single_words_on_held_out_text(docs):
    """Text from a chain of words, each with four followers."""
    rng = random.Random(2)
    follow = {i: rng.sample(range(300), 4) for i in range(300)}

    def walk():
        at, out = rng.randrange(300), []
        for _ in range(150):
            at = rng.choice(follow[at])
            out.append(f"w{at}")
        return " ".join(out)

    found = lm.interpolated_scores(docs([(i, walk()) for i in range(200)]), HELD()).collect()
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.5 * sum(r["base_score"] for r in held)


def test_histogram_and_weights():
    rng = np.random.default_rng(1)
    context = rng.integers(1, 1000, 5000)
    pair = np.minimum(rng.integers(1, 50, 5000), context)
    word = pair + rng.integers(0, 100, 5000)
    b, _, _, k, p2, p1 = lm.cells(context, pair, word, 100_000)
    assert k.sum() == 5000 and len(b) < 5000
    assert p2.sum() == pytest.approx(((pair - 1) / np.maximum(context - 1, 1) * (context > 1)).sum())
    assert p1.sum() == pytest.approx(((word - 1) / 99_999).sum())
    w = lm.learn_weights(b, k, p2 / k, p1 / k, 500)
    assert np.allclose(w.sum(axis=1), 1) and (w[1:, 2] > 0).all() and w[0, 0] == 0

    def likelihood(w):
        return (k * np.log(w[b, 0] * p2 / k + w[b, 1] * p1 / k + w[b, 2] / 501)).sum()

    assert likelihood(w) > likelihood(np.full_like(w, 1 / 3))


def test_weights_are_those_of_a_plain_em():
    """EM token by token, without histogram or numpy, on the same held-out counts."""
    rng = random.Random(3)
    n, v, tokens = 5_000, 400, []
    for _ in range(600):
        context = rng.choice([1, 1, 2, 3, 5, 9, 30, 200])
        pair = rng.randint(1, context)
        tokens.append((context, pair, pair + rng.randint(0, 300)))
    weights = {b: [1 / 3] * 3 for b in range(lm.BUCKETS)}
    held = []
    for context, pair, word in tokens:  # its own occurrence deleted from each count
        c = context - 1
        held.append((c.bit_length(), [(pair - 1) / c if c else 0.0, (word - 1) / (n - 1), 1 / (v + 1)]))
    for _ in range(60):
        shares = {b: [1.0, 1.0, 1.0] for b in range(lm.BUCKETS)}
        for b, p in held:
            parts = [w * x for w, x in zip(weights[b], p)]
            for k in range(3):
                shares[b][k] += parts[k] / sum(parts)
        weights = {b: [x / sum(s) for x in s] for b, s in shares.items()}
    b, _, _, k, p2, p1 = lm.cells(*(np.array(x) for x in zip(*tokens)), n)
    found = lm.learn_weights(b, k, p2 / k, p1 / k, v)
    for bucket in {b for b, _ in held} - {0}:
        assert found[bucket] == pytest.approx(weights[bucket], abs=0.01), bucket  # cells of an eighth of a natural logarithm


def test_model_sums_to_one():
    """Over all words after one context, the unknown included."""
    weights = np.full((lm.BUCKETS, 3), [0.5, 0.3, 0.2])
    word, pair = np.array([5, 3, 2, 0]), np.array([4, 1, 0, 0])
    p = lm.probabilities(weights, np.full(4, 5), pair, word, 10, 3)
    assert p.sum() == pytest.approx(1, abs=FULL_MASS)


def test_lm_without_rows_or_training_rows(docs):
    assert lm.interpolated_scores(docs([]), HELD()).count() == 0
    row = lm.interpolated_scores(docs([(None, "a b")]), HELD()).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_byte_planes():
    for kind in (np.uint64, np.uint32):
        x = np.array([1, 2**20, 7, 255], kind)
        assert (lm._numbers(lm._planes(x), kind) == x).all()
    assert len(lm._numbers(lm._planes(np.empty(0, np.uint64)), np.uint64)) == 0


# --- classifiers -----------------------------------------------------------------


def junk(rng, n):
    return " ".join(w + rng.choice(["***", "%%%", "$$$"]) for w in prose(rng, n).split())


@pytest.fixture
def judged(spark, docs, odd_rows):
    """(documents, labels): quality 0 is junk, toxic 1 has an insult; every third document has no label."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(10, 460):
        bad, toxic = rng.random() < 0.25, rng.random() < 0.3
        text = junk(rng, 80) if bad else prose(rng, 80)
        if toxic:
            text += "".join(f" {rng.choice(['Idiot', 'scum', 'moron'])}, {prose(rng, 3)}" for _ in range(rng.randrange(1, 12)))
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    truth = {i: (g, t) for i, g, t in labels}
    known = [x for x in labels if x[0] % 3] + [(10_000, 1, 0), (None, 1, 1), (11, None, None), (12, 0, 1), (12, 1, 0)]
    return docs(rows + odd_rows, extra=True), spark.createDataFrame(known, "doc_id long, quality int, toxic int"), truth


def test_quality_generalises(judged):
    documents, labels, truth = judged
    model = pq.fit_quality(documents, labels)
    found = pq.with_quality(documents, model).collect()
    assert len(found) == documents.count() and all(0 <= r["score"] <= 1 for r in found)
    unseen = [r for r in found if r["doc_id"] in truth and r["doc_id"] % 3 == 0]
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]][0] for r in unseen]) > 0.97
    kept = pq.keep_quality(documents, labels)
    assert kept.columns == documents.columns
    again = pq.fit_quality(documents, labels)
    assert (again.weights == model.weights).all() and again.threshold == model.threshold


def test_quality_ranks_by_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = (x @ [2.0, -1, 0, 0, 0] + 0.3 * rng.normal(size=300) > 0.5).astype(int)
    m = pq.learn_ranking(x, y)
    s = x @ m.weights
    assert (s[y == 1][:, None] > s[y == 0]).mean() > 0.97
    assert abs(int((m.scores(x) < 0.5).sum()) - int((y == 0).sum())) <= 1  # the threshold is the quantile


def test_ranking_fit_against_its_own_definition():
    """At the weights the loss of the drawn pairs, summed one by one, has no slope; the threshold is the label-0 quantile."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 4)) * [1, 5, 0.1, 1]
    x[:, 3] = 2.0  # never varies
    y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=120) > 0.4).astype(int)
    m = pq.learn_ranking(x, y, pairs=5_000, l2=1e-2)
    better, worse = pq.drawn_pairs(np.flatnonzero(y == 1), np.flatnonzero(y == 0), 5_000, 1)
    scale = x.std(axis=0)
    w = np.array([a * s if s > 1e-6 else 0.0 for a, s in zip(m.weights, scale)])
    z = x / np.where(scale > 1e-6, scale, np.inf)

    def loss(w):
        return sum(math.log1p(math.exp(-float((z[a] - z[b]) @ w))) for a, b in zip(better, worse)) / 5_000 + 0.005 * float(w @ w)

    for i in range(4):
        e = np.eye(4)[i] * 1e-4
        assert abs(loss(w + e) - loss(w - e)) / 2e-4 < 1e-5
    ranked = sorted(float(r @ m.weights) for r in x)
    bad = int((y == 0).sum())
    assert m.threshold == pytest.approx((ranked[bad - 1] + ranked[bad]) / 2) and m.weights[3] == 0
    assert m.scores(x)[0] == pytest.approx(1 / (1 + math.exp(m.threshold - float(x[0] @ m.weights))))


def test_ranking_has_no_slope_over_all_pairs(judged, spark, tmp_path):
    """The fit in Spark: no labelled document and no pair is left out."""
    documents, labels, _ = judged
    documents.repartition(5).write.parquet(str(tmp_path / "d"))
    model = pq.fit_quality(spark.read.parquet(str(tmp_path / "d")), labels)
    known = {r[0]: r[1] for r in labels.where("doc_id is not null and quality is not null and doc_id <> 12").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in documents.where("doc_id >= 10").collect() if r["doc_id"] in known)
    x, y = np.stack([pq.text_features(t) for _, t in rows]).astype(float), np.array([known[i] for i, _ in rows])
    scale = x.std(axis=0)
    z, w = x / np.where(scale < 1e-6, np.inf, scale), model.weights * np.where(scale < 1e-6, 0, scale)
    s = z @ w
    wrong = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0]))
    slope = (wrong.sum(axis=0) @ z[y == 0] - wrong.sum(axis=1) @ z[y == 1]) / wrong.size + 1e-3 * w
    assert np.abs(slope).max() < 1e-6
    ranked, bad = np.sort(x @ model.weights), int((y == 0).sum())
    assert model.threshold == pytest.approx((ranked[bad - 1] + ranked[bad]) / 2)
    alone = pq.learn_ranking(x.astype(np.float32), y)
    assert alone.weights == pytest.approx(model.weights, abs=1e-4)


def test_all_labelled_documents_are_learned_from(spark):
    """More than any former cap; with and without a broadcast."""
    rows = spark.range(30_000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    labels = rows.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    for most in (0, 10**6):
        assert labelled_texts(rows, labels, "quality", most_broadcast=most).distinct().count() == 30_000


def test_order_statistics(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3_000), np.full(500, 0.25), [1e12, -1e12]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    ranks = [0, 1, 700, 1750, 1900, 3500, 3501, 9999]
    assert order_statistics(df, "v", ranks, most=20) == order_statistics(df, "v", ranks) == [float(np.sort(values)[min(r, 3501)]) for r in ranks]


def test_gradients_are_summed_by_blocks(judged, monkeypatch):
    documents, labels, _ = judged
    whole = tox.fit_toxicity(documents, labels)
    monkeypatch.setattr(tox, "BLOCK", 4)
    parts = tox.fit_toxicity(documents, labels)
    assert len(whole.weights) > 8 and parts.place == whole.place and parts.weights == pytest.approx(whole.weights, abs=1e-6)


def test_quality_sees_bytes_lines_and_words():
    a, b = pq.text_features("Aa b\nb"), pq.text_features("aA  c\n")
    assert len(a) == pq.N_FEATURES and a[ord("b")] == pytest.approx((2 / 6) ** 0.5) and a[135:].sum() > 0
    assert (a[135:] ** 2).sum() == pytest.approx(1) and (a[135:] != b[135:]).any() and (pq.text_features(None) == 0).all()


def test_quality_keeps_clashing_columns(judged):
    documents, labels, _ = judged
    named = documents.withColumn("__quality", F.lit("mine"))
    kept = pq.keep_quality(named, labels)
    assert kept.columns == named.columns and {r[0] for r in kept.select("__quality").distinct().collect()} == {"mine"}


@pytest.mark.parametrize("quality, want", [(1, 1), (0, 0), (None, 1)])
def test_quality_without_both_labels(spark, docs, quality, want):
    labels = spark.createDataFrame([(1, quality), (2, quality)], "doc_id long, quality int")
    documents = docs([(1, "a"), (2, "b"), (3, None)])
    found = pq.with_quality(documents, pq.fit_quality(documents, labels)).collect()
    assert [int(r["score"] >= 0.5) for r in found] == [want] * 3
    assert pq.with_quality(docs([]), pq.fit_quality(docs([]), labels)).count() == 0


def test_toxicity_generalises(judged):
    documents, labels, truth = judged
    model = tox.fit_toxicity(documents, labels)
    found = tox.with_severity(documents, model).collect()
    assert len(found) == documents.count() and all(0 <= r["expected_severity"] <= tox.GRADES - 1 for r in found)
    unseen = [r for r in found if r["doc_id"] in truth and r["doc_id"] % 3 == 0]
    assert np.mean([r["toxic"] == bool(truth[r["doc_id"]][1]) for r in unseen]) > 0.97
    assert {r["grade"] for r in found} == {0, 1, 2, 3} and (np.diff(model.thresholds) > 0).all()
    clean = tox.drop_toxic(documents, labels)
    assert clean.columns == documents.columns and clean.where("doc_id is null or doc_id < 10").count() == 9
    assert {r["toxic"] for r in clean.select("toxic").collect()} == {"mine"}


def test_ordinal_regression_shares_weights():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, 2000)
    grade = np.clip(x + (rng.random(2000) < 0.1), 0, 3)
    w, theta = tox.learn_ordinal(lambda p: tox.ordinal_loss(p, np.arange(2000), np.zeros(2000, int), x.astype(float), grade), 2000, 1)
    above = 1 / (1 + np.exp(theta[None, :] - w[0] * x[:, None]))
    assert (np.diff(theta) > 0).all() and np.mean(np.round(above.sum(axis=1)) == grade) > 0.85


def plain_ordinal(p, docs, grades):
    """The negative log likelihood, document by document."""
    w, free = p[: -tox.GRADES + 1], p[-tox.GRADES + 1 :]
    theta = [free[0]]
    for x in free[1:]:
        theta.append(theta[-1] + math.exp(x))
    loss = 0.0
    for doc, y in zip(docs, grades):
        score = sum(w[i] * v for i, v in doc)
        below = [0.0, *(1 / (1 + math.exp(score - t)) for t in theta), 1.0]
        loss -= math.log(below[y + 1] - below[y])
    return loss


def test_ordinal_likelihood_and_gradient():
    """Against plain sums and numerical differences, in one part or in several."""
    rng = np.random.default_rng(5)
    docs = [[(int(i), float(rng.normal())) for i in rng.choice(6, rng.integers(0, 4), replace=False)] for _ in range(40)]
    grades = rng.integers(0, tox.GRADES, 40)

    def loss(p, which):
        rows = [n for n, k in enumerate(which) for _ in docs[k]]
        flat = [x for k in which for x in docs[k]]
        return tox.ordinal_loss(p, np.array(rows, int), np.array([i for i, _ in flat], int), np.array([v for _, v in flat]), grades[list(which)])

    p = rng.normal(0, 0.5, 6 + tox.GRADES - 1)
    value, gradient = loss(p, range(40))
    assert value == pytest.approx(plain_ordinal(p, docs, grades))
    for i in range(len(p)):
        e = np.eye(len(p))[i] * 1e-5
        assert gradient[i] == pytest.approx((plain_ordinal(p + e, docs, grades) - plain_ordinal(p - e, docs, grades)) / 2e-5, abs=1e-5)
    parts = [loss(p, range(k, 40, 3)) for k in range(3)]
    assert sum(x for x, _ in parts) == pytest.approx(value) and sum(g for _, g in parts) == pytest.approx(gradient)
    w, theta = tox.learn_ordinal(lambda q: loss(q, range(40)), 40, 6, l2=0.01)
    at_best = np.concatenate([w, [theta[0]], np.log(np.diff(theta))])

    def goal(q):
        return plain_ordinal(q, docs, grades) / 40 + 0.005 * (q[:6] ** 2).sum()

    assert all(goal(at_best) <= goal(at_best + d) + 1e-3 for d in rng.normal(0, 0.1, (200, len(p))))


def test_scores_follow_from_the_model_word_by_word(judged):
    documents, labels, _ = judged
    model = tox.fit_toxicity(documents, labels)
    by_number = {f: model.weights[i] for f, i in model.place.items()}
    for r in tox.with_severity(documents, model).collect():
        counts = Counter()
        for w in tox.words(r["text"]):
            counts.update(tox.word_features(w))
        score = sum(by_number[f] * (1 + math.log(n)) for f, n in counts.items() if f in by_number)
        above = [1 / (1 + math.exp(min(500, t - score))) for t in model.thresholds]
        assert r["expected_severity"] == pytest.approx(sum(above)) and r["toxic"] == (above[0] >= 0.5)
        shares = [a - b for a, b in zip([1, *above], [*above, 0])]
        assert shares[r["grade"]] == pytest.approx(max(shares))


def test_toxicity_without_toxic_labels(spark, docs):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    documents = docs([(1, "a b"), (2, None)])
    assert not any(r["toxic"] for r in tox.with_severity(documents, tox.fit_toxicity(documents, labels)).collect())
    assert tox.drop_toxic(docs([]), labels.limit(0)).count() == 0
