"""Quality and language classifiers: learning, held-out rows, odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import langid, quality
from ledgerline.llm.common import bounded_sample, held_out, text_chunks, words


def documents(n=400):
    rng = random.Random(9)
    good = ["river", "stone", "light", "under", "green", "walk", "morning", "house", "of", "the"]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(good, k=rng.randint(20, 80))
        bad = i % 4 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 8 else [x for x in w[:6] for _ in range(9)]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_quality_separates_held_out_rows(spark):
    rows, labels = documents()
    odd = [(1000, None), (1001, ""), (1002, "x" * 200_000), (1003, "the"), (None, "river")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "7 AS score", "'a' AS label")
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, quality int")
    model = quality.fit(docs, known)
    got = quality.classify(docs, model, keep=["doc_id"]).withColumn("out", held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict(labels)
    out = [r for r in got if r.out and r.doc_id is not None and r.doc_id < 1000]
    assert len(out) > 50
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    again = {r.doc_id: r.score for r in quality.classify(docs, quality.fit(docs, known), keep=["doc_id"]).collect()}
    assert all(again[r.doc_id] == r.score for r in got if r.doc_id is not None)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, quality.fit(docs, none)).first().score == 0.5
    assert quality.classify(docs.limit(0), quality.fit(docs, none)).collect() == []


def test_dual_coordinate_descent_against_a_dense_version_and_its_conditions():
    rng = np.random.default_rng(3)
    rows = [np.unique(np.append(rng.integers(0, 40, 8), 50 + (i % 2 if i % 17 else 1 - i % 2))) for i in range(200)]
    y = np.array([int(i % 3 == 0) for i in range(200)])
    ratio = quality.log_count_ratio(rows, y, 6, 1.0)
    plain = [np.log((1 + sum(f in r for r, v in zip(rows, y) if v == k)) / (64 + sum(len(r) for r, v in zip(rows, y) if v == k))) for f in range(64) for k in (1, 0)]
    assert np.allclose(ratio, np.array(plain[0::2]) - np.array(plain[1::2]))
    w, b = quality.dual_coordinate_descent(rows, y, ratio, 1.0, 400, 1)
    # the same steps over dense rows with a constant column for the bias
    x = np.zeros((200, 65))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(len(r))
    x[:, 64] = 1
    sign, cap = np.where(y > 0, 1.0, -1.0), np.where(y > 0, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    alpha, order = np.zeros(200), np.random.default_rng(1)
    for _ in range(400):
        was = alpha.copy()
        for i in order.permutation(200):
            gradient = sign[i] * (x[i] @ ((alpha * sign) @ x)) - 1
            alpha[i] = np.clip(alpha[i] - gradient / (x[i] @ x[i]), 0, cap[i])
        if np.abs(alpha - was).max() < 1e-3:
            break
    dense = (alpha * sign) @ x
    assert np.allclose(w, dense[:64] * ratio, atol=1e-8) and np.isclose(b, dense[64])
    # at the optimum: rows beyond the margin have no weight, rows inside it the largest
    slack = sign * (np.array([w[r].sum() / np.sqrt(len(r)) for r in rows]) + b) - 1
    assert (alpha[slack > 0.02] < 1e-6).all() and (alpha[slack < -0.02] > cap[slack < -0.02] - 1e-6).all()
    assert 0 < (alpha > 0).sum() < 200


def test_softmax_step_goes_down_the_gradient():
    rng = np.random.default_rng(5)
    row = np.array([1, 4, 6]), np.array([2, 1, 3])
    emb, out, bias = rng.normal(size=(8, 3)), rng.normal(size=(3, 4)), rng.normal(size=4)

    def loss(emb, out, bias):
        z = (row[1] / row[1].sum()) @ emb[row[0]] @ out + bias
        return np.log(np.exp(z).sum()) - z[2]

    moved = [a.copy() for a in (emb, out, bias)]
    langid.step(*moved, row, 2, 0.5)
    for k, rate in enumerate((0.5 * 3 * 0.2, 0.5, 0.5 * 0.05)):
        for at in np.ndindex(moved[k].shape):
            ends = []
            for e in (1e-6, -1e-6):
                near = [a.copy() for a in (emb, out, bias)]
                near[k][at] += e
                ends.append(loss(*near))
            slope = (ends[0] - ends[1]) / 2e-6
            assert np.isclose(moved[k][at], (emb, out, bias)[k][at] - rate * slope, atol=1e-6)


def test_training_rows_are_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (50 + i)) for i in range(200)] + [(300, "y" * 5000)] + [(7, "x" * 57)] * 3, "label int, text string")
    sizes = lambda most, nbytes: [len(r.text) for r in bounded_sample(docs, 3, most, nbytes, 1000).collect()]
    assert sum(sizes(1000, 3000)) <= 3000 < sum(sizes(1000, 5000)) + 300
    assert len(sizes(20, 1 << 20)) <= 20 and len(sizes(1000, 1 << 20)) == 203
    assert sizes(1000, 3000) and sorted(sizes(1000, 3000)) == sorted(len(r.text) for r in bounded_sample(docs.repartition(5), 3, 1000, 3000, 1000).collect())
    assert bounded_sample(docs.limit(0), 3, 10, 10, 10).count() == 0


def test_repeats_are_features():
    def of(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return set(quality.features(data, np.array([0, len(data)]), 18)[1].tolist())

    assert of("a b a b c") != of("a a b b c")
    assert len(of("a a a a")) == len({"a", "a a"}) + 3


def test_language_names_held_out_rows(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "and", "ing", "tion", "wh"], "de": ["der", "sch", "ung", "ß", "ü"], "es": ["ción", "ñ", "que", "os"]}
    rows = [(i, lang, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))) for i in range(300) for lang in [rng.choice(list(parts))]]
    odd = [(1000, "en", None), (1001, "en", ""), (1002, None, "123 !!"), (1003, None, "the and " * 40_000), (1004, "de", "ß")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, lang string, text string").selectExpr("*", "1 AS lang_pred", "2 AS rejected")
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs), keep=["doc_id"]).collect()}
    assert np.mean([got[i].lang_pred == lang for i, lang, _ in rows]) > 0.97
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert all(got[i].rejected and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "en"
    assert langid.identify(docs.limit(0), langid.fit(docs)).collect() == []
    assert langid.identify(docs, langid.fit(docs.limit(0))).where("lang_pred <> 'und'").collect() == []


def test_subwords_stay_within_their_text():
    texts = ["ab", "", "c", "abc  d1", "é"]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    feats, first = langid.subwords(data, offs, 16)
    for i, r in enumerate(raw):
        own, at = langid.subwords(np.frombuffer(r, np.uint8), np.array([0, len(r)]), 16)
        assert feats[first[i] : first[i + 1]].tolist() == own[at[0] : at[1]].tolist()


def test_words_end_with_their_text():
    import pyarrow as pa

    for _, _, data, offs in text_chunks(pa.array(["a b", None, "", " c", "d"])):
        starts, ends, first = words(data, offs)
        assert first.tolist() == [0, 2, 2, 2, 3, 4]
        assert [bytes(data[s:e]) for s, e in zip(starts, ends)] == [b"a", b"b", b"c", b"d"]


def test_quality_is_fitted_to_all_rows_at_any_size():
    rng = np.random.default_rng(4)
    for n in (200, 3200):
        rows = [np.unique(np.append(rng.integers(0, 40, 6), 50 + (i % 2))) for i in range(n)]
        y, p = np.arange(n) % 2, quality.QualityParams(bits=6, epochs=2)
        model, (w, b) = quality.fit_rows(rows, y, p), quality._fit_once(rows, y, p)
        assert (model.weights == w).all() and model.bias == b
