import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import toxicity as t
from marginalia.llm.common import held_out


def test_gradients_against_differences():
    net, rng = t.Network(1), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = np.concatenate([np.zeros((1, 16)), rng.standard_normal((9, 16))])
    rows = rng.integers(1, 10, (5, t.WINDOW))
    rows[0, 20:], rows[3, :], rows[4, 1:] = 0, 0, 0
    y, w = np.array([0, 1, 1, 0, 1]), rng.random(5) + 0.5
    _, grads, dx = net.gradients(x, rows, y, w)
    for k in ("v", "w", "b", "Wf", "Uf", "cf", "Wb", "Ub", "cb"):
        for _ in range(3):
            i = tuple(rng.integers(0, n) for n in net.p[k].shape)
            old, e = net.p[k][i], 1e-5
            up, down = (net.p[k].__setitem__(i, old + s) or net.gradients(x, rows, y, w)[0] for s in (e, -e))
            net.p[k][i] = old
            assert np.isclose(grads[k][i], (up - down) / 2 / e, rtol=1e-4, atol=1e-9), k
    old = x[3, 5]
    up, down = (x.__setitem__((3, 5), old + s) or net.gradients(x, rows, y, w)[0] for s in (1e-5, -1e-5))
    assert np.isclose(dx[3, 5], (up - down) / 2e-5, rtol=1e-4)


def test_windows_overlap_and_cover():
    for n in range(0, 200):
        doc, start = t.window_starts(np.array([n, 3]))
        own = start[doc == 0]
        seen = {k for s in own for k in range(s, s + t.WINDOW) if k < n}
        assert seen == set(range(n)) and len(own) >= 1
        assert all(b - a == t.STRIDE for a, b in zip(own, own[1:]))


def test_score_does_not_depend_on_company():
    net = t.Network(2)
    texts = ["a b c", "", "word " * 500, "x y"]
    alone = [t.Scorer(net).score([s])[0] for s in texts]
    assert np.allclose(t.Scorer(net).score(texts), alone, atol=1e-5)


def corpus(rng, n):
    syllables = ["ba", "lo", "mi", "ter", "an", "gu", "sel", "or", "ni", "ka"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 250))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(1 + len(words) // 40):
                # Half by a known word, half by a stem inside an unseen one.
                bad = rng.choice(["Zorg!", "blix,"]) if rng.random() < 0.5 else "vexum" + word()
                words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus(random.Random(5), 1500)
    docs = spark.createDataFrame([(i, x, "q", 1) for i, x, _ in rows], "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return rows, docs, t.fit(docs, labels)


def test_held_out_accuracy(fitted):
    rows, docs, net = fitted
    truth = {i: y for i, _, y in rows}
    got = t.score(docs, net).filter(held_out(F.col("doc_id"), t.FOLDS, t.HELD)).collect()
    assert len(got) > 200
    right = [(r.score >= 0.5) == bool(truth[r.doc_id]) for r in got]
    assert sum(right) / len(right) > 0.97


def test_toxic_words_anywhere_in_a_long_text(spark, fitted):
    _, _, net = fitted
    clean = " ".join(["ba", "lomi", "teran", "gusel"] * 2000)
    at = len(clean) // 2
    docs = spark.createDataFrame([(1, clean), (2, clean[:at] + " zorg blix vexumba zorg " + clean[at:])], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in t.score(docs, net).collect()}
    assert scores[1] < 0.5 <= scores[2]


def test_odd_rows(spark, fitted):
    _, _, net = fitted
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "!!!"), (3, "z" * 100_000), (3, "ba lo")], "doc_id long, text string")
    got = t.score(docs, net).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert t.score(docs.limit(0), net).count() == 0
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)]):
        net = t.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert len(t.score(docs, net).collect()) == 5
