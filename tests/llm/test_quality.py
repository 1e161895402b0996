import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import quality as q


def test_features_are_per_line():
    features, chars, n_lines = q.line_features(["Ab 1!\nAb 1!\n", "", "é|é"])
    assert n_lines.tolist() == [3, 1, 1] and chars.tolist() == [5, 5, 0, 0, 3]
    f = {name: features[:, k] for k, name in enumerate(q.FEATURES)}
    assert f["repeated"].tolist() == [0, 1, 0, 0, 0] and f["words"].tolist() == [2, 2, 0, 0, 1]
    assert np.allclose(f["upper"][:2], 0.2) and np.isclose(f["bars"][4], 1 / 3) and np.isclose(f["foreign"][4], 2 / 3)


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(0)
    n_lines = np.array([3, 1, 5, 2])
    unary, tie = rng.normal(size=11), rng.normal(size=(2, 2))
    good, pairs = q.Chains(n_lines).marginals(unary, tie)
    wanted, wanted_pairs, at = [], np.zeros((2, 2)), 0
    for n in n_lines:
        total, mass, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[at + k] for k in range(n) if labels[k]) + sum(tie[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            mass += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                moves[a, b] += w
        wanted += (mass / total).tolist()
        wanted_pairs += moves / total
        at += n
    assert np.allclose(good, wanted) and np.allclose(pairs, wanted_pairs)


def corpus(rng, n):
    rows = []
    for i in range(n):
        good = rng.random() < 0.6
        words = [("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9)))) for _ in range(rng.randint(5, 80))]
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + rng.choice(["$$$", "###"]) for w in words]
        for k in range(0, len(words), 9):
            words[k] += ".\n"
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_held_out_accuracy_and_kept_documents(spark):
    rows = corpus(random.Random(2), 900)
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t, _ in rows], "doc_id long, text string, score string, label double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = q.fit(docs, labels)
    got = q.score(docs, model).withColumn("held", q.held_out(F.col("doc_id"), q.FOLDS, q.HELD)).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held]
    assert len(held) > 200 and all(0 <= r.score <= 1 for r in got)
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.97
    kept = q.keep_good(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score >= 0.5}


def test_held_out_labels_are_never_learnt(spark):
    rows = corpus(random.Random(3), 300)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    chosen = {r.doc_id for r in q.training_labels(labels, "quality", q.FOLDS, q.HELD, 10**6).collect()}
    assert chosen == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % q.FOLDS != q.HELD}
    assert q.training_labels(labels, "quality", q.FOLDS, q.HELD, 50).count() <= 50


def test_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, "\n\n\n"), (4, "x" * 200_000), (None, "plain text here"), (1, None), (5, "line\n" * 5000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    for labels in ([], [(1, 1), (None, 0)], [(1, 1), (1, 0), (2, 0), (5, 1), (4, None)]):
        frame = spark.createDataFrame(labels, "doc_id long, quality int")
        got = q.score(docs, q.fit(docs, frame)).collect()
        assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert q.score(docs.limit(0), q.fit(docs.limit(0), frame)).count() == 0


def test_training_texts_are_bounded(spark):
    """One row per doc_id however often it is repeated, and no more than fits in all."""
    rows = [(1, "again and again")] * 5000 + [(2, "x" * 900), (3, "y" * 50), (4, None), (5, "\n" * 30), (1, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, label int")
    got = q.training_texts(docs, chosen, 10**6).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(1, 1), (2, 0), (3, 1), (4, 0), (5, 1)]
    small = q.training_texts(docs, chosen, 1000).collect()
    size = lambda t: len(t) + q.LINE_SIZE * (t.count("\n") + 1)
    assert 0 < sum(size(r.text) for r in small) <= 1000 and 5 not in {r.doc_id for r in small}
    assert q.training_texts(docs, chosen.limit(0), 1000).count() == 0


def test_keep_good_with_names_that_it_might_use(spark):
    docs = spark.createDataFrame([(1, "A good line.", 7, 8), (2, None, 7, 8)], ["doc_id", "text", "__text", "TEXT_"])
    model = q.LineField([np.zeros(0)] * len(q.FEATURES), 30.0)
    assert sorted(map(tuple, q.keep_good(docs, model).collect())) == [(1, "A good line.", 7, 8), (2, None, 7, 8)]
