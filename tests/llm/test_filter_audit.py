import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from marginalia.llm import filter_audit as a

SPACE = b" \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, PART int, words string, Mask string, n int"


def masks(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _ in rows:
        text = t or ""
        words = text.encode().split()
        yield "".join(
            letter for letter, bad in (
                ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)),
                ("C", 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)), ("D", any(c in "#$%&*|" for c in text)),
                ("E", i is not None and i > least[text]),
            ) if bad
        )


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    parts = {}
    for (i, _, lang), m in zip(rows, masks(rows), strict=True):
        parts.setdefault(lang or "", []).append((i, m))
    for part, docs in parts.items():
        found, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                removed = [(i, m) for i, m in left if f in m]
                shapley[f] += len(removed)
                left = [d for d in left if f not in d[1]]
                found.append((part, order, step, len(left), len(removed), sum(f in m for _, m in docs) - len(removed), sum(m == f for _, m in docs), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def corpus(seed, n=90):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "GAMMA", "delta#", "x", "ü", "🙂"]) + str(rng.randrange(400))
    texts = [None, "", " ", "a" * 700, "a" * 699 + "b", "A\x0b\x0cB"]
    texts += [" ".join(word() for _ in range(rng.choice([3, 99, 100, 150]))) for _ in range(20)]
    texts += ["same words " * 60, " ".join(f"w{k}" for k in range(120)), "UPPER " + " ".join(f"w{k}" for k in range(120))]
    rows = [(rng.choice([k, k, k, 5, None]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(n)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, n, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "w", "m", 2) for r in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(*x, 7) for x in labels], "doc_id long, quality int, toxic int, good int")


def collected(report):
    return sorted(map(tuple, report.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows, labels = corpus(seed)
    docs, said = frames(spark, rows, labels)
    assert collected(a.audit(docs, said)) == brute(rows, labels)


def test_equal_hashes_of_different_texts(spark):
    """Whatever the hash, texts are compared whole in the end."""
    rows, labels = corpus(3)
    docs, said = frames(spark, rows, labels)
    assert collected(a.audit(docs, said, lambda block: F.lit(0).cast("long") + F.length(block) * 0)) == brute(rows, labels)
    assert collected(a.audit(docs, said, lambda block: F.length(F.regexp_replace(block, "[^a-f]", "")).cast("long"))) == brute(rows, labels)


def test_texts_that_differ_behind_the_first_blocks(spark):
    long = "word " * 40_000
    rows = [(k, long + str(k % 3), "en") for k in range(9)] + [(10, long, "de"), (11, long[:-1], "de")]
    docs, said = frames(spark, rows, [])
    assert collected(a.audit(docs, said)) == brute(rows, [])
    measured = a.with_mask(docs).select(F.size(a.block_hashes(F.col("text"), F.xxhash64)).alias("n"))
    assert {r.n for r in measured.collect()} == {5}  # 64, 512, 4,096, 32,768 and up to 262,144 code points


def test_singletons_leave_at_every_split(spark):
    rows = [(0, "a" * 64 + "b" * 10), (1, "a" * 64 + "c" * 10), (2, "z" * 74), (3, "a" * 64 + "b" * 10), (4, "q" * 73)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    text = F.col("text")
    measured = a.with_mask(docs).select("doc_id", F.length("text").alias("n_chars"), a.block_hashes(text, F.xxhash64).alias("blocks"), F.monotonically_increasing_id().alias("row_no"))
    assert sorted(r.doc_id for r in a.never_alone(measured).collect()) == [0, 3]


def test_a_hot_group(spark):
    rows = [(k, "the same text", "en") for k in range(1000)] + [(2000 + k, f"text {k}", "en") for k in range(50)]
    docs, said = frames(spark, rows, [])
    got = collected(a.audit(docs, said))
    assert got == brute(rows, [])
    assert {r[4] for r in got if r[1][0] == "E" and r[2] == 1} == {999}


def test_empty_table(spark):
    docs, said = frames(spark, [], [])
    assert a.audit(docs, said).collect() == []
