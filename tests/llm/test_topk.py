import math
import os
import random

import numpy as np
import pytest

from marginalia.llm import topk

SF = "/root/testdata/sf0.001"


def brute(rows, every, k):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = [math.floor(256 * float(np.float32(x))) for x in v]
        vectors[i] = min(vectors.get(i, own), own)
    out = set()
    for q, a in vectors.items():
        if q % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors.items() if i != q and len(b) == len(a))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], start=1)}
    return out


def check(spark, rows, every=5, k=5):
    frame = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = topk.top_k(frame, every, k).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, every, k)
    assert len(got) == len({(r.query_id, r.rank) for r in got})


def test_random_vectors_with_ties(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    check(spark, rows)


def test_unusable_rows_and_dimensions(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (10, [3.0, 1.0]),
        (None, [1.0, 1.0]), (11, [0.0, 0.0]), (15, []), (20, []), (10, [2.0, 1.0]), (25, [1.0, 2.0, 3.0]), (12, [-0.001, 100000.0]),
    ]
    check(spark, rows)


def test_query_keeps_all_rows_of_a_repeated_id(spark, tmp_path):
    """The registered query against its SQL, with ids repeated as candidates and as queries."""
    import duckdb

    from marginalia.llm import oracles, queries

    rng = random.Random(9)
    rows = [(i % 90, [rng.gauss(0, 1) for _ in range(6)]) for i in range(240)]
    rows += [(7, [9.0] * 6), (7, [-9.0] * 6), (50, [1.0] * 6), (50, [-1.0] * 6), (8, rows[8][1])]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(path)
    got = sorted(tuple(r) for r in queries.op2_exact_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == sorted(con.execute(oracles.OP2).fetchall())
    assert {7} == {v for q, r, v, _ in got if q == 50 and r <= 2}


def test_empty_and_few(spark):
    check(spark, [])
    check(spark, [(0, [1.0])])
    check(spark, [(0, [1.0]), (5, [2.0])])


@pytest.mark.parametrize("dim", [1, 5, 32])
def test_search_prunes_nothing_that_counts(dim):
    rng = np.random.default_rng(dim)
    rows, asks = rng.integers(-300, 300, (3000, dim)), rng.integers(-300, 300, (40, dim))
    rows[1500:] //= 10
    ids, ask_ids = np.arange(3000), np.arange(40)
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    best = topk.search(ids, rows, ask_ids, asks, np.full(40, topk.LOWEST), turn)
    scores = asks @ rows.T
    for q in range(40):
        wanted = sorted((-s, i) for i, s in enumerate(scores[q].tolist()) if i != q)[:5]
        assert sorted((-s, i) for s, i, own in zip(best.score.tolist(), best.id.tolist(), best.q.tolist(), strict=True) if own == q) == wanted


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_most_pairs_are_never_scored(spark):
    """Lengths in the driver's table hardly differ, so this is the partial sums' work."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    v = np.floor(256 * np.array([r.embedding for r in rows], dtype=np.float64)).astype(np.int64)
    asked = ids % 10 == 0
    turn = np.linalg.svd(v.astype(np.float64), full_matrices=False)[2].T
    best = topk.search(ids, v, ids[asked], v[asked], np.full(asked.sum(), topk.LOWEST), turn)
    assert best.scored < 0.15 * len(ids) * asked.sum()
    scores = v[asked] @ v.T
    for q, own in enumerate(ids[asked]):
        wanted = sorted((-s, i) for i, s in zip(ids.tolist(), scores[q].tolist(), strict=True) if i != own)[:5]
        assert sorted((-s, i) for s, i, k in zip(best.score.tolist(), best.id.tolist(), best.q.tolist(), strict=True) if k == q) == wanted


def test_candidates_that_are_too_short_are_not_read(spark, monkeypatch):
    """A few long vectors answer most queries; rounds of those read the long ones alone."""
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 400)
    monkeypatch.setattr(topk, "ROUND_NUMBERS", 160)
    monkeypatch.setattr(topk, "SEEDS", 30)
    read, enough = [], topk.long_enough
    monkeypatch.setattr(topk, "long_enough", lambda *a: (lambda out: (read.append(out.count()), out)[1])(enough(*a)))
    rng = random.Random(12)
    rows = [(i, [abs(rng.gauss(0, 1)) * (20.0 if i % 50 == 7 else 0.02) for _ in range(4)]) for i in range(1000)]
    check(spark, rows)
    assert len(read) == -(-200 * 4 // 160) and sum(read) < 0.5 * len(read) * 1000


def test_candidates_are_not_copied(spark, monkeypatch):
    """However many rounds there are, candidates are written once and no plan of a round shuffles them."""
    monkeypatch.setattr(topk, "ROUND_NUMBERS", 60)
    written, cut = [], topk.cut
    monkeypatch.setattr(topk, "cut", lambda df, what, *a: (written.append((what, df._jdf.queryExecution().toString())), cut(df, what, *a))[1])
    rng = random.Random(3)
    check(spark, [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)])
    assert [w for w, _ in written].count("candidates") == 1
    rounds = [plan for w, plan in written if w == "best"]
    assert len(rounds) == 6 and not any("Exchange" in plan for plan in rounds)


def test_ties_in_length_are_split_among_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 100)
    monkeypatch.setattr(topk, "ROUND_NUMBERS", 50)
    check(spark, [(i, [1.0, 1.0] if i % 3 else [-1.0, 1.0]) for i in range(300)])
