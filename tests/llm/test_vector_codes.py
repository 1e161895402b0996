import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import vector_codes as c

SCHEMA = "vec_id long, embedding array<float>, label int, row string, KEY int, code string, v int"


def brute(vectors, parts, entries, rounds, scale=4096):
    """{row number: (code, error)} and the codebooks, by plain Lloyd rounds over Python integers."""
    kept = [k for k, (_, x, _) in enumerate(vectors) if x is not None and all(y is not None and math.isfinite(y) for y in x)]
    out, books = {}, {}
    for size in {len(vectors[k][1]) for k in kept}:
        rows = [k for k in kept if len(vectors[k][1]) == size]
        ints = {k: [math.floor(scale * float(np.float32(y))) for y in vectors[k][1]] + [0] * (-size % parts) for k in rows}
        width = len(ints[rows[0]]) // parts
        cut = {k: [tuple(ints[k][p * width : (p + 1) * width]) for p in range(parts)] for k in rows}
        first = sorted(rows, key=lambda k: (vectors[k][0] is None, vectors[k][0] or 0, ints[k]))[:entries]
        book = [[cut[k][p] for k in first] for p in range(parts)]
        dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        near = lambda: {k: [min((dist(cut[k][p], e), i) for i, e in enumerate(book[p])) for p in range(parts)] for k in rows}  # noqa: B023, E731
        for _ in range(rounds):
            found = near()
            for p in range(parts):
                for i in range(len(book[p])):
                    own = [cut[k][p] for k in rows if found[k][p][1] == i]
                    if own:
                        book[p][i] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
        for k, best in near().items():
            out[k] = (bytes(i for _, i in best), sum(d for d, _ in best))
        books[size] = book
    return out, books


def vectors(seed, n, size, spread=1.0):
    """Clustered vectors with repeats, ties and faults."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(size)] for _ in range(5)]
    rows = []
    for k in range(n):
        x = [y + rng.gauss(0, 0.05) for y in rng.choice(centres)] if rng.random() < 0.8 else [rng.choice([-1.0, 0.0, 1.0]) / 4 for _ in range(size)]
        rows.append((rng.choice([k, k, k, 3, None]), x, rng.choice([0, 1, None])))
    rows += [(900, None, 1), (901, [None] * size, 1), (902, [float("nan")] + [0.0] * (size - 1), 1), (903, [float("inf")] + [0.0] * (size - 1), 1)]
    return rows


def check(spark, rows, **how):
    frame = spark.createDataFrame([(i, x, label, "r", k, "c", 0) for k, (i, x, label) in enumerate(rows)], SCHEMA).repartition(3)
    coded, books = c.compress(frame, **how)
    got = {r["row"]["KEY"]: (bytes(r["code"]), r["error"]) for r in coded.collect()}
    want, want_books = brute(rows, how.get("parts", 8), how.get("entries", 16), how.get("rounds", 6))
    assert got == want
    assert {n: b.tolist() for n, b in books.items()} == {n: [[list(e) for e in p] for p in b] for n, b in want_books.items()}
    return coded


@pytest.mark.parametrize(("seed", "size", "how"), [(1, 16, {}), (2, 8, {"entries": 5, "rounds": 4}), (3, 12, {"parts": 4, "rounds": 9}), (4, 10, {"rounds": 1}), (5, 16, {"rounds": 0})])
def test_equals_plain_rounds(spark, seed, size, how):
    check(spark, vectors(seed, 120, size), **how)


def test_ties_and_equal_entries(spark):
    """Points on a small lattice: most distances tie, and first entries repeat."""
    rng = random.Random(7)
    rows = [(k // 2, [rng.choice([0, 1, 2]) / 4096 for _ in range(16)], 0) for k in range(150)]
    check(spark, rows)


def test_lengths_of_their_own(spark):
    rows = vectors(8, 40, 16) + vectors(9, 30, 8) + [(5, [], 1), (6, [], 1), (7, [0.5], None)]
    check(spark, rows, rounds=3)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))
    entries = x[:16].astype(np.int64)
    code, up, low, _ = c.nearest(x, entries)
    total = 0
    for _ in range(6):
        new = entries.copy()
        for k in range(16):
            if (code == k).any():
                new[k] = x[code == k].sum(0) // (code == k).sum()
        moved, entries = c.ceil_root(((new - entries) ** 2).sum(1)), new
        code, up, low, asked = c.follow(x, entries, moved, code, up, low)
        true = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (code == true.argmin(1)).all()
        assert (up.astype(object) ** 2 >= true.min(1)).all() and (low.astype(object) ** 2 <= true).all()
        total += asked.sum()
    assert total < 0.25 * 6 * x.shape[0] * 16


def test_roots():
    n = np.array([0, 1, 2, 3, 4, 8, 9, 2**52 - 1, 2**52, 2**60 - 1, 2**60, (2**30 - 1) ** 2, (2**30 - 1) ** 2 - 1], dtype=np.int64)
    assert c.floor_root(n).tolist() == [math.isqrt(int(x)) for x in n]
    assert c.ceil_root(n).tolist() == [math.isqrt(int(x)) + (math.isqrt(int(x)) ** 2 < x) for x in n]


def test_empty_and_refused(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = c.compress(none)
    assert coded.collect() == [] and books == {}
    large = spark.createDataFrame([(1, [1e9] * 8)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        c.compress(large)


def test_asked_counts_distances(spark):
    coded = check(spark, vectors(1, 100, 16), rounds=6)
    most = 7 * 8 * 16
    row = coded.agg(F.max("asked").alias("most"), F.avg("asked").alias("mean")).first()
    assert row["most"] <= most and row["mean"] < 0.6 * most
