import random
from collections import defaultdict

import numpy as np
import pytest

from marginalia.llm import jaccard_join as j
from marginalia.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    named = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted(((i, len(sets[k]), named[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 40))
    license_ = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.choice([3, 5, 8, 40, 90]))] for _ in range(12)]
    rows = [(1000 + k, " ".join(b)) for k, b in enumerate(bases)]
    for k in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = word()
        if rng.random() < 0.3:
            own += license_
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(own).upper() if rng.random() < 0.2 else " ".join(own)))
    return rows


ODD = [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "One"), (5005, "a b c d e"), (5006, "a b c d e f"), (None, "a b c d e"), (None, "lonely words"), (5003, "one"), (5007, "ein nbsp\xa0wort"), (5008, "ein nbsp wort")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + (ODD if seed == 1 else [])
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, size int, cls string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.join(frame).collect()), key=repr)
    assert got == brute(rows)


def test_heavy_shingles_and_a_large_near_group(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 500)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2])):
            own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.join(frame).collect()), key=repr)
    assert got == brute(rows)


def test_keep_first_keeps_one_of_each_component(spark):
    rows = corpus(5, 60) + ODD
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, size int, cls string")
    out = j.keep_first(frame)
    assert out.schema.names == frame.schema.names
    kept = [r.doc_id for r in out.collect()]
    least = {c for _, _, c in brute(rows)}
    assert {i for i in kept if i is not None} == {c for c in least if c is not None}
    assert len([i for i in kept if i is not None]) == len(set(kept) - {None})


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert j.join(frame).count() == 0 and j.keep_first(frame).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = random.Random(6)
    for _ in range(400):
        n = rng.randint(1, 300)
        a = {rng.randrange(2**63) for _ in range(n)}
        b = set(rng.sample(sorted(a), rng.randint(0, n))) | {rng.randrange(2**63) for _ in range(rng.randint(0, 1 + n // 5))}
        if not b:
            continue
        x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
        linked = 100 * len(a & b) >= 80 * len(a | b)
        assert j.may_link(j.parity_bits(x), j.parity_bits(y), len(a), len(b)) or not linked


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_names_that_the_operator_might_use(spark):
    names = ["__n", "__id", "__key", "__h", "id_", "KEY_", "n_", "h_", "cls", "size"]
    frame = spark.createDataFrame([(k, "one two three four five six", *range(10)) for k in (2, 1, 1)], ["doc_id", "text", *names])
    out = j.keep_first(frame)
    assert out.columns == frame.columns and [tuple(r) for r in out.collect()] == [(1, "one two three four five six", *range(10))]


def test_parts_of_large_sets_stay_small(spark, monkeypatch):
    """Sets on both sides of a change in the number of fragments are counted in the same ones."""
    monkeypatch.setattr(j, "LARGEST_PART", 8)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(70)]
    rows = [(k, " ".join(base[: 70 - k])) for k in range(0, 20, 2)] + [(100 + k, " ".join(base[: 30 + k])) for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.join(frame).collect()), key=repr)
    assert got == brute(rows)
    assert {j.fragments_of(n) for n in (32, 33, 64, 65)} == {4, 8, 16}


def test_shingles_that_counting_missed_become_heavy(spark, monkeypatch):
    """No list of a shingle that is not heavy is long, even if lossy counting saw none."""
    monkeypatch.setattr(j, "LEAST", 10**9)
    rng = random.Random(11)
    shared = [f"s{k}" for k in range(40)]
    rows = [(k, " ".join(shared[: rng.choice([20, 30, 40])] + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([0, 2, 4, 12]))])) for k in range(160)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    orders, places = [], j.places
    monkeypatch.setattr(j, "places", lambda *a: (orders.append(places(*a)), orders[-1])[1])
    posts, lists = j.settled_order(frame, j.profile(frame), len(rows))
    heavy, place = orders[-1]
    assert len(orders) > 1 and len(orders[0][0]) == 0 and sorted(place.tolist()) == list(range(len(heavy)))
    long = {r.shingle for r in lists.filter(j.F.col("n") > j.MISSED * j.heavy_at(len(rows))).collect()}
    assert long <= set(heavy.view(np.int64).tolist())
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.join(frame).collect()), key=repr)
    assert got == brute(rows)


def test_unlinked_texts_with_shared_boilerplate_give_no_pairs(spark, monkeypatch):
    """Four fifths of each text are the same; none links, and none looks for another one."""
    monkeypatch.setattr(j, "LEAST", 10**9)
    rng = random.Random(12)
    rows = [(k, " ".join([f"s{i}" for i in range(84)] + [f"x{rng.randrange(10**9)}" for _ in range(20)])) for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    posts, _ = j.settled_order(frame, j.profile(frame), len(rows))
    none = spark.createDataFrame([], "node long, label long")
    assert posts.groupBy("shingle").count().agg({"count": "max"}).first()[0] == len(rows)
    pairs = j.cross_pairs(posts, none, posts.count())
    assert pairs.count() == 0 and posts.filter(j.reach("at") >= j.F.shiftright("at", 32)).count() == 0
    assert {r.component_id for r in j.join(frame).collect()} == set(range(120))


@pytest.mark.parametrize("square", [1, 7])
def test_squares_of_a_long_list_lose_nothing(spark, monkeypatch, square):
    monkeypatch.setattr(j, "SQUARE", square)
    rows = corpus(13, 60)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.join(frame).collect()), key=repr)
    assert got == brute(rows)
    # Without labels every pair within the bounds comes out, whatever the squares.
    posts, _ = j.settled_order(frame, j.profile(frame), len(rows))
    pairs = j.cross_pairs(posts, spark.createDataFrame([], "node long, label long"), posts.count())
    sets = defaultdict(list)
    for r in posts.collect():
        sets[r.shingle].append((r.cls, r.at >> 32, (r.at >> 32) - (r.at & 0xFFFFFFFF)))
    want = {
        (min(a, b), max(a, b)) for own in sets.values() for a, m, left in own for b, n, other in own
        if a < b and 100 * min(m, n) >= 80 * max(m, n) and min(left, other) >= -(-80 * (m + n) // 180)
    }
    assert {tuple(r) for r in pairs.collect()} == want
