"""Numbers accepted in turn through composed summaries, against reading the scope in order."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import automata as A
from marginalia.operators import scoping


def in_turn(rows, first, last):
    out, due = [], {}
    for key, order, number in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        now = due.get(key, first)
        if number == now and (last is None or now <= last):
            out.append((key, order, number))
            due[key] = now + 1
    return out


@pytest.mark.parametrize(("block", "first", "last"), [(1, 1, None), (3, 1, 9), (4, 0, None), (1000, 2, None)])
def test_accepted_rows(spark, block, first, last):
    rng = random.Random(block)
    rows = []
    for key, n in (("a", 150), ("b", 40), ("c", 1), (None, 30)):
        number = 0
        for order in sorted(rng.sample(range(-50, 400), n)):
            number = number + 1 if rng.random() < 0.6 else rng.randrange(0, 12)
            rows.append((key, order, None if rng.random() < 0.1 else number))
    frame = spark.createDataFrame(rows, "run string, at long, n long").repartition(5)
    got = sorted(map(tuple, A.accepted(frame, "run", "at", "n", first, last, block).collect()), key=repr)
    want = in_turn(rows, first, last)
    assert got == sorted(want, key=repr) and want


def test_no_rows(spark):
    none = spark.createDataFrame([], "run string, at long, n long")
    assert A.accepted(none, "run", "at", "n").collect() == []


def test_summaries_compose(spark):
    """What a block leads to, from every number, is what reading it leads to."""
    rng = random.Random(5)
    numbers = [rng.randrange(6) for _ in range(40)]
    frame = spark.createDataFrame([("s", k, 0, [x]) for k, x in enumerate(numbers)], "key string, at int, block_ long, ns array<int>")
    got = {r.x: r.due for r in A.summaries(frame, "key", "at", "ns").collect()}
    for x in set(numbers):
        due = x
        for n in numbers:
            due += n == due
        assert got[x] == due
    assert set(got) == set(numbers)


def test_one_long_scope_in_many_tasks(spark):
    """A single scope of 200,000 rows: no block has more than its share, and the last number is right."""
    rows = spark.range(200_000).select(F.lit("s").alias("run"), F.col("id").alias("at"), F.when(F.col("id") % 3 == 0, F.col("id") / 3 + 1).otherwise(7).cast("long").alias("n"))
    found = A.accepted(rows, "run", "at", "n")
    assert found.agg(F.max("n"), F.count("*")).first() == (66_667, 66_667)
    blocks = A.with_blocks(rows, "at", A.BLOCK).groupBy("block_").count()
    assert blocks.count() == 49 and blocks.agg({"count": "max"}).first()[0] == A.BLOCK


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_entries_of_a_long_document(spark, block):
    rng = random.Random(block)
    pages, due, want = [], 1, []
    for page in range(60):
        lines = []
        for _ in range(rng.randrange(4)):
            n = due if rng.random() < 0.6 else rng.randrange(1, 99)
            lines.append(f"{n}. entry {n} of page {page}")
            if n == due:
                want.append((page, n, f"entry {n} of page {page}"))
                due += 1
            else:
                if want and want[-1][0] == page:
                    want[-1] = (page, want[-1][1], f"{want[-1][2]} {lines[-1]}")
        pages.append(("s", page, "\n".join(lines) if rng.random() < 0.9 or lines else None))
    frame = spark.createDataFrame(pages, "scope string, page long, text string").repartition(4)
    got = sorted((r.page, r.number, r.text) for r in scoping.entries(frame, "scope", block=block).collect())
    assert got == sorted(want) and len(want) > 20
