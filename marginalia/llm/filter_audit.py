"""How filters of a corpus interact: what each removes alone, after others, and in vain.

Every document gets a mask of the filters that it fails; per part and mask only counts
remain (at most 32 rows a part), and all orders of the filters follow from those counts:
a document is removed at the first of its filters, is redundant at its later ones, and
its one removal is shared by the orders as 120 / (number of its filters) each.

Four filters look at a document alone. The fifth, exact duplicates, refines a partition:

1. One scan measures every text: masks, length in code points, and one hash for each of
   successive blocks, which grow eightfold (64 code points, 448, 3,584, ...).
2. Rows are split by length, then by one block after the other. After each split the rows
   that are alone go; only the others are looked at again. What is alone is found by
   counts and taken away by row number, so a hot group is never joined or sorted.
3. Texts of rows that were never alone are read again (a bitmap of bounded size tells
   which) and compared whole, as grouping keys, which collapses copies before the shuffle.
   Different texts with equal hashes thereby come apart.

Rows of such a group fail the filter if their doc_id is above the group's least.

Defined results: a null text is empty, and equals others; a null doc_id is never above
another, and has no label; rows that repeat a doc_id are judged one by one, and neither
is above the other; a doc_id with several label rows is good, or toxic, if one of them
says so; a null lang is the part ''; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import cut, hash_bitmap, map_texts, release, temporary

#: Filters of a text alone, in order of their bits; the last letter marks duplicates.
LETTERS = "ABCDE"
DUPLICATE = 1 << LETTERS.index("E")
#: Code points of the first block; the next ones end where eight times as many are seen.
FIRST_BLOCK, GROWTH = 64, 8
_ENDS = [FIRST_BLOCK * GROWTH**k for k in range(9)]
_STARTS = [0, *_ENDS[:-1]]

_WORD = r"[^\x20\x09-\x0D]+"


def with_mask(docs: DataFrame) -> DataFrame:
    """doc_id, part, text, and mask: a bit per failed filter that looks at the text alone."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))
    fails = (
        F.size("words") < 100,
        100 * F.size(F.array_distinct("words")).cast("long") < 80 * F.size("words").cast("long"),
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    )
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", "text", mask.cast("int").alias("mask"))


def block_hashes(text: Column, hashed: Callable[[Column], Column]) -> Column:
    """Hashes of the text's successive blocks, as many as it reaches into."""
    block = lambda start, end: hashed(F.substring(text, start + 1, end - start))
    found = [F.when(F.length(text) > start, block(start, end)) for start, end in zip(_STARTS, _ENDS, strict=True)]
    return F.array_compact(F.array(*found))


def never_alone(rows: DataFrame) -> DataFrame:
    """The rows (row_no, n_chars, blocks, ...) whose length and block hashes another row shares."""
    alive, at = rows, 0
    while True:
        seen = F.slice("blocks", 1, at).alias("seen")
        alone = alive.groupBy("n_chars", seen).agg(F.count("*").alias("n"), F.min("row_no").alias("row_no")).filter("n = 1")
        before, alive = alive, cut(alive.join(alone.select("row_no"), "row_no", "left_anti"), "alike")
        if before is not rows:
            release(before)
        at += 1
        if alive.filter(F.size("blocks") >= at).isEmpty():
            return alive


def repeats(docs: DataFrame, rows: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """doc_id, part, mask of the rows that repeat the text of a smaller doc_id."""
    same = F.xxhash64("n_chars", "blocks").alias("same")
    alive = never_alone(rows).withColumn("same", same)
    held = docs.sparkSession.sparkContext.broadcast(hash_bitmap(alive.select("same").distinct(), alive.count()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(held.value.holds(batch.column(0).to_numpy())))

    texts = with_mask(docs).withColumns({"n_chars": F.length("text"), "blocks": block_hashes(F.col("text"), hashed)})
    again = map_texts(texts.select(same, "doc_id", "text"), run, "same long, doc_id long, text string")
    least = again.groupBy("same", "text").agg(F.min("doc_id").alias("keep"))
    groups = cut(least.groupBy("same").agg(F.count("*").alias("texts"), F.min("keep").alias("keep")), "groups")
    named = alive.filter("doc_id IS NOT NULL")
    one = groups.filter("texts = 1").select("same", F.col("keep").alias("doc_id"))
    found = named.join(one, ["same", "doc_id"], "left_anti")
    several = groups.filter("texts > 1").select("same")
    if not several.isEmpty():
        # Different texts with equal hashes: the text itself names the group.
        true = texts.withColumn("same", same).join(several, "same", "left_semi").join(least, ["same", "text"]).filter("doc_id > keep")
        found = found.join(several, "same", "left_anti").select("doc_id", "part", "mask").unionByName(true.select("doc_id", "part", "mask"))
    return found.select("doc_id", "part", "mask")


def tallies(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic from rows doc_id, part, mask, weight."""
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # Rows of a repeated (or missing) doc_id meet its labels as one row.
    few = rows.groupBy("doc_id", "part", "mask").agg(F.sum("weight").alias("n"))
    count = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return few.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def by_order(counts: DataFrame) -> DataFrame:
    """The report from part, mask, n, good, toxic: a row per part, order and step."""
    bits = [1 << k for k in range(len(LETTERS))]
    orders = list(permutations(bits))
    settings = [
        F.struct(F.lit(sum(before)).alias("before"), F.lit(bit).alias("bit"))
        for bit in bits for r in range(len(bits)) for before in combinations([b for b in bits if b != bit], r)
    ]
    mask, n = F.col("mask"), F.col("n")
    fails = mask.bitwiseAND(F.col("bit")) != 0
    reached = mask.bitwiseAND(F.col("before")) == 0
    total = lambda cond, of: F.sum(F.when(cond, of).otherwise(0)).cast("long")
    share = (F.lit(len(orders)) / F.greatest(F.bit_count(mask), F.lit(1))).cast("long")  # whole: 120 is divisible by 1 to 5
    found = counts.select("part", "mask", "n", "good", "toxic", F.inline(F.array(*settings))).groupBy("part", "before", "bit").agg(
        total(reached & ~fails, n).alias("kept"), total(reached & fails, n).alias("removed"), total(~reached & fails, n).alias("redundant"),
        total(mask == F.col("bit"), n).alias("unique_fails"), total(reached & fails, F.col("good")).alias("good_lost"),
        total(reached & fails, F.col("toxic")).alias("toxic_lost"), total(fails, n * share).alias("shapley"),
    )
    name = dict(zip(bits, LETTERS, strict=True))
    steps = counts.sparkSession.createDataFrame(
        [("".join(map(name.get, o)), k + 1, sum(o[:k]), o[k]) for o in orders for k in range(len(o))],
        "filter_order string, step int, before int, bit int",
    )
    return found.join(F.broadcast(steps), ["before", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The report over ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic).

    ``hashed`` is the hash of a block; any function of it gives the same report.
    """
    text = F.col("text")
    measured = with_mask(docs).select(
        "doc_id", "part", "mask", F.length(text).alias("n_chars"), block_hashes(text, hashed).alias("blocks"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    with temporary() as keep:
        rows = cut(measured, "measured")
        found = cut(repeats(docs, rows, hashed), "repeats")
        moved = F.explode(F.array(
            F.struct("mask", F.lit(-1).alias("weight")), F.struct(F.col("mask").bitwiseOR(DUPLICATE).alias("mask"), F.lit(1).alias("weight"))
        )).alias("to")
        weighted = rows.select("doc_id", "part", "mask", F.lit(1).alias("weight")).unionByName(
            found.select("doc_id", "part", moved).select("doc_id", "part", "to.mask", "to.weight")
        )
        counts = keep(cut(tallies(weighted, labels), "tallies"))
    return by_order(counts)
