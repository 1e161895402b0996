"""The trigram index: the same rows as the query over all notes, few texts read, batches that may run again."""

import os
import random

import pytest

from marginalia.operators import fulltext
from marginalia.operators.trigrams import TrigramIndex

SCHEMA = "path string, text string"


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["harbour", "Harbor", "STRASSE", "straße", "tide", "ti", "a", "lamp-post", "it's", "日本", "🙂", "cat", "concat"]
    return [(f"{rng.choice(['cases', 'people'])}/n{k}.md", " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8])))) for k in range(n)]


def same(spark, index, rows, query, limit=7):
    got, read = index.search_counted(query, limit)
    want = fulltext.search(spark.createDataFrame(rows, SCHEMA), query, limit, fold=index.fold)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()], query
    return read


@pytest.mark.parametrize("fold", ["casefold", "lower"])
def test_same_rows_as_without_an_index(spark, tmp_path, fold):
    rows = corpus(1)
    index = TrigramIndex(spark, str(tmp_path / "i"), fold)
    assert index.add("one", spark.createDataFrame(rows[:50], SCHEMA).repartition(2))
    assert index.add("two", spark.createDataFrame(rows[50:], SCHEMA).repartition(3))
    hits = {q: same(spark, index, rows, q) for q in ["tide", "cat tide", "STRASSE", "strasse harbour", "a", "ti it's", "日本 cat", "lamp-post harbour", "nothing", "cat a"]}
    assert hits["nothing"] == 0 and 0 < hits["lamp-post harbour"] < len(rows) / 2
    with pytest.raises(ValueError):
        index.search("")
    with pytest.raises(ValueError):
        index.search("x", 0)


def test_full_folding(spark):
    notes = spark.createDataFrame([("a.md", "Die Straße")], SCHEMA)
    assert fulltext.search(notes, "STRASSE").count() == 1 and fulltext.search(notes, "STRASSE", fold="lower").count() == 0


def test_batches_that_run_again(spark, tmp_path):
    rows = corpus(2, 40)
    index = TrigramIndex(spark, str(tmp_path / "i"))
    first = spark.createDataFrame(rows[:20], SCHEMA)
    assert index.add("one", first) and not index.add("one", spark.createDataFrame([("x.md", "tide")], SCHEMA))
    # A driver that was lost before it published: the files are there, the batch is not.
    index.add("two", spark.createDataFrame(rows[20:30], SCHEMA))
    os.remove(tmp_path / "i" / "published" / "two")
    assert TrigramIndex(spark, str(tmp_path / "i")).batches() == ["one"]
    same(spark, index, rows[:20], "tide")
    assert index.add("two", spark.createDataFrame(rows[20:], SCHEMA)) and index.batches() == ["one", "two"]
    same(spark, index, rows, "tide")


def test_a_path_that_comes_again_replaces_the_note(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "i"))
    index.add("one", spark.createDataFrame([("a.md", "the old harbour"), ("b.md", "the old harbour")], SCHEMA))
    index.add("two", spark.createDataFrame([("a.md", "a new lamp"), ("c.md", None)], SCHEMA))
    assert [r.path for r in index.search("old harbour").collect()] == ["b.md"]
    assert [r.path for r in index.search("lamp").collect()] == ["a.md"]


def test_an_empty_index(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "i"))
    assert index.search("tide").count() == 0
    index.add("none", spark.createDataFrame([], SCHEMA))
    assert index.search("tide a").count() == 0


def test_only_the_buckets_of_a_query_are_opened(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "i"))
    index.add("one", spark.createDataFrame(corpus(3), SCHEMA))
    plan = index._lists([0, 1, 2])._jdf.queryExecution().executedPlan().toString()
    buckets = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in buckets and buckets.count(",") < 4 and "PushedFilters: [In(trigram" in plan
