"""Queries that must look at every row of their table."""

import inspect
import os

import pytest

from marginalia.plans import catalogue
from marginalia.session import table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_furniture_strip_answers_for_every_document(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id for r in catalogue.QUERIES["furniture_strip_all"](spark, SF).collect()}
    assert got == {r.doc_id for r in docs.collect()}
    assert docs.filter("lang <> 'en'").count() > 0


def test_furniture_of_other_languages_is_stripped(spark):
    docs = spark.createDataFrame([(1, "Ein Satz.\nReleased under CC\nEnde 12345678"), (2, "Nada")], "doc_id long, text string")
    rows = {r.doc_id: r for r in catalogue.stripped(docs).collect()}
    assert (rows[1].license, rows[1].digits, rows[2].license, rows[2].digits) == (True, True, False, False)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_sequences_are_followed_over_every_turn(spark):
    turns = table(spark, SF, "conversations")
    held = {r.conv_id: r["count"] for r in turns.groupBy("conv_id").count().collect()}
    faulty = {r.conv_id for r in catalogue.QUERIES["sequence_gaps_all"](spark, SF).collect()}
    got = {r.conv_id: r.accepted for r in catalogue.QUERIES["running_sequence_all"](spark, SF).collect()}
    assert got.keys() == held.keys() and max(held.values()) > 4
    assert all(got[c] == n for c, n in held.items() if c not in faulty)


def test_sequences_with_invented_gaps(spark, tmp_path):
    rows = [(1, t) for t in (0, 1, 2, 3, 4, 5)] + [(2, t) for t in (0, 1, 3)] + [(3, 1)] + [(4, t) for t in (0, 1, 2, 3, 4, 6, 7)]
    spark.createDataFrame(rows, "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    faults = {tuple(r) for r in catalogue.sequence_gaps_all(spark, str(tmp_path)).collect()}
    assert faults == {(2, 3, 2), (3, 1, 0), (4, 6, 5)}
    accepted = {r.conv_id: r.accepted for r in catalogue.running_sequence_all(spark, str(tmp_path)).collect()}
    assert accepted == {1: 6, 2: 2, 3: 0, 4: 5}


def test_every_query_reads_a_table():
    for name, f in catalogue.QUERIES.items():
        assert "sf" in inspect.getsource(f).split(":\n", 1)[1], name


@pytest.mark.parametrize("most", [0, 10_000])
def test_passages_of_any_length_in_documents(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(catalogue, "MAX_TINY", most)
    texts = [(1, "the quick brown fox jumps over the lazy dog"), (2, "quick\n brown"), (3, "xthe quick brownx"), (4, ""), (5, None), (6, "日本 語 the q")]
    quotes = ["quick", "k", "the quick", "the quick brown", "e quick b", "quick\n brown", "jumps over the lazy", "he quick brown fox jumps over the lazy d", "日本", "日", "not there at all", "", None]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.item_id, r.doc_id) for r in catalogue.hits(spark, str(tmp_path)).collect())
    assert got == sorted((k, i) for k, q in enumerate(quotes) if q for i, t in texts if t and q in t)
