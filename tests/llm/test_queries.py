"""The registered queries over the small driver tables, against brute force and SQL."""

import os

import duckdb
import pytest

from marginalia.llm import oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def canon(rows):
    return sorted(repr(tuple(float(v) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    wanted = con.execute(oracles.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    assert canon(map(tuple, got.select(*columns).toPandas().itertuples(index=False))) == canon(map(tuple, wanted[columns].itertuples(index=False)))


@pytest.mark.parametrize("name", ["op1_toxicity", "op7_quality_classifier"])
def test_classifiers_return_one_row_per_document(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_the_operators_and_the_pipeline(spark):
    import corpus_pipeline

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame, seen = docs, set(docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame
        frame = stage(spark, frame, SF)
        assert set(frame.columns) == seen, name
        assert {r.doc_id for r in frame.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in frame.select("doc_id").collect()}


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "same text", "en", "s", 9), (3, "same text", "en", "s", 9), (None, "words " * 5000, "en", "s", 30000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, own in (("some", rows), ("none", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(own, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)][: len(own)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        # Null and empty texts are equal, so document 1 stands for both; the long text has two pieces.
        assert sorted(((r.doc_id, r.piece) for r in out), key=repr) == ([(1, 0), (3, 0), (None, 0), (None, 1)] if own else [])
        assert len({r.sequence_id for r in out}) == (2 if own else 0)
