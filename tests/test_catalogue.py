"""Every query over the small driver tables; those with SQL against DuckDB."""

import hashlib
import math
import os
import re
import unicodedata

import duckdb
import pytest

from marginalia.plans import bound, catalogue, indexed
from marginalia.session import TABLES
from tests.test_staging import findings

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(frame, columns):
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False))


#: Queries over the tables that neither SQL nor a list can answer; their own tests are below.
BRUTE = {"numbered_entries", "privacy_findings"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - BRUTE))
def test_query(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, SF)
    wanted = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(frame.columns) == sorted(wanted.columns)
    assert rows(frame.toPandas(), sorted(wanted.columns)) == rows(wanted, sorted(wanted.columns))


def test_every_bound_query_has_sql():
    assert {n for n, f in catalogue.QUERIES.items() if f.__module__ in (bound.__name__, indexed.__name__)} <= set(catalogue.ORACLES)


def documents(spark):
    return [(r.doc_id, r.source, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_numbered_entries(spark):
    wanted, due = [], {}
    for i, source, text in documents(spark):
        text, starts = re.sub(r"\. ", ".\n1. ", text), []
        for m in re.finditer(r"(?m)^(\d{1,3})\.\s", text):
            if int(m[1]) == due.get(source, 1):
                starts.append(m)
                due[source] = int(m[1]) + 1
        for k, m in enumerate(starts):
            end = starts[k + 1].start() if k + 1 < len(starts) else len(text)
            wanted.append((source, i, int(m[1]), len(" ".join(text[m.end() : end].split()))))
    got = [tuple(r) for r in catalogue.QUERIES["numbered_entries"](spark, SF).select("source", "page", "number", "characters").collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr) and wanted


def test_normalised_texts(spark):
    """Ligatures, widths and quotes have one form whatever the document; plain texts keep all their letters."""
    rows = {r.doc_id: r for r in catalogue.QUERIES["normalised_texts"](spark, SF).collect()}
    texts = documents(spark)
    assert rows.keys() == {i for i, _, _ in texts}
    for i, _, text in texts:
        plain = unicodedata.normalize("NFKC", text)
        if plain.isascii():
            assert rows[i].sha256 == hashlib.sha256(" ".join(plain.lower().split()).encode()).hexdigest(), i
            letters = sum(map(str.isalnum, plain))
            assert rows[i].retention == (1.0 if letters else 0.0)
    assert all(0 <= r.retention <= 1 for r in rows.values())


def test_privacy_findings(spark):
    got = {(r.doc_id, r.finding) for r in catalogue.QUERIES["privacy_findings"](spark, SF).collect()}
    wanted = {(i, finding) for i, _, text in documents(spark) for finding in findings(text)}
    assert got == wanted


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["score", "title", "path", "snippet"]
    assert set(e.oracle_sql()) <= set(e.queries())
