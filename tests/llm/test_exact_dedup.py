import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import Row

from marginalia.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, keep_id string, batch int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


ROWS = [(5, "a  b"), (3, "a\tb"), (3, "a b"), (9, None), (8, ""), (None, "lone"), (7, "long " * 20000), (6, "long\n" * 20000), (1, "a b")] + [
    (100 + i, "hot\x0bcopy") for i in range(300)
]


def test_against_brute_force(spark):
    index = exact_dedup.new_index(spark)
    got = index.ingest(docs(spark, ROWS)).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    assert len(got) == len(ROWS)
    by_digest = {hashlib.sha256(k.encode()).digest(): v for k, v in groups.items()}
    for r in got:
        members = by_digest[bytes(r.digest)]
        known = [m for m in members if m is not None]
        assert r.group_size == len(members) and r.keep_id == (min(known) if known else None)
        assert not r.known
    assert sum(r.kept for r in got) == len(groups)
    index.drop()


def test_batches_meet_the_index(spark):
    index = exact_dedup.new_index(spark)
    index.ingest(docs(spark, [(1, "a"), (2, "b")])).collect()
    got = {r.doc_id: r for r in index.ingest(docs(spark, [(0, "a"), (3, "c"), (4, "c")])).collect()}
    assert (got[0].known, got[0].kept, got[0].keep_id) == (True, False, 1)
    assert (got[3].known, got[3].kept) == (False, True) and not got[4].kept
    assert index.rows().count() == 3
    index.drop()


def test_index_outlives_its_name(spark, tmp_path):
    first = exact_dedup.DigestIndex(spark, "digest_a", str(tmp_path / "i"), buckets=2)
    first.ingest(docs(spark, [(1, "a")])).collect()
    again = exact_dedup.DigestIndex(spark, "digest_b", str(tmp_path / "i"), buckets=2)
    assert again.rows().count() == 1
    assert again.ingest(docs(spark, [(2, "a")])).collect()[0].known


def decisions(frame):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.known, r.kept) for r in frame.collect())


def test_a_batch_run_again_is_decided_alike(spark):
    """The job may die after the append, and before its result was used."""
    index = exact_dedup.new_index(spark)
    index.ingest(docs(spark, [(1, "a"), (2, "b")]), "one").collect()
    rows = docs(spark, [(0, "a"), (3, "c"), (4, "c")])
    first = decisions(index.ingest(rows, "two"))
    assert decisions(index.ingest(rows, "two")) == first == [(0, 1, 1, True, False), (3, 3, 2, False, True), (4, 3, 2, False, False)]
    assert index.rows().count() == 3
    kept = exact_dedup.deduplicate(rows, index, "two")
    assert [r.doc_id for r in kept.collect()] == [3]
    index.drop()


def test_a_half_written_batch_is_completed(spark):
    index = exact_dedup.new_index(spark)
    rows = docs(spark, [(1, "a"), (2, "b"), (3, "c")])
    index.ingest(rows.filter("doc_id = 2"), "one").collect()  # as much as got there before the job died
    got = decisions(index.ingest(rows, "one"))
    assert got == [(i, i, 1, False, True) for i in (1, 2, 3)] and index.rows().count() == 3
    index.drop()


def test_one_writer_at_a_time(spark):
    from marginalia.llm.common import create_new

    index = exact_dedup.new_index(spark)
    assert create_new(spark, f"{index.path}/writer", "other")
    with pytest.raises(exact_dedup.Busy):
        index.ingest(docs(spark, [(1, "a")]), "mine")
    assert index.ingest(docs(spark, [(1, "a")]), "other").count() == 1  # the batch whose driver died
    assert index.ingest(docs(spark, [(1, "a")]), "mine").collect()[0].known
    index.drop()


def test_compaction_keeps_every_row_and_sorts(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, "digest_c", str(tmp_path / "c"), buckets=2)
    for k in range(3):
        index.ingest(docs(spark, [(10 * k + i, f"text {k * 5 + i}") for i in range(10)]), f"b{k}").collect()
    before = sorted(map(tuple, index.rows().collect()))
    index.compact()
    assert sorted(map(tuple, index.rows().collect())) == before and len(before) == 20
    assert len(index.rows().inputFiles()) == 2
    again = exact_dedup.DigestIndex(spark, "digest_d", str(tmp_path / "c"), buckets=2)
    assert sorted(map(tuple, again.rows().collect())) == before
    # A batch that was compacted away is still known as itself.
    assert not any(r.known for r in again.ingest(docs(spark, [(5, "text 5")]), "b0").collect())
    assert again.ingest(docs(spark, [(99, "text 5")]), "new").collect()[0].keep_id == 5
    again.drop()


def test_two_batches_decide_over_all_rows(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide_in_order(docs(spark, ROWS), exact_dedup.new_index(spark)).collect()}
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    wanted = set()
    for members in groups.values():
        keep = min((m for m in members if m is not None), default=None)
        wanted |= {(m, keep, len(members), m == keep) for m in members}
    assert got == wanted
    assert exact_dedup.decide_in_order(docs(spark, []), exact_dedup.new_index(spark)).count() == 0


def test_the_anti_join_decides_in_the_query(spark, monkeypatch):
    """The upper half of the ids meets what the lower half left in the index."""
    taken, ingest = [], exact_dedup.DigestIndex.ingest

    def spy(self, rows, batch=None):
        out = ingest(self, rows, batch)
        taken.append((batch, out.filter("known").count()))
        return out

    monkeypatch.setattr(exact_dedup.DigestIndex, "ingest", spy)
    exact_dedup.decide_in_order(docs(spark, ROWS), exact_dedup.new_index(spark)).collect()
    assert [b for b, _ in taken] == ["lower", "upper"] and taken[0][1] == 0 and taken[1][1] > 100


def test_names_that_the_operator_might_use(spark):
    frame = spark.createDataFrame(
        [(1, "a", 5, b"x", 7, 8), (2, "a", 5, b"x", 7, 8), (1, "a", 5, b"x", 7, 8)], "doc_id long, text string, __n int, __digest binary, N_ int, `digest_` int"
    )
    out = exact_dedup.deduplicate(frame, exact_dedup.new_index(spark))
    assert out.columns == frame.columns and [tuple(r) for r in out.collect()] == [(1, "a", 5, b"x", 7, 8)]


def test_deduplicate_keeps_rows_and_columns(spark):
    frame = docs(spark, [*ROWS, (1, "a b")])
    out = exact_dedup.deduplicate(frame, exact_dedup.new_index(spark))
    assert out.schema == frame.schema
    kept = out.collect()
    assert len(kept) == len({norm(t) for _, t in ROWS})
    assert Row(doc_id=1, text="a b", digest="x", keep_id="y", batch=1) in kept


def test_empty(spark):
    assert exact_dedup.new_index(spark).ingest(docs(spark, [])).count() == 0
    assert exact_dedup.deduplicate(docs(spark, []), exact_dedup.new_index(spark)).count() == 0
