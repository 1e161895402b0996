"""Scratch tables go: when an operator ends, when a program ends after its session, and after a killed driver."""

import os
import subprocess
import sys
import time

import pytest

from marginalia import scratch

PROGRAM = """
import os, signal, sys
from marginalia.session import local_session
from marginalia import scratch
from marginalia.llm import jaccard_join
spark = local_session(2, 2, spark__checkpoint__dir={folder!r}, spark__sql__warehouse__dir={folder!r} + "-warehouse")
before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
docs = spark.createDataFrame([(k, "one two three four five six " + str(k % 3)) for k in range(9)], "doc_id long, text string")
out = jaccard_join.join(docs)
assert len(out.collect()) == 9
assert len(os.listdir(scratch.run_folder(spark))) == 2, os.listdir(scratch.run_folder(spark))  # what the result reads
assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
{end}
"""


def program(folder, end):
    return subprocess.run([sys.executable, "-c", PROGRAM.format(folder=folder, end=end)], capture_output=True, text=True, timeout=300)


def test_a_stopped_session_leaves_nothing(tmp_path):
    folder = str(tmp_path / "shared")
    done = program(folder, "spark.stop()")
    assert done.returncode == 0, done.stderr[-2000:]
    for _ in range(100):  # the JVM ends a moment after the program
        if not any(name.startswith(scratch.RUN) for name in os.listdir(folder)):
            break
        time.sleep(0.1)
    # Spark itself leaves an empty folder there for its own checkpoints.
    assert [path for path, folders, files in os.walk(folder) if files] == []
    assert not any(name.startswith(scratch.RUN) for name in os.listdir(folder))


def test_sweep_deletes_folders_of_dead_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    own = scratch.scratch_path(spark, "own")
    spark.range(3).write.parquet(own)
    spark.range(3).write.parquet(str(tmp_path / "marginalia-dead" / "x"))
    spark.range(3).write.parquet(str(tmp_path / "others"))
    assert scratch.sweep(spark, 1) == []
    assert scratch.sweep(spark, 0) == ["marginalia-dead"]
    assert sorted(os.listdir(tmp_path)) == sorted(["others", os.path.basename(os.path.dirname(own))])


def test_temporary_keeps_what_it_is_told(spark):
    with scratch.temporary() as outer:
        with scratch.temporary() as keep:
            a, b = scratch.cut(spark.range(3)), keep(scratch.cut(spark.range(4)))
        assert not os.path.exists(a.cut_path) and b.count() == 4
        c = outer(scratch.cut(spark.range(5)))
    assert not os.path.exists(b.cut_path) and c.count() == 5
    with pytest.raises(ValueError), scratch.temporary():
        d = scratch.cut(spark.range(2))
        raise ValueError
    assert not os.path.exists(d.cut_path)
