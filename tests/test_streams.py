"""Streams over several triggers, with restarts and crashes."""

import json
import os

import pytest

from marginalia.streaming import logs

SCHEMA = "id long, what string"


def feed(folder, number, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{number:04}.json", "w") as out:
        out.write("\n".join(json.dumps(r) for r in rows))


def stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def test_append_adds_every_key_once(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    feed(source, 1, [{"id": 1, "what": "a"}, {"id": 1, "what": "b"}, {"id": 2, "what": "c"}, {"id": None, "what": "n"}])
    feed(source, 2, [{"id": 2, "what": "late"}, {"id": 3, "what": "d"}, {"id": None, "what": "m"}])
    logs.append_new(stream(spark, source), sink, check, "id").awaitTermination()
    feed(source, 3, [{"id": 3, "what": "again"}, {"id": 4, "what": "e"}])
    logs.append_new(stream(spark, source), sink, check, "id").awaitTermination()
    rows = logs.appended(spark, sink, SCHEMA + ", epoch string")
    assert sorted((r.id for r in rows.collect()), key=str) == [1, 2, 3, 4, None] and rows.select("epoch").distinct().count() == 3
    # Another stream over the same source, without its checkpoint, adds nothing.
    logs.append_new(stream(spark, source), sink, str(tmp_path / "other"), "id").awaitTermination()
    assert logs.appended(spark, sink, SCHEMA + ", epoch string").count() == 5 == spark.read.parquet(sink).count()


def test_a_crash_before_publishing_repeats_nothing(spark, tmp_path, monkeypatch):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    feed(source, 1, [{"id": k, "what": "a"} for k in range(5)])
    feed(source, 2, [{"id": k, "what": "b"} for k in range(3, 9)])
    publish, calls = logs.create_new, []

    def crash(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return publish(*a)

    monkeypatch.setattr(logs, "create_new", crash)
    with pytest.raises(Exception, match="lost"):
        logs.append_new(stream(spark, source), sink, check, "id").awaitTermination()
    assert sorted(r.id for r in logs.appended(spark, sink, SCHEMA + ", epoch string").collect()) == [0, 1, 2, 3, 4]
    # A new stream without the checkpoint does not take the lost epoch's keys for written.
    logs.append_new(stream(spark, source), sink, str(tmp_path / "other"), "id").awaitTermination()
    assert sorted(r.id for r in logs.appended(spark, sink, SCHEMA + ", epoch string").collect()) == list(range(9))
    logs.append_new(stream(spark, source), sink, check, "id").awaitTermination()
    assert sorted(r.id for r in logs.appended(spark, sink, SCHEMA + ", epoch string").collect()) == list(range(9))


def test_a_batch_opens_the_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    feed(source, 1, [{"id": k, "what": "a"} for k in range(300)])
    logs.append_new(stream(spark, source), sink, check, "id", buckets=64).awaitTermination()
    feed(source, 2, [{"id": 7, "what": "b"}, {"id": 1000, "what": "c"}])
    plans, anti = [], type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, other, on=None, how=None: (lambda out: (how == "left_anti" and plans.append(out._jdf.queryExecution().executedPlan().toString()), out)[1])(anti(self, other, on, how)))
    logs.append_new(stream(spark, source), sink, check, "id", buckets=64).awaitTermination()
    monkeypatch.undo()
    assert logs.appended(spark, sink, SCHEMA + ", epoch string").count() == 301
    assert len(plans) == 1 and "PartitionFilters" in plans[0] and "bucket_" in plans[0].split("PartitionFilters")[1].split("]")[0]


LOG = "run_id string, sequence long, time timestamp"


def entry(run, n, minute):
    return {"run_id": run, "sequence": n, "time": f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00Z"}


def faults(spark, folder, sink, check):
    rows = logs.sequence_faults(stream(spark, folder, LOG), patience="10 minutes", expiry="2 hours")
    query = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.run_id, r.sequence, r.expected, r.fault) for r in spark.read.schema("run_id string, sequence long, expected long, fault string").parquet(sink).collect())


def test_rows_out_of_order_over_triggers_and_a_restart(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    feed(source, 1, [entry("a", 1, 0), entry("a", 3, 2), entry("b", 1, 1)])
    assert faults(spark, source, sink, check) == []  # 3 waits for 2
    feed(source, 2, [entry("a", 2, 3), entry("a", 4, 4), entry("b", 2, 4), entry("b", 4, 5)])
    assert faults(spark, source, sink, check) == []  # 2 came; the state survived the restart
    feed(source, 3, [entry("a", 5, 30), entry("a", 5, 30)])
    feed(source, 4, [entry("a", 6, 31)])
    # The watermark passed minute 5 plus the patience: b's 3 is given up; a's 5 came twice.
    assert faults(spark, source, sink, check) == [("a", 5, 6, "repeated"), ("b", 4, 3, "gap")]
    feed(source, 5, [entry("b", 3, 32), entry("b", 5, 33), entry("b", 3, 33)])
    feed(source, 6, [entry("a", 7, 34)])
    got = faults(spark, source, sink, check)
    assert got == [("a", 5, 6, "repeated"), ("b", 3, 5, "late"), ("b", 3, 5, "repeated"), ("b", 4, 3, "gap")]


def test_silent_runs_are_forgotten(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    feed(source, 1, [entry("old", 1, 0), entry("old", 2, 1), entry("new", 1, 1)])
    feed(source, 2, [entry("new", 2, 200)])
    assert faults(spark, source, sink, check) == [] and spark.read.format("statestore").load(check).count() == 1
    feed(source, 3, [entry("old", 1, 205), entry("new", 3, 206)])
    # "old" was silent for more than two hours, so its numbers start anew; "new" was told of in time.
    assert [f for f in faults(spark, source, sink, check) if f[0] == "old"] == []
    state = spark.read.format("statestore").load(check)
    assert state.count() == 2
