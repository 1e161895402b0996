"""Streaming over append-only JSON logs.

The reference only appends and re-reads its logs; event-time windows are an extension.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.scratch import create_new, listed, read_small

ACTION = (
    "sequence long, time timestamp, run_id string, phase string, action string, status string, "
    "what string, why string, how string, details string"
)


def stream_json(spark: SparkSession, path: str, schema: str = ACTION) -> DataFrame:
    """Log files as they appear below a path."""
    return spark.readStream.schema(schema).json(path)


def sequence_faults(log: DataFrame, patience: str | None = None, expiry: str = "1 day", first: int = 1) -> DataFrame:
    """run_id, sequence, expected, fault where a run's sequence does not continue.

    Without ``patience`` the rows of a trigger are ordered and a number that is not due is a
    gap at once. With it, numbers that come early wait, in the state, for those before them;
    the log needs ``time``. When the watermark, ``patience`` behind the latest time, passes
    a gap's first early number, the gap is reported (fault ``gap``: that number, and the one
    that was due) and the run goes on from there. A number below the one due is ``late`` if
    its gap was given up and ``repeated`` else; gaps that were given up are remembered as
    ranges. A run that is silent for ``expiry`` of event time is forgotten; so state grows
    with live runs and their open gaps alone.
    """
    if patience is None:
        return _faults_by_trigger(log, first)
    wait, forget = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (patience, expiry))

    def follow(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, numbers, times, lost_from, lost_to, seen = state.get if state.exists else (first, [], [], [], [], 0)
        early, lost, out = dict(zip(numbers, times, strict=True)), list(zip(lost_from, lost_to, strict=True)), []
        # Read again after a restart, rows come in another order: one order for all of them.
        rows = sorted((int(n), int(t.timestamp() * 1000)) for f in frames for n, t in zip(f["sequence"], f["time"], strict=True))
        for number, at in rows:
            seen = max(seen, at)
            if number < due or number in early:
                gone = any(low <= number <= high for low, high in lost)
                out.append((key[0], number, due, "late" if gone else "repeated"))
                if gone:
                    lost = [r for low, high in lost for r in ((low, min(high, number - 1)), (max(low, number + 1), high)) if r[0] <= r[1]]
            else:
                early[number] = at
            while due in early:
                early.pop(due)
                due += 1
        now = state.getCurrentWatermarkMs()
        while early and early[min(early)] <= now:
            number = min(early)
            out.append((key[0], number, due, "gap"))
            lost.append((due, number - 1))
            due = number
            while due in early:
                early.pop(due)
                due += 1
        if state.hasTimedOut and not early and seen + forget <= now:
            state.remove()
        else:
            order = sorted(early)
            state.update((due, order, [early[n] for n in order], [r[0] for r in lost], [r[1] for r in lost], seen))
            state.setTimeoutTimestamp(max(now + 1, early[order[0]] if order else seen + forget))
        yield pd.DataFrame(out, columns=["run_id", "sequence", "expected", "fault"])

    return log.select("run_id", "sequence", "time").withWatermark("time", f"{wait} milliseconds").groupBy("run_id").applyInPandasWithState(
        follow, "run_id string, sequence long, expected long, fault string",
        "due long, numbers array<long>, times array<long>, lost_from array<long>, lost_to array<long>, seen long",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def _faults_by_trigger(log: DataFrame, first: int) -> DataFrame:
    def follow(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due = state.get[0] if state.exists else first
        bad = []
        for number in sorted(n for frame in frames for n in frame["sequence"].tolist()):
            if number != due:
                bad.append((key[0], number, due))
            due = number + 1
        state.update((due,))
        yield pd.DataFrame(bad, columns=["run_id", "sequence", "expected"])

    return log.select("run_id", "sequence").groupBy("run_id").applyInPandasWithState(
        follow, "run_id string, sequence long, expected long", "due long", "append", GroupStateTimeout.NoTimeout
    )


def running_metrics(events: DataFrame, kinds: tuple[str, ...], key: str = "run_id", kind: str = "event") -> DataFrame:
    """Counts per key and kind so far; for complete or update mode."""
    return events.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n"))


def heartbeat(events: DataFrame, key: str = "run_id", time: str = "time", value: str = "status") -> DataFrame:
    """The latest value per key; for complete or update mode."""
    return events.groupBy(key).agg(F.max(time).alias(time), F.max_by(value, time).alias(value))


def paired(requests: DataFrame, responses: DataFrame, within: str = "1 hour") -> DataFrame:
    """Requests with their responses by model_run_id: an extension, as a bounded stream join."""
    q = requests.withWatermark("time", within).select("model_run_id", F.col("time").alias("asked"))
    r = responses.withWatermark("time", within).select(F.col("model_run_id").alias("id"), F.col("time").alias("answered"))
    return q.join(r, (F.col("model_run_id") == F.col("id")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {within}"))).drop("id")


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Counts per tumbling window and key with a bound on lateness: an extension."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), key, "n"
    )


#: Folders of key indexes by the key's hash.
KEY_BUCKETS = 256


def append_new(df: DataFrame, path: str, checkpoint: str, key: str, buckets: int = KEY_BUCKETS):
    """Writes rows whose key the target does not hold yet: a restarted run adds nothing twice.

    Every epoch of the stream writes its rows, then its keys in buckets, and is published
    last, under the stream's own id. A batch reads the keys of the buckets that its own keys
    fall into, and of published epochs alone: what a crash left behind is overwritten by the
    same epoch, and never counts before that. A null key is one key.
    """
    path = path.rstrip("/")

    def bucket(c: str):
        return F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(buckets)).cast("int")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = json.loads(read_small(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]
        name, published = f"{run}-{number}", listed(spark, f"{path}/_published")
        if name in published:
            return
        own = batch.dropDuplicates([key]).withColumn("bucket_", bucket(key)).persist()
        try:
            if published:
                touched = [r["bucket_"] for r in own.select("bucket_").distinct().collect()]
                there = spark.createDataFrame([(p,) for p in published], "epoch_ string")
                seen = (
                    spark.read.schema(f"key_ {batch.schema[key].dataType.simpleString()}, bucket_ int, epoch_ string").parquet(f"{path}/_keys")
                    .filter(F.col("bucket_").isin(touched) if touched else F.lit(False)).join(F.broadcast(there), "epoch_", "left_semi")
                )
                fresh = own.join(seen.select("key_"), F.col(key).eqNullSafe(F.col("key_")), "left_anti")
            else:
                fresh = own
            fresh.drop("bucket_").write.mode("overwrite").parquet(f"{path}/epoch={name}")
            written = spark.read.schema(batch.schema).parquet(f"{path}/epoch={name}")
            keys = written.select(F.col(key).alias("key_"), bucket(key).alias("bucket_"), F.lit(name).alias("epoch_"))
            with_epoch = keys.repartition("bucket_").write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
            with_epoch.partitionBy("bucket_", "epoch_").parquet(f"{path}/_keys")
            create_new(spark, f"{path}/_published/{name}", "")
        finally:
            own.unpersist()

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of published epochs, with the epoch's name."""
    there = [(p,) for p in listed(spark, f"{path.rstrip('/')}/_published")]
    rows = spark.read.schema(schema).option("basePath", path).parquet(path) if there else spark.createDataFrame([], schema).withColumn("epoch", F.lit(""))
    return rows.join(F.broadcast(spark.createDataFrame(there, "epoch string")), "epoch", "left_semi")
