"""Batch operators over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_metrics(events: DataFrame, kinds: tuple[str, ...], key: str = "run_id", kind: str = "event") -> DataFrame:
    """Per key, the number of events of each kind, in one pass."""
    return events.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n"))


def latest(snapshots: DataFrame, key: str, time: str) -> DataFrame:
    """The last snapshot per key."""
    rest = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(time)).alias("s")).select(key, "s.*")


def by_file(issues: DataFrame) -> DataFrame:
    return issues.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("kind", "detail"))).alias("issues"))


def kind_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind").agg(F.count("*").alias("n"))


#: Error names that a retry may cure, and those that none does.
TRANSIENT = r"(?i)timeout|connection|ratelimit|overloaded|temporar|unavailable|internalserver"
PERMANENT = r"(?i)authentication|permission|notfound|badrequest|validation|value"


def retryable(column):
    return column.rlike(TRANSIENT) & ~column.rlike(PERMANENT)
