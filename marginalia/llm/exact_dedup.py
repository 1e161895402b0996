"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of documents is reduced to
one row per digest (partial aggregation first, so a group of copies of any size reaches
the shuffle as one row per task), anti-joined to the index by sort-merge, and what is
new is appended. The index's side of that join needs no shuffle.

A batch has an id, the caller's or a new one. The index's rows name the batch that
brought them, and a batch's own rows never count against it: whoever runs a batch again,
because the job died after the append or halfway through it, gets the decisions of the
first run, and only rows that are not there yet are appended. One batch writes at a time.

Every append adds a file per bucket, so the sort order holds within files only;
``compact`` writes the index anew with one sorted file per bucket.

Defined results: a null text counts as empty; a null doc_id sorts after every number,
and a group without any number is kept under a null keep_id; of rows that repeat both
doc_id and text one stays; an empty table gives an empty result; other columns pass,
whatever their names.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import create_new, cut, delete, fresh_names, listed, own_columns, read_small, scratch_path

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest per row of ``docs``, in the shared folder."""
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")


class Busy(RuntimeError):
    """Another batch is being written to the index."""


class DigestIndex:
    """Digests seen so far and the doc_id that stays for each.

    ``path`` is a folder that driver and executors share; opening it again registers its
    files. ``buckets`` is fixed for the life of an index; the default is the session's
    number of shuffle partitions, so that a batch meets the index in place.

    Below ``path`` lies one folder per generation. Compaction writes the next one, which
    counts only once its job has left its marker.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{path}/buckets={self.buckets}"
        done = [g for g in self._generations() if "_SUCCESS" in listed(spark, self._at(g))]
        self._register(max(done, default=0))

    def _at(self, generation: int) -> str:
        return f"{self.folder}/generation={generation}"

    def _generations(self) -> list[int]:
        return [int(x.partition("=")[2]) for x in listed(self.spark, self.folder) if x.startswith("generation=")]

    def _register(self, generation: int) -> None:
        self.generation = generation
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._at(generation)}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    @contextmanager
    def _writing(self, batch: str):
        """Only one batch writes; one whose driver died may be run again under its own id."""
        lock = f"{self.path}/writer"
        if not create_new(self.spark, lock, batch) and (owner := read_small(self.spark, lock)) != batch:
            raise Busy(f"batch {owner} is being written to {self.path}, or its driver died: run it again, or delete {lock}")
        try:
            yield
        finally:
            delete(self.spark, lock)

    def ingest(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Decide on every row of a batch (``docs`` or its ``digests``) and append its new digests.

        Returns doc_id, digest, keep_id, group_size (rows of the batch with this digest),
        known (another batch brought the digest) and kept.
        """
        batch = batch or uuid.uuid4().hex
        own = docs if "digest" in docs.columns and "text" not in docs.columns else digests(docs)
        seen = cut(own.select("doc_id", "digest", F.monotonically_increasing_id().alias("row_no")), "seen")
        groups = cut(
            seen.groupBy("digest").agg(
                F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row_no")).alias("first"),
                F.count("*").alias("group_size"),
            ),
            "groups",
        )
        with self._writing(batch):
            # What an earlier run of this batch has appended is there already.
            missing = groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
            (
                missing.select("digest", F.col("first.doc_id").alias("keep_id"), F.lit(batch).alias("batch"))
                .repartition(self.buckets, "digest").sortWithinPartitions("digest")
                .write.insertInto(self.name)
            )
            decided = cut(
                groups.hint("merge").join(self.rows(), "digest").select(
                    "digest", "keep_id", "group_size", (F.col("batch") != batch).alias("known"),
                    F.col("first.row_no").alias("keep_row"),
                ),
                "decided",
            )
        return seen.join(decided, "digest").select(
            "doc_id", "digest", "keep_id", "group_size", "known",
            (~F.col("known") & (F.col("row_no") == F.col("keep_row"))).alias("kept"),
        )

    def compact(self) -> None:
        """Write the index anew, one sorted file per bucket."""
        with self._writing("compaction"):
            before, after = self._at(self.generation), self.generation + 1
            for stale in [g for g in self._generations() if g != self.generation]:
                delete(self.spark, self._at(stale))
            spare = f"{self.name}_{uuid.uuid4().hex}"
            rows = self.spark.read.schema(self.rows().schema).parquet(before)  # as files: the table claims to be sorted out already
            (
                rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
                .write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self._at(after)).saveAsTable(spare)
            )
            self.spark.sql(f"DROP TABLE {spare}")
            self._register(after)
            delete(self.spark, before)

    def drop(self) -> None:
        """Forget the index and its files; decisions made before stay readable."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index of its own under the shared folder."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", scratch_path(spark, "index"))


def decide_in_order(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept over all of ``docs``, taken in as two batches.

    The lower half of the doc_ids goes first. So what the index holds when the upper half
    (with the rows without a number) meets it has a smaller doc_id, and stays.
    """
    own = digests(docs)
    middle = own.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    lower = F.coalesce(F.col("doc_id") <= middle, F.lit(False)) if middle is not None else F.lit(False)
    halves = [
        cut(index.ingest(own.filter(part), name), "half") for name, part in (("lower", lower), ("upper", ~lower))
    ]
    both = halves[0].unionByName(halves[1])
    # Written, so that the join below has two plain sides and a hot digest can be split.
    sizes = cut(
        halves[0].select("digest", "group_size").distinct().unionByName(halves[1].select("digest", "group_size").distinct())
        .groupBy("digest").agg(F.sum("group_size").alias("group_size")),
        "sizes",
    )
    return both.drop("group_size").join(sizes, "digest").select("doc_id", "digest", "keep_id", "group_size", "kept")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row stays if no other batch brought its digest and no equal text has a smaller
    doc_id. Texts are shuffled once, and copies of a hot group can be split anywhere.
    """
    own, keep, n = fresh_names(docs, "digest_", "keep_", "n_")
    decided = index.ingest(docs.select("doc_id", "text"), batch)
    first = cut(
        decided.filter(~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy(F.col("digest").alias(own), F.col("keep_id").alias(keep)).agg(F.count("*").alias(n)),
        "stay",
    )
    stay = docs.withColumn(own, digest(F.col("text"))).join(first, own).filter(F.col("doc_id").eqNullSafe(F.col(keep)))
    repeats = stay.filter(F.col(n) > 1).dropDuplicates([own])
    return stay.filter(F.col(n) == 1).unionByName(repeats).select(*own_columns(docs))
