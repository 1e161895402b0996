"""Bounded repair rounds: find, repair, find again, until nothing is left or the rounds are.

:func:`repair` looks at all notes in every round. :class:`Repair` looks at all of them
once, and then only at notes that the last round changed and at those whose findings
depend on a changed one. Its state lies in a folder: the notes as they came, what each
round changed, the findings, and which notes depend on which, all in buckets by path, so a
round opens the buckets of the paths that it asks for. A round is there when its report is
published, after everything else of it; a driver that comes after a lost one goes on
behind the last published round.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.profile import sha256_json
from marginalia.scratch import create_new, cut, listed, read_small, temporary

BUCKETS = 64


def repair(notes: DataFrame, find: Callable[[DataFrame], DataFrame], fix: Callable[[DataFrame, DataFrame], DataFrame], most: int) -> tuple[DataFrame, int, int]:
    """(notes, rounds used, findings left). Each round is a batch query over all notes."""
    with temporary() as keep:
        for used in range(most + 1):
            found = cut(find(notes), "findings")
            left = found.count()
            if not left or used == most:
                return keep(notes), used, left
            notes = cut(fix(notes, found), "notes")
    raise AssertionError("unreachable")


#: Gives the notes (path, text) of the paths in a frame, as far as there are such.
Known = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Rules:
    """What is wrong with notes, what that depends on, and what is done about it.

    ``find(look, known)``: findings (path, ...) of the notes in ``look`` (path, text).
    ``needs(look)``: path, target for every other path that a note's findings depend on,
    whether there is such a note or not. ``fix(known, findings)``: path, text of notes that
    are changed or new; a null text takes a note away. All three must give the same result
    when they run again.
    """

    find: Callable[[DataFrame, Known], DataFrame]
    needs: Callable[[DataFrame], DataFrame]
    fix: Callable[[Known, DataFrame], DataFrame]


def _bucket(path: str):
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class Repair:
    def __init__(self, spark: SparkSession, folder: str, rules: Rules):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules

    def reports(self) -> list[dict]:
        """What the published rounds say: round, looked, changed, left."""
        names = listed(self.spark, f"{self.folder}/published")
        return sorted((json.loads(read_small(self.spark, f"{self.folder}/published/{n}")) for n in names), key=lambda r: r["round"])

    def _write(self, rows: DataFrame, what: str, number: int, by: str) -> None:
        rows.withColumn("bucket", _bucket(by)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{what}-{number}")

    def _read(self, what: str, number: int, schema: str, paths: DataFrame | None = None, by: str = "path") -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.folder}/{what}-{number}")
        if paths is not None:
            asked = paths.select(F.col("path").alias(by)).distinct()
            buckets = [r["b"] for r in asked.select(_bucket(by).alias("b")).distinct().collect()]
            rows = rows.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False)).join(asked, by, "left_semi")
        return rows.drop("bucket")

    def notes(self, last: int, paths: DataFrame | None = None) -> DataFrame:
        """path, text of all notes, or of some paths, as round ``last`` left them."""
        layers = [self._read("notes", k, "path string, text string", paths).withColumn("layer", F.lit(k)) for k in range(last + 1)]
        every = layers[0]
        for own in layers[1:]:
            every = every.unionByName(own)
        now = every.groupBy("path").agg(F.max_by(F.struct("text"), "layer").alias("now"))
        return now.select("path", "now.text").filter("text IS NOT NULL")

    def _look(self, number: int, look: DataFrame, changed: int, before: DataFrame | None) -> DataFrame:
        """Evaluate the looked-at notes, write the round's findings and needs, and publish it."""
        look = cut(look, "look")
        fresh = self.rules.find(look, lambda paths: self.notes(number, paths))
        if before is not None:
            fresh = before["rest"].unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{self.folder}/findings-{number}")
        self._write(self.rules.needs(look).select("path", "target").distinct(), "needs", number, "target")
        found = self.spark.read.schema(fresh.schema).parquet(f"{self.folder}/findings-{number}")
        report = {"round": number, "looked": look.count(), "changed": changed, "left": found.count(), "findings": fresh.schema.json()}
        create_new(self.spark, f"{self.folder}/published/{number}", json.dumps(report))
        return found

    def _findings(self, report: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(report["findings"]))).parquet(f"{self.folder}/findings-{report['round']}")

    def run(self, notes: DataFrame, most: int) -> tuple[DataFrame, list[dict]]:
        """The notes behind the last round, and the reports. ``notes`` (path, text) have distinct paths."""
        done = self.reports()
        if not done:
            with temporary():
                self._write(notes.select("path", F.coalesce("text", F.lit("")).alias("text")), "notes", 0, "path")
                self._look(0, self.notes(0), 0, None)
            done = self.reports()
        while done[-1]["left"] and done[-1]["round"] < most:
            number = done[-1]["round"] + 1
            with temporary():
                found = self._findings(done[-1])
                known = lambda paths: self.notes(number - 1, paths)  # noqa: B023, E731
                self._write(self.rules.fix(known, found).select("path", "text"), "notes", number, "path")
                changed = cut(self._read("notes", number, "path string, text string").select("path"), "changed")
                n = changed.count()
                paths = changed
                for k in range(number):
                    paths = paths.unionByName(self._read("needs", k, "path string, target string", changed, "target").select("path"))
                paths = cut(paths.distinct(), "paths")
                rest = found.join(paths, "path", "left_anti")
                self._look(number, self.notes(number, paths), n, {"rest": rest})
            done = self.reports()
            if not n:
                break
        return self.notes(done[-1]["round"]), [{k: v for k, v in r.items() if k != "findings"} for r in done]


def binding(parts: dict[str, str]) -> str:
    """One digest over everything that a run depends on, by name."""
    return sha256_json(dict(parts))
