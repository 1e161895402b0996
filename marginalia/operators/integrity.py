"""Integrity: inventories, differences, sequences, locks and gates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.scratch import cut, temporary


def checksum_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, status (missing, extra or changed) of (path, sha256) inventories that disagree."""
    old, new = expected.select("path", F.col("sha256").alias("old")), actual.select("path", F.col("sha256").alias("new"))
    status = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "extra").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, "path", "full_outer").select("path", status.alias("status")).filter("status IS NOT NULL")


def artifact_check(index: DataFrame, artifacts: DataFrame) -> DataFrame:
    """As checksum_diff, but artifacts beyond the index are no finding."""
    found = index.join(artifacts.select("path", F.col("sha256").alias("now")), "path", "left")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    return found.select("path", status.alias("status")).filter("status IS NOT NULL")


def page_hash_mismatches(pages: DataFrame, inventory: DataFrame) -> DataFrame:
    """Pages whose bytes differ from the inventory, or that it does not list."""
    named = inventory.select("path", F.col("sha256").alias("listed"))
    return pages.join(named, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("listed"))).select("path", "sha256", "listed")


def sequence_faults(log: DataFrame, run: str = "run_id", sequence: str = "sequence", start: int = 1) -> DataFrame:
    """Rows whose sequence does not follow the row before it in their run."""
    order = Window.partitionBy(run).orderBy(sequence)
    before = F.lag(sequence).over(order)
    due = F.coalesce(before + 1, F.lit(start))
    return log.select(run, sequence, due.alias("expected")).filter(F.col(sequence) != F.col("expected"))


def resequence(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Appends child rows under the parent's numbering and keeps their own number.

    The parent's last number is one value; the child's order is kept per run.
    """
    last = parent.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("last"))
    order = Window.partitionBy("run_id").orderBy("sequence")
    moved = child.crossJoin(F.broadcast(last)).select(
        *[c for c in child.columns if c != "sequence"], F.col("sequence").alias("child_sequence"),
        (F.col("last") + F.row_number().over(order)).alias("sequence"),
    )
    return parent.withColumn("child_sequence", F.lit(None).cast("long")).unionByName(moved, allowMissingColumns=True)


def activity(files: DataFrame) -> DataFrame:
    """Total bytes and latest change, null without files."""
    return files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("modified").alias("modified"))


def tail(lines: DataFrame, n: int = 80, order: str = "line") -> DataFrame:
    return lines.orderBy(F.desc(order)).limit(n).orderBy(order)


#: What the kinds of JSON values are called.
KINDS = {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BIGINT": "int", "DOUBLE": "float", "DECIMAL": "float", "BOOLEAN": "bool", "VOID": "NoneType"}


def flattened(documents: DataFrame, *keys: str, column: str = "document", at: str = "lock") -> DataFrame:
    """keys, location, kind, value of every node of JSON documents; a list's value is its length.

    Documents are variants and come apart level by level: every level is one explode of the
    containers of the one before, so the work is spread as the documents are, and ends with
    the deepest of them. A text that is no JSON has no node.
    """
    spark = documents.sparkSession
    kind = F.regexp_extract(F.schema_of_variant("node"), "^[A-Z]+", 0)
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    level = documents.select(*keys, F.lit(at).alias("location"), F.try_parse_json(column).alias("node")).filter("node IS NOT NULL")
    found = None
    with temporary() as keep:
        while True:
            # The children of a list are counted below it; a scalar is its canonical text.
            own = cut(level.withColumn("shape", kind).withColumn("json", F.to_json("node")).drop("node"), "level")
            children = own.filter("shape IN ('OBJECT', 'ARRAY')").withColumn("node", F.parse_json("json")).lateralJoin(
                spark.tvf.variant_explode(F.col("node").outer())
            )
            step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
            level = children.select(*keys, F.concat("location", step).alias("location"), F.col("value").alias("node"))
            sizes = F.size(F.from_json("json", "array<variant>")).cast("string")
            value = F.when(F.col("shape") == "OBJECT", "").when(F.col("shape") == "ARRAY", sizes).otherwise(F.col("json"))
            rows = own.select(*keys, "location", F.coalesce(F.try_element_at(names, F.col("shape")), F.lower("shape")).alias("kind"), value.alias("value"))
            found = rows if found is None else found.unionByName(rows)
            if own.filter("shape IN ('OBJECT', 'ARRAY')").isEmpty():
                return keep(cut(found, "flat"))


def differences(expected: DataFrame, actual: DataFrame, *keys: str, column: str = "document", at: str = "lock") -> DataFrame:
    """keys, location, problem for every node in which two sets of JSON documents differ, document by document."""
    side = lambda d, s: flattened(d, *keys, column=column, at=at).withColumnsRenamed({"kind": f"kind_{s}", "value": f"value_{s}"})
    both = side(expected, "e").join(side(actual, "a"), [*keys, "location"], "full_outer")
    problem = (
        F.when(F.col("kind_e").isNull(), "unexpected field").when(F.col("kind_a").isNull(), "missing field")
        .when(F.col("kind_e") != F.col("kind_a"), F.concat(F.lit("expected "), F.col("kind_e"), F.lit(", got "), F.col("kind_a")))
        .when(F.col("value_e") != F.col("value_a"), F.concat(F.lit("expected "), F.col("value_e"), F.lit(", got "), F.col("value_a")))
    )
    return both.select(*keys, "location", problem.alias("problem")).filter("problem IS NOT NULL")


def first_differences(expected: DataFrame, actual: DataFrame, *keys: str, column: str = "document", at: str = "lock") -> DataFrame:
    """Of every document that differs the first node in order of location."""
    found = differences(expected, actual, *keys, column=column, at=at)
    return found.groupBy(*keys).agg(F.min(F.struct("location", "problem")).alias("first")).select(*keys, "first.*")


def document_diff(spark, expected, actual, at: str = "lock") -> DataFrame:
    """location, problem for every node in which two parsed documents differ."""
    frame = lambda d: spark.createDataFrame([(json.dumps(d),)], "document string")
    return differences(frame(expected), frame(actual), at=at)


def first_difference(spark, expected, actual, at: str = "lock") -> str:
    rows = document_diff(spark, expected, actual, at).orderBy("location").limit(1).collect()
    return f"{rows[0]['location']}: {rows[0]['problem']}" if rows else ""


def smoke_gate(report: DataFrame, binding: str, now: Column | None = None) -> DataFrame:
    """The first reason for which a smoke report does not open the gate, or null."""
    now = F.current_timestamp() if now is None else now
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    reason = (
        F.when(bad(F.col("status") == "passed"), "smoke did not pass")
        .when(bad(~F.col("corrected")), "smoke was corrected")
        .when(bad(~F.col("creates_published_wiki")), "smoke published a wiki")
        .when(bad(F.to_timestamp("expires_at") > now), "smoke has expired")
        .when(bad(F.to_timestamp("created_at") < F.to_timestamp("expires_at")), "smoke times are out of order")
        .when(bad(F.col("binding_sha256") == binding), "smoke belongs to another binding")
    )
    return report.select("run_id", reason.alias("reason"), reason.isNull().alias("open"))


def seal_gate(lint: DataFrame, okf: DataFrame, model_gates: DataFrame) -> DataFrame:
    """One row: counts of findings and whether the wiki may be sealed."""
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return count(lint, "lint").crossJoin(count(okf, "okf")).crossJoin(count(model_gates, "gates")).withColumn(
        "sealed", (F.col("lint") == 0) & (F.col("okf") == 0) & (F.col("gates") == 0)
    )


def isolation(tools: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """Tools whose name holds a forbidden marker; must be empty."""
    return tools.filter(F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower("tool"), m)))


def stray_files(files: DataFrame, root_files: list[str], folders: list[str]) -> DataFrame:
    """Files outside the allowed root names and top folders."""
    top = F.split_part("path", F.lit("/"), F.lit(1))
    at_root = ~F.contains("path", F.lit("/"))
    return files.filter((at_root & ~top.isin(root_files)) | (~at_root & ~top.isin(folders)))


def missing_prefixes(required: DataFrame, labels: DataFrame) -> DataFrame:
    """Required stage prefixes with no label that starts with them.

    A label gives its beginnings of the lengths that prefixes have, so the join is an equality.
    """
    lengths = [r["n"] for r in required.select(F.length("prefix").alias("n")).distinct().collect() if r["n"] is not None]
    starts = F.array(*[F.left("label", F.lit(n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    return required.join(labels.select(F.explode(starts).alias("prefix")).distinct(), "prefix", "left_anti")


def unchanged(before: DataFrame, after: DataFrame, allowed: DataFrame) -> DataFrame:
    """Files that changed in a stage although it may not write them."""
    return checksum_diff(before, after).join(allowed.select("path"), "path", "left_anti")


def load_strict(text: str, label: str = "document") -> dict:
    """A JSON object; repeated keys and other values are errors."""

    def once(pairs):
        out = {}
        for key, value in pairs:
            if key in out:
                raise ValueError(f"{label}: repeated key {key!r}")
            out[key] = value
        return out

    value = json.loads(text.lstrip("﻿"), object_pairs_hook=once)
    if not isinstance(value, dict):
        raise ValueError(f"{label} must be a JSON object")
    return value
