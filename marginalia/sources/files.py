"""Reading corpora from files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T

CHECKSUM_LINE = r"\A([0-9a-f]{64})  (\s*\S.*)\z"


def relative(root: str, column: str = "file"):
    """A file's path below a root, percent-decoded, with slashes."""
    return T.unquote(F.regexp_replace(F.col(column), F.concat(F.lit(r"\A.*?\Q"), F.lit(root.rstrip("/").removeprefix("file:") + "/"), F.lit(r"\E")), F.lit("")))


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """path, text of every note below ``root`` outside .git; null text if not valid UTF-8."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
        .select(relative(root, "path").alias("path"), "content")
    )
    return raw.filter(~F.array_contains(T.parts(F.col("path")), ".git")).select(
        "path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).alias("text")
    )


def published_notes(spark: SparkSession, root: str) -> DataFrame:
    """path, text, sha256, listed of the current version of a published tree.

    sha256 is taken of what is read, listed is what was written; a file that is missing or
    beside the inventory has a null on one side. Spark reads no empty files, so one that the
    inventory lists counts as there.
    """
    from marginalia.scratch import read_small
    from marginalia.sources.sinks import CURRENT

    base = f"{root.rstrip('/')}/versions/{read_small(spark, f'{root.rstrip('/')}/{CURRENT}').strip()}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{base}/tree").select(
        relative(f"{base}/tree", "path").alias("path"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256")
    )
    listed = spark.read.parquet(f"{base}/inventory").select("path", F.col("sha256").alias("listed"), "bytes")
    nothing = F.col("text").isNull() & (F.col("bytes") == 0)
    return raw.join(listed, "path", "full_outer").select(
        "path", F.when(nothing, "").otherwise(F.col("text")).alias("text"),
        F.when(nothing, F.sha2(F.lit(""), 256)).otherwise(F.col("sha256")).alias("sha256"), "listed",
    )


def page_texts(spark: SparkSession, root: str) -> DataFrame:
    """page, path, text, sha256 of native page texts."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "page-*.txt").load(f"{root}/text/native-pages")
    return raw.select(
        F.regexp_extract("path", r"page-(\d+)\.txt\z", 1).cast("int").alias("page"), relative(root, "path").alias("path"),
        F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"),
    )


def checksum_inventory(lines: DataFrame) -> DataFrame:
    """path, sha256 from checksum lines (value); a malformed line or a repeated path fails the job."""
    rows = lines.filter(T.nonempty(F.col("value")))
    bad = F.raise_error(F.concat(F.lit("invalid checksum line: "), F.col("value")))
    parsed = rows.select(
        F.when(F.col("value").rlike(CHECKSUM_LINE), F.regexp_replace(F.regexp_extract("value", CHECKSUM_LINE, 2), r"\\", "/")).otherwise(bad).alias("path"),
        F.regexp_extract("value", CHECKSUM_LINE, 1).alias("sha256"),
    )
    twice = F.raise_error(F.concat(F.lit("duplicate checksum path: "), F.col("path")))
    return parsed.groupBy("path").agg(F.count("*").alias("n"), F.min("sha256").alias("sha256")).select(
        F.when(F.col("n") > 1, twice).otherwise(F.col("path")).alias("path"), "sha256"
    )


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    return checksum_inventory(spark.read.text(path))


def fenced_json(texts: DataFrame, schema: str, column: str = "text") -> DataFrame:
    """Parses JSON that may stand in a code fence; value is null where it does not parse."""
    bare = F.regexp_replace(F.regexp_replace(T.strip(F.col(column)), r"\A```[a-zA-Z]*\s*\n", ""), r"\n?```\z", "")
    return texts.withColumn("value", F.from_json(bare, schema))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; blank lines are no rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, sha256, modified of every file below ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(
        relative(root, "path").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
        F.col("modificationTime").alias("modified"),
    )


def json_document(spark: SparkSession, path: str, label: str = "document") -> dict:
    """A strict JSON object, read through Spark so that any store will do."""
    from marginalia.operators.integrity import load_strict

    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise ValueError(f"{label}: one file expected")
    return load_strict(rows[0]["value"], label)


def html_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, links of raw HTML: the form in which pages enter without a PDF."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", "url", T.collapse(title).alias("title"), links.alias("links"))


def dumps(document) -> str:
    return json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
