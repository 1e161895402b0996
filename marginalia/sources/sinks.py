"""Writing results: exclusive, appended, staged, and one file per row.

All go through Hadoop file systems, so that every path Spark reads can be written.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.scratch import cut, temporary


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def exclusive(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Fails if the target exists."""
    df.write.mode("errorifexists").format(format).save(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def atomic_text(spark: SparkSession, path: str, value: str, overwrite: bool = True) -> None:
    """A small file, complete or absent: written aside, then renamed.

    The store decides whether the target may be replaced, in the same step as the rename
    where it can (a local file system cannot, and checks first).
    """
    aside, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    target, _ = _fs(spark, path)
    out = fs.create(aside)
    try:
        out.write(bytearray(value.encode()))
    finally:
        out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE if overwrite else kinds.NONE
    store = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        store.rename(aside, target, how)
    except Py4JJavaError as refused:
        fs.delete(aside, False)
        if "FileAlreadyExists" in refused.java_exception.getClass().getName():
            raise FileExistsError(path) from refused
        raise


def staged(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Published by one rename once all of it is written; the target must be absent."""
    spark = df.sparkSession
    target, fs = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    aside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.staging")
    df.write.format(format).save(aside.toString())
    if not fs.rename(aside, target):
        fs.delete(aside, True)
        raise FileExistsError(path)


def publish(spark: SparkSession, candidate: str, output: str, faults: DataFrame) -> None:
    """Renames a candidate folder to its place if no checksum differs."""
    bad = faults.orderBy("path").limit(3).collect()
    if bad:
        raise ValueError(f"candidate does not match its checksums: {[tuple(r) for r in bad]}")
    source, fs = _fs(spark, candidate)
    target, _ = _fs(spark, output)
    if fs.exists(target):
        raise FileExistsError(output)
    if not fs.rename(source, target):
        raise OSError(f"cannot rename to {output}")


def write_notes(notes: DataFrame, root: str) -> None:
    """One file per row (path, text), written by the tasks; rewriting a row gives the same file."""
    parts = notes.select("path", "text").withColumn("folder", T.parent(F.col("path"))).withColumn("name", T.name(F.col("path")))
    root = root.removeprefix("file://")

    def save(rows):
        import os

        for row in rows:
            folder = os.path.join(root, row["folder"])
            os.makedirs(folder, exist_ok=True)
            aside = os.path.join(folder, f".{row['name']}.{uuid.uuid4().hex}")
            with open(aside, "w", encoding="utf-8") as file:
                file.write(row["text"])
            os.replace(aside, os.path.join(folder, row["name"]))

    parts.foreachPartition(save)


#: The small file of a published tree that names its current version.
CURRENT = "current"


def publish_notes(notes: DataFrame, root: str) -> str:
    """Publishes a tree of notes (path, text) as a whole and gives its version.

    Tasks write the files of a new version, each aside and then moved to its name, so a task
    that runs again leaves the same file, and take checksums of what they write. These
    become the version's inventory (path, bytes, sha256). One small file names the current
    version and is replaced at the very end: a reader finds the old tree or the new one. A
    path that stands twice, is absolute or leaves the tree is refused before anything is
    written. ``root`` is any place that Arrow's file systems reach (local, hdfs, s3, gs).
    """
    spark = notes.sparkSession
    version = uuid.uuid4().hex
    base = f"{root.rstrip('/')}/versions/{version}"
    with temporary():
        rows = cut(notes.select("path", F.coalesce("text", F.lit("")).alias("text")), "tree")
        steps = F.split("path", "/")
        odd = F.col("path").isNull() | F.exists(steps, lambda s: s.isin("", ".", ".."))
        faults = rows.filter(odd).select("path").unionByName(rows.groupBy("path").count().filter("count > 1").select("path"))
        if bad := faults.limit(3).collect():
            raise ValueError(f"paths that no tree can hold: {[r['path'] for r in bad]}")

        def save(batches):
            import hashlib

            import pandas as pd
            from pyarrow import fs

            store, top = fs.FileSystem.from_uri(base if "://" in base else f"file://{base}")
            made: set[str] = set()
            for frame in batches:
                out = []
                for path, text in zip(frame["path"], frame["text"], strict=True):
                    target, raw = f"{top}/tree/{path}", text.encode()
                    folder, _, name = target.rpartition("/")
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
                    with store.open_output_stream(aside) as file:
                        file.write(raw)
                    store.move(aside, target)
                    out.append((path, len(raw), hashlib.sha256(raw).hexdigest()))
                yield pd.DataFrame(out, columns=["path", "bytes", "sha256"])

        rows.mapInPandas(save, "path string, bytes long, sha256 string").write.parquet(f"{base}/inventory")
        if spark.read.parquet(f"{base}/inventory").count() != rows.count():
            raise OSError(f"version {version} is not whole")
    atomic_text(spark, f"{root.rstrip('/')}/{CURRENT}", version)
    return version


def gateway_notes(scoped: DataFrame, title: str, scope_id: str, tags: list[str]) -> DataFrame:
    """path, text of one gateway note per scoped page."""
    page = F.lpad(F.col("page").cast("string"), F.greatest(F.lit(4), F.length(F.col("page").cast("string"))), F.lit("0"))
    head = F.concat(F.lit(f"{title}, PDF page "), F.col("page").cast("string"))
    text = F.concat(
        F.lit("---\ntype: Source Page\ntitle: \""), head, F.lit(f"\"\ndescription: The verbatim scoped text of one source page\ntags: [{', '.join(tags)}]\nscope: {scope_id}\npdf_page: "),
        F.col("page").cast("string"), F.lit("\nsection: "), "section", F.lit("\nsha256: "), "sha256", F.lit("\n---\n# "), head,
        F.lit("\n\n````text\n"), T.rstrip(F.col("text")), F.lit("\n````\n\n## Sources\n\n- "), head, F.lit("\n"),
    )
    return scoped.select(F.concat(F.lit("sources/pdf-pages/page-"), page, F.lit(".md")).alias("path"), text.alias("text"))


def folder_index(notes: DataFrame) -> DataFrame:
    """path, text of an index.md per folder, listing its notes by title."""
    listed = notes.select(
        T.parent(F.col("path")).alias("folder"), T.name(F.col("path")).alias("name"), T.note_title(F.col("path"), F.col("text")).alias("title")
    ).filter("name <> 'index.md'")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "title"))), lambda x: F.concat(F.lit("- ["), x["title"], F.lit("]("), x["name"], F.lit(")"))), "\n")
    path = F.when(F.col("folder") == "", "index.md").otherwise(F.concat("folder", F.lit("/index.md")))
    return listed.groupBy("folder").agg(lines.alias("lines")).select(path.alias("path"), F.concat(F.lit("# Index\n\n"), "lines", F.lit("\n")).alias("text"))


def page_map_note(mapped: DataFrame) -> DataFrame:
    """One note with a table of pages: page, opening, characters, hash prefix."""
    row = F.concat_ws(" | ", F.col("page").cast("string"), "opening", F.col("characters").cast("string"), "hash_prefix")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.concat(F.lit("| "), row, F.lit(" |")).alias("line")))), lambda x: x["line"]), "\n")
    head = "# Page map\n\n| Page | Opening | Characters | SHA-256 |\n|-|-|-|-|\n"
    return mapped.agg(rows.alias("rows")).select(F.lit("reference/page-map.md").alias("path"), F.concat(F.lit(head), "rows", F.lit("\n")).alias("text"))


def table_note(rows: DataFrame, path: str, title: str, order: str) -> DataFrame:
    """One note with a table of all rows and columns: the form of the derived notes on
    scope, provenance, anomalies and apparatus. Bars in cells are escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), F.lit("|"), F.lit("\\|")) for c in rows.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), "\n")
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{'-|' * len(rows.columns)}\n"
    return rows.agg(lines.alias("lines")).select(F.lit(path).alias("path"), F.concat(F.lit(head), "lines", F.lit("\n")).alias("text"))


def staged_images(notes: DataFrame, images: DataFrame, marker: str = r"!\[[^\]]*\]\((?:\.\./)*images/([^)\s]+)\)") -> DataFrame:
    """The images that some note embeds, once each. images: name and whatever belongs to it."""
    used = notes.select(F.explode(F.regexp_extract_all("text", F.lit(marker), F.lit(1))).alias("name")).distinct()
    return images.join(used, "name", "left_semi")
