"""Checks and joins over page records that an extractor has left as tables.

page_records: page, native_text_characters, raw_characters, vectors, images, sha256.
image_occurrences: page, occurrence, xref; image_objects: xref, smask, files, error.
Reading PDF itself is out of scope.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The grid of the orientation fallback.
ROTATIONS, MODES = (0, 90, 180, 270), (6, 11)


def ocr_targets(pages: DataFrame, mode: str) -> DataFrame:
    """Pages to recognise: none, those without native text, or all."""
    if mode not in ("none", "missing", "all"):
        raise ValueError(f"unknown mode {mode!r}")
    return {"none": pages.filter(F.lit(False)), "missing": pages.filter("native_text_characters = 0"), "all": pages}[mode]


def fallback_grid(pages: DataFrame) -> DataFrame:
    """page, rotation, mode: every variant for pages with images or without native text."""
    grid = F.flatten(F.array(*[F.array(*[F.struct(F.lit(r).alias("rotation"), F.lit(m).alias("mode")) for m in MODES]) for r in ROTATIONS]))
    wanted = pages.filter("images > 0 OR native_text_characters = 0")
    return wanted.select("page", F.explode(grid).alias("g")).select("page", "g.rotation", "g.mode")


def best_variant(variants: DataFrame) -> DataFrame:
    """The variant of a page with most characters; ties to the smaller rotation and mode."""
    best = F.max_by(F.struct("rotation", "mode", "characters"), F.struct("characters", -F.col("rotation"), -F.col("mode")))
    return variants.groupBy("page").agg(best.alias("b")).select("page", "b.rotation", "b.mode", "b.characters")


def all_pages_text(recognised: DataFrame, page_count: int) -> DataFrame:
    """page, text for 1 to the page count; pages without a result are empty."""
    every = recognised.sparkSession.range(1, page_count + 1).select(F.col("id").cast("int").alias("page"))
    return every.join(recognised, "page", "left").select("page", F.coalesce("text", F.lit("")).alias("text"))


def number_occurrences(images: DataFrame, *order: str) -> DataFrame:
    """Adds occurrence, 1 to n within a page."""
    return images.withColumn("occurrence", F.row_number().over(Window.partitionBy("page").orderBy(*order)))


def pages_of_images(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("xref").agg(F.array_sort(F.collect_set("page")).alias("referenced_on_pages"))


def with_soft_masks(objects: DataFrame, masks: DataFrame) -> DataFrame:
    return objects.join(masks.select("xref", "smask_xref"), "xref", "left")


def once_per_content(files: DataFrame, key: str = "sha256") -> DataFrame:
    """One row per content, the first by page and order."""
    return files.groupBy(key).agg(F.min_by(F.struct(*[c for c in files.columns if c != key]), F.struct("page", "ord")).alias("f")).select(key, "f.*")


def raw_characters(blocks: Column) -> Column:
    """Characters in array<struct<kind,lines:array<struct<spans:array<struct<chars:array>>>>>>; text blocks only."""
    per_span = lambda s: F.size(s["chars"])
    per_line = lambda x: F.aggregate(F.transform(x["spans"], per_span), F.lit(0), lambda a, n: a + n)
    per_block = lambda b: F.aggregate(F.transform(b["lines"], per_line), F.lit(0), lambda a, n: a + n)
    return F.aggregate(F.transform(F.filter(blocks, lambda b: b["kind"] == 0), per_block), F.lit(0), lambda a, n: a + n)


def recovered_pages(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages without native text for which recognition found some."""
    return pages.filter("native_text_characters = 0").join(recognised.filter("length(trim(text)) > 0"), "page", "left_semi")


def validation(pages: DataFrame, occurrences: DataFrame, objects: DataFrame, page_count: int, counted_images: int) -> DataFrame:
    """One row: status, the checks and the counts behind them."""
    p = pages.agg(
        F.count("*").alias("pages"), F.coalesce(F.sum("native_text_characters"), F.lit(0)).alias("native_characters"),
        F.coalesce(F.sum("raw_characters"), F.lit(0)).alias("raw_layout_characters"), F.coalesce(F.sum("vectors"), F.lit(0)).alias("vectors"),
        F.count_distinct("page").alias("distinct_pages"),
        F.array_sort(F.collect_list(F.when(F.col("native_text_characters") == 0, F.col("page")))).alias("pages_without_native_text"),
    )
    o = occurrences.agg(F.count("*").alias("image_occurrences"), F.count_distinct("xref").alias("image_xrefs"))
    x = objects.agg(F.count("*").alias("image_objects"), F.count_if(F.col("error").isNotNull()).alias("image_errors"))
    lost = occurrences.join(objects, "xref", "left_anti").agg(F.count("*").alias("images_without_object"))
    checks = {
        "all_pages_present": (F.col("pages") == page_count) & (F.col("distinct_pages") == page_count),
        "image_count_matches": F.col("image_occurrences") == counted_images,
        "images_have_objects": F.col("images_without_object") == 0,
    }
    one = p.crossJoin(o).crossJoin(x).crossJoin(lost).withColumns(checks)
    passed = F.forall(F.array(*checks), lambda c: c)
    return one.withColumn("status", F.when(passed, "passed").otherwise("failed"))


def artifact_counts(expected: DataFrame, found: DataFrame) -> DataFrame:
    """kind, expected, found of artifacts by kind."""
    e, f = expected.groupBy("kind").agg(F.count("*").alias("expected")), found.join(expected.select("path"), "path", "left_semi").groupBy("kind").agg(F.count("*").alias("found"))
    return e.join(f, "kind", "left").na.fill(0)


def same_multiset(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row, ok: both sides hold every value of ``key`` equally often."""
    counted = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = counted(left, "n_left").join(counted(right, "n_right"), key, "full_outer")
    return both.agg((F.count_if(~F.col("n_left").eqNullSafe(F.col("n_right"))) == 0).alias("ok"))


def checks(
    pages: DataFrame, occurrences: DataFrame, objects: DataFrame, page_count: int, *, listed: DataFrame | None = None,
    page_files: DataFrame | None = None, files: DataFrame | None = None, targets: DataFrame | None = None,
    recognised: DataFrame | None = None, variants: DataFrame | None = None, variant_pages: DataFrame | None = None,
    counted_images: int | None = None, written_images: int | None = None, hashes: tuple[str, str] | None = None,
) -> DataFrame:
    """check, ok: one row per check of an extraction; what is not given is not checked.

    objects: xref, encoded_stream_file, native_file, rendered_file. listed: xref, as the
    document itself lists them. page_files: kind, path, one row a page and kind.
    recognised and variants: page, path, one row per output file. files: path of all that exist.
    """
    out = [
        ("page_record_count", pages.agg((F.count("*") == page_count).alias("ok"))),
        ("occurrences_have_pages", occurrences.agg((F.count_if(~F.coalesce(F.col("page").between(1, page_count), F.lit(False))) == 0).alias("ok"))),
    ]
    if {"encoded_stream_file", "native_file", "rendered_file"} <= set(objects.columns):
        kept = F.col("encoded_stream_file").isNotNull() & (F.col("native_file").isNotNull() | F.col("rendered_file").isNotNull())
        out.append(("objects_have_data", objects.agg((F.count_if(~kept) == 0).alias("ok"))))
    if hashes:
        out.append(("source_unchanged", pages.sparkSession.range(1).select(F.lit(hashes[0] == hashes[1]).alias("ok"))))
    if listed is not None:
        out.append(("listed_objects_extracted", same_multiset(listed, objects, "xref")))
    if page_files is not None and files is not None:
        there = page_files.join(files.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
        per_kind = there.groupBy("kind").agg(((F.count("*") == page_count) & (F.count("there") == F.count("*"))).alias("ok"))
        out.append((F.concat(F.col("kind"), F.lit("_pages_complete")), per_kind))
    if targets is not None and recognised is not None:
        out.append(("recognition_complete", same_multiset(targets.select("page").distinct(), recognised.select("page").distinct(), "page")))
    if variants is not None and variant_pages is not None:
        grid = variant_pages.select("page", F.lit(1).alias("images"), F.lit(1).alias("native_text_characters"))
        wanted = fallback_grid(grid).select(F.struct("page", "rotation", "mode").alias("v"))
        out.append(("fallback_complete", same_multiset(wanted, variants.select(F.struct("page", "rotation", "mode").alias("v")).distinct(), "v")))
    outputs = [x.select("path") for x in (recognised, variants) if x is not None and "path" in x.columns]
    if outputs and files is not None:
        lost = reduce(DataFrame.unionByName, outputs).join(files.select("path"), "path", "left_anti")
        out.append(("recognition_outputs_exist", lost.agg((F.count("*") == 0).alias("ok"))))
    if counted_images is not None:
        out.append(("image_count_matches", occurrences.agg((F.count("*") == counted_images).alias("ok"))))
    if written_images is not None:
        out.append(("no_image_missed", occurrences.agg((F.count("*") >= written_images).alias("ok"))))
    named = [df.select((F.lit(name) if isinstance(name, str) else name).alias("check"), "ok") for name, df in out]
    return reduce(DataFrame.unionByName, named)
