"""Scoping: furniture, boundary clips, sections, canonical text and entries.

pages: page, text. Rules are small declared lists and become literals or a broadcast
join with a checked size.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from marginalia.functions import text as T
from marginalia.operators import automata, evidence

#: How a numbered entry starts; window and stride of repeated passages.
ENTRY_START = r"(?m)^(\d{1,3})\.\s"
BLOCK, STRIDE, SHOWN = 120, 20, 110
SOFT_HYPHEN = "­"


def java_pattern(pattern: str) -> str:
    """A pattern that means the same to Java; rejects what does not carry over."""
    re.compile(pattern)
    if re.search(r"\(\?\(|\(\?P=|(?<!\\)\\Z", pattern):
        raise ValueError(f"pattern has another meaning in the engine: {pattern!r}")
    return re.sub(r"\(\?P<", "(?<", pattern)


def strip_furniture(pages: DataFrame, rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Applies (pattern, reason) rules in order; adds furniture_removed, the reasons that matched."""
    current, applied = F.col(text), []
    for pattern, reason in rules:
        own = java_pattern(pattern)
        applied.append(F.when(current.rlike(own), F.lit(reason)))
        current = F.regexp_replace(current, own, "")
    reasons = F.array_compact(F.array(*applied)) if applied else F.array().cast("array<string>")
    return pages.withColumns({text: current, "furniture_removed": F.array_sort(reasons)})


def unused_furniture(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Declared reasons that matched no page; must be empty."""
    spark = pages.sparkSession
    declared = spark.createDataFrame([(r,) for _, r in rules], "reason string")
    return declared.join(pages.select(F.explode("furniture_removed").alias("reason")).distinct(), "reason", "left_anti")


def clip(pages: DataFrame, boundaries: DataFrame, text: str = "text") -> DataFrame:
    """Cuts each page at its boundary marker.

    boundaries: page, marker, keep (before or after), action. Adds boundary_action and
    discarded_text. A page without a rule is unchanged; a missing marker fails the job.
    """
    rules = boundaries.select("page", "marker", "keep", "action")
    joined = pages.join(rules, "page", "left")
    at = F.expr(f"locate(marker, {text})")
    whole = F.col(text)
    head, tail = F.substr(whole, F.lit(1), at - 1), F.substr(whole, at, F.length(whole))
    after = F.col("keep") == "after"
    missing = F.raise_error(F.concat(F.lit("boundary marker missing on page "), F.col("page").cast("string")))
    kept = F.concat(T.rstrip(F.when(after, tail).otherwise(head)), F.lit("\n"))
    return joined.withColumns({
        text: F.when(F.col("marker").isNull(), whole).when(at == 0, missing).otherwise(kept),
        "boundary_action": F.coalesce("action", F.lit("none")),
        "discarded_text": F.when(F.col("marker").isNull() | (at == 0), F.lit("")).otherwise(T.strip(F.when(after, head).otherwise(tail))),
    }).drop("marker", "keep", "action")


def discarded(removed: str = "discarded_text"):
    """What a clip removed, in words."""
    text = F.col(removed)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(ENTRY_START), F.lit(1)), lambda n: n.cast("int"))
    listed = F.concat(
        F.lit("the discarded portion carries "), F.size(numbers).cast("string"), F.lit(" numbered entries ("),
        F.element_at(numbers, 1).cast("string"), F.lit("-"), F.element_at(numbers, -1).cast("string"),
        F.lit(") belonging to an adjoining division"),
    )
    counted = F.concat(
        F.lit("the discarded portion is about "), T.word_count(text).cast("string"), F.lit(" words of adjoining material")
    )
    return F.when(text == "", F.lit("")).when(
        (F.size(numbers) >= 2) & (F.array_sort(numbers) == numbers), listed
    ).otherwise(counted)


def scope(pages: DataFrame, sections: DataFrame, rules: list[tuple[str, str]], boundaries: DataFrame) -> DataFrame:
    """The scoped pages: page, text, section, boundary_action, furniture_removed, discarded and hashes.

    sections: page, section (primary_text or citation_apparatus); other pages are left out.
    """
    inside = pages.join(sections, "page").withColumn("native_sha256", T.sha256(F.col("text")))
    cut = clip(strip_furniture(inside, rules), boundaries)
    return cut.withColumn("discarded", discarded()).drop("discarded_text").withColumn("sha256", T.sha256(F.col("text")))


def canonical(scoped: DataFrame, primary_banner: str, apparatus_banner: str | None = None, key: str | None = None) -> DataFrame:
    """The scope's running text with its hash: banners and right-stripped pages, primary first.

    With ``key`` one row per value of that column. The text is one value by definition;
    the pages of a scope are bounded by its declaration.
    """
    first = F.when(F.col("section") == "primary_text", 0).otherwise(1)
    rows = scoped.select(
        *([key] if key else []), F.struct(first.alias("part"), "page", T.rstrip(F.col("text")).alias("text")).alias("p")
    )
    grouped = (rows.groupBy(key) if key else rows.groupBy()).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    joined = lambda part: F.array_join(F.transform(F.filter("ps", lambda p: p["part"] == part), lambda p: p["text"]), "\n")
    has = F.exists("ps", lambda p: p["part"] == 1)
    primary = F.concat_ws("\n", F.lit(primary_banner), F.when(F.exists("ps", lambda p: p["part"] == 0), joined(0)))
    apparatus = F.when(has, F.concat_ws("\n", F.lit(apparatus_banner or ""), joined(1)))
    text = F.concat(F.concat_ws("\n", primary, apparatus), F.lit("\n"))
    return grouped.withColumn("canonical", text).select(
        *([key] if key else []), "canonical", F.length("canonical").alias("canonical_characters"),
        T.sha256(F.col("canonical")).alias("canonical_sha256"),
    )


def canonical_digest(scoped: DataFrame, primary_banner: str, apparatus_banner: str | None = None, key: str = "key") -> DataFrame:
    """key, canonical_characters, canonical_sha256: as ``canonical``, without building the text.

    A digest is sequential, so one task reads the pages of a key, in order and one at a
    time, from a sorted partition; no text is ever whole in memory.
    """

    def run(batches):
        current, digest, size, part = None, None, 0, 0
        ready: list[tuple] = []

        def add(piece: str) -> None:
            nonlocal size
            digest.update(piece.encode())
            size += len(piece)

        for rows in batches:
            for own, now, text in rows[[key, "part", "text"]].itertuples(index=False):
                if digest is None or own != current:
                    if digest is not None:
                        add("\n")
                        ready.append((current, size, digest.hexdigest()))
                    current, digest, size, part = own, hashlib.sha256(), 0, 0
                    add(primary_banner)
                if now and not part:
                    add(f"\n{apparatus_banner or ''}")
                part = now
                add(f"\n{text}")
            yield pd.DataFrame(ready, columns=[key, "canonical_characters", "canonical_sha256"])
            ready = []
        if digest is not None:
            add("\n")
            yield pd.DataFrame([(current, size, digest.hexdigest())], columns=[key, "canonical_characters", "canonical_sha256"])

    first = F.when(F.col("section") == "primary_text", 0).otherwise(1)
    ordered = (
        scoped.select(key, first.alias("part"), "page", T.rstrip(F.col("text")).alias("text"))
        .repartition(key).sortWithinPartitions(key, "part", "page")
    )
    return ordered.mapInPandas(run, f"{key} {scoped.schema[key].dataType.simpleString()}, canonical_characters long, canonical_sha256 string")


def running_sequence(numbers, first, last):
    """The numbers accepted in turn: each equal to the one then due, up to ``last``."""
    due = F.aggregate(numbers, first.cast("int"), lambda e, x: F.when((x == e) & (e <= last), e + 1).otherwise(e))
    return F.when(due > first, F.sequence(first.cast("int"), due - 1)).otherwise(F.array().cast("array<int>"))


def entry_numbers(text, pattern: str = ENTRY_START):
    return F.transform(F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(1)), lambda n: n.cast("int"))


def entries(pages: DataFrame, key: str, first: int = 1, pattern: str = ENTRY_START, block: int = automata.BLOCK) -> DataFrame:
    """Numbered entries: key, page, number, text.

    Which start counts depends on all entries before it. The numbers of every block of
    pages are summarised first and composed (:mod:`marginalia.operators.automata`), so each
    block knows the number due at its start, and a long document is read by many tasks.
    """
    compiled = re.compile(pattern)
    own = automata.with_blocks(pages.select(key, "page", F.coalesce("text", F.lit("")).alias("text")), "page", block)
    numbers = own.select(key, "page", "block_", entry_numbers(F.col("text"), pattern).alias("numbers_"))
    due = automata.due_at(numbers, key, "page", "numbers_", first)

    def split(batches):
        at, now = None, first
        for rows in batches:
            out = []
            for name, page, text, here, start in rows[[key, "page", "text", "block_", "due"]].itertuples(index=False):
                scope = (None if pd.isna(name) else name, here)
                if at != scope:
                    at, now = scope, start
                starts = []
                for m in compiled.finditer(text):
                    if int(m[1]) == now:
                        starts.append(m)
                        now += 1
                stops = [m.start() for m in starts[1:]] + [len(text)]
                out += [
                    (name, page, int(m[1]), re.sub(r"\s+", " ", text[m.end() : stop].strip()))
                    for m, stop in zip(starts, stops, strict=False)
                ]
            yield pd.DataFrame(out, columns=[key, "page", "number", "text"])

    schema = f"{key} {pages.schema[key].dataType.simpleString()}, page {pages.schema['page'].dataType.simpleString()}, number int, text string"
    ordered = automata.start_of_blocks(own, key, due).repartition(key, "block_").sortWithinPartitions(key, "block_", "page")
    return ordered.select(key, "page", "text", "block_", "due").mapInPandas(split, schema)


def entries_per_page(found: DataFrame) -> DataFrame:
    return found.groupBy("page").agg(F.array_sort(F.collect_list("number")).alias("numbers"))


def repeated_block(text: str | None, block: int = BLOCK, stride: int = STRIDE) -> str | None:
    """The first window of ``block`` characters, at a multiple of ``stride``, that occurs again.

    Every window's rolling hash is sorted once, so a page of n characters costs n log n;
    what the hashes suggest is then compared as text. Occurrences must not overlap.
    """
    flat = re.sub(r"\s+", " ", text or "").strip()
    if len(flat) <= block:
        return None
    codes = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)  # odd, so its powers can be divided out
    back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers = np.cumprod(np.full(len(codes), base), dtype=np.uint64)
    undo = np.cumprod(np.full(len(codes), back), dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(codes * powers, dtype=np.uint64))
    hashes = (sums[block:] - sums[:-block]) * undo[: len(codes) - block + 1]
    order = np.argsort(hashes, kind="stable")
    fresh = np.append(True, hashes[order][1:] != hashes[order][:-1])
    group = np.cumsum(fresh) - 1
    first = order[fresh]
    last = order[np.append(np.flatnonzero(fresh)[1:] - 1, len(order) - 1)]
    apart = (last - first >= block)[group]
    may = np.zeros(len(hashes), dtype=bool)
    may[order] = apart
    for start in np.flatnonzero(may[: len(flat) - block : stride]) * stride:
        window = flat[start : start + block]
        if flat.find(window, flat.find(window) + block) >= 0:
            return window[:SHOWN].strip()
    return None


@F.pandas_udf(S.StringType())
def duplicate_block(texts: pd.Series) -> pd.Series:
    return texts.map(repeated_block)


def soft_hyphens(pages: DataFrame) -> DataFrame:
    n = T.occurrences(F.col("text"), F.lit(SOFT_HYPHEN))
    return pages.select("page", n.alias("soft_hyphens")).filter("soft_hyphens > 0")


def page_ranges(pages: DataFrame, chunks: int = 2) -> DataFrame:
    """chunk, first, last: at most ``chunks`` ranges of equal size, rounded up."""
    size = max(1, -(-pages.count() // chunks))
    return evidence.chunk(pages.select("page"), size, "page").groupBy("chunk").agg(F.min("page").alias("first"), F.max("page").alias("last"))


def page_map(pages: DataFrame) -> DataFrame:
    return pages.select("page", T.opening(F.col("text")).alias("opening"), F.length("text").alias("characters"),
                        F.left(T.sha256(F.col("text")), F.lit(12)).alias("hash_prefix"))
