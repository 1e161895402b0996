"""Evidence packing for review: chunks of notes, page demand, budgets and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as T
from marginalia.functions.frontmatter import front_matter
from marginalia.operators import linkgraph as G
from marginalia.operators.lint import PAGE_LINK
from marginalia.scratch import cut

# Notes a packet, characters a note, pages and characters of evidence.
NOTES, NOTE_CHARACTERS, PAGES, BUDGET = 5, 6_000, 12, 50_400
NO_PAGE = 10**9


def chunk(rows: DataFrame, size: int, *order, key: list[str] | None = None, name: str = "chunk") -> DataFrame:
    """Numbers rows in fixed-size chunks by an order, within each value of ``key``.

    Without a key the order is global: rows are range-sorted and numbered by partition
    counts, not by one task.
    """
    if size < 1:
        raise ValueError("chunk size must be positive")
    if key:
        n = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
        return rows.withColumn(name, F.floor(n / size).cast("int"))
    return numbered(rows, *order).withColumn(name, F.floor(F.col("__n") / size).cast("int")).drop("__n")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """Adds __n, the global place from 0 by an order, without a single-task sort.

    The ranges are written before they are counted, so a lost executor changes no place.
    """
    ranged = rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = cut(ranged.withColumn("__part", F.shiftright("__id", 33)), "numbered")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(counts.select("__part", before.alias("__b"))), "__part").withColumn(
        "__n", F.col("__b") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    ).drop("__part", "__id", "__b")


def semantic_notes(notes: DataFrame) -> DataFrame:
    own = G.kept(notes).filter(~G.is_gateway(F.col("path")) & (T.name(F.col("path")) != "index.md"))
    return own.withColumn("fm", front_matter(F.col("text"))).filter("fm.semantic").drop("fm")


def gateway_pages(notes: DataFrame, scope: DataFrame) -> DataFrame:
    """page, text of scoped gateways that hold a fenced text; others are left out."""
    fence = r"(?s)````text\s*\n(.*?)\n````"
    number = F.regexp_extract("path", r"\Asources/pdf-pages/page-(\d{4})\.md\z", 1)
    rows = notes.filter((number != "") & F.col("text").rlike(fence)).select(
        number.cast("int").alias("page"), T.strip(F.regexp_extract("text", fence, 1)).alias("text")
    )
    return rows.join(scope.select("page"), "page", "left_semi")


def cited(text: Column, scope: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(PAGE_LINK), F.lit(1)), lambda n: n.cast("int"))
    return F.array_sort(F.array_intersect(F.array_distinct(found), scope))


def packets(notes: DataFrame, size: int = NOTES) -> DataFrame:
    """packet, path, pages, text: notes by first page, then path, in chunks. notes: path, text, pages."""
    first = F.when(F.size("pages") > 0, F.element_at("pages", 1)).otherwise(NO_PAGE)
    ranked = chunk(notes.withColumn("__first", first), size, "__first", "path", name="packet")
    return ranked.select("packet", "path", "pages", F.left("text", F.lit(NOTE_CHARACTERS)).alias("text"))


def cap(packed: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` packets, and one row with how many were left out."""
    if most is None:
        return packed, packed.agg(F.lit(0).cast("long").alias("skipped"))
    return packed.filter(F.col("packet") < most), packed.filter(F.col("packet") >= most).agg(F.count_distinct("packet").alias("skipped"))


def page_demand(packed: DataFrame, pages: DataFrame) -> DataFrame:
    """packet, page, demand, chars of the cited pages that exist. pages: page, chars."""
    asked = packed.select("packet", "path", F.explode(F.array_distinct("pages")).alias("page"))
    return asked.groupBy("packet", "page").agg(F.count("*").alias("demand")).join(pages.select("page", "chars"), "page")


def within_budget(ranked: Column, budget: int = BUDGET) -> Column:
    """Pages taken from an array of struct(page, chars) in order.

    The first is always taken, whole; a later one that costs more than what remains is
    skipped, and smaller ones after it may still fit.
    """
    start = F.struct(F.array().cast("array<int>").alias("chosen"), F.lit(budget).cast("long").alias("left"))

    def step(a, p):
        take = (F.size(a["chosen"]) == 0) | (p["chars"] <= a["left"])
        return F.when(take, F.struct(
            F.concat(a["chosen"], F.array(p["page"].cast("int"))).alias("chosen"),
            F.greatest(F.lit(0).cast("long"), a["left"] - p["chars"]).alias("left"),
        )).otherwise(a)

    return F.array_sort(F.aggregate(ranked, start, step, lambda a: a["chosen"]))


def packet_pages(packed: DataFrame, pages: DataFrame, most: int = PAGES, budget: int = BUDGET) -> DataFrame:
    """packet, supplied, omitted: the best-cited pages of a packet within the budget."""
    order = Window.partitionBy("packet").orderBy(F.desc("demand"), "page")
    top = page_demand(packed, pages).withColumn("rank", F.row_number().over(order))
    grouped = top.groupBy("packet").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "page", F.col("chars").cast("long").alias("chars"))))).alias("ranked"),
        F.array_sort(F.collect_set(F.col("page").cast("int"))).alias("wanted"),
    )
    lowest = pages.agg(F.min("page").cast("int").alias("lowest"))
    none = F.array().cast("array<int>")
    chosen = packed.select("packet").distinct().join(grouped, "packet", "left").crossJoin(F.broadcast(lowest)).withColumn(
        "supplied", F.coalesce(within_budget(F.col("ranked"), budget), F.when(F.col("lowest").isNotNull(), F.array("lowest")).otherwise(none))
    )
    return chosen.select("packet", "supplied", F.array_except(F.coalesce("wanted", none), "supplied").alias("omitted"))


def round_report(packets: DataFrame) -> DataFrame:
    """Per round: totals, pages supplied and cited, coverage.

    packets: round, notes, pages_supplied, pages_cited, findings, error, skipped, reduced.
    """
    pages = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = packets.groupBy("round").agg(
        F.count("*").alias("packet_count"), F.sum(F.size("notes")).alias("note_count"), F.sum("findings").alias("material_findings"),
        pages("pages_supplied").alias("pages_reviewed"), pages("pages_cited").alias("cited"),
        F.bool_or(F.col("error").isNotNull()).alias("failed"), F.sum("skipped").alias("skipped"), F.sum("reduced").alias("reduced"),
    )
    lost = F.array_except("cited", "pages_reviewed")
    partial = F.col("failed") | (F.col("skipped") > 0) | (F.col("reduced") > 0) | (F.size(lost) > 0)
    return out.select(
        "round", "packet_count", "note_count", "material_findings", "pages_reviewed", lost.alias("pages_never_supplied"),
        F.when(F.col("failed"), "failed").otherwise("passed").alias("execution_status"),
        F.when(~F.col("failed") & (F.col("material_findings") == 0), "clear").otherwise("findings").alias("finding_status"),
        F.when(partial, "partial").otherwise("complete").alias("coverage"),
    )


def coverage(rounds: DataFrame, notes: Column) -> DataFrame:
    """One row folded over the rounds in order.

    rounds: round, reviewed (notes read), repaired (notes changed after it), supplied,
    cited. A repaired note is pending again until a later round reads it.
    """
    none = F.array().cast("array<int>")
    start = F.struct(notes.alias("pending"), F.array().cast("array<string>").alias("seen"), none.alias("pages"), none.alias("cited"))
    step = lambda a, r: F.struct(
        F.array_union(F.array_except(a["pending"], r["reviewed"]), r["repaired"]).alias("pending"),
        F.array_union(a["seen"], r["reviewed"]).alias("seen"),
        F.array_union(a["pages"], r["supplied"]).alias("pages"), F.array_union(a["cited"], r["cited"]).alias("cited"),
    )
    folded = rounds.agg(F.array_sort(F.collect_list(F.struct("round", "reviewed", "repaired", "supplied", "cited"))).alias("rs")).select(
        F.aggregate("rs", start, step).alias("a")
    )
    lost = F.array_sort(F.array_except("a.cited", "a.pages"))
    return folded.select(
        F.array_sort("a.pages").alias("pages_reviewed"), lost.alias("pages_never_supplied"), F.array_sort("a.seen").alias("notes_reviewed"),
        F.array_sort("a.pending").alias("notes_pending"),
        F.when(F.size(lost) == 0, "complete").otherwise("incomplete").alias("page_coverage"),
        F.when((F.size(lost) == 0) & (F.size("a.pending") == 0), "complete").otherwise("partial").alias("coverage"),
    )


def packet_prompt(packed: DataFrame, supplied: DataFrame, pages: DataFrame) -> DataFrame:
    """packet, prompt: the notes and whole pages of a packet as one text."""
    block = lambda head, body: F.concat(F.lit("## "), head, F.lit("\n\n"), body, F.lit("\n"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["block"]), "\n")
    notes = packed.groupBy("packet").agg(joined(F.struct("path", block(F.col("path"), F.col("text")).alias("block"))).alias("notes"))
    shown = supplied.select("packet", F.explode("supplied").alias("page")).join(pages, "page")
    evidence = shown.groupBy("packet").agg(
        joined(F.struct("page", block(F.concat(F.lit("Page "), F.col("page").cast("string")), F.col("text")).alias("block"))).alias("evidence")
    )
    return notes.join(evidence, "packet", "left").select("packet", F.concat_ws("\n", "notes", "evidence").alias("prompt"))
