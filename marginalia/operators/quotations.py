"""Quotation verification: does the source carry what a note quotes, and on a page it cites?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.unicode import RETENTION, comparable_forms, comparable_parts, normalise
from marginalia.operators import linkgraph as G
from marginalia.operators.lint import PAGE_LINK
from marginalia.operators.passages import PassageIndex, in_order, scanned
from marginalia.scratch import cut, scratch_path, temporary

# Shortest quotation and fragment, length of a report's quote, edge marks.
SHORTEST, FRAGMENT, SHOWN = 40, 4, 120
EDGES = " .,;:!?'\"-–—"
SKIPPED_PARTS = ("_schema", ".obsidian", "reports", "audit")
TABLE_ROW = r"(?m)^\s*\|.*\|\s*$"
#: Characters of a scope that is searched as one text; larger ones are indexed.
DIRECT = 1 << 20
#: Characters of passages that are sent to where the texts are; for more of them the texts are indexed.
SENT = 1 << 24
FIRST_BLOCK = r"(?ms)^---.*?^---\s*"


def needle(normal: Column) -> Column:
    """What must occur in the source, from a normalised quotation."""
    edge = r"[ .,;:!?'\"\-–—]+"
    inner = F.regexp_replace(normal, rf"\A{edge}|{edge}\z", "")
    return T.strip(F.regexp_replace(inner, r"\A…+|…+\z", ""))


def fragments(of: Column) -> Column:
    """The parts between ellipses that are long enough to mean something."""
    parts = F.filter(F.split(of, r"\s*(?:…|\.\.\.)\s*"), lambda p: F.length(T.strip(p)) >= FRAGMENT)
    return F.when(F.size(parts) > 0, F.transform(parts, T.strip)).otherwise(F.array(of))


def ordered_in(hay: Column, parts: Column) -> Column:
    """Whether all parts occur, each after the one before it."""

    def run(text: Column) -> Column:
        find = lambda at, p: F.call_function("locate", p, text, at)
        step = lambda at, p: F.when(at > 0, F.when(find(at, p) > 0, find(at, p) + F.length(p)).otherwise(0)).otherwise(0)
        return F.aggregate(parts, F.lit(1), step) > 0

    return T.bound(hay, run)


def straight_quoted(body: Column, shortest: int = SHORTEST) -> Column:
    """Spans between the first and second, third and fourth ... straight mark of each line."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda line: ~F.regexp_replace(line, r"\A\s+", "").startswith("```"))

    def spans(line: Column) -> Column:
        # Piece i lies between marks i-1 and i; odd pieces with a mark behind them are quoted.
        odd = lambda pieces: F.filter(pieces, lambda p, i: (i % 2 == 1) & (i < F.size(pieces) - 1))
        return T.bound(F.split(line, '"', -1), odd)

    return F.filter(
        F.flatten(F.transform(lines, spans)),
        lambda s: (F.length(s) >= shortest) & ~F.contains(s, F.lit("“")) & ~F.contains(s, F.lit("”")),
    )


def quoted(text: Column, shortest: int = SHORTEST) -> Column:
    """Quotations of a note in order: directional first, then straight; own prose left out."""
    body = F.regexp_replace(text, r"\r\n", "\n")
    first = F.regexp_extract(body, FIRST_BLOCK, 0)
    at = F.instr(body, first)
    dropped = F.when(first == "", body).otherwise(F.concat(F.substr(body, F.lit(1), at - 1), F.substr(body, at + F.length(first))))
    own = T.without_constructed(F.regexp_replace(dropped, TABLE_ROW, ""))
    curly = F.regexp_extract_all(own, F.lit(rf"(?s)“([^“”]{{{shortest},}}?)”"), F.lit(1))
    every = F.transform(F.concat(curly, straight_quoted(own, shortest)), T.strip)
    return F.filter(every, lambda q: ~F.contains(q, F.lit("](")) & ~q.startswith("#") & ~F.contains(q, F.lit('"')))


def quotations(notes: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """note, ord, quote, needle, pages: distinct quotations of the semantic notes."""
    parts = T.parts(F.col("path"))
    skipped = F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_PARTS))) | G.is_gateway(F.col("path"))
    own = notes.filter(~skipped & T.is_semantic(F.col("text")))
    pages = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("(?i)" + PAGE_LINK), F.lit(1)), lambda n: n.cast("int")))
    spans = own.select(F.col("path").alias("note"), pages.alias("pages"), F.posexplode(quoted(F.col("text"), shortest)).alias("ord", "quote"))
    keyed = spans.withColumn("needle", needle(normalise(F.col("quote")))).filter("needle <> ''")
    first = keyed.groupBy("note", "needle").agg(F.min(F.struct("ord", "quote", "pages")).alias("q"))
    return first.select("note", "q.ord", "q.quote", "needle", "q.pages")


def source_pages(notes: DataFrame) -> DataFrame:
    """page, text of the gateway notes."""
    number = F.regexp_extract("path", r"\Asources/pdf-pages/page-(\d+)\.md\z", 1)
    return notes.filter(number != "").select(number.cast("int").alias("page"), T.fenced_text(F.col("text")).alias("text"))


def comparable_pages(pages: DataFrame) -> DataFrame:
    """page, tight, latin, kept, letters of pages (page, text): the two forms that quotations are sought in."""
    return pages.select("page", comparable_forms(F.coalesce("text", F.lit(""))).alias("f")).select("page", "f.*")


def sought(asked: DataFrame) -> DataFrame:
    """Adds tight and latin, the parts of ``needle`` in either form; latin is null where it may not be compared.

    A part that occurs as it is occurs without white space, too, so that form stands for both.
    """
    parts = fragments(F.col("needle"))
    return asked.withColumns({"tight": F.transform(parts, T.squeeze), "latin": comparable_parts(parts)})


def supported(asked: DataFrame, pages: DataFrame, direct: int = DIRECT) -> DataFrame:
    """The (scope, needle) whose parts occur in order in the scope's pages, joined in order.

    asked: scope, needle, tight, latin. pages: scope, page, tight, latin, kept, letters.
    Scopes of up to ``direct`` characters are searched as one text each; larger ones
    passage by passage where the pages are, or, if there are very many passages, through a
    positional index; neither holds a scope in a row or a task. The Latin form is
    tried where the other one fails and the scope is Latin for the most part.
    """
    sizes = pages.groupBy("scope").agg(
        F.sum(F.length("tight")).alias("size"), (F.sum("kept") >= RETENTION * F.sum("letters")).alias("mostly"), F.sum("kept").alias("kept")
    ).select("scope", "size", (F.col("mostly") & (F.col("kept") > 0)).alias("mostly"))
    with temporary() as keep:
        sizes = cut(sizes.join(asked.select("scope").distinct(), "scope", "left_semi"), "sizes")
        small = sizes.filter(F.col("size") <= direct)
        joined = lambda form: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", form))), lambda p: p[form]), "").alias(form)
        texts = pages.join(small, "scope").groupBy("scope", "mostly").agg(joined("tight"), joined("latin"))
        n = small.limit(2).count()
        if n == 1:
            texts = F.broadcast(texts)  # one row of ``direct`` characters at most
        near = asked.alias("q").join(texts.alias("t"), "scope").filter(
            ordered_in(F.col("t.tight"), F.col("q.tight"))
            | (F.col("mostly") & F.col("q.latin").isNotNull() & ordered_in(F.col("t.latin"), F.coalesce("q.latin", F.array().cast("array<string>"))))
        ).select("scope", "needle")
        large = sizes.filter(F.col("size") > direct)
        if large.isEmpty():
            return keep(cut(near.distinct(), "near"))
        wide = asked.join(large, "scope")
        first = _through_index(wide, pages.join(large, "scope", "left_semi"), "tight")
        left = cut(wide.filter("mostly AND latin IS NOT NULL").join(first, ["scope", "needle"], "left_anti"), "left")
        found = near.unionByName(first) if n else first
        if not left.isEmpty():
            found = found.unionByName(_through_index(left, pages.join(large.filter("mostly"), "scope", "left_semi"), "latin"))
        return keep(cut(found.distinct(), "found"))


def _through_index(asked: DataFrame, pages: DataFrame, form: str) -> DataFrame:
    spark, texts = asked.sparkSession, pages.select("scope", "page", F.col(form).alias("text"))
    lists, index = asked.select("scope", F.col(form).alias("parts")), None
    size = lists.distinct().select(F.explode("parts").alias("p")).agg(F.sum(F.length("p"))).first()[0] or 0
    if size <= SENT:
        found = in_order(lists, lambda passages: scanned(texts, passages))
    else:
        index = PassageIndex(spark, scratch_path(spark, "passages")).build(texts)
        found = index.in_order(lists)
    out = cut(asked.join(found.withColumnRenamed("parts", form), ["scope", form], "left_semi").select("scope", "needle"), "through")
    if index:
        index.drop()
    return out


def status(asked: DataFrame, pages: DataFrame, direct: int = DIRECT) -> DataFrame:
    """note, ord, quote, status: supported by a cited page, elsewhere in the scope, or unsupported.

    asked: note, ord, quote, needle and pages, the numbers that the note cites; a note asks a
    needle once. pages: page, text. Every join is by what a row says, so rows that are
    computed again, after a lost executor, come out the same.
    """
    with temporary() as keep:
        forms = comparable_pages(pages)  # not written: it is made again wherever it is read, texts stay where they are
        rows = cut(sought(asked), "asked")
        named = rows.withColumn("scope", F.col("note"))
        cites = rows.select(F.col("note").alias("scope"), F.explode("pages").alias("page")).distinct()
        of = cut(comparable_pages(pages.join(cites.select("page").distinct(), "page", "left_semi")), "cited")
        cited = supported(named, of.join(cites, "page"), direct).select(F.col("scope").alias("note"), "needle")
        rest = rows.join(cited, ["note", "needle"], "left_anti").withColumn("scope", F.lit(""))
        anywhere = supported(rest, forms.withColumn("scope", F.lit("")), direct).select("needle", F.lit("elsewhere").alias("status"))
        named_all = rows.join(cited.withColumn("found", F.lit(True)), ["note", "needle"], "left").join(anywhere, "needle", "left")
        verdict = F.when(F.col("found"), "supported").otherwise(F.coalesce("status", F.lit("unsupported")))
        return keep(cut(named_all.select("note", "ord", "quote", verdict.alias("status")), "status"))


def verify(notes: DataFrame, shortest: int = SHORTEST, direct: int = DIRECT) -> DataFrame:
    """note, ord, quote, status of every quotation in the semantic notes, over the gateways' page texts."""
    return status(quotations(notes, shortest), source_pages(notes), direct).withColumn("quote", F.left("quote", F.lit(SHOWN)))


def report(notes: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """One row: semantic_notes, checked, supported, elsewhere, unsupported, support_rate, verdict."""
    parts = T.parts(F.col("path"))
    skipped = F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_PARTS))) | G.is_gateway(F.col("path"))
    n = notes.filter(~skipped & T.is_semantic(F.col("text"))).agg(F.count("*").alias("semantic_notes"))
    return summary(n, verify(notes, shortest))


def summary(notes: DataFrame, found: DataFrame) -> DataFrame:
    """The report from the number of semantic notes, one row, and the status of their quotations."""
    one = lambda s: F.count_if(F.col("status") == s)
    counts = found.agg(
        F.count("*").alias("checked"), one("supported").alias("supported"), one("elsewhere").alias("elsewhere"), one("unsupported").alias("unsupported")
    )
    rate = F.round(F.col("supported") / F.nullif("checked", F.lit(0)), 4)
    return notes.crossJoin(counts).withColumns({"support_rate": rate, "verdict": verdict()})


def verdict() -> Column:
    """Findings never fail; notes without a single checked quotation leave the question open."""
    return (
        F.when((F.col("semantic_notes") > 0) & (F.col("checked") == 0), "inconclusive")
        .when(F.col("elsewhere") + F.col("unsupported") > 0, "findings").otherwise("clear")
    )
