"""A note corpus made of the documents table: one note per document, faults by its number.

The table has no notes, links or metadata. So every document gets a note whose faults
follow from its ``doc_id`` alone, which lets SQL say what each operator must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import table

FOLDERS = ("concepts", "cases", "people", "odd")
TYPES = ("Concept", "Case Dossier", "Person", "Concept")
TITLES = 40
INDEX = "# Index\n\n- [first](concepts/d0.md)\n- [gone](concepts/gone.md)\n- [[d1]]\n"
LOG = "# Log\n\n- started\n"
#: Files that are no notes.
FILES = ("sources/pdf-pages/page-0001.md", "concepts/img/m.png")


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.array(*map(F.lit, values))[F.pmod(i, F.lit(len(values))).cast("int")]


def path_of(i: Column) -> Column:
    return F.concat(_pick(FOLDERS, i), F.lit("/d"), i.cast("string"), F.lit(".md"))


def note_of(i: Column) -> Column:
    every = lambda n, k=0: F.pmod(i, F.lit(n)) == k
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit("\n"))
    some = lambda wanted, text: F.when(wanted, text).otherwise("")
    title = F.concat(F.lit("Title "), F.pmod(i, F.lit(TITLES)).cast("string"))
    block = F.concat(
        line("---"), line("type: ", F.when(every(7), "Overview").otherwise(_pick(TYPES, i))), line("title: ", title),
        line("description: ", F.trim(F.repeat(F.lit("word "), F.pmod(i, F.lit(12)).cast("int")))),
        some(~every(5), line("tags: [a, b]")),
        line("pdf_pages: ", F.when(every(41), "one").when(every(3), "[1, 2]").otherwise("[1]")),
        line("semantic_note: ", F.when(every(13), "false").otherwise("true")),
        line("status: ", F.when(every(23), "final").otherwise("draft")), some(every(29), line("verified: yes")),
        some(~every(31), line("sources:\n  - { resource: book.pdf, page: 1 }")), some(~every(19, 1), line("---")),
    )
    heading = F.when(every(11), F.concat(F.lit("Other "), i.cast("string"))).otherwise(title)
    concept, case = every(4) | every(4, 3), every(4, 1)
    body = F.concat(
        line("# ", heading, "\n"), line("[next](../", path_of(i + 3), ")\n"), line("[page](../sources/pdf-pages/page-0001.md)\n"),
        some(every(6), line("[[d", (i + 2).cast("string"), "]]\n")), some(every(10), line("![m](img/m.png)\n")),
        some(every(14), line("[web](https://example.com/a.md)\n")),
        some(concept & ~every(8) & ~every(8, 3), line("## Instances in scope\n\n- one\n")), some(concept & ~every(5, 2), line("## Evidence status\n\nGood.\n")),
        some(case & ~every(3), line("## Evidence limits\n\n", F.when(every(3, 1), "Only praise.").otherwise("It is not known."), "\n")),
        some(~every(37), line("## Sources\n\n- Book")),
    )
    return F.concat(some(~every(17), block), body)


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """path, text, source, doc_id; the catalogue, the log and an unreadable file among them."""
    i = F.col("doc_id")
    own = table(spark, sf, "documents").select(path_of(i).alias("path"), note_of(i).alias("text"), "source", "doc_id")
    more = [("index.md", INDEX), ("log.md", LOG), ("people/unread.md", None)]
    return own.unionByName(spark.createDataFrame(more, "path string, text string"), allowMissingColumns=True)


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f,) for f in FILES], "path string")


def sql_path(i: str) -> str:
    """SQL for the path of document ``i``."""
    return f"(['concepts', 'cases', 'people', 'odd'])[({i}) % 4 + 1] || '/d' || ({i}) || '.md'"


#: SQL: every note with its number, path, block state and titles; ``d`` knows all numbers.
SQL_NOTES = f"""d AS (SELECT doc_id AS i, source FROM documents),
n AS (
  SELECT i, source, {sql_path('i')} AS path, (['concepts', 'cases', 'people', 'odd'])[i % 4 + 1] AS folder,
         i % 17 <> 0 AS opened, i % 17 <> 0 AND i % 19 <> 1 AS closed, 'Title ' || (i % {TITLES}) AS title,
         CASE WHEN i % 11 = 0 THEN 'Other ' || i ELSE 'Title ' || (i % {TITLES}) END AS heading,
         CASE WHEN i % 7 = 0 THEN 'Overview' ELSE (['Concept', 'Case Dossier', 'Person', 'Concept'])[i % 4 + 1] END AS kind,
         (['Concept', 'Case Dossier', 'Person', NULL])[i % 4 + 1] AS wanted
  FROM d
)"""
