"""Corpus lint and metadata audit: each rule is a frame of issues, and all are united."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.frontmatter import front_matter
from marginalia.operators import linkgraph as G

# Note types by folder, root note and exception; headings; words of absence.
FOLDER_TYPES = {
    "chapters": "Chapter", "sections": "Section", "cases": "Case Dossier", "concepts": "Concept",
    "people": "Person", "synthesis": "Synthesis", "sources": "Source Guide", "reference": "Source Guide",
}
ROOT_TYPES = {"overview.md": "Overview", "reading-guide.md": "Reading Guide"}
TYPE_EXCEPTIONS = {"synthesis/open-questions.md": "Open Question"}
SOURCES = r"(?m)^## Sources\s*$"
CITATION = r"(?m)^\*[^*]+\*,.*?(?:ch\.|pp\.)"
INSTANCES = r"(?m)^## Instances in scope\s*$"
GUARDRAIL = r"(?m)^## (?:What this licenses and what it does not|Evidence status)\s*$"
LIMITS = r"(?ms)^## Evidence limits\s*$(.*?)(?=^## |\z)"
ABSENCE = (
    r"(?i)\b(no|not|none|never|nothing|without|absent|lacks?|lacking|missing|"
    r"unnamed|unattributed|uncorroborated|unverified|does not|do not|is not|are not)\b"
)
PAGE_LINK = r"(?:sources/)?pdf-pages/page-(\d{4})\.md"
LOG_ENTRY = r"(?m)^(?:- |## \[\d{4}-\d{2}-\d{2}\])"
STRUCTURAL = ("WIKI_GUIDE.md", "AGENTS.md", "README.md")
NO_BLOCK = ("index.md", "log.md")
AUDIT_KINDS = (
    "missing-fm", "wrong-type", "missing-type", "unknown-location", "title-mismatch", "missing-title",
    "weak-description", "missing-tags", "not-draft-unverified", "missing-sources", "no-fm-expected",
)
SHORTEST_DESCRIPTION = 8


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def expected_type(path: Column) -> Column:
    nested = F.contains(path, F.lit("/"))
    return F.coalesce(
        _lookup(TYPE_EXCEPTIONS, path),
        F.when(nested, _lookup(FOLDER_TYPES, F.split_part(path, F.lit("/"), F.lit(1)))).otherwise(_lookup(ROOT_TYPES, path)),
    )


def cited_pages(text: Column) -> Column:
    """Pages that the whole file links to, its metadata block included."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PAGE_LINK), F.lit(1)), lambda n: n.cast("int"))))


# The kinds of issues below and what each says.


def _issues(df: DataFrame, kind: str, detail: Column, file: str = "path") -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(file).alias("file"), detail.alias("detail"))


def _quoted(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("None")).otherwise(F.concat(F.lit("'"), x, F.lit("'")))


def parsed(notes: DataFrame) -> DataFrame:
    """notes with fm, the fields of the leading block."""
    return notes.withColumn("fm", front_matter(F.col("text")))


def lint(notes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """kind, file, detail of every issue.

    notes: path, text (null where a file is not valid UTF-8). files: path of everything
    that links and images may point at; the notes themselves by default. A corpus
    without its catalogue has that single issue.
    """
    notes = notes.withColumn("text", F.regexp_replace("text", r"\A\x{FEFF}", ""))
    files = notes.select("path") if files is None else files.select("path").unionByName(notes.select("path"))
    every = G.kept(notes)
    readable = every.filter("text IS NOT NULL")
    linking = readable.filter(~T.name(F.col("path")).isin(*[s for s in G.SPECIAL if s != "index.md"]))
    rules = [_issues(every.filter("text IS NULL"), "bad-encoding", F.lit("file is not valid UTF-8"))]
    rules += link_rules(linking, every, files)
    rules += catalogue_rules(readable, files)
    rules.append(note_rules(parsed(G.checked(readable))))
    titled = G.checked(readable).select("path", T.first_line(T.without_block(F.col("text"))).alias("line")).filter("line LIKE '# %'")
    shared = titled.groupBy(T.strip(F.substr("line", F.lit(3))).alias("title")).agg(F.array_sort(F.collect_list("path")).alias("paths")).filter(F.size("paths") > 1)
    rules.append(_issues(shared.withColumn("path", F.col("paths")[0]), "duplicate-title", F.concat(
        F.lit("title "), _quoted(F.col("title")), F.lit(" is shared by "), F.array_join("paths", ", "))))
    rules.append(_issues(G.orphans(readable), "orphan", F.lit("no other note links to this one")))
    has = notes.agg(
        F.coalesce(F.bool_or(F.col("path") == "index.md"), F.lit(False)).alias("index"),
        F.coalesce(F.bool_or((F.col("path") == "log.md") & F.coalesce(F.col("text").rlike(LOG_ENTRY), F.lit(False))), F.lit(False)).alias("log"),
    )
    rules.append(_issues(has.filter("NOT log").withColumn("path", F.lit("log.md")), "empty-log", F.lit("log.md missing or has no entries")))
    found = reduce(DataFrame.unionByName, rules)
    whole = F.broadcast(has.select("index"))
    missing = has.filter("NOT index").select(F.lit("no-index").alias("kind"), F.lit("index.md").alias("file"), F.lit("index.md missing").alias("detail"))
    return found.crossJoin(whole).filter("index").drop("index").unionByName(missing)


def link_rules(linking: DataFrame, every: DataFrame, files: DataFrame) -> list[DataFrame]:
    links = G.broken(G.note_links(linking), files)
    slugs = every.select(T.stem(F.col("path")).alias("slug")).distinct()
    wiki = G.found_links(linking, G.WIKILINK).withColumn("slug", T.strip(F.col("raw"))).join(slugs, "slug", "left_anti")
    images = G.found_links(linking, G.IMAGE).filter(~G.is_remote(F.col("raw"), "data:"))
    lost = G.broken(images.withColumn("target", T.normal_path(F.concat_ws("/", F.nullif(T.parent(F.col("source")), F.lit("")), F.col("raw")))), files)
    return [
        _issues(links, "broken-link", F.concat(F.lit("link to "), F.col("raw"), F.lit(" does not resolve")), "source"),
        _issues(wiki, "broken-link", F.concat(F.lit("wikilink [["), F.col("slug"), F.lit("]] matches no note")), "source"),
        _issues(lost, "broken-image", F.concat(F.lit("image "), F.col("raw"), F.lit(" does not resolve")), "source"),
    ]


def catalogue_rules(readable: DataFrame, files: DataFrame) -> list[DataFrame]:
    listed = G.catalogued(readable)
    ghosts = listed.join(files.select("path").distinct(), "path", "left_anti")
    unlisted = G.checked(readable).filter(~G.is_gateway(F.col("path"))).join(listed, "path", "left_anti")
    ghost_detail = F.concat(F.lit("index links missing file "), T.name(F.col("path")))
    return [
        ghosts.select(F.lit("index-ghost").alias("kind"), F.lit("index.md").alias("file"), ghost_detail.alias("detail")),
        _issues(unlisted, "not-in-index", F.lit("note not listed in index.md")),
    ]


def note_rules(notes: DataFrame) -> DataFrame:
    """Rules over one note each, in one pass. notes: path, text, fm."""
    text, kind = F.col("text"), F.col("fm.type")
    line = T.first_line(T.without_block(text))
    limits = F.regexp_extract(text, LIMITS, 1)
    has_limits = text.rlike(LIMITS)
    lone = F.array_except(F.col("fm.pages"), cited_pages(text))
    pages = F.col("fm.pages_kind")
    rules = [
        ("no-sources", ~(text.rlike(SOURCES) | text.rlike(CITATION)), F.lit("no '## Sources' section and no inline citation line")),
        ("no-title", ~line.startswith("# "), F.lit("first line is not an H1 title")),
        ("no-instances", (kind == "Concept") & ~text.rlike(INSTANCES), F.lit("a Concept must list its instances under '## Instances in scope'")),
        ("no-guardrail", (kind == "Concept") & ~text.rlike(GUARDRAIL), F.lit("a Concept must state what it licenses or its evidence status")),
        ("no-evidence-limits", (kind == "Case Dossier") & ~has_limits, F.lit("a Case Dossier must have an '## Evidence limits' section")),
        ("no-evidence-limits", (kind == "Case Dossier") & has_limits & ~limits.rlike(ABSENCE), F.lit("the 'Evidence limits' section names no absence")),
        ("bad-locators", pages == "not-list", F.lit("'pdf_pages' must be a list of page numbers")),
        ("bad-locators", pages == "not-number", F.lit("'pdf_pages' contains a non-numeric entry")),
        ("bad-locators", (pages == "list") & (F.size(lone) > 0), F.concat(
            F.lit("front matter claims pages that the body never links: "), F.array_join(F.transform(lone, lambda p: p.cast("string")), ", "))),
        *[("bad-front-matter", c, d) for c, d in block_rules(line)],
    ]
    issue = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    cut_short = F.transform(F.col("fm.truncated"), lambda k: issue(
        "bad-front-matter", F.concat(F.lit("unquoted '#' in front-matter '"), k, F.lit("' - double-quote the value"))))
    found = F.concat(cut_short, F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), issue(k, d)) for k, c, d in rules])))
    return notes.select(F.col("path").alias("file"), F.explode(found).alias("i")).select("i.kind", "file", "i.detail")


def block_rules(line: Column) -> list[tuple[Column, Column]]:
    """The metadata contract as (condition, detail); gateways answer for structure and title only."""
    path, fm = F.col("path"), F.col("fm")
    closed, own = fm["closed"], ~G.is_gateway(F.col("path"))
    title, wanted = T.strip(fm["title"]), expected_type(F.col("path"))
    heading = T.strip(F.substr(line, F.lit(3)))
    rest = closed & own
    return [
        (~fm["opened"], F.lit("note does not start with a '---' front-matter block")),
        (fm["opened"] & ~closed, F.lit("front-matter block has no closing '---'")),
        (closed & fm["title"].isNull(), F.lit("front matter has no 'title'")),
        (closed & line.startswith("# ") & (title != heading), F.concat(F.lit("front-matter title "), _quoted(title), F.lit(" != H1 "), _quoted(heading))),
        (rest & wanted.isNull(), F.lit("note sits outside the guide's folder vocabulary")),
        (rest & wanted.isNotNull() & ~fm["type"].eqNullSafe(wanted), F.concat(F.lit("type "), _quoted(fm["type"]), F.lit(" != "), _quoted(wanted), F.lit(" required for "), path)),
        (rest & ~T.nonempty(fm["description"]), F.lit("front matter has no 'description'")),
        (rest & (fm["tags"] < 1), F.lit("'tags' missing, empty, or not a list")),
        (rest & ~fm["semantic"], F.lit("every compiled note needs 'semantic_note: true'")),
        (rest & ~fm["status"].eqNullSafe(F.lit("draft")), F.concat(F.lit("status must be 'draft', got "), _quoted(fm["status"]))),
        (rest & fm["verified_present"] & ~fm["verified_false"], F.lit("'verified' must be absent")),
        (rest & (fm["sources"] < 1), F.lit("'sources' must be a non-empty list of source locators")),
        (rest & (fm["sources"] > 0) & fm["sources_bad"], F.lit("each source entry needs a non-empty 'resource'")),
    ]


def audit(notes: DataFrame, *carry: str) -> DataFrame:
    """kind, relpath, detail, severity of the metadata audit; ``carry`` names columns to keep."""
    every = G.kept(notes).filter(~T.name(F.col("path")).isin(*STRUCTURAL))
    bare = T.name(F.col("path")).isin(*NO_BLOCK)
    frame = parsed(every)
    fm, path = F.col("fm"), F.col("path")
    own, wanted = ~G.is_gateway(F.col("path")), expected_type(F.col("path"))
    heading = T.first_h1(fm["body"])
    title, described = T.strip(fm["title"]), T.word_count(fm["description"])
    usable = ~bare & (F.size(fm["meta"]) > 0) & fm["opened"]
    typed = T.nonempty(fm["type"])
    draft = fm["semantic"] & fm["status"].eqNullSafe(F.lit("draft")) & (~fm["verified_present"] | fm["verified_false"])
    rules = [
        ("no-fm-expected", bare & fm["opened"], F.concat(T.name(path), F.lit(" must not start with YAML front matter"))),
        ("missing-fm", ~bare & ~fm["opened"], F.lit("note has no '---' front-matter block")),
        ("missing-fm", ~bare & fm["opened"] & (F.size(fm["meta"]) == 0), F.lit("front matter is empty or has no closing '---'")),
        ("missing-type", usable & ~typed, F.lit("front matter has no 'type' field")),
        ("unknown-location", usable & typed & own & wanted.isNull(), F.lit("note sits outside the guide's folder vocabulary")),
        ("wrong-type", usable & typed & own & (T.strip(fm["type"]) != wanted), F.concat(F.lit("type "), _quoted(T.strip(fm["type"])), F.lit(" != expected "), _quoted(wanted))),
        ("missing-title", usable & ~T.nonempty(fm["title"]), F.lit("front matter has no 'title' field")),
        ("title-mismatch", usable & T.nonempty(fm["title"]) & heading.isNull(), F.concat(F.lit("title "), _quoted(title), F.lit(" but no H1 in body"))),
        ("title-mismatch", usable & T.nonempty(fm["title"]) & (title != T.strip(heading)), F.concat(F.lit("title "), _quoted(title), F.lit(" != H1 "), _quoted(T.strip(heading)))),
        ("weak-description", usable & ~fm["described"], F.lit("description missing or empty")),
        ("weak-description", usable & fm["described"] & (described < SHORTEST_DESCRIPTION), F.concat(F.lit("description has only "), described.cast("string"), F.lit(" words (minimum 8)"))),
        ("missing-tags", usable & (fm["tags"] < 1), F.lit("'tags' missing, empty, or not a list")),
        ("not-draft-unverified", usable & own & ~draft, F.lit("compiled notes must carry semantic_note: true, status: draft, and no 'verified' key")),
        ("missing-sources", usable & own & (fm["sources"] < 1), F.lit("'sources' must be a non-empty list of source locators")),
        ("missing-sources", usable & own & (fm["sources"] > 0) & fm["sources_bad"], F.lit("each source entry needs a non-empty 'resource'")),
    ]
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("kind"), d.alias("detail"))) for k, c, d in rules
    ]))
    return frame.select(*carry, "path", F.explode(found).alias("f")).select(
        *carry, "f.kind", F.col("path").alias("relpath"), "f.detail", F.lit("error").alias("severity")
    )


def pivot(rows: DataFrame, key: str, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """key and one zero-filled count per kind, in a fixed order; other kinds are left out."""
    return rows.groupBy(key).pivot(kind, list(kinds)).count().na.fill(0)


def audit_table(snapshots: DataFrame) -> DataFrame:
    """dir, notes, errors and one zero-filled column per kind; snapshots: dir, path, text."""
    ruled = G.kept(snapshots).filter(~T.name(F.col("path")).isin(*STRUCTURAL, *NO_BLOCK))
    kinds = pivot(audit(snapshots, "dir"), "dir", "kind", AUDIT_KINDS)
    filled = (
        snapshots.select("dir").distinct().join(ruled.groupBy("dir").agg(F.count("*").alias("notes")), "dir", "left")
        .join(kinds, "dir", "left").na.fill(0)
    )
    columns = [F.col(f"`{k}`") for k in AUDIT_KINDS]
    return filled.select("dir", "notes", sum(columns[1:], columns[0]).alias("errors"), *columns)
