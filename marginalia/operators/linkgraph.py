"""The link graph of a note corpus. notes: path, text; files: path of everything that exists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.unicode import casefold

# Link shapes, and names and folders with a role of their own.
NOTE_LINK = r"\[[^\]]*\]\(([^)#\s]+\.md)\)"
WIKILINK = r"\[\[([^\]|#]+)(?:\|[^\]]*)?\]\]"
IMAGE = r"!\[[^\]]*\]\(([^)\s]+)\)"
ANY_WIKILINK = r"\[\[([^\]]+)\]\]"
ANY_LINK = r"(?<!!)\[[^\]]*\]\(([^)]+)\)"
SPECIAL = ("index.md", "log.md", "WIKI_GUIDE.md", "AGENTS.md", "README.md")
SKIPPED_FOLDERS = ("_ingest", "_plan", "_schema", "reports", "audit")
ORPHAN_EXEMPT = ("AGENTS.md", "README.md", "index.md", "log.md")
SHOWN_CANDIDATES = 8


def folders(path):
    every = T.parts(path)
    return F.slice(every, 1, F.size(every) - 1)


def in_skipped(path):
    return F.arrays_overlap(folders(path), F.array(*map(F.lit, SKIPPED_FOLDERS))) & (F.size(folders(path)) > 0)


def is_gateway(path):
    return path.startswith("sources/pdf-pages/") | (path == "sources/pdf-pages")


def kept(notes: DataFrame) -> DataFrame:
    """Markdown notes outside the skipped folders."""
    return notes.filter(F.col("path").endswith(".md") & ~F.coalesce(in_skipped(F.col("path")), F.lit(False)))


def checked(notes: DataFrame) -> DataFrame:
    """The notes that per-note rules apply to."""
    return kept(notes).filter(~T.name(F.col("path")).isin(*SPECIAL))


def found_links(notes: DataFrame, pattern: str, column: str = "raw") -> DataFrame:
    return notes.select(F.col("path").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias(column))


def is_remote(target, *more: str):
    out = target.startswith("http://") | target.startswith("https://")
    for start in more:
        out = out | target.startswith(start)
    return out


def note_links(notes: DataFrame) -> DataFrame:
    """source, raw, target of links to notes, resolved beside the note."""
    links = found_links(notes, NOTE_LINK).filter(~is_remote(F.col("raw")))
    beside = T.normal_path(F.concat_ws("/", F.nullif(T.parent(F.col("source")), F.lit("")), F.col("raw")))
    return links.withColumn("target", beside)


def broken(links: DataFrame, files: DataFrame) -> DataFrame:
    return links.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_anti")


def without_inbound(nodes: DataFrame, links: DataFrame, node: str = "path") -> DataFrame:
    """The nodes (with their path) that no other node links to. links: source (a ``node``), path.

    Of the links to a path only the least and the greatest source count: if any source
    differs from the node, one of these does. So a path that everything links to is one row.
    """
    ends = links.groupBy("path").agg(F.min("source").alias("__low"), F.max("source").alias("__high"))
    linked = F.coalesce((F.col("__low") != F.col(node)) | (F.col("__high") != F.col(node)), F.lit(False))
    return nodes.join(ends, "path", "left").filter(~linked).drop("__low", "__high")


def orphans(notes: DataFrame) -> DataFrame:
    """Checked notes that no other note links to; catalogues and gateways do not count as sources."""
    sources = kept(notes).filter((T.name(F.col("path")) != "index.md") & ~is_gateway(F.col("path")))
    linked = note_links(sources).filter(F.col("target") != F.col("source")).select(F.col("target").alias("path")).distinct()
    return checked(notes).filter(~is_gateway(F.col("path"))).join(linked, "path", "left_anti").select("path")


def catalogued(notes: DataFrame) -> DataFrame:
    """path of every target of the root catalogue, existing or not."""
    index = notes.filter(F.col("path") == "index.md")
    direct = found_links(index, NOTE_LINK).select(T.normal_path(F.col("raw")).alias("path"))
    slugs = found_links(index, WIKILINK).select(T.strip(F.col("raw")).alias("slug"))
    by_slug = kept(notes).select("path", T.stem(F.col("path")).alias("slug")).join(slugs, "slug").select("path")
    return direct.unionByName(by_slug).distinct()


def resolve_wikilinks(notes: DataFrame, files: DataFrame) -> DataFrame:
    """source, raw, target, resolved, problem for every wikilink.

    In order: the path itself, with .md, beside the note, with .md there, the only note
    of that stem. Each step is one equality join; the first that finds anything counts.
    """
    links = found_links(notes, ANY_WIKILINK).select("source", "raw", T.wikilink_target(F.col("raw")).alias("target"))
    bare = T.suffix(F.col("target")) == ""
    beside = F.concat_ws("/", F.nullif(T.parent(F.col("source")), F.lit("")), F.col("target"))
    tries = F.array(
        T.normal_path(F.col("target")), F.when(bare, T.normal_path(F.concat("target", F.lit(".md")))),
        T.normal_path(beside), F.when(bare, T.normal_path(F.concat(beside, F.lit(".md")))),
    )
    hits = (
        links.select("source", "raw", F.posexplode(tries).alias("rank", "path")).filter("path IS NOT NULL AND path <> ''")
        .join(files.select("path").distinct(), "path").groupBy("source", "raw").agg(F.min(F.struct("rank", "path")).alias("hit"))
        .select("source", "raw", F.col("hit.path").alias("direct"))
    )
    stems = notes.groupBy(casefold(T.stem(F.col("path"))).alias("key")).agg(
        F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("path")), 1, SHOWN_CANDIDATES).alias("options")
    )
    joined = links.join(hits, ["source", "raw"], "left").withColumn("key", casefold(T.stem(F.col("target")))).join(stems, "key", "left")
    empty, direct = F.col("target") == "", F.col("direct").isNotNull()
    return joined.select(
        "source", "raw", "target",
        F.when(empty, F.col("source")).when(direct, F.col("direct")).when(F.col("n") == 1, F.col("options")[0]).alias("resolved"),
        F.when(empty | direct | (F.col("n") == 1), F.lit(None)).when(
            F.col("n") > 1, F.concat(F.lit("ambiguous; candidates: "), F.array_join("options", ", "))
        ).otherwise("target does not exist").alias("problem"),
    )


def resolve_markdown(notes: DataFrame, files: DataFrame) -> DataFrame:
    """source, raw, target, external, resolved, problem for every Markdown link."""
    links = found_links(notes, ANY_LINK).withColumn("target", T.markdown_target(F.col("raw")))
    path = T.resolve(F.col("source"), F.col("target"))
    located = links.withColumns({"external": T.is_external(F.col("target")), "path": path})
    tries = F.array(F.col("path"), F.concat_ws("/", F.nullif(F.col("path"), F.lit("")), F.lit("index.md")))
    hits = (
        located.filter("NOT external").select("source", "raw", F.posexplode(tries).alias("rank", "path"))
        .join(files.select("path").distinct(), "path").groupBy("source", "raw").agg(F.min(F.struct("rank", "path")).alias("hit"))
        .select("source", "raw", F.col("hit.path").alias("resolved"))
    )
    return located.drop("path").join(hits, ["source", "raw"], "left").select(
        "source", "raw", "target", "external", "resolved",
        F.when(~F.col("external") & F.col("resolved").isNull(), "target does not exist").alias("problem"),
    )


def duplicate_titles(notes: DataFrame) -> DataFrame:
    """title, paths of titles that several notes share, letter case aside."""
    titled = notes.select("path", casefold(T.note_title(F.col("path"), F.col("text"))).alias("title"))
    return titled.groupBy("title").agg(F.array_sort(F.collect_list("path")).alias("paths")).filter(F.size("paths") > 1)


def vault_report(notes: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """problems, duplicate_titles, orphans and one row of counts with the status."""
    wiki, markdown = resolve_wikilinks(notes, files), resolve_markdown(notes, files)
    problems = wiki.filter("problem IS NOT NULL").select("source", F.col("raw").alias("target"), F.lit("wikilink").alias("kind"), "problem").unionByName(
        markdown.filter("problem IS NOT NULL").select("source", F.col("raw").alias("target"), F.lit("markdown-link").alias("kind"), "problem")
    )
    inbound = wiki.select(F.col("resolved").alias("path")).unionByName(markdown.select(F.col("resolved").alias("path"))).filter("path IS NOT NULL").groupBy("path").count()
    lonely = (
        notes.filter(~T.name(F.col("path")).isin(*ORPHAN_EXEMPT) & ~F.col("path").startswith("reports/"))
        .join(inbound, "path", "left_anti").select("path")
    )
    titles = duplicate_titles(notes)
    one = lambda df, name, c=None: df.agg((F.count("*") if c is None else F.count_if(c)).alias(name))
    counts = (
        one(notes, "markdown_files").crossJoin(one(wiki, "wikilinks")).crossJoin(one(markdown, "markdown_links", ~F.col("external")))
        .crossJoin(one(markdown, "external_links", F.col("external"))).crossJoin(one(problems, "broken_or_ambiguous_links"))
        .crossJoin(one(titles, "duplicate_titles")).crossJoin(one(lonely, "orphan_notes"))
    )
    clean = (F.col("broken_or_ambiguous_links") == 0) & (F.col("duplicate_titles") == 0) & (F.col("orphan_notes") == 0)
    counts = counts.withColumn("status", F.when(clean, "passed").otherwise("failed"))
    return {"problems": problems, "duplicate_titles": titles, "orphans": lonely, "inbound": inbound, "counts": counts}
