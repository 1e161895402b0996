"""Scalar text, path and page expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
WORD = r"(?U)[\w'-]+"
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"
ORDERED_SLUG = r"^\d{2}-[a-z0-9]+(?:-[a-z0-9]+)*\z"
#: Length of a page's opening.
OPENING = 64
#: Leading metadata block, and the key that makes a note count.
LEADING_BLOCK = r"(?s)\A\x{FEFF}?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
SEMANTIC_KEY = r"(?m)^[ \t]*semantic_note[ \t]*:[ \t]*true[ \t]*(?:#.*)?$"
#: Sections that state propositions rather than quote the source.
CONSTRUCTED_SECTIONS = (
    "what this licenses and what it does not",
    "competing readings the material admits",
    "evidence limits",
    "connections",
)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often a lambda in it uses it."""
    return F.transform(F.array(value), body)[0]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, SPACES, " "))


def squeeze(x: Column) -> Column:
    return F.regexp_replace(x, SPACES, "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+\z", "")


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty string."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def opening(text: Column, limit: int = OPENING) -> Column:
    flat = collapse(text)
    cut = rstrip(F.left(flat, F.lit(limit)))
    marked = F.when(F.length(flat) > limit, F.concat(cut, F.lit("…"))).otherwise(cut)
    safe = F.replace(marked, F.lit("|"), F.lit("\\|"))
    return F.when(safe == "", F.lit("—")).otherwise(safe)


def word_count(text: Column) -> Column:
    flat = collapse(text)
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " ")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def nonempty(x: Column) -> Column:
    return F.coalesce(F.length(strip(x)) > 0, F.lit(False))


def is_slug(x: Column, ordered: bool = False) -> Column:
    return F.coalesce(x.rlike(ORDERED_SLUG if ordered else SLUG), F.lit(False))


def valid_pages(pages: Column, scope: Column) -> Column:
    """A non-empty ascending list of distinct pages of the scope."""
    clean = F.coalesce(F.forall(pages, lambda p: p.isNotNull()), F.lit(False))
    return F.coalesce(
        clean & (F.size(pages) > 0) & (F.array_sort(F.array_distinct(pages)) == pages)
        & (F.size(F.array_except(pages, scope)) == 0), F.lit(False),
    )


def unquote(x: Column) -> Column:
    """Percent-decoding that leaves plus signs and malformed escapes alone."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def wikilink_target(raw: Column) -> Column:
    bare = strip(F.substring_index(F.substring_index(raw, "|", 1), "#", 1))
    return F.replace(unquote(bare), F.lit("\\"), F.lit("/"))


def markdown_target(raw: Column) -> Column:
    trimmed = strip(raw)
    bare = F.regexp_replace(trimmed, r"(?s)\A<(.*)>\z", "$1")
    return F.replace(unquote(F.substring_index(bare, "#", 1)), F.lit("\\"), F.lit("/"))


def is_external(target: Column) -> Column:
    return (target == "") | F.lower(target).rlike(r"\A(?:#|https?://|mailto:|data:|obsidian:)")


def slugify(x: Column, fallback: str = "untitled") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def person_slug(name: Column, scope_id: Column) -> Column:
    return F.concat(slugify(name, ""), F.lit("-in-"), scope_id)


def entry_range(spec: Column) -> Column:
    """'a-b' with 1 <= a <= b as struct(first, last), else null."""
    first = F.regexp_extract(spec, r"\A\s*(\d+)\s*-\s*(\d+)\s*\z", 1).try_cast("int")
    last = F.regexp_extract(spec, r"\A\s*(\d+)\s*-\s*(\d+)\s*\z", 2).try_cast("int")
    return F.when((first >= 1) & (last >= first), F.struct(first.alias("first"), last.alias("last")))


def page_spec(spec: Column) -> Column:
    """'1-4,7,9-10' as ascending distinct pages; null where a part is no page or range."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    ok = F.forall(parts, lambda p: p.rlike(r"\A[1-9]\d*(?:\s*-\s*[1-9]\d*)?\z"))
    low = lambda p: F.trim(F.split_part(p, F.lit("-"), F.lit(1))).cast("int")
    high = lambda p: F.trim(F.element_at(F.split(p, "-"), -1)).cast("int")
    rising = F.forall(parts, lambda p: low(p) <= high(p))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p))))))
    return F.when(ok, F.when(rising, pages))


def safe_name(name: Column, fallback: str = "file") -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]+', "_"), r"\A[ .]+|[ .]+\z", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def page_file(page: Column, page_count: Column, suffix: str) -> Column:
    """Zero-padded to four digits or as many as the page count has."""
    digits = F.greatest(F.lit(4), F.length(page_count.cast("string")))
    return F.concat(F.lit("page-"), F.lpad(page.cast("string"), digits, F.lit("0")), F.lit(suffix))


def fenced_text(gateway: Column) -> Column:
    """The first fenced text block, else the whole note."""
    pattern = r"(?s)```+text\s*\n(.*?)\n```+"
    return F.when(gateway.rlike(pattern), F.regexp_extract(gateway, pattern, 1)).otherwise(gateway)


def without_block(text: Column) -> Column:
    """The note after a closed leading block, without leading newlines."""
    opener = r"(?s)\A[ \t]*---[ \t]*\r?\n(?:.*?\r?\n)??[ \t]*---[ \t]*(?:\r?\n|\z)\n*"
    return F.regexp_replace(text, opener, "")


def is_semantic(text: Column) -> Column:
    return F.regexp_extract(text, LEADING_BLOCK, 1).rlike(SEMANTIC_KEY)


def first_h1(body: Column) -> Column:
    """The first level-one heading; empty for a bare mark, null without any."""
    line = F.regexp_extract(body, r"(?m)^[^\S\n]*(#(?: [^\n]*)?)[^\S\n]*$", 1)
    return F.when(line != "", strip(F.substr(line, F.lit(2))))


def first_line(body: Column) -> Column:
    return F.regexp_extract(body, r"\A\s*?([^\n]*\S[^\n]*)", 1)


def note_title(path: Column, text: Column) -> Column:
    block = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    own = F.regexp_extract(block, r"""(?m)^title:\s*["']?(.*?)["']?\s*$""", 1)
    heading = F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(heading, F.lit("")), stem(path))


def without_constructed(body: Column) -> Column:
    """Drops the lines from a constructed section's heading to the next heading."""
    start = F.struct(F.lit(False).alias("skip"), F.lit("").alias("out"))
    heading = lambda line: F.regexp_extract(line, r"^##+\s+(.*?)\s*$", 1)
    is_heading = lambda line: line.rlike(r"^##+\s+.*$")

    def step(a, line):
        skip = F.when(is_heading(line), F.lower(strip(heading(line))).isin(*CONSTRUCTED_SECTIONS)).otherwise(a["skip"])
        return F.struct(skip.alias("skip"), F.when(skip, a["out"]).otherwise(F.concat(a["out"], line, F.lit("\n"))).alias("out"))

    return F.regexp_replace(F.aggregate(F.split(body, r"\r?\n"), start, step, lambda a: a["out"]), r"\n\z", "")


# Paths --------------------------------------------------------------------------------


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*\z", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(name(path), r"(?<=.)(\.[^.]+)\z", 1)


def parts(path: Column) -> Column:
    return F.split(path, "/")


def normal_path(path: Column) -> Column:
    """Folds '.', '..' and empty segments; a path that climbs out of the root is null."""
    fold = F.aggregate(
        F.split(path, "/"),
        F.array(F.lit("")).cast("array<string>"),
        lambda a, s: F.when((s == "") | (s == "."), a)
        .when(s == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.lit(None)))
        .otherwise(F.concat(a, F.array(s))),
    )
    return F.array_join(F.slice(fold, 2, F.greatest(F.size(fold), F.lit(1))), "/")


def resolve(source: Column, target: Column) -> Column:
    """A link target relative to its note, or to the root if it starts with a slash."""
    joined = F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", parent(source), target))
    return normal_path(joined)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def bytes_record(data: Column) -> Column:
    """What stands for bytes in a JSON record."""
    return F.struct(F.octet_length(data).alias("byte_length"), F.sha2(data, 256).alias("sha256"))
