"""Queries that run the library's operators over the driver tables, each with its DuckDB twin.

Notes come from :mod:`marginalia.plans.corpora`; page records, inventories and logs are
tables of the star schema under the names that the operators ask for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.frontmatter import front_matter
from marginalia.operators import evidence, eventlog, extraction, integrity, inventory, leakscan, linkgraph, lint, scoping
from marginalia.plans.catalogue import query
from marginalia.plans.corpora import SQL_NOTES, files, notes, sql_path
from marginalia.session import table

# Notes --------------------------------------------------------------------------------

_REST = "closed AND i % 4 <> 3"


def _say(kind: str, detail: str, where: str, rows: str = "n") -> str:
    return f"SELECT '{kind}' AS kind, path AS file, {detail} AS detail FROM {rows} WHERE {where}"


def _front(detail: str, where: str) -> str:
    return _say("bad-front-matter", detail, where)


_LINT = "\nUNION ALL ".join([
    _say("broken-link", f"'link to ../' || {sql_path('i + 3')} || ' does not resolve'", "i + 3 NOT IN (SELECT i FROM d)"),
    _say("broken-link", "'wikilink [[d' || (i + 2) || ']] matches no note'", "i % 6 = 0 AND i + 2 NOT IN (SELECT i FROM d)"),
    _say("broken-image", "'image img/m.png does not resolve'", "i % 10 = 0 AND i % 4 <> 0"),
    "SELECT 'broken-link', 'index.md', 'link to concepts/gone.md does not resolve'",
    "SELECT 'broken-link', 'index.md', 'link to concepts/d0.md does not resolve' WHERE 0 NOT IN (SELECT i FROM d)",
    "SELECT 'broken-link', 'index.md', 'wikilink [[d1]] matches no note' WHERE 1 NOT IN (SELECT i FROM d)",
    "SELECT 'index-ghost', 'index.md', 'index links missing file gone.md'",
    "SELECT 'index-ghost', 'index.md', 'index links missing file d0.md' WHERE 0 NOT IN (SELECT i FROM d)",
    "SELECT 'bad-encoding', 'people/unread.md', 'file is not valid UTF-8'",
    _say("not-in-index", "'note not listed in index.md'", "i > 1"),
    _say("orphan", "'no other note links to this one'", "i - 3 NOT IN (SELECT i FROM d)"),
    _say("no-sources", "'no ''## Sources'' section and no inline citation line'", "i % 37 = 0"),
    _say("no-title", "'first line is not an H1 title'", "opened AND NOT closed"),
    _say("no-instances", "'a Concept must list its instances under ''## Instances in scope'''", "closed AND kind = 'Concept' AND i % 8 IN (0, 3)"),
    _say("no-guardrail", "'a Concept must state what it licenses or its evidence status'", "closed AND kind = 'Concept' AND i % 5 = 2"),
    _say("no-evidence-limits", "'a Case Dossier must have an ''## Evidence limits'' section'", "closed AND kind = 'Case Dossier' AND i % 3 = 0"),
    _say("no-evidence-limits", "'the ''Evidence limits'' section names no absence'", "closed AND kind = 'Case Dossier' AND i % 3 = 1"),
    _say("bad-locators", "'''pdf_pages'' must be a list of page numbers'", "closed AND i % 41 = 0"),
    _say("bad-locators", "'front matter claims pages that the body never links: 2'", "closed AND i % 3 = 0 AND i % 41 <> 0"),
    _front("'note does not start with a ''---'' front-matter block'", "NOT opened"),
    _front("'front-matter block has no closing ''---'''", "opened AND NOT closed"),
    _front("'front-matter title ''' || title || ''' != H1 ''' || heading || ''''", "closed AND title <> heading"),
    _front("'note sits outside the guide''s folder vocabulary'", "closed AND wanted IS NULL"),
    _front("'type ''' || kind || ''' != ''' || wanted || ''' required for ' || path", "closed AND kind <> wanted"),
    _front("'front matter has no ''description'''", "closed AND i % 12 = 0"),
    _front("'''tags'' missing, empty, or not a list'", "closed AND i % 5 = 0"),
    _front("'every compiled note needs ''semantic_note: true'''", "closed AND i % 13 = 0"),
    _front("'status must be ''draft'', got ''final'''", "closed AND i % 23 = 0"),
    _front("'''verified'' must be absent'", "closed AND i % 29 = 0"),
    _front("'''sources'' must be a non-empty list of source locators'", "closed AND i % 31 = 0"),
    """SELECT 'duplicate-title', min(path), 'title ''' || heading || ''' is shared by ' || string_agg(path, ', ' ORDER BY path)
       FROM n WHERE closed OR NOT opened GROUP BY heading HAVING count(*) > 1""",
])


@query(f"WITH {SQL_NOTES} {_LINT}")
def lint_issues(spark, sf):
    """Every issue of every lint rule over a note per document."""
    return lint.lint(notes(spark, sf), files(spark))


@query(f"WITH {SQL_NOTES}, a AS ({_LINT}) SELECT kind, count(*) AS n FROM a GROUP BY kind")
def lint_kind_counts(spark, sf):
    return eventlog.kind_counts(lint_issues(spark, sf))


_AUDIT = {
    "missing-fm": "NOT closed", "wrong-type": "closed AND kind <> wanted", "missing-type": "false",
    "unknown-location": "closed AND wanted IS NULL", "title-mismatch": "closed AND title <> heading", "missing-title": "false",
    "weak-description": "closed AND i % 12 < 8", "missing-tags": "closed AND i % 5 = 0",
    "not-draft-unverified": "closed AND (i % 13 = 0 OR i % 23 = 0 OR i % 29 = 0)", "missing-sources": "closed AND i % 31 = 0",
    "no-fm-expected": "false",
}


@query(f"""WITH {SQL_NOTES}
SELECT source AS dir, count(*) AS notes, {" + ".join(f"count(*) FILTER (WHERE {w})" for w in _AUDIT.values())} AS errors,
  {", ".join(f'count(*) FILTER (WHERE {w}) AS "{k}"' for k, w in _AUDIT.items())}
FROM n GROUP BY source""")
def audit_pivot(spark, sf):
    """Metadata audit, one row per source with a zero-filled column per kind."""
    own = notes(spark, sf).filter("source IS NOT NULL").select(F.col("source").alias("dir"), "path", "text")
    return lint.audit_table(own)


@query(f"""WITH {SQL_NOTES}
SELECT path, opened, closed, CASE WHEN closed THEN title END AS title, CASE WHEN closed THEN kind END AS type,
       CASE WHEN closed THEN trim(repeat('word ', (i % 12)::INTEGER)) END AS description, (CASE WHEN closed AND i % 5 <> 0 THEN 2 ELSE -1 END)::INTEGER AS tags,
       closed AND i % 13 <> 0 AS semantic, CASE WHEN closed THEN CASE WHEN i % 23 = 0 THEN 'final' ELSE 'draft' END END AS status,
       closed AND i % 29 = 0 AS verified_present, (CASE WHEN closed AND i % 31 <> 0 THEN 1 ELSE -1 END)::INTEGER AS sources,
       CASE WHEN NOT closed THEN 'absent' WHEN i % 41 = 0 THEN 'not-list' ELSE 'list' END AS pages_kind,
       CASE WHEN NOT closed OR i % 41 = 0 THEN '' WHEN i % 3 = 0 THEN '1,2' ELSE '1' END AS pages
FROM n""")
def note_fields(spark, sf):
    """The typed fields of every leading block."""
    own = notes(spark, sf).filter("doc_id IS NOT NULL").select("path", front_matter(F.col("text")).alias("fm"))
    plain = ("opened", "closed", "title", "type", "description", "tags", "semantic", "status", "verified_present", "sources", "pages_kind")
    return own.select("path", *[F.col(f"fm.{c}").alias(c) for c in plain], F.array_join(F.col("fm.pages").cast("array<string>"), ",").alias("pages"))


@query(f"""WITH {SQL_NOTES}
SELECT path, CASE WHEN closed THEN title ELSE heading END AS title, CASE WHEN opened AND NOT closed THEN '---' ELSE '# ' || heading END AS first_line,
       heading AS h1, closed AND i % 13 <> 0 AS semantic, split_part(path, '/', 2) AS name, folder AS parent, 'd' || i AS stem, '.md' AS suffix
FROM n""")
def note_parts(spark, sf):
    """Titles, first lines, headings and path parts of every note."""
    path, text = F.col("path"), F.col("text")
    return notes(spark, sf).filter("doc_id IS NOT NULL").select(
        "path", T.note_title(path, text).alias("title"), T.first_line(T.without_block(text)).alias("first_line"), T.first_h1(text).alias("h1"),
        T.is_semantic(text).alias("semantic"), T.name(path).alias("name"), T.parent(path).alias("parent"), T.stem(path).alias("stem"), T.suffix(path).alias("suffix"),
    )


_ALL_LINKS = f"""l AS (
  SELECT path AS source, '../' || {sql_path('i + 3')} AS raw, {sql_path('i + 3')} AS target, i + 3 IN (SELECT i FROM d) AS ok FROM n
  UNION ALL SELECT path, '../sources/pdf-pages/page-0001.md', 'sources/pdf-pages/page-0001.md', true FROM n
  UNION ALL SELECT 'index.md', 'concepts/d0.md', 'concepts/d0.md', 0 IN (SELECT i FROM d)
  UNION ALL SELECT 'index.md', 'concepts/gone.md', 'concepts/gone.md', false
)"""


@query(f"WITH {SQL_NOTES}, {_ALL_LINKS} SELECT source, raw, target FROM l WHERE NOT ok")
def broken_note_links(spark, sf):
    own = notes(spark, sf)
    return linkgraph.broken(linkgraph.note_links(own), own.select("path").unionByName(files(spark))).select("source", "raw", "target")


@query(f"WITH {SQL_NOTES} SELECT path FROM n WHERE i - 3 NOT IN (SELECT i FROM d)")
def note_orphans(spark, sf):
    return linkgraph.orphans(notes(spark, sf).filter("text IS NOT NULL"))


@query(f"WITH {SQL_NOTES} SELECT 'concepts/d0.md' AS path UNION SELECT 'concepts/gone.md' UNION SELECT path FROM n WHERE i = 1")
def index_targets(spark, sf):
    return linkgraph.catalogued(notes(spark, sf))


@query(f"""WITH {SQL_NOTES}
SELECT 'd' || (i + 2) AS raw, path AS source, CASE WHEN i + 2 IN (SELECT i FROM d) THEN {sql_path('i + 2')} END AS resolved,
       CASE WHEN i + 2 NOT IN (SELECT i FROM d) THEN 'target does not exist' END AS problem
FROM n WHERE i % 6 = 0
UNION ALL SELECT 'd1', 'index.md', (SELECT path FROM n WHERE i = 1), CASE WHEN 1 NOT IN (SELECT i FROM d) THEN 'target does not exist' END""")
def wikilinks_resolved(spark, sf):
    own = notes(spark, sf)
    return linkgraph.resolve_wikilinks(own, own.select("path").unionByName(files(spark))).select("raw", "source", "resolved", "problem")


@query(f"""WITH {SQL_NOTES}, {_ALL_LINKS}
SELECT source, raw, false AS external, CASE WHEN ok THEN target END AS resolved, CASE WHEN NOT ok THEN 'target does not exist' END AS problem FROM l
UNION ALL SELECT path, 'https://example.com/a.md', true, NULL, NULL FROM n WHERE i % 14 = 0""")
def markdown_resolved(spark, sf):
    own = notes(spark, sf)
    return linkgraph.resolve_markdown(own, own.select("path").unionByName(files(spark))).select("source", "raw", "external", "resolved", "problem")


@query(f"""WITH {SQL_NOTES}, t AS (SELECT path, lower(CASE WHEN closed THEN title ELSE heading END) AS title FROM n)
SELECT title, string_agg(path, ' ' ORDER BY path) AS paths FROM t GROUP BY title HAVING count(*) > 1""")
def shared_titles(spark, sf):
    return linkgraph.duplicate_titles(notes(spark, sf)).select("title", F.array_join("paths", " ").alias("paths"))


@query(f"""WITH {SQL_NOTES}, {_ALL_LINKS},
w AS (SELECT i + 2 IN (SELECT i FROM d) AS ok, i + 2 AS i FROM n WHERE i % 6 = 0 UNION ALL SELECT 1 IN (SELECT i FROM d), 1),
t AS (SELECT lower(CASE WHEN closed THEN title ELSE heading END) AS title FROM n GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT target FROM l WHERE ok UNION SELECT path FROM n WHERE i IN (SELECT i FROM w WHERE ok)),
o AS (SELECT path FROM n WHERE path NOT IN (SELECT target FROM r) UNION ALL SELECT 'people/unread.md')
SELECT (SELECT count(*) FROM n) + 3 AS markdown_files, (SELECT count(*) FROM w) AS wikilinks, (SELECT count(*) FROM l) AS markdown_links,
       (SELECT count(*) FROM n WHERE i % 14 = 0) AS external_links,
       (SELECT count(*) FROM l WHERE NOT ok) + (SELECT count(*) FROM w WHERE NOT ok) AS broken_or_ambiguous_links,
       (SELECT count(*) FROM t) AS duplicate_titles, (SELECT count(*) FROM o) AS orphan_notes, 'failed' AS status""")
def vault_totals(spark, sf):
    own = notes(spark, sf)
    return linkgraph.vault_report(own, own.select("path").unionByName(files(spark)))["counts"]


# Inventories --------------------------------------------------------------------------


@query("""SELECT l_orderkey AS slug, l_linenumber AS ord, l_suppkey AS section_order FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 5000)""")
def dangling_lines(spark, sf):
    """Lines whose supplier is not among the solvent ones."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slug"), F.col("l_linenumber").alias("ord"), F.col("l_suppkey").alias("section_order"))
    return inventory.dangling(lines, table(spark, sf, "supplier").filter("s_acctbal >= 5000").select(F.col("s_suppkey").alias("order")))


@query("""SELECT 5 AS rule, max(doc_id)::INTEGER AS ord, 0 AS step, 'text is there more than once: ' || sha256(coalesce(text, '')) AS violation
FROM documents GROUP BY sha256(coalesce(text, '')) HAVING count(*) > 1""")
def repeated_texts(spark, sf):
    rows = table(spark, sf, "documents").select(T.sha256(F.coalesce("text", F.lit(""))).alias("key"), F.col("doc_id").cast("int").alias("ord"))
    return inventory.repeated(rows, "key", 5, "text is there more than once: ")


@query("""SELECT 3 AS rule, -1 AS ord, 0 AS step, 'inventory.nations needs at least 30 entries' AS violation WHERE (SELECT count(*) FROM nation) < 30
UNION ALL SELECT 4, -1, 0, 'inventory.regions needs at least 5 entries' WHERE (SELECT count(*) FROM region) < 5
UNION ALL SELECT 5, -1, 0, 'inventory.debtors is empty' WHERE (SELECT count(*) FROM customer WHERE c_acctbal < -1000000) = 0""")
def relation_floors(spark, sf):
    """Floors of three relations; the second is met, the third relation is empty."""
    debtors = table(spark, sf, "customer").filter("c_acctbal < -1000000")
    return (
        inventory.below_floor(table(spark, sf, "nation"), "nations", 30, 3).unionByName(inventory.below_floor(table(spark, sf, "region"), "regions", 5, 4))
        .unionByName(inventory.empty(debtors, "debtors", 5))
    )


@query("""SELECT n_name AS "group", min(s_suppkey)::INTEGER AS ord, string_agg(s_name, ',' ORDER BY s_suppkey) AS members
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def supplier_groups(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    people = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("int").alias("ord"), F.col("s_name").alias("name"), F.col("n_name").alias("group")
    )
    return inventory.role_groups(people).select("group", "ord", F.array_join("members", ",").alias("members"))


@query("""SELECT n_nationkey AS "order", n_name AS slug,
  coalesce((SELECT string_agg('s' || s_suppkey, ',' ORDER BY 's' || s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS episodes,
  coalesce((SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region WHERE r_regionkey IN (n_nationkey, n_regionkey)), '') AS concepts
FROM nation""")
def nation_parts(spark, sf):
    """Sections with their episodes by order and their concepts by a page in common."""
    n, s, r = (table(spark, sf, t) for t in ("nation", "supplier", "region"))
    sections = n.select(F.col("n_nationkey").alias("order"), F.col("n_name").alias("slug"), F.array("n_nationkey", "n_regionkey").alias("pdf_pages"))
    episodes = s.select(F.col("s_nationkey").alias("section_order"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"))
    concepts = r.select(F.col("r_name").alias("slug"), F.array("r_regionkey").alias("pdf_pages"))
    out = inventory.section_parts(sections, episodes, concepts)
    return out.select("order", "slug", F.array_join("episodes", ",").alias("episodes"), F.array_join("concepts", ",").alias("concepts"))


_SLUG = "'^[a-z0-9]+(-[a-z0-9]+)*$'"


def _violations() -> str:
    rows: list[str] = []

    def need(rule: int, rel: str, step: int | str, bad: str, say: str, ord_: str = "ord") -> None:
        rows.append(f"SELECT {rule} AS rule, {ord_} AS ord, {step} AS step, {say} AS violation FROM {rel} WHERE {bad}")

    need(3, "sections", 0, "num < 1", "'section.order must be a positive integer'")
    need(3, "sections", 0, "num >= 1 AND NOT regexp_matches(slug, '^[0-9]{2}-[a-z0-9]+(-[a-z0-9]+)*$')", "'bad section slug ' || slug")
    need(3, "sections", "(num < 1)::INTEGER + (NOT regexp_matches(slug, '^[0-9]{2}-[a-z0-9]+(-[a-z0-9]+)*$'))::INTEGER", "NOT page BETWEEN 1 AND 20", "'section ' || slug || ' has invalid or out-of-scope pdf_pages'")
    need(4, "episodes", 0, f"NOT regexp_matches(slug, {_SLUG})", "'bad episode slug ' || slug")
    need(4, "episodes", 9, "sec NOT IN (SELECT num FROM sections)", "'episode ' || slug || '.section_order does not name a surveyed section'")
    need(5, "concepts", 0, "kind NOT IN ('epistemic', 'methodological', 'substantive')", "'concept ' || slug || '.kind is invalid'")
    need(5, "concepts", 0, "kind IN ('epistemic', 'methodological', 'substantive') AND NOT page BETWEEN 1 AND 20", "'concept ' || slug || ' has invalid or out-of-scope pdf_pages'")
    need(5, "concepts", 1, "kind NOT IN ('epistemic', 'methodological', 'substantive') AND NOT page BETWEEN 1 AND 20", "'concept ' || slug || ' has invalid or out-of-scope pdf_pages'")
    need(7, "claims", 0, "evidence = ''", "'claim.evidence is empty'")
    need(8, "motifs", 0, "motif = ''", "'inventory.motifs must be a non-empty string list'")
    rows.append("SELECT 6, -1, 99, 'inventory.people must contain exactly one author' WHERE (SELECT count(*) FROM people WHERE grp = 'author') <> 1")
    rows.append("SELECT 4, max(ord), 0, 'duplicate episode slug ' || slug FROM episodes GROUP BY slug HAVING count(*) > 1")
    rows.append("SELECT 5, -1, 99, 'inventory.concepts must cover substantive, methodological, and epistemic kinds' WHERE (SELECT list_sort(list(DISTINCT kind)) FROM concepts) <> ['epistemic', 'methodological', 'substantive']")
    rows.append("SELECT 8, -1, 0, 'inventory.motifs needs at least 99 entries' WHERE (SELECT count(*) FROM motifs) < 99")
    return "\nUNION ALL ".join(rows)


@query(f"""WITH sections AS (SELECT r_regionkey::INTEGER AS ord, r_regionkey AS num, '0' || r_regionkey || '-' || lower(r_name) AS slug, r_regionkey * 6 AS page FROM region),
episodes AS (SELECT n_nationkey::INTEGER AS ord, lower(n_name) AS slug, n_regionkey + 1 AS sec FROM nation),
concepts AS (SELECT p_partkey::INTEGER AS ord, 'p' || p_partkey AS slug, (['epistemic', 'methodological', 'substantive', 'other'])[p_size % 4 + 1] AS kind, p_size AS page FROM part),
people AS (SELECT CASE WHEN s_suppkey < 3 THEN 'author' ELSE 'maker' END AS grp FROM supplier),
claims AS (SELECT c_custkey::INTEGER AS ord, CASE WHEN c_acctbal < 0 THEN '' ELSE 'paid' END AS evidence FROM customer),
motifs AS (SELECT r_regionkey::INTEGER AS ord, CASE WHEN r_regionkey = 2 THEN '' ELSE r_name END AS motif FROM region)
{_violations()}""")
def inventory_violations(spark, sf):
    """All plan rules over an inventory made of the star schema."""
    t = lambda n: table(spark, sf, n)
    num = lambda c: F.col(c).cast("int")
    word = F.lit("x")
    chapter = spark.createDataFrame(
        [(0, 1, "01-all", "All", "Why?", ["a", "b", "c", "d"], ["e"], ["f"])],
        "ord int, number int, slug string, title string, organizing_question string, argument_steps array<string>, establishes array<string>, leaves_open array<string>",
    )
    kinds = F.array(*map(F.lit, ("epistemic", "methodological", "substantive", "other")))
    rels = {
        "chapter": chapter,
        "sections": t("region").select(
            num("r_regionkey").alias("ord"), num("r_regionkey").alias("order"), F.concat(F.lit("0"), F.col("r_regionkey").cast("string"), F.lit("-"), F.lower("r_name")).alias("slug"),
            F.col("r_name").alias("title"), F.array((F.col("r_regionkey") * 6).cast("int")).alias("pdf_pages"), word.alias("summary")),
        "episodes": t("nation").select(
            num("n_nationkey").alias("ord"), F.lower("n_name").alias("slug"), F.col("n_name").alias("title"), F.array(F.lit(1)).alias("pdf_pages"), word.alias("summary"),
            word.alias("support"), (num("n_regionkey") + 1).alias("section_order")),
        "concepts": t("part").select(
            num("p_partkey").alias("ord"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("title"),
            kinds[F.col("p_size") % 4].alias("kind"), F.array(num("p_size")).alias("pdf_pages"), F.col("p_type").alias("summary")),
        "people": t("supplier").select(
            num("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") < 3, "author").otherwise("maker").alias("group"),
            F.array(F.lit(1)).alias("pdf_pages"), word.alias("role"), word.alias("caution")),
        "claims": t("customer").select(
            num("c_custkey").alias("ord"), F.col("c_name").alias("claim"), F.col("c_mktsegment").alias("owner"),
            F.when(F.col("c_acctbal") < 0, "").otherwise("paid").alias("evidence"), word.alias("limit")),
        "motifs": t("region").select(num("r_regionkey").alias("ord"), F.when(F.col("r_regionkey") == 2, "").otherwise(F.col("r_name")).alias("motif")),
    }
    return inventory.violations(rels, list(range(1, 21)), "Nobody", {"motifs": 99, "section_notes": 2})


# Page and image records ---------------------------------------------------------------


def occurrences(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("xref"), "l_suppkey", "l_quantity")


@query("SELECT l_partkey AS xref, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS pages FROM lineitem GROUP BY l_partkey")
def image_pages(spark, sf):
    return extraction.pages_of_images(occurrences(spark, sf)).select("xref", F.array_join(F.col("referenced_on_pages").cast("array<string>"), ",").alias("pages"))


@query("SELECT l_orderkey AS page, l_linenumber AS ord, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey)::INTEGER AS occurrence FROM lineitem")
def image_numbers(spark, sf):
    return extraction.number_occurrences(occurrences(spark, sf), F.desc("ord"), F.col("l_suppkey")).select("page", "ord", "l_suppkey", "occurrence")


@query("SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS page FROM documents GROUP BY 1")
def first_contents(spark, sf):
    rows = table(spark, sf, "documents").select(T.sha256(F.coalesce("text", F.lit(""))).alias("sha256"), F.col("doc_id").alias("page"), F.lit(0).alias("ord"))
    return extraction.once_per_content(rows).select("sha256", "page")


@query("""SELECT page, rotation, mode, characters FROM (
  SELECT l_orderkey AS page, l_linenumber AS rotation, l_suppkey AS mode, l_quantity AS characters,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def best_variants(spark, sf):
    rows = occurrences(spark, sf).select("page", F.col("ord").alias("rotation"), F.col("l_suppkey").alias("mode"), F.col("l_quantity").alias("characters"))
    return extraction.best_variant(rows)


@query("""SELECT doc_id AS page, n_chars FROM documents d WHERE n_chars % 5 = 0 AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def recovered(spark, sf):
    """Pages taken to be without native text (a length divisible by five) for which recognition, the labels, has something."""
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), "n_chars", (F.col("n_chars") % 5).alias("native_text_characters"))
    found = table(spark, sf, "labels").select(F.col("doc_id").alias("page"), F.lit("found").alias("text")).distinct()
    return extraction.recovered_pages(pages, found).select("page", "n_chars")


@query("SELECT 'missing' AS kind, count(*) AS expected, 0::BIGINT AS found FROM region UNION ALL SELECT 'there', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))")
def artifact_totals(spark, sf):
    orders, region = table(spark, sf, "orders"), table(spark, sf, "region")
    expected = orders.select(F.col("o_orderkey").cast("string").alias("path"), F.lit("there").alias("kind")).unionByName(
        region.select(F.col("r_name").alias("path"), F.lit("missing").alias("kind")))
    found = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.lit("there").alias("kind")).distinct()
    return extraction.artifact_counts(expected, found)


# Integrity, leaks, scoping ------------------------------------------------------------


@query("""SELECT doc_id AS path, sha256(coalesce(text, '')) AS sha256, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN sha256(trim(coalesce(text, ''), ' ')) END AS listed
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR text <> trim(text, ' ')""")
def page_hash_faults(spark, sf):
    """Pages that the inventory (the labelled ones, trimmed) does not list, or with other bytes."""
    docs, labels = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text")), table(spark, sf, "labels")
    listed = docs.join(labels.select(F.col("doc_id").alias("path")).distinct(), "path").select("path", T.sha256(F.trim("text")).alias("sha256"))
    return integrity.page_hash_mismatches(docs.select("path", T.sha256(F.col("text")).alias("sha256")), listed)


@query("""SELECT doc_id AS path, CASE WHEN doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars % 2 = 0) THEN 'missing' ELSE 'changed' END AS status
FROM (SELECT DISTINCT doc_id FROM labels) l
WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars % 2 = 0) OR doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 3000)""")
def artifact_faults(spark, sf):
    """An index (the labels) against artifacts (documents of even length; long ones have changed)."""
    index = table(spark, sf, "labels").select(F.col("doc_id").alias("path"), F.lit("short").alias("sha256")).distinct()
    now = F.when(F.col("n_chars") > 3000, "long").otherwise("short")
    return integrity.artifact_check(index, table(spark, sf, "documents").filter("n_chars % 2 = 0").select(F.col("doc_id").alias("path"), now.alias("sha256")))


_SHAPES = {
    "absolute machine path": r"""regexp_matches(text, '(?i)(^|[^a-z0-9])[a-z]:\\(users|projects)\\[^\s"'']+') OR regexp_matches(text, '(^|[^a-z0-9])/(home|users)/[^/\s]+/')""",
    "private network endpoint": r"regexp_matches(text, '(^|[^0-9])(10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|192\.168\.[0-9]{1,3}\.[0-9]{1,3}|172\.(1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3})([^0-9]|$)') OR regexp_matches(text, '(?i)(https?://)?(localhost|127\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|169\.254\.[0-9]{1,3}\.[0-9]{1,3}|\[?::1\]?)(:[0-9]+)?([/?#]|\b)')",
    "credential-shaped value": r"regexp_matches(text, '(?i)\b(sk|key|token|secret)[-_][a-z0-9]{16,}\b') OR regexp_matches(text, '-----BEGIN ([A-Z0-9]+ )?PRIVATE KEY-----|\bAKIA[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bgithub_pat_[A-Za-z0-9_]{40,}\b|\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b')",
    "non-placeholder email address": r"len(list_filter(regexp_extract_all(lower(text), '\b[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,}\b'), lambda m: m NOT IN ('noreply@github.com', 'support@github.com') AND NOT regexp_matches(m, '(\.example|\.invalid|example\.com|example\.org|example\.net|users\.noreply\.github\.com)$'))) > 0",
}


#: What is added to the documents, whose own values are all harmless; both engines read it.
_PLANTED = """concat(coalesce(text, ''), CASE doc_id % 9
  WHEN 0 THEN concat(' c:', chr(92), 'Users', chr(92), 'ann ') WHEN 1 THEN ' /home/ann/x' WHEN 2 THEN concat(' 10.0.0.', doc_id % 200, ' ')
  WHEN 3 THEN ' see localhost:80/ ' WHEN 4 THEN concat(' token_', repeat('ab3', 8), ' ') WHEN 5 THEN concat(' gh', 'p_', repeat('Ab3', 8), ' ')
  WHEN 6 THEN ' ann@corp.test ' WHEN 7 THEN concat(' noreply@', 'github.com ') ELSE concat(' ey', 'J', repeat('a-', 6), '.', repeat('b', 12), '.', repeat('c', 12), ' ') END)"""


@query(f"WITH p AS (SELECT doc_id, {_PLANTED} AS text FROM documents) " + "\nUNION ALL ".join(f"SELECT doc_id, '{say}' AS finding FROM p WHERE {test}" for say, test in _SHAPES.items()))
def privacy_shapes(spark, sf):
    """All privacy shapes and all credential shapes over every document, with something planted in each."""
    docs = table(spark, sf, "documents").select("doc_id", F.expr(_PLANTED).alias("text"))
    return docs.select("doc_id", F.explode(leakscan.privacy_findings(F.col("text"))).alias("finding"))


_WORDS = "string_split(trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query(f"""WITH b AS (SELECT {_WORDS} AS t FROM benchmark),
deny AS (SELECT DISTINCT unnest([array_to_string(t[i:i + least(12, len(t)) - 1], ' ') FOR i IN range(1, len(t) - least(12, len(t)) + 2)]) AS gram, least(12, len(t)) AS k FROM b WHERE t <> ['']),
d AS (SELECT doc_id, {_WORDS} AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest([array_to_string(t[i:i + k - 1], ' ') FOR i IN range(1, len(t) - k + 2)]) AS gram FROM d, (SELECT DISTINCT k FROM deny) s WHERE len(t) >= k)
SELECT doc_id AS path, 'text' AS place, count(*) AS denied FROM g WHERE gram IN (SELECT gram FROM deny) GROUP BY doc_id""")
def denylist_hits(spark, sf):
    """Documents that hold a denied phrase: any run of twelve words of a benchmark item, or a whole shorter one."""
    items = table(spark, sf, "benchmark").select("item_id", leakscan.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    runs = T.bound(F.col("w"), lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - F.least(F.lit(leakscan.LONGEST), F.size(w)) + 1), lambda i: F.array_join(F.slice(w, i, F.lit(leakscan.LONGEST)), " ")))
    denylist = items.filter(F.size("w") > 0).select(F.explode(runs).alias("gram")).select(F.sha2("gram", 256).alias("sha256")).distinct()
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return leakscan.denied(docs, denylist).groupBy("path", "place").agg(F.count("*").alias("denied"))


@query("""SELECT ((row_number() OVER (ORDER BY doc_id) - 1) // ceil((SELECT count(*) FROM documents) / 7.0)::BIGINT)::BIGINT AS chunk, doc_id AS page FROM documents""".join(
    ["SELECT chunk, min(page) AS first, max(page) AS last FROM (", ") GROUP BY chunk"]))
def page_chunks(spark, sf):
    return scoping.page_ranges(table(spark, sf, "documents").select(F.col("doc_id").alias("page")), 7).select(F.col("chunk").cast("long").alias("chunk"), "first", "last")


@query("""WITH s AS (SELECT doc_id, lang, source, CASE lang WHEN 'de' THEN 'citation_apparatus' ELSE 'primary_text' END AS section,
  regexp_replace(coalesce(text, ''), '(?m)^(Released|Licensed) under .*$', '', 'g') AS t, regexp_matches(coalesce(text, ''), '(?m)^(Released|Licensed) under .*$') AS hit, coalesce(text, '') AS native FROM documents)
SELECT doc_id AS page, section, sha256(t) AS sha256, sha256(native) AS native_sha256, CASE WHEN hit THEN 'license' ELSE '' END AS removed, 'none' AS boundary_action, '' AS discarded
FROM s WHERE section IS NOT NULL""")
def scoped_documents(spark, sf):
    """Scoping of the German documents as apparatus and all others as text."""
    docs = table(spark, sf, "documents")
    pages = docs.select(F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    sections = docs.select(F.col("doc_id").alias("page"), F.when(F.col("lang") == "de", "citation_apparatus").otherwise("primary_text").alias("section"))
    none = spark.createDataFrame([], "page long, marker string, keep string, action string")
    out = scoping.scope(pages, sections, [(r"(?m)^(Released|Licensed) under [^\n]*$", "license")], none)
    return out.select("page", "section", "sha256", "native_sha256", F.array_join("furniture_removed", ",").alias("removed"), "boundary_action", "discarded")


@query("SELECT 'nothing like it' AS reason")
def unused_rules(spark, sf):
    """Declared furniture that matches no document."""
    rules = [(r"[A-Za-z]", "a letter"), ("🧿🧿", "nothing like it")]
    return scoping.unused_furniture(scoping.strip_furniture(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rules), rules)


@query(r"""SELECT l_orderkey, l_linenumber, l_suppkey,
  CASE WHEN l_linenumber >= 1 AND l_quantity::INTEGER >= l_linenumber THEN l_linenumber || '..' || l_quantity::INTEGER END AS entry_range,
  array_to_string(list_sort(list_distinct(list_concat([l_linenumber], range(l_linenumber + 2, l_linenumber + 4)))), ',') AS pages,
  'page-' || lpad(l_linenumber::VARCHAR, 4, '0') || '.txt' AS file
FROM lineitem""")
def page_specs(spark, sf):
    """Entry ranges, page lists and page files from the numbers of every line."""
    number = F.col("l_linenumber").cast("int").cast("string")
    spec = F.concat(F.col("l_linenumber").cast("int").cast("string"), F.lit(" - "), F.col("l_quantity").cast("int").cast("string"))
    pages = F.concat(number, F.lit(", "), (F.col("l_linenumber") + 2).cast("int").cast("string"), F.lit("-"), (F.col("l_linenumber") + 3).cast("int").cast("string"), F.lit(","), number)
    own = table(spark, sf, "lineitem").withColumn("e", T.entry_range(spec))
    return own.select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.concat_ws("..", "e.first", "e.last").alias("entry_range"),
        F.array_join(T.page_spec(pages).cast("array<string>"), ",").alias("pages"), T.page_file(F.col("l_linenumber").cast("int"), F.lit(50), ".txt").alias("file"),
    ).withColumn("entry_range", F.nullif("entry_range", F.lit("")))


@query(r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS name, regexp_replace(url, '/?[^/]*$', '') AS parent, url IS NOT NULL AS external,
  regexp_replace(lower(regexp_replace(url, '[<>:"/\\|?*]+', '_', 'g')), '^[ .]+|[ .]+$', '', 'g') AS safe, split_part(url, '#', 1) AS target,
  replace(regexp_extract(url, '://([^?#]*)', 1), '//', '/') AS folded
FROM pages""")
def url_paths(spark, sf):
    """Path and link-target expressions over every page's address."""
    url = F.col("url")
    inner = F.regexp_extract(url, r"://([^?#]*)", 1)
    return table(spark, sf, "pages").select(
        "page_id", T.name(url).alias("name"), T.parent(url).alias("parent"), T.is_external(url).alias("external"), T.safe_name(F.lower(url)).alias("safe"),
        T.markdown_target(F.concat(F.lit("<"), url, F.lit(">"))).alias("target"),
        F.concat(T.normal_path(F.concat(F.lit("./x/../"), inner)), F.when(inner.endswith("/"), "/").otherwise("")).alias("folded"),
    )


@query("SELECT user_id, event_type, max(event_id) AS last_id, count(*) AS n FROM events GROUP BY user_id, event_type")
def event_kinds(spark, sf):
    rows = table(spark, sf, "events").select(F.concat_ws("|", "user_id", "event_type").alias("kind"), "event_id")
    counts, last = eventlog.kind_counts(rows), eventlog.latest(rows, "kind", "event_id")
    part = lambda k: F.split_part("kind", F.lit("|"), F.lit(k))
    return counts.join(last, "kind").select(part(1).cast("long").alias("user_id"), part(2).alias("event_type"), F.col("event_id").alias("last_id"), "n")


# Gates and reviews --------------------------------------------------------------------


@query("""SELECT event_id AS run_id, CASE WHEN event_type <> 'purchase' THEN 'smoke did not pass' WHEN user_id % 5 = 0 THEN 'smoke was corrected'
  WHEN user_id % 7 = 0 THEN 'smoke published a wiki' WHEN ts <= TIMESTAMP '2024-01-08 00:00:00' THEN 'smoke has expired'
  WHEN event_id % 11 = 0 THEN 'smoke times are out of order' WHEN user_id % 2 = 0 THEN 'smoke belongs to another binding' END AS reason FROM events""")
def smoke_reasons(spark, sf):
    """A smoke report for every event, with faults by its numbers."""
    i, u = F.col("event_id"), F.col("user_id")
    report = table(spark, sf, "events").select(
        i.alias("run_id"), F.when(F.col("event_type") == "purchase", "passed").otherwise("failed").alias("status"), (u % 5 == 0).alias("corrected"),
        (u % 7 == 0).alias("creates_published_wiki"), F.col("ts").cast("string").alias("expires_at"),
        F.when(i % 11 == 0, F.col("ts")).otherwise(F.col("ts") - F.expr("INTERVAL 1 HOUR")).cast("string").alias("created_at"),
        F.when(u % 2 == 0, "other").otherwise("mine").alias("binding_sha256"),
    )
    return integrity.smoke_gate(report, "mine", F.to_timestamp(F.lit("2024-01-08 00:00:00"))).select("run_id", "reason")


@query("""SELECT (SELECT count(*) FROM documents WHERE lang = 'xx') AS lint, (SELECT count(*) FROM nation WHERE n_regionkey > 99) AS okf,
  (SELECT count(*) FROM labels WHERE toxic = 1) AS gates, (SELECT count(*) FROM labels WHERE toxic = 1) = 0 AS sealed""")
def seal_counts(spark, sf):
    return integrity.seal_gate(
        table(spark, sf, "documents").filter("lang = 'xx'"), table(spark, sf, "nation").filter("n_regionkey > 99"), table(spark, sf, "labels").filter("toxic = 1"))


@query("SELECT p_partkey, p_type AS tool FROM part WHERE contains(lower(p_type), 'promo') OR contains(lower(p_type), 'larg')")
def tools_refused(spark, sf):
    return integrity.isolation(table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("tool")), ("promo", "larg"))


@query(f"WITH {SQL_NOTES} SELECT path FROM n WHERE folder NOT IN ('concepts', 'cases') UNION ALL SELECT 'log.md' UNION ALL SELECT 'people/unread.md'")
def stray_notes(spark, sf):
    return integrity.stray_files(notes(spark, sf).select("path"), ["index.md"], ["concepts", "cases"])


@query("SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM orders WHERE starts_with(o_orderpriority, n_nationkey::VARCHAR))")
def prefixes_missing(spark, sf):
    """Nations whose number starts no order's priority."""
    required = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("prefix"), "n_name")
    labels = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label")).distinct()
    return integrity.missing_prefixes(required, labels).select("n_name")


@query("SELECT o_orderkey AS path, 'changed' AS status FROM orders WHERE o_totalprice > 100000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def forbidden_changes(spark, sf):
    """Dear orders have changed; those with a large line were allowed to."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.lit("a").alias("sha256"), F.when(F.col("o_totalprice") > 100000, "b").otherwise("a").alias("now"))
    allowed = table(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("path")).distinct()
    return integrity.unchanged(orders.select("path", "sha256"), orders.select("path", F.col("now").alias("sha256")), allowed)


@query("SELECT sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, max(doc_id) AS modified FROM documents")
def activity_total(spark, sf):
    return integrity.activity(table(spark, sf, "documents").select(F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"), F.col("doc_id").alias("modified")))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 80")
def log_tail(spark, sf):
    """The last eighty lines of a log, by design."""
    return integrity.tail(table(spark, sf, "events").select("event_id", "event_type"), 80, "event_id")


_ERRORS = ("APITimeoutError", "AuthenticationError", "RateLimitError", "ValueError", "ConnectionNotFoundError", "KeyError")


@query(f"SELECT event_id, ({list(_ERRORS)})[event_id % 6 + 1] AS name, event_id % 6 IN (0, 2) AS again FROM events")
def retries(spark, sf):
    names = F.array(*map(F.lit, _ERRORS))
    rows = table(spark, sf, "events").select("event_id", names[(F.col("event_id") % 6).cast("int")].alias("name"))
    return rows.withColumn("again", eventlog.retryable(F.col("name")))


@query("""WITH d AS (SELECT doc_id, least(greatest(doc_id % 40, 1), 39) AS a FROM documents),
g AS (SELECT packet, page, count(*) AS demand FROM (SELECT doc_id // 50 AS packet, unnest([a, a + 1]) AS page FROM d) GROUP BY ALL),
r AS (SELECT packet, page, row_number() OVER (PARTITION BY packet ORDER BY demand DESC, page) AS k FROM g)
SELECT packet, array_to_string(list_sort(list(page) FILTER (WHERE k <= 12)), ',') AS supplied, coalesce(array_to_string(list_sort(list(page) FILTER (WHERE k > 12)), ','), '') AS omitted
FROM r GROUP BY packet""")
def packet_evidence(spark, sf):
    """Pages supplied to packets of fifty documents, each citing two of forty pages."""
    a = F.least(F.greatest(F.col("doc_id") % 40, F.lit(1)), F.lit(39)).cast("int")
    packed = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 50).alias("packet"), F.col("doc_id").alias("path"), F.array(a, a + 1).alias("pages"))
    pages = spark.range(1, 41).select(F.col("id").cast("int").alias("page"), F.lit(100).cast("long").alias("chars"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    out = evidence.packet_pages(packed, pages)
    return out.select("packet", text(F.col("supplied")).alias("supplied"), text(F.array_sort("omitted")).alias("omitted"))


@query("""SELECT o_custkey AS round, count(*) AS packet_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS material_findings,
  CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'failed' ELSE 'passed' END AS execution_status,
  CASE WHEN NOT bool_or(o_orderpriority = '1-URGENT') AND count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'clear' ELSE 'findings' END AS finding_status,
  CASE WHEN bool_or(o_orderpriority = '1-URGENT') OR bool_or(o_orderkey % 9 = 0) THEN 'partial' ELSE 'complete' END AS coverage,
  coalesce(array_to_string(list_sort(list(DISTINCT o_orderkey % 9) FILTER (WHERE o_orderkey % 9 > 0)), ','), '') AS reviewed
FROM orders GROUP BY o_custkey""")
def round_reports(spark, sf):
    """Review rounds made of customers, packets of their orders; page 0 is cited and never supplied."""
    page = (F.col("o_orderkey") % 9).cast("int")
    packets = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("round"), F.array(F.lit("n")).alias("notes"), F.when(page > 0, F.array(page)).otherwise(F.array().cast("array<int>")).alias("pages_supplied"),
        F.array(page).alias("pages_cited"), (F.col("o_orderstatus") == "F").cast("int").alias("findings"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "x").alias("error"), F.lit(0).alias("skipped"), F.lit(0).alias("reduced"),
    )
    return evidence.round_report(packets).select(
        "round", "packet_count", "material_findings", "execution_status", "finding_status", "coverage", F.array_join(F.col("pages_reviewed").cast("array<string>"), ",").alias("reviewed"),
    )


def _joined(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""WITH e AS (
  SELECT 'chapters/01-all.md' AS path, 'scope hub' AS reason UNION ALL SELECT 'sections/0' || r_regionkey || '.md', 'section: ' || r_name FROM region
  UNION ALL SELECT 'cases/' || lower(n_name) || '.md', 'episode: ' || n_name FROM nation UNION ALL SELECT 'concepts/p' || p_partkey || '.md', 'concept: ' || p_name FROM part
  UNION ALL SELECT 'people/g' || s_nationkey || '.md', 'role roster: g' || s_nationkey || ' (' || count(*) || ' named)' FROM supplier GROUP BY s_nationkey)
SELECT path, reason FROM e WHERE path NOT IN (SELECT 'concepts/p' || l_partkey || '.md' FROM lineitem WHERE l_quantity > 49)""")
def notes_missing(spark, sf):
    """Notes that an inventory of the star schema calls for; the root notes and those of parts in large lines are there."""
    t = lambda n: table(spark, sf, n)
    own = {
        "chapter": spark.createDataFrame([("01-all",)], "slug string"),
        "sections": t("region").select(_joined("0", F.col("r_regionkey")).alias("slug"), F.col("r_name").alias("title")),
        "episodes": t("nation").select(F.lower("n_name").alias("slug"), F.col("n_name").alias("title")),
        "concepts": t("part").select(_joined("p", F.col("p_partkey")).alias("slug"), F.col("p_name").alias("title")),
        "people": t("supplier").select(F.col("s_name").alias("name"), _joined("g", F.col("s_nationkey")).alias("group")),
    }
    there = t("lineitem").filter("l_quantity > 49").select(_joined("concepts/p", F.col("l_partkey"), ".md").alias("path")).distinct()
    return inventory.missing_notes(own, "all", there.unionByName(spark.createDataFrame([(p,) for p in inventory.ROOT_NOTES], "path string")))


@query("""SELECT 'sections' AS relation, r_name AS slug FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)
UNION ALL (SELECT 'episodes', n_name FROM nation WHERE n_regionkey = (SELECT min(r_regionkey) FROM region) ORDER BY n_nationkey LIMIT 2)
UNION ALL (SELECT 'concepts', p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1)
UNION ALL (SELECT 'people', s_name FROM supplier WHERE s_nationkey = (SELECT s_nationkey FROM supplier ORDER BY s_suppkey LIMIT 1) ORDER BY s_suppkey LIMIT 4)""")
def narrowed(spark, sf):
    """A small inventory of the same shape: a sample by design."""
    t = lambda n: table(spark, sf, n)
    own = {
        "sections": t("region").select(F.col("r_regionkey").alias("order"), F.col("r_name").alias("slug")),
        "episodes": t("nation").select(F.col("n_nationkey").alias("ord"), F.col("n_regionkey").alias("section_order"), F.col("n_name").alias("slug")),
        "concepts": t("part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("kind"), F.col("p_name").alias("slug")),
        "people": t("supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_nationkey").cast("string").alias("group"), F.col("s_name").alias("slug")),
    }
    out = [df.select(F.lit(name).alias("relation"), "slug") for name, df in inventory.narrow(own).items()]
    return reduce(DataFrame.unionByName, out)


@query("SELECT n_name AS slug FROM nation WHERE n_nationkey BETWEEN 3 AND 9 OR n_regionkey BETWEEN 3 AND 9")
def pages_in_range(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("slug"), F.array("n_nationkey", "n_regionkey").alias("pdf_pages"))
    return inventory.in_page_range(rows, 3, 9).select("slug")


# Texts and pages ----------------------------------------------------------------------


@query(f"""WITH {SQL_NOTES}
SELECT path, 'd' || (i + 2) AS wikilink, {sql_path('i + 3')} AS resolved, lower(replace(title, ' ', '-')) || '-in-s' AS person,
  octet_length(encode(path)) AS byte_length, sha256(path) AS sha256, folder || ', ' || i AS fenced, i % 7 = 0 AS slug_ok FROM n""")
def text_marks(spark, sf):
    """Link targets, slugs, fences and byte records made of every note's number."""
    i, path = F.col("doc_id"), F.col("path")
    record = T.bytes_record(path.cast("binary"))
    fence = _joined("intro\n````text\n", T.parent(path), ", ", i, "\n````\nafter")
    own = notes(spark, sf).filter("doc_id IS NOT NULL").withColumn("to", F.regexp_extract("text", r"\[next\]\(([^)]*)\)", 1))
    return own.select(
        "path", T.wikilink_target(_joined(" d", i + 2, "#part|shown")).alias("wikilink"), T.resolve(path, F.col("to")).alias("resolved"),
        T.person_slug(_joined("Title ", F.pmod(i, F.lit(40))), F.lit("s")).alias("person"), record["byte_length"].cast("long").alias("byte_length"),
        record["sha256"].alias("sha256"), T.fenced_text(fence).alias("fenced"), T.is_slug(F.when(i % 7 == 0, _joined("a-", i)).otherwise(_joined("A_", i))).alias("slug_ok"),
    )


@query("SELECT doc_id AS page, len(string_split(text, 'e')) - 1 AS soft_hyphens FROM documents WHERE contains(text, 'e')")
def hyphen_counts(spark, sf):
    """Soft hyphens per page, one put in place of every e."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.replace("text", F.lit("e"), F.lit(scoping.SOFT_HYPHEN)).alias("text"))
    return scoping.soft_hyphens(rows)


@query("""SELECT page, coalesce(max(quality)::VARCHAR, '') AS text FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM documents))) AS page) d
LEFT JOIN labels ON doc_id = page GROUP BY page""")
def every_page(spark, sf):
    """A text for every page number up to the count of documents, empty where no label is."""
    found = table(spark, sf, "labels").groupBy(F.col("doc_id").cast("int").alias("page")).agg(F.max("quality").cast("string").alias("text"))
    return extraction.all_pages_text(found, table(spark, sf, "documents").count()).select(F.col("page").cast("long").alias("page"), "text")


@query("SELECT doc_id AS page FROM documents WHERE n_chars % 6 = 0")
def pages_to_recognise(spark, sf):
    """Documents whose length divides by six stand for pages without native text."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), (F.col("n_chars") % 6).alias("native_text_characters"))
    return extraction.ocr_targets(rows, "missing").select("page")


@query("""SELECT 'page_record_count' AS "check", true AS ok UNION ALL SELECT 'occurrences_have_pages', (SELECT max(l_orderkey) FROM lineitem) <= (SELECT count(*) FROM documents)
UNION ALL SELECT 'listed_objects_extracted', (SELECT count(DISTINCT l_partkey) FROM lineitem) = (SELECT count(*) FROM part)
UNION ALL SELECT 'image_count_matches', true UNION ALL SELECT 'no_image_missed', false""")
def extraction_checks(spark, sf):
    """Documents as pages, lines as image occurrences, parts as image objects."""
    t = lambda n: table(spark, sf, n)
    pages, objects = t("documents").select(F.col("doc_id").alias("page")), t("part").select(F.col("p_partkey").alias("xref"))
    seen = t("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("xref"))
    n = seen.count()
    return extraction.checks(pages, seen, objects, pages.count(), listed=seen.select("xref").distinct(), counted_images=n, written_images=n + 1)
