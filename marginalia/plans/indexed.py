"""Queries through the library's indexes and stateful structures, over the driver tables, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.unicode import normalise
from marginalia.operators import automata, integrity, leakscan, quotations
from marginalia.operators.trigrams import TrigramIndex
from marginalia.plans.catalogue import ORACLES, notes, query
from marginalia.plans.rounds import Repair, Rules
from marginalia.scratch import scratch_path
from marginalia.session import table

# Quotations ----------------------------------------------------------------------------

_TIGHT = r"regexp_replace(lower({0}), '\s+', '', 'g')"
_LATIN = "regexp_replace(lower(strip_accents({0})), '[^a-z0-9]', '', 'g')"
_LETTERS = r"length(regexp_replace(strip_accents({0}), '[^\pL\pN]', '', 'g'))"
_EDGE = r"[ .,;:!?''\"\-–—]+"


def _found(hay: str, parts: str) -> str:
    first, rest = f"instr({hay}, {parts}[1])", f"substr({hay}, instr({hay}, {parts}[1]) + length({parts}[1]))"
    return f"({first} > 0 AND (len({parts}) = 1 OR instr({rest}, {parts}[2]) > 0))"


def _carried(form: str) -> str:
    return (
        f"({_found(form + '.tight', 'q.tight')} OR ({form}.kept > 0 AND {form}.kept >= 0.8 * {form}.letters AND q.fit AND {_found(form + '.latin', 'q.latin')}))"
    )


_STATUS = rf"""
WITH d AS (
  SELECT doc_id, {_TIGHT.format("t")} AS tight, {_LATIN.format("t")} AS latin, {_LETTERS.format("t")} AS letters
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
),
p AS (
  SELECT item_id, regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^{_EDGE}', ''), '{_EDGE}$', '') AS t, length(text) // 3 AS n,
    regexp_replace(left(text, length(text) // 3), '[^A-Za-z]+$', '') AS a, regexp_replace(right(text, length(text) // 3), '^[^A-Za-z]+', '') AS b
  FROM benchmark WHERE length(text) >= 40
),
s AS (
  SELECT item_id, 0 AS ord, [t] AS parts FROM p
  UNION ALL SELECT item_id, 1, [regexp_replace(a, '^{_EDGE}', ''), regexp_replace(b, '{_EDGE}$', '')] FROM p
),
q AS (
  SELECT item_id, ord, [{_TIGHT.format("x")} FOR x IN parts] AS tight, [{_LATIN.format("x")} FOR x IN parts] AS latin,
    len(list_filter(parts, lambda x: length({_LATIN.format("x")}) < 25 OR length({_LATIN.format("x")}) < 0.8 * {_LETTERS.format("x")})) = 0 AS fit
  FROM s
),
w AS (SELECT string_agg(tight, '' ORDER BY doc_id) AS tight, string_agg(latin, '' ORDER BY doc_id) AS latin, sum(length(latin)) AS kept, sum(letters) AS letters FROM d),
c AS (
  SELECT item_id, string_agg(tight, '' ORDER BY doc_id) AS tight, string_agg(latin, '' ORDER BY doc_id) AS latin, sum(length(latin)) AS kept, sum(letters) AS letters
  FROM p JOIN d ON doc_id BETWEEN 10 * item_id AND 10 * item_id + 9 GROUP BY item_id
),
st AS (
  SELECT q.item_id, ord, CASE WHEN coalesce({_carried("c")}, false) THEN 'supported' WHEN coalesce({_carried("w")}, false) THEN 'elsewhere' ELSE 'unsupported' END AS status
  FROM q LEFT JOIN c USING (item_id) CROSS JOIN w
)
"""


def quoted_passages(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Benchmark passages as quotations, whole (0) and with the middle left out (1), and documents as pages.

    A note per passage cites ten pages, those whose numbers start with its own.
    """
    text = F.col("text")
    third = (F.length("text") / 3).cast("int")
    opening = F.regexp_replace(F.left(text, third), "[^A-Za-z]+$", "")
    ending = F.regexp_replace(F.right(text, third), "^[^A-Za-z]+", "")
    kinds = F.posexplode(F.array(text, F.concat(opening, F.lit(" … "), ending))).alias("ord", "quote")
    items = table(spark, sf, "benchmark").filter(F.length("text") >= quotations.SHORTEST)
    cites = F.sequence(10 * F.col("item_id"), 10 * F.col("item_id") + 9)
    asked = items.select(F.col("item_id").cast("string").alias("note"), cites.alias("pages"), kinds).withColumn(
        "needle", quotations.needle(normalise(F.col("quote")))
    )
    return asked, table(spark, sf, "documents").select(F.col("doc_id").alias("page"), "text")


@query(_STATUS + "SELECT item_id, ord, status FROM st")
def quote_support_full(spark, sf):
    """Status of every quotation: cited pages as they are, the whole scope through the positional index."""
    asked, pages = quoted_passages(spark, sf)
    return quotations.status(asked, pages).select(F.col("note").cast("long").alias("item_id"), "ord", "status")


@query(_STATUS + """
SELECT (SELECT count(*) FROM p) AS semantic_notes, count(*) AS checked, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'elsewhere') AS elsewhere,
  count(*) FILTER (status = 'unsupported') AS unsupported, round(count(*) FILTER (status = 'supported') / nullif(count(*), 0), 4) AS support_rate,
  CASE WHEN (SELECT count(*) FROM p) > 0 AND count(*) = 0 THEN 'inconclusive' WHEN count(*) FILTER (status <> 'supported') > 0 THEN 'findings' ELSE 'clear' END AS verdict
FROM st""")
def quote_report(spark, sf):
    """The report of the same quotations."""
    asked, pages = quoted_passages(spark, sf)
    return quotations.summary(asked.agg(F.countDistinct("note").alias("semantic_notes")), quotations.status(asked, pages))


# Full text -------------------------------------------------------------------------------

_GRAMS = " AND ".join(f"instr(lower(text), '{g}') > 0" for g in ("the", "lic", "ice", "cen", "ens", "nse"))


@query(f"SELECT *, (SELECT count(*) FROM documents WHERE {_GRAMS}) AS texts_read FROM ({ORACLES['fulltext_rank']})")
def fulltext_indexed(spark, sf):
    """The ranked query through the trigram index, built in two batches; texts_read counts what was verified."""
    own, title = notes(spark, sf), T.rstrip(F.split_part("text", F.lit("\n"), F.lit(1)))
    index = TrigramIndex(spark, scratch_path(spark, "trigrams"), fold="lower")
    middle = own.selectExpr("percentile_approx(doc_id, 0.5)").first()[0]
    for name, part in (("lower", F.col("doc_id") <= middle), ("upper", ~(F.col("doc_id") <= middle))):
        index.add(name, own.filter(F.coalesce(part, F.lit(name == "lower"))), title)
    found, n = index.search_counted("the license", 10)
    index.drop()
    return found.withColumn("texts_read", F.lit(n).cast("long"))


# Numbers in turn -------------------------------------------------------------------------


@query("""
WITH RECURSIVE o AS (SELECT o_orderkey AS place, o_custkey AS number FROM orders),
r AS (
  SELECT min(place) AS place, 1::BIGINT AS number FROM o WHERE number = 1 HAVING count(*) > 0
  UNION ALL SELECT min(o.place), r.number + 1 FROM r JOIN o ON o.number = r.number + 1 AND o.place > r.place GROUP BY r.number
)
SELECT place, number FROM r""")
def customers_in_turn(spark, sf):
    """All orders as one scope: the customer numbers that come in turn, from 1 on."""
    orders = table(spark, sf, "orders").select(F.lit("all").alias("scope"), F.col("o_orderkey").alias("place"), F.col("o_custkey").cast("long").alias("number"))
    return automata.accepted(orders, "scope", "place", "number").select("place", "number")


# Repair rounds -----------------------------------------------------------------------------

_HREF = 'href="([^"]*)"'


def _links(look: DataFrame) -> DataFrame:
    return look.select("path", F.explode(F.regexp_extract_all("text", F.lit(_HREF), F.lit(1))).alias("target")).filter("target <> ''").distinct()


def _dead(look: DataFrame, known) -> DataFrame:
    links = _links(look)
    there = known(links.select(F.col("target").alias("path"))).select(F.col("path").alias("target"))
    return links.join(there, "target", "left_anti").select("path", "target")


def _stubs(known, findings: DataFrame) -> DataFrame:
    """A page for every missing one, which links to the folder above it."""
    parent = F.regexp_extract("path", r"^(.*/)[^/]+/?$", 1)
    return findings.select(F.col("target").alias("path")).distinct().select("path", F.when(
        parent != "", F.concat(F.lit('<a href="'), parent, F.lit('">up</a>'))).otherwise("end").alias("text"))


@query(r"""
WITH RECURSIVE p AS (
  SELECT path, arg_min(html, page_id) AS html
  FROM (SELECT page_id, regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages) GROUP BY path
),
l AS (SELECT DISTINCT path, target FROM (SELECT path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM p) WHERE target <> ''),
s AS (
  SELECT DISTINCT 1 AS round, target AS path FROM l WHERE target NOT IN (SELECT path FROM p)
  UNION SELECT round + 1, parent FROM (SELECT round, regexp_extract(path, '^(.*/)[^/]+/?$', 1) AS parent FROM s)
  WHERE parent <> '' AND parent NOT IN (SELECT path FROM p)
),
f AS (SELECT path, min(round) AS round FROM s GROUP BY path),
e AS (SELECT 0 AS made, path, target FROM l UNION ALL SELECT round, path, regexp_extract(path, '^(.*/)[^/]+/?$', 1) FROM f WHERE regexp_extract(path, '^(.*/)[^/]+/?$', 1) <> ''),
r AS (SELECT unnest(range(0, 1 + least(9, coalesce((SELECT max(round) FROM f), 0))))::BIGINT AS round)
SELECT round,
  CASE WHEN round = 0 THEN (SELECT count(*) FROM p) ELSE (SELECT count(DISTINCT path) FROM (
    SELECT path FROM f WHERE f.round = r.round UNION ALL SELECT e.path FROM e JOIN f ON e.target = f.path WHERE f.round = r.round AND e.made < r.round)) END AS looked,
  (SELECT count(*) FROM f WHERE f.round = r.round) AS changed,
  (SELECT count(*) FROM e JOIN f ON e.target = f.path WHERE e.made <= r.round AND f.round > r.round) AS remaining
FROM r""")
def repair_rounds(spark, sf):
    """Dead links of the pages, repaired by stubs that link upwards, round by round; looked falls to what changed."""
    path = F.regexp_extract("url", r"^[^:]+://[^/]+(/[^?#]*)", 1)
    pages = table(spark, sf, "pages").select(path.alias("path"), F.coalesce("html", F.lit("")).alias("text"), "page_id")
    own = pages.groupBy("path").agg(F.min_by("text", "page_id").alias("text"))
    _, reports = Repair(spark, scratch_path(spark, "repair"), Rules(_dead, _links, _stubs)).run(own, 9)
    return spark.createDataFrame([(r["round"], r["looked"], r["changed"], r["left"]) for r in reports], "round long, looked long, changed long, remaining long")


# Denied phrases --------------------------------------------------------------------------

#: Ids that are sent to every task, so that no text is shuffled; more are joined by shuffle.
SENT_IDS = 1_000_000
_WORDS = "string_split(trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query(f"""
WITH w AS (SELECT doc_id, {_WORDS} AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest([array_to_string(t[i:i + 11], ' ') FOR i IN range(1, len(t) - 10)]) AS phrase FROM w WHERE len(t) >= 12),
bad AS (SELECT DISTINCT phrase FROM g WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT doc_id AS path, count(*) AS phrases FROM g WHERE phrase IN (SELECT phrase FROM bad) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_id""")
def rejected_phrases(spark, sf):
    """Documents that hold twelve words in a row of a document that the labels reject."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    rejected = table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("path")).distinct()
    if rejected.limit(SENT_IDS + 1).count() <= SENT_IDS:
        rejected = F.broadcast(rejected)
    found = leakscan.denied_phrases(docs.join(rejected, "path", "left_anti"), leakscan.word_runs(docs.join(rejected, "path", "left_semi")))
    return found.filter("place = 'text'").groupBy("path").agg(F.count("*").alias("phrases"))


# Documents compared ------------------------------------------------------------------------


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus AS s, left(o_orderpriority, 1)::INTEGER AS n FROM orders)
SELECT o_orderkey, 'lock.status' AS location, 'missing field' AS problem FROM o WHERE s = 'P'
UNION ALL SELECT o_orderkey, 'lock.extra', 'unexpected field' FROM o WHERE s = 'F'
UNION ALL SELECT o_orderkey, 'lock.customer.key', 'expected int, got str' FROM o WHERE o_orderkey % 50 = 0
UNION ALL SELECT o_orderkey, 'lock.steps', 'expected ' || n || ', got ' || (n - 1) FROM o WHERE n > 1
UNION ALL SELECT o_orderkey, 'lock.steps[' || (n - 1) || ']' || child, 'missing field' FROM o, (SELECT unnest(['', '.step', '.even']) AS child) WHERE n > 1""")
def lock_diff(spark, sf):
    """A document per order against one in which fields are missing, added, of another type or shorter."""
    c = F.col
    orders, n = table(spark, sf, "orders"), F.left("o_orderpriority", F.lit(1)).cast("int")
    steps = lambda last: F.transform(F.sequence(F.lit(1), last), lambda k: F.struct(k.alias("step"), (k % 2 == 0).alias("even")))
    document = lambda status, customer, last, *more: F.to_json(F.struct(
        c("o_orderkey").alias("key"), status.alias("status"), F.struct(customer.alias("key")).alias("customer"), steps(last).alias("steps"), *more))
    expected = orders.select("o_orderkey", document(c("o_orderstatus"), c("o_custkey").cast("string"), n).alias("document"))
    as_number = F.regexp_replace("document", r'"customer":\{"key":"(\d+)"\}', r'"customer":{"key":$1}')
    actual = orders.select("o_orderkey", document(
        F.when(c("o_orderstatus") != "P", c("o_orderstatus")), c("o_custkey").cast("string"), F.greatest(n - 1, F.lit(1)), F.when(c("o_orderstatus") == "F", True).alias("extra")
    ).alias("document"))
    actual = actual.withColumn("document", F.when(c("o_orderkey") % 50 == 0, c("document")).otherwise(as_number))
    return integrity.differences(expected.withColumn("document", as_number), actual, "o_orderkey")
