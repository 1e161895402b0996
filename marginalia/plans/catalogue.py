"""The reference's operators as queries over the driver tables, each with its DuckDB twin.

Documents stand in for notes and pages, benchmark passages for quotations, page links
for the link graph, conversation turns for sequences, events for logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as T
from marginalia.functions import unicode as U
from marginalia.operators import evidence, eventlog, extraction, fulltext, integrity, inventory, leakscan, linkgraph, lint, quotations, scoping
from marginalia.session import table
from marginalia.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def notes(spark, sf) -> DataFrame:
    """path, text, title, source of the documents."""
    return table(spark, sf, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), "doc_id", "source"
    )


@query("""
WITH n AS (SELECT source || '/' || doc_id AS path, text, split_part(text, chr(10), 1) AS title FROM documents),
c AS (SELECT *, lower(text) AS b, lower(title) AS t, lower(path) AS p FROM n),
s AS (SELECT *, list_sum([
    (length(b) - length(replace(b, w, ''))) // length(w) + 8 * ((length(t) - length(replace(t, w, ''))) // length(w))
    + 3 * ((length(p) - length(replace(p, w, ''))) // length(w)) FOR w IN ['the', 'license']])::BIGINT AS score,
    least(instr(b, 'the'), instr(b, 'license')) - 1 AS pos
  FROM c WHERE instr(b, 'the') > 0 AND instr(b, 'license') > 0)
SELECT score, title, path, trim(regexp_replace(text[greatest(0, pos - 90) + 1:least(length(text), pos + 220)], '\\s+', ' ', 'g')) AS snippet
FROM s ORDER BY score DESC, path LIMIT 10
""".replace("\\\\", "\\"))
def fulltext_rank(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.search(notes(spark, sf), "the license", 10, T.rstrip(F.split_part("text", F.lit("\n"), F.lit(1))), fold="lower")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, length(coalesce(text, '')) AS characters FROM documents")
def scoped_hash(spark, sf):
    return notes(spark, sf).select("doc_id", T.sha256(F.col("text")).alias("sha256"), F.length("text").cast("long").alias("characters"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat, replace(regexp_replace(text, '\s+', '', 'g'), ' ', '') AS tight FROM documents")
def whitespace_norm(spark, sf):
    return notes(spark, sf).select("doc_id", T.collapse(F.col("text")).alias("flat"), T.squeeze(F.col("text")).alias("tight"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_''\-]+')) AS words, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_''\-]+'))) AS distinct_words FROM documents")
def word_tokens(spark, sf):
    w = T.words(F.col("text"))
    return notes(spark, sf).select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"))


@query("""
WITH s AS (SELECT source, 'BANNER' || chr(10) || string_agg(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10) ORDER BY doc_id) || chr(10) AS c FROM documents GROUP BY source)
SELECT source, length(c) AS canonical_characters, sha256(c) AS canonical_sha256 FROM s
""")
def canonical_by_source(spark, sf):
    pages = notes(spark, sf).select("source", F.col("doc_id").alias("page"), "text", F.lit("primary_text").alias("section"))
    return scoping.canonical_digest(pages, "BANNER", key="source")


@query(r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(range(0, greatest(length(t) - 120, 0), 20), lambda s: (length(t) - length(replace(t, t[s + 1:s + 120], ''))) // 120 > 1) AS hits FROM f)
SELECT doc_id, trim(t[hits[1] + 1:hits[1] + 110]) AS block FROM w WHERE len(hits) > 0
""")
def duplicate_window(spark, sf):
    return notes(spark, sf).select("doc_id", scoping.duplicate_block(F.col("text")).alias("block")).filter("block IS NOT NULL")


@query(r"""
WITH n AS (SELECT source, CASE WHEN trim(split_part(text, chr(10), 1)) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')), ' ')) END AS words FROM documents)
SELECT source, count(*) FILTER (WHERE words < 8) AS weak, count(*) AS n FROM n GROUP BY source
""")
def weak_description(spark, sf):
    words = T.word_count(F.split_part("text", F.lit("\n"), F.lit(1)))
    return notes(spark, sf).groupBy("source").agg(F.count_if(words < lint.SHORTEST_DESCRIPTION).alias("weak"), F.count("*").alias("n"))


#: Inner words of a passage that make its key, and tiny passages that are sent to all texts.
KEY_WORDS, MAX_TINY = 4, 10_000


def hits(spark, sf) -> DataFrame:
    """item_id, doc_id of the documents that hold a benchmark passage.

    A passage may start and end inside a word of the text, so its outer words are left out;
    the first of the inner ones, four at most, are its key. An equality join on runs of as
    many words as keys have finds the candidates, and containment is then tested on them.
    Passages without an inner word have no key: they are counted, and sent to the texts if
    they are few; many of them meet the texts by their first three letters.
    """
    items = table(spark, sf, "benchmark").filter("text IS NOT NULL AND length(text) > 0").select("item_id", F.col("text").alias("quote"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    flat = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    words = flat("quote")
    keyed = items.filter(F.size(words) >= 3).select("item_id", F.slice(words, F.lit(2), F.least(F.size(words) - 2, F.lit(KEY_WORDS))).alias("inner")).select(
        "item_id", F.size("inner").alias("n"), F.array_join("inner", " ").alias("key")
    )
    lengths = sorted(r["n"] for r in keyed.select("n").distinct().collect())  # 1 to 4
    found = spark.createDataFrame([], "item_id long, doc_id long")
    if lengths:
        def runs_of(w, n: int):
            own = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
            return F.when(F.size(w) >= n, own).otherwise(F.array().cast("array<string>"))

        runs = lambda w: F.flatten(F.array(*[runs_of(w, n) for n in lengths]))
        found = (
            docs.select("doc_id", F.explode(F.array_distinct(T.bound(flat("text"), runs))).alias("key")).join(keyed.select("key").distinct(), "key", "left_semi")
            .join(keyed.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
            .join(docs, "doc_id").join(items, "item_id").filter(F.instr("text", F.col("quote")) > 0).select("item_id", "doc_id")
        )
    tiny = items.filter(F.size(words) < 3)
    n_tiny = tiny.limit(MAX_TINY + 1).count()
    if n_tiny > MAX_TINY:
        starts = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substr("text", i, F.lit(3))))).alias("start"))
        long = tiny.filter(F.length("quote") >= 3).withColumn("start", F.left("quote", F.lit(3)))
        near = starts.join(long.select("item_id", "start"), "start").select("doc_id", "item_id").join(docs, "doc_id").join(items, "item_id")
        found = found.unionByName(near.filter(F.instr("text", F.col("quote")) > 0).select("item_id", "doc_id"))
        tiny = tiny.filter(F.length("quote") < 3)
    if n_tiny:
        found = found.unionByName(docs.join(F.broadcast(tiny), F.expr("instr(text, quote) > 0")).select("item_id", "doc_id"))
    return found


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0 WHERE length(b.text) > 0")
def quote_containment(spark, sf):
    return hits(spark, sf)


@query("""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
p AS (SELECT doc_id, string_split(line, '"') AS pieces FROM lines WHERE NOT starts_with(ltrim(line), '```')),
q AS (SELECT doc_id, unnest([pieces[i] FOR i IN range(2, len(pieces), 2)]) AS span FROM p)
SELECT doc_id, count(*) AS spans, sum(length(span))::BIGINT AS characters FROM q WHERE length(span) >= 3 AND instr(span, '“') = 0 AND instr(span, '”') = 0 GROUP BY doc_id
""")
def straight_quote_pairs(spark, sf):
    spans = notes(spark, sf).select("doc_id", F.explode(quotations.straight_quoted(F.col("text"), 3)).alias("span"))
    return spans.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.length("span")).alias("characters"))


@query("""
WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x <> '') AS t FROM benchmark),
g AS (SELECT item_id, unnest(list_distinct(flatten([[array_to_string(t[i:i + k - 1], ' ') FOR i IN range(1, len(t) - k + 2)] FOR k IN range(1, least(12, len(t)) + 1)]))) AS gram FROM w)
SELECT item_id, sha256(gram) AS sha256 FROM g
""")
def ngram_hashes(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return leakscan.gram_hashes(table(spark, sf, "benchmark"), "item_id", words)


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest([array_to_string(t[i:i + 4], ' ') FOR i IN range(1, len(t) - 3)]) AS gram FROM w),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark),
d AS (SELECT DISTINCT unnest([array_to_string(t[i:i + 4], ' ') FOR i IN range(1, len(t) - 3)]) AS gram FROM b)
SELECT doc_id, count(*) AS denied FROM g JOIN d USING (gram) GROUP BY doc_id
""")
def ngram_denied(spark, sf):
    """Documents against a denylist of hashed five-word runs."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    every = lambda w, of: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: of(F.array_join(F.slice(w, i, F.lit(5)), " "))))
    runs = lambda df, key, of: df.filter(F.size(words) >= 5).select(key, F.explode(T.bound(words, lambda w: every(w, of))).alias("hash"))
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    # Short hashes tell which documents may hold a run; only those are hashed in full.
    near = runs(docs, "doc_id", F.xxhash64).join(runs(items, "item_id", F.xxhash64).select("hash").distinct(), "hash", "left_semi").select("doc_id").distinct()
    sha = lambda run: F.sha2(run, 256)
    found = runs(docs.join(near, "doc_id", "left_semi"), "doc_id", sha).join(runs(items, "item_id", sha).select("hash").distinct(), "hash", "left_semi")
    return found.groupBy("doc_id").agg(F.count("*").alias("denied"))


@query(r"""
SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '\b[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,}\b'), lambda m: NOT (ends_with(m, '.com')))) AS other_mail,
       len(regexp_extract_all(lower(text), '\b[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,}\b')) AS mail
FROM documents WHERE regexp_matches(lower(text), '\b[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,}\b')
""")
def leak_email(spark, sf):
    mails = F.regexp_extract_all(F.lower("text"), F.lit(leakscan.EMAIL), F.lit(0))
    return notes(spark, sf).filter(F.lower("text").rlike(leakscan.EMAIL)).select(
        "doc_id", F.size(F.filter(mails, lambda m: ~m.endswith(".com"))).cast("long").alias("other_mail"), F.size(mails).cast("long").alias("mail")
    )


@query(r"""
SELECT doc_id, regexp_matches(text, '(?i)\b(?:sk|key|token|secret)[-_][a-z0-9]{16,}\b') AS shape, regexp_matches(text, '\bAKIA[A-Z0-9]{16}\b') AS credential
FROM documents WHERE regexp_matches(text, '(?i)\b(?:sk|key|token|secret)[-_][a-z0-9]{16,}\b') OR regexp_matches(text, '\bAKIA[A-Z0-9]{16}\b')
""")
def leak_secret(spark, sf):
    shape, known = F.col("text").rlike(leakscan.SECRET_SHAPE), F.col("text").rlike(r"\bAKIA[A-Z0-9]{16}\b")
    return notes(spark, sf).select("doc_id", shape.alias("shape"), known.alias("credential")).filter("shape OR credential")


@query()
def privacy_findings(spark, sf):
    """All privacy shapes; lookbehind has no form in the oracle's engine."""
    return notes(spark, sf).select("doc_id", F.explode(leakscan.privacy_findings(F.col("text"))).alias("finding"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages")
def link_edges(spark, sf):
    return files.html_pages(table(spark, sf, "pages")).select("page_id", F.explode("links").alias("target"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, sf):
    return files.html_pages(table(spark, sf, "pages")).select("page_id", "title")


@query(r"""
WITH t AS (SELECT page_id, lower(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))) AS title FROM pages)
SELECT title, count(*) AS pages, min(page_id) AS first_page FROM t GROUP BY title HAVING count(*) > 1
""")
def duplicate_titles(spark, sf):
    titles = files.html_pages(table(spark, sf, "pages")).select("page_id", F.lower("title").alias("title"))
    return titles.groupBy("title").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).filter("pages > 1")


_TARGETS = """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
p AS (SELECT DISTINCT regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
"""


def page_paths(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[^:]+://[^/]+(/[^?#]*)", 1).alias("path"))


@query(_TARGETS + "SELECT target, count(*) AS links FROM l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.path = l.target) GROUP BY target")
def link_status(spark, sf):
    """Link targets that no page answers to."""
    return linkgraph.broken(link_edges(spark, sf), page_paths(spark, sf)).groupBy("target").agg(F.count("*").alias("links"))


@query(_TARGETS + "SELECT page_id FROM (SELECT page_id, regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1) AS path FROM pages) q WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.target = q.path AND l.page_id <> q.page_id)")
def inbound_orphans(spark, sf):
    """Pages that no other page links to."""
    inbound = link_edges(spark, sf).select(F.col("page_id").alias("source"), F.col("target").alias("path"))
    return linkgraph.without_inbound(page_paths(spark, sf), inbound, "page_id").select("page_id")


@query(_TARGETS + "SELECT target, count(*) AS inbound, count(DISTINCT page_id) AS from_pages FROM l GROUP BY target")
def inbound_counts(spark, sf):
    return link_edges(spark, sf).groupBy("target").agg(F.count("*").alias("inbound"), F.count_distinct("page_id").alias("from_pages"))


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM (SELECT doc_id, quality::VARCHAR AS q FROM labels WHERE doc_id % 3 <> 0) a
FULL JOIN (SELECT doc_id, (CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END)::VARCHAR AS q FROM labels WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.q <> b.q
""")
def checksum_diff(spark, sf):
    """Two inventories derived from the labels: some lost, some added, some changed."""
    rows = table(spark, sf, "labels")
    value = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    old = rows.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.col("quality").cast("string"), 256).alias("sha256"))
    new = rows.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.sha2(value.cast("string"), 256).alias("sha256"))
    return integrity.checksum_diff(old, new)


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unlabelled_docs(spark, sf):
    return notes(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def ref_integrity(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("SELECT o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def childless_orders(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


_GAPS = "SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 1"


def thinned(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").filter("turn % 3 <> 1").select("conv_id", "turn")


@query(f"""
WITH t AS ({_GAPS}), o AS (SELECT conv_id, turn, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, 0) AS expected FROM t)
SELECT conv_id, turn, expected FROM o WHERE turn <> expected
""")
def sequence_gaps(spark, sf):
    return integrity.sequence_faults(thinned(spark, sf), "conv_id", "turn", start=0)


@query(f"""
WITH t AS ({_GAPS}), l AS (SELECT conv_id, list(turn ORDER BY turn) AS ts FROM t GROUP BY conv_id)
SELECT conv_id, list_reduce(ts, lambda e, x: CASE WHEN x = e AND e <= 3 THEN e + 1 ELSE e END, 0::BIGINT) AS accepted FROM l
""")
def running_sequence(spark, sf):
    turns = thinned(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("int"))).alias("ts"))
    return turns.select("conv_id", F.size(scoping.running_sequence(F.col("ts"), F.lit(0), F.lit(3))).cast("long").alias("accepted"))


@query("""
WITH o AS (SELECT conv_id, turn, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, 0) AS expected FROM conversations)
SELECT conv_id, turn, expected FROM o WHERE turn <> expected
""")
def sequence_gaps_all(spark, sf):
    """Faults of every turn as it stands; sequence_gaps leaves some out to make gaps."""
    return integrity.sequence_faults(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", start=0)


@query("""
WITH l AS (SELECT conv_id, list(turn ORDER BY turn) AS ts FROM conversations GROUP BY conv_id)
SELECT conv_id, list_reduce(ts, lambda e, x: CASE WHEN x = e THEN e + 1 ELSE e END, 0::BIGINT) AS accepted FROM l
""")
def running_sequence_all(spark, sf):
    """Every turn, up to the conversation's own last one."""
    return followed(table(spark, sf, "conversations"))


def followed(turns: DataFrame) -> DataFrame:
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("int"))).alias("ts"))
    return rows.select("conv_id", F.size(scoping.running_sequence(F.col("ts"), F.lit(0), F.array_max("ts"))).cast("long").alias("accepted"))


@query("""
WITH RECURSIVE r AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS k FROM documents QUALIFY k <= 12),
f AS (
  SELECT source, 1::BIGINT AS k, [doc_id] AS chosen, greatest(0, 9000 - n) AS remaining FROM r WHERE k = 1
  UNION ALL
  SELECT f.source, f.k + 1, CASE WHEN r.n <= f.remaining THEN list_append(chosen, r.doc_id) ELSE chosen END, CASE WHEN r.n <= f.remaining THEN f.remaining - r.n ELSE f.remaining END
  FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1
)
SELECT source, array_to_string(list_sort(chosen), ',') AS chosen FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC) = 1
""")
def greedy_budget(spark, sf):
    order = Window.partitionBy("source").orderBy(F.desc("chars"), "doc_id")
    top = notes(spark, sf).select("source", "doc_id", F.length("text").cast("long").alias("chars")).withColumn("rank", F.row_number().over(order)).filter("rank <= 12")
    ranked = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("page"), "chars"))).alias("ranked"))
    return ranked.select("source", F.array_join(F.transform(evidence.within_budget(F.col("ranked"), 9000), lambda p: p.cast("string")), ",").alias("chosen"))


@query(r"""
WITH d AS (SELECT doc_id, text FROM documents WHERE lang = 'en')
SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?m)^(Released|Licensed) under .*$', '', 'g'), '[0-9]{7,}', '', 'g')) AS sha256,
       regexp_matches(text, '(?m)^(Released|Licensed) under .*$') AS license,
       regexp_matches(regexp_replace(text, '(?m)^(Released|Licensed) under .*$', '', 'g'), '[0-9]{7,}') AS digits
FROM d
""")
def furniture_strip(spark, sf):
    return stripped(table(spark, sf, "documents").filter("lang = 'en'"))


def stripped(docs: DataFrame) -> DataFrame:
    rules = [(r"(?m)^(Released|Licensed) under [^\n]*$", "license"), ("[0-9]{7,}", "digits")]
    out = scoping.strip_furniture(docs.select("doc_id", "text"), rules)
    has = lambda r: F.array_contains("furniture_removed", r).alias(r)
    return out.select("doc_id", T.sha256(F.col("text")).alias("sha256"), has("license"), has("digits"))


@query(ORACLES["furniture_strip"].replace(" WHERE lang = 'en'", ""))
def furniture_strip_all(spark, sf):
    return stripped(table(spark, sf, "documents"))


@query(r"""
WITH d AS (SELECT doc_id, text, instr(text, '.') AS pos FROM documents)
SELECT doc_id, sha256(CASE WHEN pos = 0 THEN text ELSE regexp_replace(text[pos:], '\s+$', '') || chr(10) END) AS sha256,
       CASE WHEN pos = 0 THEN 0 ELSE length(regexp_replace(regexp_replace(text[:pos - 1], '^\s+', ''), '\s+$', '')) END AS removed
FROM d
""")
def boundary_clip(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), "text")
    rules = pages.filter(F.instr("text", ".") > 0).select("page", F.lit(".").alias("marker"), F.lit("after").alias("keep"), F.lit("clip").alias("action"))
    out = scoping.clip(pages, rules)
    return out.select(F.col("page").alias("doc_id"), T.sha256(F.col("text")).alias("sha256"), F.length("discarded_text").cast("long").alias("removed"))


@query(r"""
WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN '—' ELSE replace(rtrim(t[1:64]) || CASE WHEN length(t) > 64 THEN '…' ELSE '' END, '|', '\|') END AS opening,
       length(text) AS characters, sha256(text)[1:12] AS hash_prefix
FROM f
""")
def page_map(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), "text")
    return scoping.page_map(pages).select(F.col("page").alias("doc_id"), "opening", F.col("characters").cast("long").alias("characters"), "hash_prefix")


_HITS = "h AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0 WHERE length(b.text) > 0)"


@query(f"""
WITH {_HITS}, f AS (SELECT b.item_id, min(h.doc_id) AS first_doc FROM benchmark b LEFT JOIN h USING (item_id) GROUP BY b.item_id)
SELECT item_id, coalesce(first_doc, -1) AS first_doc, ((row_number() OVER (ORDER BY coalesce(first_doc, 1000000000), item_id) - 1) // 5)::INTEGER AS packet FROM f
""")
def review_packets(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id")
    first = hits(spark, sf).groupBy("item_id").agg(F.min("doc_id").alias("first_doc"))
    ranked = items.join(first, "item_id", "left").withColumn("o", F.coalesce("first_doc", F.lit(evidence.NO_PAGE)))
    packed = evidence.chunk(ranked, evidence.NOTES, "o", "item_id", name="packet").drop("o")
    return packed.withColumn("first_doc", F.coalesce("first_doc", F.lit(-1).cast("long")))


@query(f"""
WITH {_HITS}, p AS (SELECT item_id // 5 AS packet, doc_id AS page, count(DISTINCT item_id) AS demand FROM h GROUP BY ALL)
SELECT packet, page, demand FROM p QUALIFY row_number() OVER (PARTITION BY packet ORDER BY demand DESC, page) <= 12
""")
def page_demand(spark, sf):
    packed = hits(spark, sf).groupBy("item_id").agg(F.collect_set("doc_id").alias("pages")).select(
        F.floor(F.col("item_id") / 5).alias("packet"), F.col("item_id").alias("path"), "pages"
    )
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.length("text").alias("chars"))
    order = Window.partitionBy("packet").orderBy(F.desc("demand"), "page")
    return evidence.page_demand(packed, pages).withColumn("r", F.row_number().over(order)).filter(f"r <= {evidence.PAGES}").select("packet", "page", "demand")


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view,
       count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, count(*) AS n
FROM events GROUP BY user_id
""")
def event_metrics(spark, sf):
    return eventlog.event_metrics(table(spark, sf, "events"), ("click", "view", "purchase"), "user_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_snapshot(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return eventlog.latest(rows, "user_id", "at").drop("at")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) < 5")
def floors(spark, sf):
    return inventory.fewer_than(table(spark, sf, "orders"), "o_custkey", 5)


@query("SELECT text_key, n, first_doc FROM (SELECT sha256(text) AS text_key, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1) WHERE n > 1")
def uniqueness(spark, sf):
    """Keys that several rows share."""
    rows = notes(spark, sf).select(T.sha256(F.col("text")).alias("text_key"), F.col("doc_id").alias("ord"))
    return inventory.several(rows, "text_key").select("text_key", "n", F.col("first").alias("first_doc"))


@query("""
SELECT n_regionkey, list_sort(list(DISTINCT left(n_name, 1)))::VARCHAR <> list_sort(['A', 'B', 'C'])::VARCHAR AS uncovered FROM nation GROUP BY n_regionkey
""")
def kind_coverage(spark, sf):
    kinds = F.array(*map(F.lit, "ABC"))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg((F.array_sort(F.collect_set(F.left("n_name", F.lit(1)))) != kinds).alias("uncovered"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def issue_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("""
SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es,
       count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'xx') AS xx FROM documents GROUP BY source
""")
def kinds_pivot(spark, sf):
    """Zero-filled pivot over a fixed list of kinds, one of them absent."""
    return lint.pivot(table(spark, sf, "documents"), "source", "lang", ("de", "en", "es", "fr", "xx"))


@query("""
WITH a AS (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS n FROM documents)
SELECT (n // 100)::INTEGER AS chunk, min(doc_id) AS low, max(doc_id) AS high, count(*) AS n FROM a GROUP BY 1
""")
def chunks(spark, sf):
    rows = evidence.chunk(notes(spark, sf).select("source", "doc_id"), 100, "source", "doc_id")
    return rows.groupBy("chunk").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))


@query("SELECT page_id, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]+)', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slugs(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.lower(F.regexp_extract("url", "^([^:]+)://", 1)).alias("scheme"), T.slugify(F.regexp_extract("url", r"^[^:]+://([^/?#]+)", 1), "").alias("slug")
    )


@query("SELECT source, bool_and(n_chars = length(text)) AS lengths_agree, sum(n_chars)::BIGINT AS characters, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")
def validation_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(
        F.bool_and(F.col("n_chars") == F.length("text")).alias("lengths_agree"), F.sum("n_chars").alias("characters"),
        F.min("n_chars").alias("least"), F.max("n_chars").alias("most"),
    )


@query("""
SELECT s.s_suppkey, n.n_name, r.r_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s.s_suppkey) AS lines
FROM supplier s LEFT JOIN nation n ON s_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey
""")
def lookup_joins(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"))
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "n_name", "r_name", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("SELECT conv_id, turn, role, (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn)::BIGINT + (SELECT max(event_id) FROM events) AS sequence FROM conversations a WHERE conv_id >= 0")
def resequenced(spark, sf):
    """Child logs appended under a parent's numbering."""
    parent = table(spark, sf, "events").select(F.col("event_id").alias("sequence"), F.lit(None).cast("long").alias("run_id"))
    child = table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("sequence"), "role")
    both = integrity.resequence(parent, child).filter("child_sequence IS NOT NULL")
    return both.select(F.col("run_id").alias("conv_id"), F.col("child_sequence").alias("turn"), "role", "sequence")


@query("SELECT doc_id, label FROM (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' ELSE 'unknown' END AS label FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)) WHERE label <> 'good'")
def issues_union(spark, sf):
    """Rule outputs as one bag."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    bad = docs.join(labels.filter("quality = 0"), "doc_id", "left_semi").select("doc_id", F.lit("bad").alias("label"))
    unknown = docs.join(labels.filter("quality IS NOT NULL"), "doc_id", "left_anti").select("doc_id", F.lit("unknown").alias("label"))
    return bad.unionByName(unknown)


# Shapes that SQL cannot express. --------------------------------------------------------


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strip_accents(coalesce(text, '')) AS bare FROM documents),
k AS (SELECT doc_id, t, length(regexp_replace(bare, '[^A-Za-z0-9]', '', 'g')) AS kept, length(regexp_replace(bare, '[^\pL\pN]', '', 'g')) AS letters FROM d)
SELECT doc_id, sha256(trim(regexp_replace(lower(t), '\s+', ' ', 'g'))) AS sha256, CASE WHEN letters > 0 THEN round(kept / letters, 6) ELSE 0.0 END AS retention FROM k""")
def normalised_texts(spark, sf):
    """Compatibility forms of whole texts; the twin has canonical composition alone, which is the same for plain texts."""
    return notes(spark, sf).select("doc_id", T.sha256(U.normalise(F.col("text"))).alias("sha256"), F.round(U.latin_key(F.col("text"))["retention"], 6).alias("retention"))


@query()
def numbered_entries(spark, sf):
    """Entries that start a line with the number then due, per source."""
    text = F.regexp_replace("text", r"\. ", ".\n1. ")
    pages = notes(spark, sf).select("source", F.col("doc_id").alias("page"), text.alias("text"))
    return scoping.entries(pages, "source").select("source", "page", "number", F.length("text").alias("characters"))


@query("SELECT doc_id AS page, rotation, mode FROM documents, (VALUES (0), (90), (180), (270)) r(rotation), (VALUES (6), (11)) m(mode) WHERE n_chars % 3 > 0 OR n_chars = 0")
def ocr_grid(spark, sf):
    pages = table(spark, sf, "documents").select(
        F.col("doc_id").alias("page"), (F.col("n_chars") % 3).alias("images"), F.col("n_chars").alias("native_text_characters")
    )
    return extraction.fallback_grid(pages)
