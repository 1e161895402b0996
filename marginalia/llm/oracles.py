"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from marginalia.llm import secret_scans as s

OP2 = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""

OP4 = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END) AS shingle
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, h) AS rep
  FROM (SELECT doc_id, count(*) AS n, sum(hash(shingle)::HUGEINT) AS h FROM s GROUP BY doc_id)
),
r AS (SELECT s.doc_id, shingle, n FROM s JOIN sets USING (doc_id) WHERE s.doc_id = sets.rep),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM r a JOIN r b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sets WHERE doc_id = rep
  UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
),
least_of AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN least_of ON least_of.u = sets.rep
"""


def _op11(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, part, min({{'d': xx - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'k': k}}) AS best
  FROM p JOIN c{r} USING (part) GROUP BY rid, part
)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT part, k, coalesce(m.c, b.c) AS c FROM c{r} b LEFT JOIN (
    SELECT part, k, list(mean ORDER BY j) AS c FROM (
      SELECT part, best.k AS k, j, floor(sum(x[j]) / count(*)) AS mean
      FROM a{r} JOIN p USING (rid, part), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS j) GROUP BY part, best.k, j
    ) GROUP BY part, k
  ) m USING (part, k)
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, [floor(4096 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS MATERIALIZED (
  SELECT *, list_inner_product(x, x) AS xx FROM (
    SELECT rid, part, e[1 + part * len(e) // {parts}:(1 + part) * len(e) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS part)
  )
),
c0 AS MATERIALIZED (
  SELECT part, k, x AS c FROM p JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS k FROM v) USING (rid) WHERE k < {entries}
),{",".join(steps)},
f AS (SELECT rid, string_agg(printf('%02x', best.k), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string([x::BIGINT FOR x IN c], ','), ',' ORDER BY part, k)) FROM c{rounds}) AS codebooks_sha256
FROM v JOIN f USING (rid)
"""


OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
m AS (
  SELECT doc_id, part,
    (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM d
),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits
  FROM f a, f b, f x, f y, f z WHERE a.bit + b.bit + x.bit + y.bit + z.bit = 31
    AND len(list_distinct([a.bit, b.bit, x.bit, y.bit, z.bit])) = 5
),
s AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(bad) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op9() -> str:
    found = "\nUNION ALL\n".join(
        f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, i,
        list_sum([length(x) FOR x IN string_split_regex(t, {_literal(s.PATTERNS[kind])})[1:i]])
          + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS start,
        length(m[i]) AS size, m[i] AS whole, v[i] AS value
        FROM (SELECT rid, t, regexp_extract_all(t, {_literal(s.PATTERNS[kind])}) AS m,
                     regexp_extract_all(t, {_literal(s.PATTERNS[kind])}, {s.VALUE_GROUP.get(kind, 0)}) AS v
              FROM d WHERE regexp_matches(t, {_literal(s.PATTERNS[kind])})) x,
             LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) y"""
        for rank, kind in enumerate(s.KINDS)
    )
    role = "CASE b.kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in s.ROLE.items()) + " END"
    needs = " ".join(
        f"WHEN '{k}' THEN " + " AND ".join(f"bool_or(role = '{r}')" for r in rs) for k, rs in s.NEEDS.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT rid, rank, kind, start, start + size AS stop FROM ({found}) f
  WHERE CASE kind WHEN 'assign' THEN length(value) >= {s.SHORTEST_VALUE["assign"]}
                  WHEN 'account' THEN length(value) >= {s.SHORTEST_VALUE["account"]}
                  WHEN 'bare' THEN regexp_matches(whole, '[A-Z]') AND regexp_matches(whole, '[a-z]')
                                   AND regexp_matches(whole, '[0-9]')
                  ELSE true END
),
near AS (
  SELECT a.rid, a.rank, a.kind, a.start, a.stop, {role} AS role,
         b.rank < {s.BASE} AND b.start <= a.start AND b.stop >= a.stop AS covers
  FROM parts a JOIN parts b
    ON a.rid = b.rid AND a.rank >= {s.BASE} AND a.kind <> b.kind
   AND b.start - {s.SCOPE} < a.stop AND b.stop + {s.SCOPE} > a.start
),
kept AS (
  SELECT rid, rank, kind, start, stop FROM near GROUP BY rid, rank, kind, start, stop
  HAVING NOT bool_or(covers) AND CASE kind {needs} END
),
spans AS (
  SELECT rid, rank, kind, start, stop FROM parts WHERE rank < {s.BASE}
  UNION ALL SELECT * FROM kept
),
one AS (
  SELECT rid,
         count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) FILTER (WHERE rank < {s.BASE}) AS base,
         string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN one USING (rid)
"""


ORACLES = {"op2_exact_topk": OP2, "op4_exact_dedup": OP4, "op8_ngram_jaccard": OP8, "op9_secret_scans": _op9(), "op11_vector_codes": _op11(), "op12_filter_audit": OP12}
