"""URL filters: allow and block rules, and gradient-boosted trees where no rule fits.

Labels come from the URLs that a rule fits. DataFrame aggregations reduce all of them to
a histogram of at most ``MAX_TRAINING_ROWS`` rows, on which the driver grows the trees.
They become one CASE expression, so no row meets Python.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule
and the trees' verdict; with no labelled URL at all, or labels of one kind only, the
trees are constant; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import cut

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Bound on the rows of the histogram that the trees are fitted on, and their shape.
MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 16, 3, 16, 0.3, 1.0
#: Suffixes with this share of all pages are broadcast: 1 / COMMON_SUFFIX of them at most.
COMMON_SUFFIX = 0.002
#: Folds of the labelled URLs, and URLs without a label that each suffix is given besides.
FOLDS, PRIOR, BLIND = 5, 10, 2

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "letter_ratio",
    "host_entropy", "url_entropy", "parameters", "query_length", "suffix_share", "suffix_blocked",
)


def parts(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _PARTS, 1), UPPER, LOWER), F.regexp_extract(text, _PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule), or null."""
    fits = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        fits = F.when(fit, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(fits)
    return fits


def _entropy(text: Column) -> Column:
    size = F.length(text)
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    count = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    return F.aggregate(chars, F.lit(0.0), lambda a, c: a - count(c) * F.log2(count(c)))


def _suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def lexical(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, fit, suffix and the lexical features."""
    host, path = parts(F.col("url"))
    judged = pages.withColumns({"host": host, "path": path})
    judged = judged.withColumns({"fit": rule_of(F.col("host"), F.col("path"), rules), "suffix": _suffix(F.col("host"))})
    url = F.coalesce(F.col("url"), F.lit(""))
    ratio = lambda pattern: F.coalesce(F.regexp_count(url, F.lit(pattern)) / F.nullif(F.length(url), F.lit(0)), F.lit(0.0))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return judged.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "labels": F.regexp_count("host", F.lit(r"\.")).cast("double"),
        "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        "digit_ratio": ratio("[0-9]"),
        "letter_ratio": ratio("[A-Za-z]"),
        "host_entropy": _entropy(F.col("host")),
        "url_entropy": _entropy(url),
        "parameters": F.when(F.length(query) > 0, F.regexp_count(query, F.lit("&")) + 1).otherwise(0).cast("double"),
        "query_length": F.length(query).cast("double"),
    })


def with_suffixes(judged: DataFrame) -> DataFrame:
    """Adds suffix_share and suffix_blocked; the statistics are over all rows.

    suffix_share is the power of ten below a suffix's share of all pages: anything finer
    would name the suffix, and the trees would learn names in place of words.
    suffix_blocked is the share of blocked URLs among all of a suffix, where a URL
    without a rule, and ``PRIOR`` more, count as the mean does: labels speak for a suffix
    as far as they cover it. A labelled URL's own fold takes no part, so no label is read
    from the statistic; and to those of the first ``BLIND`` folds their suffix is as one
    without labels, so the trees learn to judge URLs of new suffixes. Common suffixes are broadcast, the others joined by shuffle.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col("url"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    judged = judged.withColumn("fold", F.when(F.col("fit").isNotNull(), fold))
    blocked = (F.col("fit.verdict") == "block").cast("long")
    in_fold = lambda k: F.col("fold") == k
    counts = cut(
        judged.groupBy("suffix").agg(
            F.count("*").alias("n"),
            F.array(*[F.count_if(in_fold(k)) for k in range(FOLDS)]).alias("ruled"),
            F.array(*[F.coalesce(F.sum(F.when(in_fold(k), blocked)), F.lit(0)) for k in range(FOLDS)]).alias("blocked"),
        ),
        "suffixes",
    )
    sum_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    total, ruled, hits = counts.agg(F.sum("n"), F.sum(sum_of("ruled")), F.sum(sum_of("blocked"))).first()
    mean = ((hits or 0) + 1.0) / ((ruled or 0) + 2.0)
    common = F.col("n") >= COMMON_SUFFIX * (total or 0)
    own = lambda c: F.coalesce(F.get(c, F.col("fold")), F.lit(0))
    others_ruled, others_blocked = (sum_of(c) - own(c) for c in ("ruled", "blocked"))
    known = judged.join(F.broadcast(counts.filter(common)), "suffix").unionByName(
        judged.join(F.broadcast(counts.filter(common).select("suffix")), "suffix", "left_anti").join(
            counts.filter(~common).hint("merge"), "suffix"
        )
    )
    size = F.col("n") - own("ruled")
    rate = (others_blocked + mean * (size - others_ruled + PRIOR)) / (size + PRIOR)
    return known.withColumns({
        "suffix_share": F.floor(F.log10(F.col("n") / F.lit(float(max(total or 0, 1))) + 1e-12)).cast("double"),
        "suffix_blocked": F.when(F.col("fold") < BLIND, F.lit(mean)).otherwise(rate),
    }).drop("n", "ruled", "blocked", "fold")


class BoostedTrees:
    """Trees as nested tuples: a leaf value, or (feature, threshold, left, right)."""

    def __init__(self, base: float, trees: list):
        self.base, self.trees = base, trees

    def margin(self) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            return F.when(F.col(node[0]) <= node[1], walk(node[2])).otherwise(walk(node[3]))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + walk(tree)
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def fit(labelled: DataFrame, label: str = "y", max_rows: int = MAX_TRAINING_ROWS) -> BoostedTrees:
    """Boosted trees on the histogram of all labelled rows.

    Rows whose features fall in the same bins are one row of the histogram with its
    counts, so a URL that repeats adds none. Of more than ``max_rows`` such rows the least
    by hash are learnt from. One aggregation finds the bins, a second the histogram.
    """
    found = labelled.agg(F.count("*").alias("n"), F.sum(label).alias("positive"), *[
        F.percentile_approx(f, [(i + 1) / BINS for i in range(BINS - 1)], 1000).alias(f) for f in FEATURES
    ]).first()
    n, positive = found["n"], found["positive"]
    if not n or not positive or positive == n:
        return BoostedTrees(0.0 if not n else (4.0 if positive else -4.0), [])
    edges = [sorted({float(e) for e in found[f]}) for f in FEATURES]
    bins = F.array(*[sum(((F.col(f) > e).cast("int") for e in own), F.lit(0)) for f, own in zip(FEATURES, edges, strict=True)])
    rows = (
        labelled.groupBy(bins.alias("bins")).agg(F.count("*").alias("n"), F.sum(label).alias("positive"))
        .orderBy(F.xxhash64("bins"), "bins").limit(max_rows).collect()
    )
    cells = np.array([r["bins"] for r in rows], dtype=np.int64)
    count, hit = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("n", "positive"))
    base = math.log(positive / (n - positive))
    margin, trees = np.full(len(rows), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(cells, count * p - hit, count * p * (1 - p), np.arange(len(rows)), margin)
        trees.append(_named(tree, edges))
    return BoostedTrees(base, trees)


def _grow(cells: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, margin: np.ndarray, depth: int = 0):
    """A tree over some rows of the histogram; adds its leaves to their margins.

    A leaf value, or (feature, last bin to the left, left, right).
    """
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best_gain, best = 1e-6, None
    for f in range(cells.shape[1] if depth < DEPTH else 0):
        own = cells[rows, f]
        left_g, left_h = (np.cumsum(np.bincount(own, weights=x[rows], minlength=BINS))[:-1] for x in (g, h))
        gain = left_g**2 / (left_h + RIDGE) + (total_g - left_g) ** 2 / (total_h - left_h + RIDGE) - total_g**2 / (total_h + RIDGE)
        at = int(np.argmax(gain))
        if gain[at] > best_gain and (own <= at).any() and (own > at).any():
            best_gain, best = gain[at], (f, at)
    if best is None:
        leaf = float(-RATE * total_g / (total_h + RIDGE))
        margin[rows] += leaf
        return leaf
    f, at = best
    left = cells[rows, f] <= at
    return (f, at, *[_grow(cells, g, h, rows[side], margin, depth + 1) for side in (left, ~left)])


def _named(node, edges: list[list[float]]):
    """The tree with names of features and thresholds in place of numbers of bins."""
    if isinstance(node, float):
        return node
    f, at, left, right = node
    return (FEATURES[f], edges[f][at], _named(left, edges), _named(right, edges))


def labelled_rows(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("fit").isNotNull()).withColumn("y", (F.col("fit.verdict") == "block").cast("int"))


def held_out_accuracy(pages: DataFrame, held: Column, rules=RULES) -> tuple[int, int]:
    """Labelled URLs that ``held`` (over the columns of ``lexical``) keeps from training, and how many are judged right."""
    whole = cut(lexical(pages.select("page_id", "url"), rules), "lexical")
    masked = whole.withColumn("truth", F.col("fit")).withColumn("fit", F.when(~held, F.col("fit")))
    judged = cut(with_suffixes(masked), "masked")
    score = fit(labelled_rows(judged)).probability()
    right = F.when(score >= 0.5, "block").otherwise("allow") == F.col("truth.verdict")
    n, good = judged.filter(F.col("truth").isNotNull() & F.col("fit").isNull()).agg(F.count("*"), F.count_if(right)).first()
    return n, good


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every page."""
    judged = cut(with_suffixes(cut(lexical(pages.select("page_id", "url"), rules), "lexical")), "judged")
    score = fit(labelled_rows(judged)).probability()
    return judged.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
        score.alias("block_score"),
    )
