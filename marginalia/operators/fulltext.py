"""Ranked full-text query over notes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.unicode import casefold

#: Weights of a term in title and path beside 1 in the body; snippet reach.
TITLE_WEIGHT, PATH_WEIGHT = 8, 3
BEFORE, AFTER = 90, 220


#: How letters are folded, in a column and in a term: fully, or as far as SQL engines do.
FOLDS = {"casefold": (casefold, str.casefold), "lower": (F.lower, str.lower)}


def query_terms(query: str, fold: str = "casefold") -> list[str]:
    terms = [FOLDS[fold][1](t) for t in re.findall(r"[\w'-]+", query)]
    if not terms:
        raise ValueError("a query needs at least one word")
    return terms


def search(notes: DataFrame, query: str, limit: int = 10, title=None, fold: str = "casefold") -> DataFrame:
    """score, title, path, snippet of the best notes in which every term occurs.

    notes: path, text. Terms are substrings of folded texts; a repeated term counts again
    in the score. The order is by falling score, then path: a top-k, not a full sort.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    terms, folding = query_terms(query, fold), FOLDS[fold][0]
    title = T.note_title(F.col("path"), F.col("text")) if title is None else title
    folded = notes.select(
        "path", "text", title.alias("title"), folding(F.col("text")).alias("body"), folding(title).alias("title_"), folding(F.col("path")).alias("path_")
    )
    counts = {t: T.occurrences(F.col("body"), F.lit(t)) for t in terms}
    every = None
    for t in counts:
        hit = F.instr("body", t) > 0
        every = hit if every is None else every & hit
    score = sum(
        (counts[t] + TITLE_WEIGHT * T.occurrences(F.col("title_"), F.lit(t)) + PATH_WEIGHT * T.occurrences(F.col("path_"), F.lit(t))
         for t in terms[1:]),
        counts[terms[0]] + TITLE_WEIGHT * T.occurrences(F.col("title_"), F.lit(terms[0]))
        + PATH_WEIGHT * T.occurrences(F.col("path_"), F.lit(terms[0])),
    )
    first = F.least(*[F.instr("body", t) for t in counts], F.lit(2**31 - 1)) - 1
    start = F.greatest(F.lit(0), first - BEFORE)
    snippet = T.collapse(F.substr("text", start + 1, F.least(F.length("text"), first + AFTER) - start))
    return (
        folded.filter(every)
        .select(score.alias("score"), "title", "path", snippet.alias("snippet"))
        .orderBy(F.desc("score"), "path").limit(limit)
    )
