"""Connected components by alternating large and small stars.

Every round is a minimum per node, which partial aggregation shrinks before the shuffle,
and a join back to the edges, which can be split at a hot node. Edges only get fewer or
point lower, and the round's result is cut, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import cut, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect each node's higher (large) or lower (small) neighbours to its minimum."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, label for every node of an edge (u, v); label is the component's least node. A cut frame.

    ``rows``: the rough number of edges, if it is known. A round is both stars and one
    write; it is the last when it leaves the edges as they were.
    """
    edges = cut(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows
    )
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        before, edges = edges, cut(_star(_star(edges, True), False), "star", now[0])
        release(before)
    labels = cut(
        edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
            edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
        ), "labels", rows,
    )
    release(edges)
    return labels
