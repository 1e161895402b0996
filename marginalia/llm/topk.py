"""Exact top-k inner product search over norm-sorted vectors.

Vectors are integers: floor(256 x) of every component, rotated into the singular
directions of a sample. Candidates are written once, by falling length, and stay where
they are: no candidate is shuffled again or copied. Queries come to them in rounds of a
bounded size, ordered by the length that a candidate must have to reach their k-th score
against the longest vectors; a round reads only the candidates that are long enough for
one of its queries, so the scan passes over the others by the statistics of the file.

A task keeps the k best per query of its round while its candidates pass, longest first.
The product of both lengths bounds a score first. Then partial sums over the leading
directions grow in ``STEPS``, each with the product of the lengths of what is left
(Cauchy-Schwarz), and a candidate is dropped at the first bound that falls below the
query's k-th score. The most promising candidates of a chunk are scored first, so that
score rises early. Bounds are floating and slack; scores are integers. What is shuffled
are k rows per query and task, ranked before the shuffle.

Defined results: a null vec_id or vector, and a vector with a null or non-finite
component, takes no part; vectors of different dimension do not meet; of rows that
repeat a vec_id the least vector counts, or with ``repeats`` every row is a candidate of
all other ids and the rows of a query's id share one answer, the best of all their pairs;
ties go to the smaller vec_id; fewer than k candidates give fewer rows; an empty table
gives none; other columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import cut, release, temporary

K = 5
#: Numbers in a file of candidates, and the least rows of one; of the queries that one round
#: sends to every task (32 MB); of the sample whose singular directions rotate the vectors;
#: of the vectors that seed the thresholds, and the rows of those.
BLOCK_NUMBERS, LEAST_ROWS = 1 << 22, 2_048
ROUND_NUMBERS = 1 << 22
SAMPLE_NUMBERS = 1 << 20
SEED_NUMBERS, SEEDS = 1 << 20, 1_024
#: Candidates that are judged at once, and the eighths of the directions that partial sums cover.
CHUNK, STEPS = 512, (2, 4, 5, 6, 7)
#: The share of pairs below which they are followed one by one.
FEW = 1 / 8


def integer_vectors(embeddings: DataFrame, repeats: bool = False) -> DataFrame:
    """vec_id, v, dim, norm2, row_no of the vectors that take part."""
    x = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, finite)
    rows = embeddings.filter(F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(256 * c.cast("double"))).alias("v")
    )
    if not repeats:
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.select(
        "vec_id", "v", F.size("v").alias("dim"),
        F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")).alias("norm2"),
        F.monotonically_increasing_id().alias("row_no"),
    )


class Best:
    """The k best (score, id) per query, in arrays; ``scored`` counts exact scores."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.bound = k, floor.copy()
        self.q = np.empty(0, dtype=np.int64)
        self.score, self.id = self.q.copy(), self.q.copy()
        self.n, self.scored = n, 0

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.scored += q.size
        ok = score >= self.bound[q]
        self.q, self.score, self.id = (np.concatenate(x) for x in ((self.q, q[ok]), (self.score, score[ok]), (self.id, ids[ok])))
        order = np.lexsort((self.id, -self.score, self.q))
        q = self.q[order]
        first = np.searchsorted(q, q, side="left")
        rank = np.arange(q.size) - first
        keep = rank < self.k
        last = order[rank == self.k - 1]
        self.bound[self.q[last]] = np.maximum(self.bound[self.q[last]], self.score[last])
        order = order[keep]
        self.q, self.score, self.id = self.q[order], self.score[order], self.id[order]


def _pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of ``a`` with rows j of ``b``."""
    return np.concatenate([np.zeros(0, dtype=a.dtype)] + [
        np.einsum("ij,ij->i", a[i[at : at + 32_768]], b[j[at : at + 32_768]]) for at in range(0, i.size, 32_768)
    ])


class Turned:
    """Rotated rows with their lengths, and the lengths of what each step leaves out."""

    def __init__(self, rows: np.ndarray, turn: np.ndarray, steps: list[int]):
        self.rows = rows @ turn
        self.length = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        self.rest = [np.sqrt((self.rows[:, s:] ** 2).sum(1)) for s in steps]


class Search:
    """The k best per query among the candidates that were shown so far, from ``floor`` upwards."""

    def __init__(self, query_ids, queries, floor, rotation, k: int = K):
        self.k, self.ids, self.queries = k, query_ids, queries
        self.best = Best(len(queries), k, floor)
        dim = queries.shape[1] if len(queries) else 0
        self.steps = sorted({max(1, dim * s // 8) for s in STEPS})
        self.turn = rotation if rotation is not None and rotation.shape[0] == dim else np.eye(dim)
        self.asked = Turned(queries, self.turn, self.steps) if len(queries) else None

    def show(self, ids, rows) -> None:
        """Take more candidates into account."""
        if not len(rows) or not len(self.queries):
            return
        k, best, ask, steps, queries, query_ids = self.k, self.best, self.asked, self.steps, self.queries, self.ids
        order = np.lexsort((ids, -(rows.astype(np.float64) ** 2).sum(1)))
        ids, rows = ids[order], rows[order]
        own = Turned(rows, self.turn, steps)
        for at in range(0, len(rows), CHUNK):
            part = slice(at, at + CHUNK)
            slack = 1e-6 * (1 + ask.length * own.length[at])
            active = np.flatnonzero(ask.length * own.length[at] + slack >= best.bound)
            if not active.size:
                break  # all later rows are shorter, and bounds only rise
            for some in np.array_split(active, -(-active.size // 1024)):
                other = query_ids[some, None] != ids[None, part]
                partial, low = np.zeros(other.shape), 0
                for step, high in enumerate(steps):
                    partial += ask.rows[some, low:high] @ own.rows[part, low:high].T
                    reach = partial + ask.rest[step][some, None] * own.rest[step][None, part]
                    low, open_ = high, other & (reach + slack[some, None] >= best.bound[some, None])
                    if np.count_nonzero(open_) <= FEW * open_.size:
                        break
                # The most promising candidates of every query first.
                few = min(k, partial.shape[1])
                first = np.argpartition(-np.where(open_, partial, -np.inf), few - 1, axis=1)[:, :few]
                i, j = np.repeat(np.arange(len(some)), few), first.ravel()
                i, j = i[open_[i, j]], j[open_[i, j]]
                best.add(some[i], _pairs(queries, rows, some[i], at + j), ids[at + j])
                open_[i, j] = False
                open_ &= reach + slack[some, None] >= best.bound[some, None]
                i, j = np.nonzero(open_)
                value = partial[i, j]
                for later in range(step + 1, len(steps)):
                    low, high = steps[later - 1], steps[later]
                    value = value + _pairs(ask.rows[:, low:high], own.rows[:, low:high], some[i], at + j)
                    ok = value + ask.rest[later][some[i]] * own.rest[later][at + j] + slack[some[i]] >= best.bound[some[i]]
                    i, j, value = i[ok], j[ok], value[ok]
                best.add(some[i], _pairs(queries, rows, some[i], at + j), ids[at + j])


def search(ids, rows, query_ids, queries, floor, rotation, k: int = K) -> Best:
    """The k best rows per query that score ``floor`` at least, other than the query's own."""
    own = Search(query_ids, queries, floor, rotation, k)
    own.show(ids, rows)
    return own.best


def _matrix(column, dim: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(column), dim)


LOWEST = -(2**62)


def top_k(embeddings: DataFrame, every: int = 50, k: int = K, repeats: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    with temporary() as keep:
        base = cut(integer_vectors(embeddings, repeats), "vectors")
        out = spark.createDataFrame([], "query_id long, vec_id long, score long")
        for r in base.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
            for found in _top_k(spark, base.filter(F.col("dim") == r["dim"]), int(r["dim"]), int(r["n"]), every, k):
                out = out.unionByName(found)
        return keep(cut(out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score"
        ), "ranked"))


def _blocks(n: int, dim: int, tasks: int) -> int:
    return max(1, -(-n * max(dim, 1) // BLOCK_NUMBERS), min(tasks, n // LEAST_ROWS))


def _in_blocks(rows: DataFrame, n: int, name: str, *order) -> DataFrame:
    """Adds the number of each row's block, ``n`` ranges of an order; one block needs none."""
    if n == 1:
        return rows.withColumn(name, F.lit(0))
    return rows.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id())


def _top_k(spark, base: DataFrame, dim: int, n: int, every: int, k: int) -> list[DataFrame]:
    """The best rows of every round, for the vectors of one dimension."""
    wanted = max(1, SAMPLE_NUMBERS // max(dim, 1))
    share = min(1.0, wanted / max(n, 1))
    sample = base.filter(F.pmod(F.xxhash64("row_no"), F.lit(1 << 20)) < int((1 << 20) * share)).select("v").limit(wanted).collect()
    rotation = np.eye(dim)
    if sample and dim:
        drawn = np.array([r["v"] for r in sample], dtype=np.float64)
        rotation = np.linalg.svd(drawn, full_matrices=len(drawn) < dim)[2].T
    seeds_wanted = max(k + 1, min(SEEDS, SEED_NUMBERS // max(dim, 1)))
    top = base.orderBy(F.desc("norm2"), "vec_id").select("vec_id", "v").limit(seeds_wanted).collect()
    seed_ids = np.array([r["vec_id"] for r in top], dtype=np.int64)
    seeds = np.array([r["v"] for r in top], dtype=np.int64).reshape(len(top), dim)
    tasks = spark.sparkContext.defaultParallelism

    def seeded(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            q = _matrix(batch.column(1), dim)
            best = search(seed_ids, seeds, ids, q, np.full(len(ids), LOWEST, dtype=np.int64), rotation, k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best.bound)], names=["vec_id", "v", "norm2", "row_no", "bound"]
            )

    asked = cut(
        base.filter(F.col("vec_id") % every == 0).select("vec_id", "v", "norm2", "row_no")
        .mapInArrow(seeded, "vec_id long, v array<long>, norm2 double, row_no long, bound long"),
        "queries",
    )
    # The length below which no candidate counts for a query.
    needed = F.when(F.col("norm2") > 0, F.col("bound") / F.sqrt("norm2")).otherwise(F.lit(float(LOWEST)))
    rounds = max(1, -(-asked.count() * max(dim, 1) // ROUND_NUMBERS))
    queries = cut(
        _in_blocks(asked.withColumn("needed", needed), rounds, "round", "needed", "row_no")
        .select("round", "vec_id", "v", "bound", "needed"),
        "rounds",
    )
    ranged = cut(
        _in_blocks(base, _blocks(n, dim, tasks), "block", F.desc("norm2"), "row_no")
        .sortWithinPartitions(F.desc("norm2")).select("vec_id", "v", "norm2"),
        "candidates",
    )
    release(asked)
    return [cut(one_round(ranged, queries.filter(F.col("round") == r), dim, rotation, k), "best") for r in range(rounds)]


def long_enough(candidates: DataFrame, needed: float) -> DataFrame:
    """The candidates of that length, with room for rounding."""
    least = max(0.0, (needed - 1e-6) / (1 + 1e-9))
    return candidates.filter(F.col("norm2") >= least * least * (1 - 1e-12)) if least > 0 else candidates


def one_round(candidates: DataFrame, queries: DataFrame, dim: int, rotation: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of every task for the queries of a round."""
    asked = queries.select("vec_id", "v", "bound", "needed").toArrow()
    ids, bound = asked.column(0).to_numpy(), asked.column(2).to_numpy()
    vectors = _matrix(asked.column(1).combine_chunks(), dim)
    sent = candidates.sparkSession.sparkContext.broadcast((ids, vectors, bound, rotation))

    def run(batches):
        import pyarrow as pa

        own = Search(*sent.value, k)
        for batch in batches:
            own.show(batch.column(0).to_numpy(), _matrix(batch.column(1), dim))
        best = own.best
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.ids[best.q], pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.score, pa.int64())],
            names=["query_id", "vec_id", "score"],
        )

    near = long_enough(candidates, min(asked.column(3).to_numpy(), default=0.0))
    return near.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
