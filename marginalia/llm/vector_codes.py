"""Product codes of vectors: integer Lloyd rounds with Elkan's bounds.

Components become integers, vectors are cut into equal parts, and each part position has
a codebook of a few entries, which starts as that part of the first vectors by id. A
round assigns every part to its nearest entry and moves each entry to the mean of its
parts, rounded down.

Written beside each vector, and carried from round to round, are per part an upper bound
on the distance to its own entry and a lower bound on the distance to every entry, in
whole units: lower ones rounded down, upper ones up. When entries move, the bounds move
with them, by the distance rounded up. An entry is passed over only if the triangle
inequality puts it strictly farther than the own one: its lower bound is above the upper
bound, or it lies from the own entry by more than twice the upper bound. What is left is
compared by exact integer distances, so ties go to the lower index as if all had been
compared.

Every round is two jobs: one reads the state and writes the next, one adds up the parts
of every entry, per task and then by shuffle. The driver holds the codebooks alone:
``entries`` vectors per length.

Defined results: a vector that is null, or holds a null or non-finite component, takes
no part; rows that repeat an id are rows of their own, and of equal ids the lesser vector
starts first; null ids start last; fewer rows than entries give fewer entries; vectors of
different length have codebooks of their own; a length that the parts do not divide is
filled up with zeros; an empty table gives no rows; other columns pass as they are. A
component beyond 2**24 in integer form is refused, since distances must fit 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from marginalia.llm.common import cut, own_columns, release

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 24
#: Numbers of the vectors whose distances are computed at once.
AT_ONCE = 1 << 20

#: Codebooks per length of vectors: an array (part, entry, position).
Books = dict[int, np.ndarray]


def floor_root(x: np.ndarray) -> np.ndarray:
    """Integer square roots."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def ceil_root(x: np.ndarray) -> np.ndarray:
    r = floor_root(x)
    return r + (r * r < x)


def distances(x: np.ndarray, entries: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to the entries of the same place in ``which``."""
    out = np.empty(rows.size, dtype=np.int64)
    step = max(1, AT_ONCE // max(1, x.shape[1]))
    for at in range(0, rows.size, step):
        end = at + step
        out[at:end] = ((x[rows[at:end]] - entries[which[at:end]]) ** 2).sum(1)
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first round of a part: code, upper and lower bounds, and distances computed per row."""
    n, k = len(x), len(entries)
    d = distances(x, entries, np.repeat(np.arange(n), k), np.tile(np.arange(k), n)).reshape(n, k)
    code = d.argmin(1)
    return code, ceil_root(d[np.arange(n), code]), floor_root(d), np.full(n, k)


def follow(x, entries, moved, code, up, low) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A later round of a part, from the bounds of the round before and how far entries moved."""
    far = np.iinfo(np.int64).max // 4
    up = up + moved[code]
    low = np.maximum(low - moved, 0)
    between = floor_root(((entries[:, None] - entries[None]) ** 2).sum(2))
    np.fill_diagonal(between, far)
    asked = np.zeros(len(x), dtype=np.int64)

    def possible(rows):
        out = (low[rows] <= up[rows, None]) & (between[code[rows]] <= 2 * up[rows, None])
        out[np.arange(rows.size), code[rows]] = False
        return out

    rows = np.flatnonzero(between.min(1)[code] <= 2 * up)
    rows = rows[possible(rows).any(1)]
    own = distances(x, entries, rows, code[rows])
    asked[rows] += 1
    up[rows], low[rows, code[rows]] = ceil_root(own), floor_root(own)
    maybe = possible(rows)
    i, k = np.nonzero(maybe)
    found = distances(x, entries, rows[i], k)
    low[rows[i], k] = floor_root(found)
    asked[rows] += maybe.sum(1)
    d = np.full(maybe.shape, np.iinfo(np.int64).max)
    d[np.arange(rows.size), code[rows]] = own
    d[i, k] = found
    code[rows] = d.argmin(1)  # the first of equal ones: the lower index
    up[rows] = ceil_root(d.min(1))
    return code, up, low, asked


def _numbers(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _fields(ddl: str) -> list[S.StructField]:
    return S.StructType.fromDDL(ddl).fields


def _lists(values: np.ndarray, kind):
    """A list column from a matrix."""
    import pyarrow as pa

    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _by_length(batch, sizes: np.ndarray):
    """(length, rows of that length) for every length in a batch."""
    import pyarrow as pa

    for size in np.unique(sizes).tolist():
        yield int(size), batch.filter(pa.array(sizes == size))


def integers(vectors: DataFrame, column: str, scale: int, parts: int, *order: str) -> DataFrame:
    """row, key, length, v: the rows that take part, their order and their filled-up integers."""
    key = F.struct(*[F.col(c).isNull() for c in order], *[F.col(c) for c in order]).alias("key")
    taken = vectors.select(
        F.struct(*own_columns(vectors)).alias("row"), key, F.col(column).cast("array<double>").alias("x")
    ).filter("x IS NOT NULL")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            sizes = pc.list_value_length(whole.column(2)).to_numpy(zero_copy_only=False)
            for size, batch in _by_length(whole, sizes):
                x = _numbers(batch.column(2)).astype(np.float64).reshape(batch.num_rows, size)
                fine = np.isfinite(x).all(1)
                v = np.floor(scale * x[fine])
                if v.size and np.abs(v).max() > LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST / scale:g}")
                v = np.pad(v.astype(np.int64), ((0, 0), (0, -size % parts)))
                kept = batch.filter(pa.array(fine))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), pa.array(np.full(len(v), size), pa.int32()), _lists(v, pa.int32())],
                    names=["row", "key", "length", "v"],
                )

    return taken.mapInArrow(run, S.StructType([*taken.schema.fields[:2], *_fields("length int, v array<int>")]))


def first_books(ints: DataFrame, parts: int, entries: int) -> Books:
    """The parts of the first vectors of each length, by key and vector."""
    rank = F.row_number().over(Window.partitionBy("length").orderBy("key", "v"))
    found: dict[int, list] = {}
    for r in ints.select("length", "v", rank.alias("rank")).filter(F.col("rank") <= entries).orderBy("length", "rank").collect():
        found.setdefault(r["length"], []).append(r["v"])
    return {size: np.array(vs, dtype=np.int64).reshape(len(vs), parts, len(vs[0]) // parts).transpose(1, 0, 2) for size, vs in found.items()}


def assign(state: DataFrame, books: Books, before: Books | None, last: bool = False) -> DataFrame:
    """The state after an assignment: its columns, code, up, low and the distances computed so far.

    ``before`` are the codebooks that the state's bounds are about; without it there are none.
    With ``last``, the code as bytes and the squared error in place of vector and bounds.
    """
    sent = state.sparkSession.sparkContext.broadcast((books, before))

    def run(batches):
        import pyarrow as pa

        books, before = sent.value
        for whole in batches:
            for size, batch in _by_length(whole, whole.column(1).to_numpy()):
                n, own = batch.num_rows, books[size]
                parts, k, width = own.shape
                v = _numbers(batch.column(2)).astype(np.int64).reshape(n, parts, width)
                code, up = np.empty((n, parts), dtype=np.int64), np.empty((n, parts), dtype=np.int64)
                low, asked = np.empty((n, parts, k), dtype=np.int64), np.zeros(n, dtype=np.int64)
                if before is not None:
                    code[:] = _numbers(batch.column(3)).reshape(n, parts)
                    up[:] = _numbers(batch.column(4)).reshape(n, parts)
                    low[:] = _numbers(batch.column(5)).reshape(n, parts, k)
                    asked += batch.column(6).to_numpy()
                for p in range(parts):
                    x = np.ascontiguousarray(v[:, p])
                    if before is None:
                        code[:, p], up[:, p], low[:, p], more = nearest(x, own[p])
                    else:
                        moved = ceil_root(((own[p] - before[size][p]) ** 2).sum(1))
                        code[:, p], up[:, p], low[:, p], more = follow(x, own[p], moved, code[:, p].copy(), up[:, p], low[:, p])
                    asked += more
                if last:
                    error = sum(distances(np.ascontiguousarray(v[:, p]), own[p], np.arange(n), code[:, p]) for p in range(parts))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()), pa.array(error, pa.int64()),
                         pa.array(asked, pa.int64())], names=["row", "length", "code", "error", "asked"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), batch.column(2), _lists(code, pa.int16()), _lists(up, pa.int64()),
                         _lists(low.reshape(n, parts * k), pa.int64()), pa.array(asked, pa.int64())],
                        names=["row", "length", "v", "code", "up", "low", "asked"],
                    )

    more = "code binary, error long, asked long" if last else "v array<int>, code array<short>, up array<long>, low array<long>, asked long"
    schema = S.StructType([*state.select("row", "length").schema.fields, *_fields(more)])
    bounds = [] if before is None else ["code", "up", "low", "asked"]
    return state.select("row", "length", "v", *bounds).mapInArrow(run, schema)


def moved_books(state: DataFrame, books: Books) -> Books:
    """The entries at the means of their parts, rounded down; an entry without parts stays."""
    shapes = {size: own.shape for size, own in books.items()}

    def run(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        n: dict[int, np.ndarray] = {}
        for whole in batches:
            for size, batch in _by_length(whole, whole.column(0).to_numpy()):
                parts, k, width = shapes[size]
                v = _numbers(batch.column(1)).reshape(batch.num_rows, parts, width)
                code = _numbers(batch.column(2)).reshape(batch.num_rows, parts)
                mine = total.setdefault(size, np.zeros((parts, k, width), dtype=np.int64))
                count = n.setdefault(size, np.zeros((parts, k), dtype=np.int64))
                for p in range(parts):
                    count[p] += np.bincount(code[:, p], minlength=k)
                    for j in range(width):  # sums of a batch are far below 2**53
                        mine[p, :, j] += np.bincount(code[:, p], weights=v[:, p, j], minlength=k).astype(np.int64)
        for size, mine in total.items():
            width, places = mine.shape[2], np.arange(n[size].size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(mine.size, size), pa.int32()), pa.array(np.repeat(places, width), pa.int32()),
                 pa.array(np.tile(np.arange(width), places.size), pa.int32()), pa.array(mine.ravel()), pa.array(np.repeat(n[size].ravel(), width))],
                names=["length", "entry", "at", "total", "n"],
            )

    rows = (
        state.select("length", "v", "code").mapInArrow(run, "length int, entry int, at int, total long, n long")
        .groupBy("length", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0").collect()
    )
    out = {size: own.copy() for size, own in books.items()}
    for r in rows:
        k = out[r["length"]].shape[1]
        out[r["length"]][r["entry"] // k, r["entry"] % k, r["at"]] = r["total"] // r["n"]
    return out


def digest(book: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, in decimals with commas between."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, column: str = "embedding", order: tuple[str, ...] = ("vec_id",), parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Books]:
    """(row, length, code, error, asked per vector that takes part; the codebooks).

    ``row`` holds the columns of ``vectors``, ``code`` a byte per part, ``error`` the sum of
    squared distances, ``asked`` how many distances all assignments computed for the row.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte per part")
    state = cut(integers(vectors, column, scale, parts, *order), "integers")
    books, before = first_books(state, parts, entries), None
    for _ in range(rounds):
        after = cut(assign(state, books, before), "assigned")
        release(state)
        state, before = after, books
        books = moved_books(state, books)
    coded = cut(assign(state, books, before, last=True), "codes")
    release(state)
    return coded, books
