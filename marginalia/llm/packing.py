"""Best-fit packing with Martello-Toth dominance reduction.

Texts are tokenized where they lie; only piece lengths matter for packing, and there are
at most ``capacity`` of them. So the instance is the histogram of lengths: the driver
packs counts, not documents, whatever the corpus holds. It first fixes document sets
that provably dominate every other way to fill a sequence (one, two or three pieces),
for all pieces of a length at once, and gives the remainder to best-fit in falling
order. The outcome is a list of intervals of ranks: "pieces lo to hi of length n lie in
sequences s, s+1, ... at offset o". Each piece finds its interval by its rank among the
pieces of its length, which needs no sort: a task numbers its own pieces and a running
sum over tasks adds what came before.

Defined results: a null or empty text is the end mark alone; repeated rows and ids are
packed each for itself; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm import tokens
from marginalia.llm.common import cut, map_texts, portions, tokenizer_path

CAPACITY = 4096
END_ID = 1
#: Up to this many intervals go to every task; more are joined by shuffle.
MAX_BROADCAST_INTERVALS = 200_000
#: Ranks of a length that meet as one key then.
RANKS = 1 << 20

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, ord long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens; ord counts within task and length."""

    def cut_up(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), tokens.encoder(path).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        width = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            encoded = itertools.chain.from_iterable(map(encode, portions(batch.column(1))))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    own = ids[at : at + width]
                    n = len(own) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(own), part, int(seen[n])))
                    seen[n] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "ord"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut_up, _PIECES)


class Packer:
    """Packs a histogram of lengths. ``events``: length, lo, hi, sequence, copies, offset.

    The pieces of a length with ranks lo to hi - 1 lie in consecutive sequences from
    ``sequence`` on, ``copies`` in each, the first at ``offset``.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.ranked = np.zeros(capacity + 1, dtype=np.int64)
        self.events: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0

    def _place(self, length: int, sequence: int, n: int, copies: int, offset: int) -> None:
        lo = int(self.ranked[length])
        self.events.append((length, lo, lo + n * copies, sequence, copies, offset))
        self.ranked[length] += n * copies
        self.left[length] -= n * copies

    def _fix(self, n: int, *lengths: int) -> None:
        """``n`` sequences that hold one piece of each of the lengths."""
        offset = 0
        for length in lengths:
            self._place(length, self.sequences, n, 1, offset)
            offset += length
        self.sequences += n
        self.fixed += n

    def _times(self, *lengths: int) -> int:
        """How often the set can be taken from what is left."""
        return min(int(self.left[x]) // lengths.count(x) for x in set(lengths))

    def reduce(self) -> None:
        """Fix sets that dominate all other feasible sets with their largest piece."""
        for large in range(self.capacity, 0, -1):
            while self.left[large] > 0 and (found := self._dominating(large)):
                self._fix(self._times(*found), *found)

    def _dominating(self, large: int) -> tuple[int, ...] | None:
        room = self.capacity - large
        others = self.left[: room + 1].copy()
        if large <= room:
            others[large] -= 1
        have = np.flatnonzero(others > 0)
        if not have.size:
            return (large,)  # nothing fits beside it
        most = int(have[-1])
        if most == room:
            return (large, most)  # an exact fill is at least any set in the room
        smallest = np.repeat(have[:3], np.minimum(others[have[:3]], 3))[:3]
        if smallest.size < 2 or smallest[:2].sum() > room:
            return (large, most)  # one companion at most, so the largest
        if smallest.size > 2 and smallest.sum() <= room:
            return None
        # Two companions at most. For each smaller one, the largest that fits beside it.
        upto = np.zeros(room + 1, dtype=np.int64)
        upto[have] = have
        np.maximum.accumulate(upto, out=upto)
        beside = upto[room - have]
        ok = (beside > 0) & ((beside != have) | (others[have] > 1))
        low, high = np.minimum(have[ok], beside[ok]), np.maximum(have[ok], beside[ok])
        # A length that has itself as best partner but no second copy may pair below it;
        # counting such pairs would only raise the bounds, so leave it to best-fit.
        if not ok.all():
            return None
        if int((low + high).max()) <= most:
            return (large, most)
        a, b = int(high.max()), int(low.max())
        if most <= a and a + b <= room and self._times(large, a, b) > 0:
            return (large, a, b)
        return None

    def best_fit(self) -> None:
        """Falling lengths, each into the fullest sequence that has room."""
        groups: dict[int, list[tuple[int, int]]] = {}
        open_rooms = np.zeros(self.capacity + 1, dtype=bool)

        def keep(room: int, first: int, n: int) -> None:
            if room and n:
                groups.setdefault(room, []).append((first, n))
                open_rooms[room] = True

        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                fitting = np.flatnonzero(open_rooms[length:])
                if fitting.size:
                    room = length + int(fitting[0])
                    first, n = groups[room].pop()
                    if not groups[room]:
                        open_rooms[room] = False
                else:
                    room, first = self.capacity, self.sequences
                    n = -(-int(self.left[length]) // (self.capacity // length))
                    self.sequences += n
                each, have = room // length, int(self.left[length])
                full = min(n, have // each)
                if full:
                    self._place(length, first, full, each, self.capacity - room)
                    keep(room - each * length, first, full)
                rest = int(self.left[length])
                if full < n and rest:
                    self._place(length, first + full, 1, rest, self.capacity - room)
                    keep(room - rest * length, first + full, 1)
                    full += 1
                keep(room, first + full, n - full)

    def run(self) -> Packer:
        self.reduce()
        self.best_fit()
        return self


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the pieces."""
    spark = cut_pieces.sparkSession
    per_task = cut(
        cut_pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths"
    )
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    packer = Packer(counts, capacity).run()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    intervals = spark.createDataFrame(
        packer.events, "length long, lo long, hi long, sequence long, copies long, offset long"
    )
    ranked = cut_pieces.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("ord"))
    keys = ["length"]
    if len(packer.events) <= MAX_BROADCAST_INTERVALS:
        intervals = F.broadcast(intervals)
    else:
        # A length may be that of a third of all pieces, so they meet by ranges of ranks.
        span = lambda c: F.floor(c / RANKS)
        intervals = intervals.withColumn("span", F.explode(F.sequence(span(F.col("lo")), span(F.col("hi") - 1))))
        ranked, keys = ranked.withColumn("span", span(F.col("rank"))), ["length", "span"]
    at = F.col("rank") - F.col("lo")
    return (
        ranked.join(intervals, keys)
        .filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("sequence") + F.floor(at / F.col("copies"))).alias("sequence_id"),
            (F.col("offset") + (at % F.col("copies")) * F.col("length")).alias("offset"),
        )
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    path = path or tokenizer_path("word_bpe_49k.json")
    return place(cut(pieces(docs, path, capacity), "pieces"), capacity)
