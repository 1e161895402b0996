"""A positional index over running texts: where do passages occur, and in which order?

A running text is the pages of a scope, one after the other. It is cut anew, at fixed
offsets and whatever its pages, into windows that reach a little into the next one, so a
passage that crosses page ends lies whole in the window where it starts. No window, row
or task holds a scope.

Postings are winnowed: of every ``WINDOW`` successive grams the least by hash is kept, so
text and passage keep the same ones wherever they agree, and a passage of ``SURE``
characters has one at least. A passage probes by the gram of its own that the index holds
least often; what the postings propose is compared with the window character by
character. Passages longer than a window's reach are followed in segments; passages too
short to have a gram are looked for in all windows, in blocks of a bounded number.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.scratch import cut, delete, temporary

#: Characters of a gram, and successive grams of which one is kept.
GRAM, WINDOW = 8, 8
SURE = GRAM + WINDOW - 1
#: Characters of a window, and how far it reaches into the next one.
SPAN, REACH = 1 << 16, 1 << 10
#: Pages whose lengths are added up in one task.
BLOCK = 4_096
#: Short passages that are sent to all windows at a time.
SHORT_AT_ONCE = 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` characters, as signed numbers."""
    count = max(0, points.size - n + 1)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = out * _BASE + points[k : k + count] + np.uint64(1)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def winnowed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the grams that are kept: the first least one of every ``WINDOW``."""
    hashes = gram_hashes(points, GRAM)
    if hashes.size < WINDOW:
        return hashes[:0], hashes[:0]
    least = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW).argmin(1) + np.arange(hashes.size - WINDOW + 1)
    places = np.unique(least)
    return hashes[places], places


def offsets(rows: DataFrame, keys: list[str], order: str, size: str, *ties: str) -> DataFrame:
    """Adds ``start``: the sum of ``size`` over the rows of the key before this one.

    ``ties`` order rows of the same number.
    Rows are summed per block of ``BLOCK`` successive numbers, then the blocks, then the
    rows of each block, so one long key is added up by many tasks.
    """
    blocked = rows.withColumn("block_", F.floor(F.col(order) / F.lit(BLOCK)))
    every = Window.partitionBy(*keys).orderBy("block_")
    before = blocked.groupBy(*keys, "block_").agg(F.sum(size).alias("sum_")).withColumn(
        "before_", F.sum("sum_").over(every) - F.col("sum_")
    ).drop("sum_")
    within = Window.partitionBy(*keys, "block_").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("within_", F.coalesce(F.sum(size).over(within), F.lit(0)))
        .join(before, [*keys, "block_"]).withColumn("start", F.col("before_") + F.col("within_")).drop("block_", "before_", "within_")
    )


def windows(pages: DataFrame, span: int = SPAN, reach: int = REACH) -> DataFrame:
    """scope, number, text: the running text of each scope's pages (scope, page, text) in windows.

    Window k starts at character k * span and ends ``reach`` characters after the next one's start.
    """
    size = F.length("text").cast("long")
    placed = offsets(pages.filter("text <> ''").withColumn("size", size), ["scope"], "page", "size", "text")
    in_order = F.array_sort(F.collect_list(F.struct("at", "piece")))  # span + reach characters at most
    return _dealt(placed, span, reach).groupBy("scope", "number").agg(F.array_join(F.transform(in_order, lambda p: p["piece"]), "").alias("text"))


def _dealt(placed: DataFrame, span: int, reach: int) -> DataFrame:
    """scope, number, at, piece: texts (scope, start, size, text) cut into what each window has of them."""
    first = F.greatest(F.lit(0), F.floor((F.col("start") - reach) / span)).cast("long")
    last = F.floor((F.col("start") + F.col("size") - 1) / span).cast("long")
    low = F.greatest(F.col("start"), F.col("number") * span)
    high = F.least(F.col("start") + F.col("size"), (F.col("number") + 1) * span + reach)
    return placed.select("*", F.explode(F.sequence(first, last)).alias("number")).filter(low < high).select(
        "scope", "number", low.alias("at"), F.substring("text", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("piece")
    )


def _starts(length: int, reach: int) -> list[int]:
    """Where a passage's segments start: they follow one another, and the last one ends with the passage."""
    return sorted({*range(0, max(1, length - reach), reach), max(0, length - reach)})


def _doubled(points: np.ndarray, most: int = 32):
    """(n, hashes of every run of n characters) for n = 1, 2, 4, ... ``most``."""
    run, n, power = points + np.uint64(1), 1, int(_BASE)
    while True:
        mixed = (run ^ (run >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        yield n, mixed ^ (mixed >> np.uint64(29))
        if 2 * n > min(most, points.size):
            return
        run, n, power = run[:-n] * np.uint64(power) + run[n:], 2 * n, power * power % (1 << 64)


class Segments:
    """Segments of one scope's passages, found in a text by hashes of their first characters."""

    def __init__(self, rows: list[tuple[str, int, int, str]]):
        """rows: passage, its number of segments, where this one starts in it, segment."""
        self.rows, by = rows, {}
        for k, row in enumerate(rows):
            n, hashes = list(_doubled(_points(row[3][:32])))[-1]
            by.setdefault(n, {}).setdefault(int(hashes[0]), []).append(k)
        self.known = {n: (np.sort(np.array(list(of), dtype=np.uint64)), of) for n, of in by.items()}
        self.marks = {n: np.zeros(1 << 20, dtype=bool) for n in by}
        for n, (keys, _) in self.known.items():
            self.marks[n][keys >> np.uint64(44)] = True

    def found(self, text: str):
        """(row, place) of every segment in the text."""
        if not text:
            return
        for n, hashes in _doubled(_points(text), max(self.known)):
            if n in self.known:
                keys, of = self.known[n]
                at = np.flatnonzero(self.marks[n][hashes >> np.uint64(44)])
                at = at[np.isin(hashes[at], keys)]
                for place, h in zip(at.tolist(), hashes[at].tolist(), strict=True):
                    for k in of[h]:
                        if text.startswith(self.rows[k][3], place):
                            yield self.rows[k], place


def scanned(pages: DataFrame, passages: DataFrame, reach: int = REACH, span: int = SPAN) -> DataFrame:
    """scope, passage, pos of every occurrence, as an index gives it, without one: for passages that all tasks can hold.

    pages: scope, page, text; passages: scope, passage. Texts are read where they are and are
    not shuffled. What crosses the end of a page is found in the pages' first and last
    characters, as many as the longest segment has, put together in windows. Pages of one
    number are in the order of those first characters, then of a hash.
    """
    spark = pages.sparkSession
    own: dict[str, list] = {}
    for scope, passage in passages.select("scope", "passage").filter("passage <> ''").distinct().collect():
        starts = _starts(len(passage), reach)
        own.setdefault(scope, []).extend((passage, len(starts), s, passage[s : s + reach]) for s in starts)
    near = max((len(r[3]) for rows in own.values() for r in rows), default=1)
    sent = spark.sparkContext.broadcast({scope: Segments(rows) for scope, rows in own.items()})
    names = ["passage", "segments", "from", "at"]

    def batch_of(rows: list, keys: list[str]):
        import pyarrow as pa

        kinds = {"scope": pa.string(), "page": pa.int64(), "tie": pa.int64(), "passage": pa.string(), "segments": pa.int32(), "from": pa.int32(), "at": pa.int64()}
        columns = list(zip(*rows, strict=True)) or [[]] * (len(keys) + 4)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, keys + names, strict=True)], names=keys + names)

    def in_pages(batches):
        for batch in batches:
            for scope, page, tie, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if scope in sent.value and (rows := [(scope, page, tie, *row[:3], at) for row, at in sent.value[scope].found(text)]):
                    yield batch_of(rows, ["scope", "page", "tie"])

    def in_seams(batches):
        for batch in batches:
            for scope, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                joined: list[list] = []  # where a run of successive pieces starts, where it ends, and the pieces
                for p in pieces:
                    if joined and joined[-1][1] == p["at"]:
                        joined[-1][1] += len(p["piece"])
                        joined[-1][2].append(p["piece"])
                    else:
                        joined.append([p["at"], p["at"] + len(p["piece"]), [p["piece"]]])
                for start, _, parts in joined:
                    if len(parts) > 1 and (rows := [(scope, *row[:3], start + at) for row, at in sent.value[scope].found("".join(parts))]):
                        yield batch_of(rows, ["scope"])

    size, whole = F.length("text").cast("long"), F.length("text") <= 2 * near
    of = pages.filter(F.col("text") != "").select("scope", F.col("page").cast("long").alias("page"), F.xxhash64("text").alias("tie"), "text")
    with temporary() as keep:
        edges = of.filter(F.col("scope").isin(*own)).select(
            "scope", "page", "tie", size.alias("size"),
            F.when(whole, F.col("text")).otherwise(F.left("text", F.lit(near))).alias("head"), F.when(whole, "").otherwise(F.right("text", F.lit(near))).alias("tail"),
        )
        placed = cut(offsets(edges, ["scope"], "page", "size", "head", "tie"), "edges")
        ends = F.explode(F.array(
            F.struct("start", F.col("head").alias("text")), F.struct((F.col("start") + F.col("size") - F.length("tail")).alias("start"), F.col("tail").alias("text"))
        )).alias("e")
        pieces = placed.select("scope", ends).select("scope", "e.start", "e.text", F.length("e.text").alias("size")).filter("size > 0")
        windowed = _dealt(pieces, span, near).groupBy("scope", "number").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
        kinds = "passage string, segments int, `from` int, at long"
        seams = windowed.filter(F.size("pieces") > 1).select("scope", "pieces").mapInArrow(in_seams, f"scope string, {kinds}")
        inside = cut(of.mapInArrow(in_pages, f"scope string, page long, tie long, {kinds}"), "inside")
        inside = inside.join(placed.select("scope", "page", "tie", "start"), ["scope", "page", "tie"]).withColumn("at", F.col("start") + F.col("at"))
        every = inside.select("scope", *names).unionByName(seams).withColumn("pos", F.col("at") - F.col("from")).drop("at").distinct()
        found = every.groupBy("scope", "passage", "segments", "pos").agg(F.count("*").alias("n")).filter("n = segments").select("scope", "passage", "pos")
        return keep(cut(found, "scanned"))


class PassageIndex:
    """The windows of scopes and the winnowed postings of their grams, as bucketed tables."""

    def __init__(self, spark: SparkSession, path: str, span: int = SPAN, reach: int = REACH, buckets: int | None = None):
        if reach < SURE:
            raise ValueError(f"a window must reach {SURE} characters into the next one")
        self.spark, self.path, self.span, self.reach = spark, path.rstrip("/"), span, reach
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"passages_{uuid.uuid4().hex}"

    def build(self, pages: DataFrame) -> PassageIndex:
        """Write the index of pages (scope, page, text)."""
        self._write(windows(pages, self.span, self.reach), "windows", ["scope", "number"])
        self._write(self._postings(), "postings", ["scope", "gram"])
        return self

    def open(self) -> PassageIndex:
        """Name the tables of an index that was built before, in this session or another."""
        for what, columns, keys in (
            ("windows", "scope STRING, number BIGINT, text STRING", "scope, number"),
            ("postings", "scope STRING, gram BIGINT, number BIGINT, at ARRAY<INT>", "scope, gram"),
        ):
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.name}_{what} ({columns}) USING parquet "
                f"CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{what}'"
            )
        return self

    def close(self) -> None:
        """Forget the tables' names; their files stay."""
        for what in ("windows", "postings"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{what}")

    def drop(self) -> None:
        self.close()
        delete(self.spark, self.path)

    def _write(self, rows: DataFrame, what: str, keys: list[str]) -> None:
        (
            rows.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys)
            .option("path", f"{self.path}/{what}").saveAsTable(f"{self.name}_{what}")
        )

    @property
    def windows(self) -> DataFrame:
        return self.spark.table(f"{self.name}_windows")

    @property
    def postings(self) -> DataFrame:
        return self.spark.table(f"{self.name}_postings")

    def _postings(self) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for scope, number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    grams, places = winnowed(_points(text))
                    order = np.argsort(grams, kind="stable")
                    grams, places = grams[order], places[order]
                    starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if grams.size else np.zeros(0, dtype=np.int64)
                    at = pa.ListArray.from_arrays(pa.array([*starts, grams.size], pa.int32()), pa.array(places, pa.int32()))
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([scope] * n, pa.string()), pa.array(grams[starts]), pa.array(np.full(n, number), pa.int64()), at],
                        names=["scope", "gram", "number", "at"],
                    )

        return self.windows.mapInArrow(run, "scope string, gram long, number long, at array<int>")

    def occurrences(self, passages: DataFrame) -> DataFrame:
        """scope, passage, pos: every place where a non-empty passage (scope, passage) of its scope starts."""
        passages = passages.select("scope", "passage").filter("passage <> ''").distinct()
        long = self._long(passages.filter(F.length("passage") >= SURE))
        short = passages.filter(F.length("passage") < SURE)
        return long.unionByName(self._short(short))

    def _long(self, passages: DataFrame) -> DataFrame:
        reach = self.reach

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                rows = []
                for scope, passage in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    starts = _starts(len(passage), reach)
                    for start in starts:
                        segment = passage[start : start + reach]
                        grams, places = winnowed(_points(segment))
                        rows += [(scope, passage, len(starts), start, segment, int(g), int(p)) for g, p in zip(grams, places, strict=True)]
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32()]
                names = ["scope", "passage", "segments", "start", "segment", "gram", "place"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        probes = cut(passages.mapInArrow(
            run, "scope string, passage string, segments int, start int, segment string, gram long, place int"
        ), "probes")
        asked = probes.select("scope", "gram").distinct()
        held = self.postings.join(asked, ["scope", "gram"], "left_semi").groupBy("scope", "gram").agg(F.sum(F.size("at")).alias("n"))
        of = ["scope", "passage", "segments", "start", "segment"]
        rarest = probes.join(held, ["scope", "gram"], "left").groupBy(*of).agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "gram")).alias("by")
        ).filter("by.n > 0").select(*of, "by.place", "by.gram")
        proposed = rarest.join(self.postings, ["scope", "gram"]).select(*of, "number", F.explode("at").alias("at"), "place").withColumn(
            "at", F.col("at") - F.col("place")
        ).filter(F.col("at").between(0, self.span - 1))
        same = F.substring("text", F.col("at") + 1, F.length("segment")) == F.col("segment")
        return (
            proposed.drop("place").join(self.windows, ["scope", "number"]).filter(same)
            .select("scope", "passage", "segments", (F.col("number") * self.span + F.col("at") - F.col("start")).alias("pos"))
            .groupBy("scope", "passage", "segments", "pos").agg(F.count("*").alias("n")).filter("n = segments").select("scope", "passage", "pos")
        )

    def _short(self, passages: DataFrame) -> DataFrame:
        found = self.spark.createDataFrame([], "scope string, passage string, pos long")
        kept = cut(passages, "short")
        blocks = -(-kept.count() // SHORT_AT_ONCE)
        dealt = kept.withColumn("block", F.pmod(F.xxhash64("scope", "passage"), F.lit(max(1, blocks))))
        for block in range(blocks):
            found = found.unionByName(self._scan(dealt.filter(F.col("block") == block).select("scope", "passage").collect()))
        return found

    def _scan(self, rows: list) -> DataFrame:
        wanted: dict[str, dict[int, dict[int, list[str]]]] = {}
        for scope, passage in rows:
            key = int(gram_hashes(_points(passage), len(passage))[0])
            wanted.setdefault(scope, {}).setdefault(len(passage), {}).setdefault(key, []).append(passage)
        sent, span = self.spark.sparkContext.broadcast(wanted), self.span

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                out = []
                for scope, number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    points = _points(text)
                    for n, known in sent.value.get(scope, {}).items():
                        hashes = gram_hashes(points, n)[:span]
                        for at in np.flatnonzero(np.isin(hashes, np.array(list(known)))).tolist():
                            out += [(scope, p, number * span + at) for p in known[int(hashes[at])] if text.startswith(p, at)]
                columns = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["scope", "passage", "pos"]
                )

        return self.windows.mapInArrow(run, "scope string, passage string, pos long")

    def in_order(self, lists: DataFrame) -> DataFrame:
        """The distinct (scope, parts) whose parts occur in the scope, each after the end of the one before."""
        return in_order(lists, self.occurrences)


def in_order(lists: DataFrame, occurrences) -> DataFrame:
    """The distinct (scope, parts) whose parts occur in the scope in order, by ``occurrences`` of passages."""
    with temporary() as keep:
        lists = cut(lists.select("scope", "parts").filter(F.size("parts") > 0).distinct(), "lists")
        found = cut(occurrences(lists.select("scope", F.explode("parts").alias("passage"))), "occurrences")
        first = found.groupBy("scope", "passage").agg(F.min("pos").alias("pos"))
        most = lists.agg(F.max(F.size("parts"))).first()[0] or 0
        done = None
        state = lists.withColumn("end", F.lit(0).cast("long"))
        for k in range(1, most + 1):
            own = state.withColumn("passage", F.element_at("parts", F.lit(k)))
            if k == 1:  # the first place of a passage is one row, however often it occurs
                met = own.join(first, ["scope", "passage"]).select("scope", "parts", (F.col("pos") + F.length("passage")).alias("end"))
            else:
                met = own.join(found, ["scope", "passage"]).filter("pos >= end").groupBy("scope", "parts", "passage").agg(
                    F.min("pos").alias("pos")
                ).select("scope", "parts", (F.col("pos") + F.length("passage")).alias("end"))
            met = cut(met, "step")
            ready = met.filter(F.size("parts") == k).select("scope", "parts")
            done = ready if done is None else done.unionByName(ready)
            state = met.filter(F.size("parts") > k)
        return keep(cut(done if done is not None else lists.select("scope", "parts"), "found"))
