"""Exact Jaccard self-join on word shingles by vertical partitioning.

All shingles have one global order: rare ones by hash, then the heavy ones (in at least a
thousandth of the documents, found by lossy counting over all of them) by rising count.
Two sets that link must share a shingle among their first n - ceil(0.8 n) + 1 in that
order. Equal sets are one class and meet as one row.

1. ``profile``: size, class and parity bitmap of every set, and the heavy shingles.
2. ``settled_order``: the shared prefix shingles as posting rows. Shingles with too long a
   list, because counting missed them, become heavy, until there is none.
3. Leaders: each posting list compares its members with the one in which the shingle
   comes earliest, which joins a group of near copies by as many pairs as it has members.
4. Exact round: pairs on a posting list that lie in different components, within the
   size and position bounds: the smaller set names the sizes that its place on the list
   leaves possible. Groups already joined give no pairs among themselves; long lists are
   compared in squares of bounded size.

Pairs pass the bitmap bound (the parity of hashed shingles differs in at most as many
bits as the sets differ in shingles), then are counted: the order is cut into vertical
fragments, each fragment counts a pair's overlap on its own, and the sum per pair
decides. Links become components.

A class is known by a 64-bit hash of its set; for 10^8 classes the chance that any two
share one is 3 in 10^4.

Defined results: null and empty texts have no shingles and are their own component; a
text of fewer than five words is one shingle; equal texts link; rows that repeat a
doc_id each count; a null doc_id is never a component's id unless alone; empty tables
give no rows; other columns are ignored, or kept by ``keep_first`` whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import FILE_ROWS, HashBitmap, cut, delete, hash_bitmap, keep_rows, map_texts, portions, release, scratch_path, small_batches, temporary, text_key
from marginalia.llm.components import components

WORDS = 5
PERCENT = 80
#: A shingle in this share of all documents is heavy; at most MAX_HEAVY are told apart.
HEAVY_SHARE = 0.001
MAX_HEAVY = 200_000
#: A list of so many times that length is heavy although lossy counting did not see it.
MISSED = 4
#: Sizes on a list are told apart by steps a little wider than a pair may differ; at most
#: so many rows of a list, on either side, are compared in one square.
SIZE_STEP, SQUARE = 101 / PERCENT, 2_000
#: Lossy counting: a block of so many shingles reports those it holds LEAST times or more.
BLOCK, LEAST = 2_000_000, 4
#: Fragments of the global order; as many more, doubling, as keep parts near LARGEST_PART.
FRAGMENTS, LARGEST_PART = 4, 16_384

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    split = text.encode().lower().split()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, split), dtype=np.uint64, count=len(split))
    if not own.size:
        return own
    take = min(words, own.size)
    out = np.full(own.size - take + 1, take, dtype=np.uint64)
    for k in range(take):
        out = (out ^ own[k : own.size - take + 1 + k]) * _M1
        out ^= out >> np.uint64(29)
    out *= _M2
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def parity_bits(hashes: np.ndarray) -> bytes:
    """One bit per hash value modulo a power of two, 2 to 4 times the size: odd or even."""
    bits = 64
    while bits < 2 * hashes.size:
        bits *= 2
    slots = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, size_a: int, size_b: int) -> bool:
    """Whether the bitmaps leave room for a link. Halves of the longer one are folded."""
    while len(a) > len(b):
        half = len(a) // 2
        a = (int.from_bytes(a[:half], "little") ^ int.from_bytes(a[half:], "little")).to_bytes(half, "little")
    while len(b) > len(a):
        half = len(b) // 2
        b = (int.from_bytes(b[:half], "little") ^ int.from_bytes(b[half:], "little")).to_bytes(half, "little")
    differ = (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()
    # overlap <= (size_a + size_b - differ) / 2 and union = size_a + size_b - overlap
    overlap = (size_a + size_b - differ) // 2
    return 100 * overlap >= PERCENT * (size_a + size_b - overlap)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def profile(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: doc_id, text_key, size, class, bits; of kind 1: shingle, count."""
    schema = "kind int, doc_id long, text_key long, size long, cls long, bits binary"

    def run(batches):
        import pyarrow as pa
        import xxhash

        names = ["kind", "doc_id", "text_key", "size", "cls", "bits"]
        block: list[np.ndarray] = []
        held = 0

        def frequent():
            values, counts = np.unique(np.concatenate(block), return_counts=True)
            values, counts = values[counts >= LEAST], counts[counts >= LEAST]
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(values), dtype=np.int32)), none, none, pa.array(counts.astype(np.int64)),
                 pa.array(_signed(values)), pa.nulls(len(values), pa.binary())], names=names,
            )

        for batch in batches:
            sizes, classes, bits = [], [], []
            for texts in portions(batch.column(1)):
                for text in texts:
                    own = shingle_hashes(text)
                    sizes.append(own.size)
                    classes.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if own.size else None)
                    bits.append(parity_bits(own) if own.size else None)
                    block.append(own)
                    held += own.size
                    if held >= BLOCK:
                        yield frequent()
                        block, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sizes), dtype=np.int32)), batch.column(0), batch.column(2),
                 pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(bits, pa.binary())], names=names,
            )
        if block:
            yield frequent()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key().alias("text_key"))
    return map_texts(rows, run, schema)


def heavy_at(n_docs: int) -> int:
    return max(16, int(HEAVY_SHARE * n_docs))


def heavy_shingles(profiled: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the heavy shingles, and their counts as far as blocks reported them."""
    rows = (
        profiled.filter("kind = 1").groupBy("cls").agg(F.sum("size").alias("n"))
        .filter(F.col("n") >= heavy_at(n_docs))
        .orderBy(F.desc("n"), "cls").limit(MAX_HEAVY).collect()
    )
    hashes = np.array([r["cls"] for r in rows], dtype=np.int64).view(np.uint64)
    counts = np.array([r["n"] for r in rows], dtype=np.int64)
    return hashes, counts


def places(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heavy shingles in order of the hash, and each one's place by count."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    place = np.empty(len(hashes), dtype=np.int64)
    place[np.lexsort((hashes, counts))] = np.arange(len(hashes))
    return hashes, place


def in_order(own: np.ndarray, heavy: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The set in the global order."""
    if not heavy.size:
        return own
    at = np.minimum(np.searchsorted(heavy, own), heavy.size - 1)
    is_heavy = heavy[at] == own
    common = own[is_heavy]
    return np.concatenate([own[~is_heavy], common[np.argsort(place[at[is_heavy]])]])


def prefixes(docs: DataFrame, heavy: np.ndarray, place: np.ndarray, wanted: HashBitmap | None = None) -> DataFrame:
    """Posting rows: shingle, cls, at (size in the upper, position in the lower 32 bits).

    With ``wanted``, a bitmap, only rows of shingles that it holds.
    """
    sent = docs.sparkSession.sparkContext.broadcast((heavy, place, wanted))

    def run(batches):
        import pyarrow as pa
        import xxhash

        heavy, place, wanted = sent.value
        names = ["shingle", "cls", "at"]
        parts: list[list[np.ndarray]] = [[], [], []]
        held = 0

        def ready():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=names)

        for batch in batches:
            for texts in portions(batch.column(0)):
                for text in texts:
                    own = shingle_hashes(text)
                    n = own.size
                    if not n:
                        continue
                    cls = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)
                    ordered = in_order(own, heavy, place)
                    length = n - -(-PERCENT * n // 100) + 1
                    where = np.arange(length, dtype=np.int64)
                    if wanted is not None:
                        where = where[wanted.holds(ordered[:length])]
                    parts[0].append(_signed(ordered[where]))
                    parts[1].append(np.full(where.size, cls, dtype=np.int64))
                    parts[2].append((n << 32) | where)
                    held += where.size
                    if held >= 200_000:
                        yield ready()
                        parts, held = [[], [], []], 0
        if held:
            yield ready()

    return map_texts(docs.select(F.col("text").cast("string")), run, "shingle long, cls long, at long")


def postings(docs: DataFrame, heavy: np.ndarray, place: np.ndarray, n_docs: int) -> DataFrame:
    """Distinct posting rows of the shingles that several classes' prefixes hold.

    Which shingles those are is found with partial aggregation, so a shingle in many
    prefixes is one row a task. Tasks then drop the rows of others by a bitmap before the
    shuffle; what it lets through is a list of one class, which gives no pair.
    """
    shared = cut(
        prefixes(docs, heavy, place).groupBy("shingle").agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
        .filter("low < high").select("shingle"), "shared", 4 * n_docs
    )
    wanted = hash_bitmap(shared, shared.count())
    release(shared)
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, 1 + 32 * n_docs // FILE_ROWS)
    return cut(prefixes(docs, heavy, place, wanted).distinct(), "postings", files=tasks)


def settled_order(docs: DataFrame, profiled: DataFrame, n_docs: int) -> tuple[DataFrame, DataFrame]:
    """The posting rows in an order in which no list of a shingle that is not heavy is long, and the lists.

    A list is a shingle, its length and its leader: the member in which the shingle comes
    earliest. Shingles that counting missed join the heavy ones, which changes the prefixes.
    """
    hashes, counts = heavy_shingles(profiled, n_docs)
    while True:
        posts = postings(docs, *places(hashes, counts), n_docs)
        lists = cut(posts.groupBy("shingle").agg(F.count("*").alias("n"), F.min(F.struct(
            F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"), "at", "cls"
        )).alias("first")).filter("n > 1").select("shingle", "n", F.col("first.cls").alias("b"), F.col("first.at").alias("at_b")), "lists", 4 * n_docs)
        known = set(hashes.view(np.int64).tolist())
        # Lists that long are few: each has that share of all documents.
        long = lists.filter(F.col("n") > MISSED * heavy_at(n_docs)).select("shingle", "n").collect()
        missed = [r for r in long if r["shingle"] not in known][: max(0, MAX_HEAVY - len(hashes))]
        if not missed:
            return posts, lists
        release(posts, lists)
        hashes = np.concatenate([hashes, np.array([r["shingle"] for r in missed], dtype=np.int64).view(np.uint64)])
        counts = np.concatenate([counts, np.array([r["n"] for r in missed], dtype=np.int64)])


def _fits(a: str, b: str):
    """Size and position bounds for posting rows named ``a`` and ``b``."""
    size = lambda x: F.shiftright(F.col(x), 32)
    left = lambda x: size(x) - F.col(x).bitwiseAND(F.lit(0xFFFFFFFF))
    need = F.ceil(F.lit(PERCENT) * (size(a) + size(b)) / F.lit(100 + PERCENT))
    return (
        (100 * F.least(size(a), size(b)) >= PERCENT * F.greatest(size(a), size(b)))
        & (F.least(left(a), left(b)) >= need)
    )


def _pair(a: str = "a", b: str = "b") -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def leader_pairs(posts: DataFrame, lists: DataFrame) -> DataFrame:
    """Each posting list's members with its leader."""
    return (
        posts.join(lists.select("shingle", "b", "at_b"), "shingle").filter((F.col("cls") != F.col("b")) & _fits("at", "at_b"))
        .select(F.col("cls").alias("a"), "b").select(*_pair()).distinct()
    )


def _step(size) -> Column:
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(SIZE_STEP))).cast("int")


def reach(at: str) -> Column:
    """The largest size, of its own or more, that a set can link with from its place on a list."""
    size, left = F.shiftright(F.col(at), 32), F.shiftright(F.col(at), 32) - F.col(at).bitwiseAND(F.lit(0xFFFFFFFF))
    by_size = F.floor(F.lit(100) * size / F.lit(PERCENT))
    return F.least(by_size, F.floor(F.lit(100 + PERCENT) * left / F.lit(PERCENT)) - size)


def cross_pairs(posts: DataFrame, labels: DataFrame, n_posts: int) -> DataFrame:
    """Pairs of a posting list that lie in different components.

    The smaller set of a pair (the lesser class of equal sizes) looks for the other among
    the steps of size that its reach allows; from the later places of a list there are
    none. A list with more than ``SQUARE`` rows is dealt into a grid for every step: the
    smaller sets into rows and the larger ones into columns, each square joined on its own.
    """
    size = F.shiftright("at", 32)
    named = posts.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn(
        "label", F.coalesce("label", "cls")
    )
    mixed = named.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low < high")
    open_lists = cut(named.join(mixed.select("shingle", "n"), "shingle"), "open", n_posts)

    def asking(rows: DataFrame) -> DataFrame:
        steps = F.explode(F.sequence(_step(size), _step(reach("at"))))
        return rows.filter(reach("at") >= size).select("shingle", steps.alias("step"), F.col("cls").alias("a"), "at", "label")

    def asked(rows: DataFrame) -> DataFrame:
        return rows.select("shingle", _step(size).alias("step"), F.col("cls").alias("b"), F.col("at").alias("at_b"), F.col("label").alias("label_b"))

    short = open_lists.filter(F.col("n") <= SQUARE)
    met = asking(short).hint("merge").join(asked(short), ["shingle", "step"])
    long = open_lists.filter(F.col("n") > SQUARE)
    if not long.isEmpty():
        cells = lambda rows, name: rows.groupBy("shingle", "step").agg(F.ceil(F.count("*") / F.lit(SQUARE)).alias(name))
        grid = cells(asking(long), "n_rows").join(cells(asked(long), "n_columns"), ["shingle", "step"])
        dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
        left = asking(long).join(grid, ["shingle", "step"]).withColumns({"row": dealt("a", "n_rows"), "column": every("n_columns")})
        right = asked(long).join(grid, ["shingle", "step"]).withColumns({"column": dealt("b", "n_columns"), "row": every("n_rows")})
        squares = left.drop("n_rows", "n_columns").hint("merge").join(right.drop("n_rows", "n_columns"), ["shingle", "step", "row", "column"])
        met = met.unionByName(squares.drop("row", "column"))
    larger = F.shiftright("at_b", 32)
    return (
        met.filter(((larger > size) | ((larger == size) & (F.col("a") < F.col("b")))) & (F.col("label") != F.col("label_b")) & _fits("at", "at_b"))
        .select(*_pair()).distinct()
    )


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that the bitmaps do not rule out, with both sizes."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            d = batch.to_pydict()
            ok = [may_link(*row) for row in zip(d["bits_a"], d["bits_b"], d["size_a"], d["size_b"], strict=True)]
            yield batch.select(["a", "b", "size_a", "size_b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", "size_a", "size_b", "bits_a", "bits_b"
    ).mapInArrow(run, "a long, b long, size_a long, size_b long")


def fragment_steps(largest_part: int) -> list[tuple[int, int]]:
    """(largest size, number of fragments) in which a pair with a larger set of that size is counted."""
    return [(largest_part * FRAGMENTS << k, FRAGMENTS << k) for k in range(32)]


def fragments_of(size: int, steps: list[tuple[int, int]] | None = None) -> int:
    """Fragments that a pair is counted in, by the size of its larger set."""
    return next(n for most, n in steps or fragment_steps(LARGEST_PART) if size <= most)


class Fragments:
    """The sets of the classes in ``pairs``, cut at fixed pivots of the hash order.

    A table of (cls, cuts, fragment, part), bucketed by class: ``cuts`` is the number of
    fragments, which grows with the set, so a part stays small. A set is there in the
    numbers that pairs with it may be counted in, nearly always one. Texts are read again
    and not shuffled; a bitmap tells which rows may be needed.
    """

    def __init__(self, docs: DataFrame, pairs: DataFrame, n_pairs: int, classes: DataFrame):
        spark = docs.sparkSession
        # The driver settles the steps once; tasks and the join of pairs use these.
        self.steps = steps = fragment_steps(LARGEST_PART)
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = scratch_path(spark, "fragments")
        self.name = self.path.rsplit("/", 1)[1].replace("-", "_")
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        wanted = classes.join(ends, "cls", "left_semi").select("doc_id", "text_key")
        sent = spark.sparkContext.broadcast(hash_bitmap(wanted.select(F.xxhash64("doc_id", "text_key").alias("h")), 2 * n_pairs))

        def run(batches):
            import pyarrow as pa
            import xxhash

            sent_on: set[int] = set()  # classes of this task: copies that slipped through go once
            for batch in batches:
                hit = sent.value.holds(batch.column(0).to_numpy())
                for texts in portions(batch.column(1).filter(pa.array(hit))):
                    d = {"cls": [], "cuts": [], "fragment": [], "part": []}
                    for text in texts:
                        own = shingle_hashes(text)
                        if not own.size:
                            continue
                        cls = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)
                        if cls in sent_on:
                            continue
                        sent_on.add(cls)
                        for cuts in {fragments_of(own.size, steps), fragments_of(100 * own.size // PERCENT, steps)}:
                            pivots = np.arange(1, cuts, dtype=np.uint64) << np.uint64(64 - cuts.bit_length() + 1)
                            at = [0, *np.searchsorted(own, pivots).tolist(), own.size]
                            for k in range(cuts):
                                if at[k] < at[k + 1]:
                                    d["cls"].append(cls)
                                    d["cuts"].append(cuts)
                                    d["fragment"].append(k)
                                    d["part"].append(_signed(own[at[k] : at[k + 1]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d["cls"], pa.int64()), pa.array(d["cuts"], pa.int32()), pa.array(d["fragment"], pa.int32()),
                         pa.array(d["part"], pa.list_(pa.int64()))], names=list(d),
                    )

        parts = map_texts(
            docs.select(F.xxhash64("doc_id", text_key()).alias("h"), "text"), run,
            "cls long, cuts int, fragment int, part array<long>",
        )
        with small_batches(spark):
            (
                parts.repartition(self.n, "cls").sortWithinPartitions("cls", "cuts", "fragment")
                .dropDuplicates(["cls", "cuts", "fragment"])
                .write.bucketBy(self.n, "cls").sortBy("cls").option("path", self.path).saveAsTable(self.name)
            )
        self.rows = spark.table(self.name)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose partial overlaps, summed over the fragments, reach the bound."""
        side = lambda x: self.rows.select(
            F.col("cls").alias(x), F.col("cuts").alias(f"cuts_{x}"), "fragment", F.col("part").alias(f"part_{x}")
        )
        size = F.greatest("size_a", "size_b")
        asked = pairs.withColumn("cuts", F.coalesce(*[F.when(size <= most, n) for most, n in self.steps]))
        partial = (
            asked.join(side("a"), "a").filter("cuts = cuts_a").join(side("b"), ["b", "fragment"]).filter("cuts - cuts_b = 0")
            .select("a", "b", "size_a", "size_b", F.size(F.array_intersect("part_a", "part_b")).alias("n"))
        )
        return (
            partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
            .filter(100 * F.col("n") >= PERCENT * (F.col("size_a") + F.col("size_b") - F.col("n")))
            .select(F.col("a").alias("u"), F.col("b").alias("v"))
        )

    def drop(self) -> None:
        spark = self.rows.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(spark, self.path)


def counted(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n_posts: int) -> tuple[DataFrame, int]:
    """The links among candidate pairs, and a bound on their number."""
    near = cut(bounded(pairs, classes), "near", n_posts)
    n = near.count()
    if not n:
        return near.select(F.col("a").alias("u"), F.col("b").alias("v")), 0
    fragments = Fragments(docs, near, n, classes)
    links = cut(fragments.links(near), "links", n)
    fragments.drop()
    release(near)
    return links, n


def join(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with temporary() as keep:
        profiled = keep(cut(profile(docs), "profile"))
        rows = profiled.filter("kind = 0")
        n_docs = rows.count()
        posts, lists = settled_order(docs, profiled, n_docs)
        classes = cut(
            rows.filter("cls IS NOT NULL").groupBy("cls").agg(
                F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key", "size", "bits")).alias("first")
            ).select("cls", "first.doc_id", "first.text_key", "first.size", "first.bits"),
            "classes", 8 * n_docs,  # bitmaps make these rows wide
        )
        n_posts = posts.count()
        links, n_links = counted(docs, leader_pairs(posts, lists), classes, n_posts)
        labels = components(links, n_links)
        pairs = cross_pairs(posts, labels, n_posts)
        more, n_more = counted(docs, pairs, classes, n_posts)
        # Further links join components, so their ends are known by the first labels.
        name = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
        merged = more.join(name("u"), "u", "left").join(name("v"), "v", "left").select(
            F.coalesce("label_u", "u").alias("u"), F.coalesce("label_v", "v").alias("v")
        )
        second = components(merged, n_more)
        labelled = classes.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn(
            "one", F.coalesce("label", "cls")
        ).join(second.select(F.col("node").alias("one"), F.col("label").alias("label2")), "one", "left").select(
            "cls", "doc_id", F.coalesce("label2", "one").alias("label")
        )
        least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = keep(cut(labelled.join(least, "label").select("cls", "component_id"), "named", n_docs))
    linked = rows.filter("cls IS NOT NULL").join(named, "cls").select(
        "doc_id", "text_key", F.col("size").alias("n_shingles"), "component_id"
    )
    return linked.unionByName(rows.filter("cls IS NULL").select(
        "doc_id", "text_key", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")
    ))


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest doc_id, with all its columns."""
    joined = join(docs)
    return keep_rows(docs, joined.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))
