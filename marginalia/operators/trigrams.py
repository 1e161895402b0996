"""A trigram index for the full-text query, which grows by batches.

A batch of notes is numbered, in blocks of ``BLOCK`` notes, and every three successive
letters of a folded text point to the notes that hold them: per trigram and block a
sorted list of places. Postings lie in buckets by trigram, so a query opens only the
buckets of its own trigrams. Lists are intersected block by block, from the shortest on;
what is left are the only notes whose texts are read, and the query proper decides on
those, so its result is the one over all notes.

Terms of one or two letters have no trigram of their own; the lists of all trigrams that
hold such a term are united. Texts count as if two letters of no alphabet stood at either end, so
every letter is in a trigram.

A batch is there when its name is published, after everything else of it is written.
Adding it again, after a crash or by mistake, changes nothing. A path that comes again in
a later batch replaces the earlier note.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import fulltext
from marginalia.scratch import create_new, cut, delete, listed, read_small, temporary

#: Notes of a block, as bits of a place; buckets of postings; blocks that a filter names.
PLACE_BITS, BUCKETS, NAMED_BLOCKS = 12, 64, 200
#: A letter that stands around a text; no text holds it.
_EDGE = 0x1FFFFF
_LOW = (1 << 21) - 1


def packed(text: str) -> np.ndarray:
    """The distinct trigrams of a text with its edges, 21 bits a letter."""
    own = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    p = np.concatenate([[_EDGE, _EDGE], own, [_EDGE, _EDGE]])
    return np.unique((p[:-2] << 42) | (p[1:-1] << 21) | p[2:])


def inner(term: str) -> list[int]:
    """The trigrams within a term."""
    p = [ord(c) for c in term]
    return sorted({(a << 42) | (b << 21) | c for a, b, c in zip(p, p[1:], p[2:], strict=False)})


def bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


class TrigramIndex:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, fold: str = "casefold"):
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold

    def batches(self) -> list[str]:
        """The batches that are there, in the order in which they came."""
        return sorted(listed(self.spark, f"{self.path}/published"), key=lambda name: json.loads(read_small(self.spark, f"{self.path}/published/{name}"))["at"])

    def add(self, name: str, notes: DataFrame, title: Column | None = None) -> bool:
        """Index a batch of notes (path, text), unless a batch of that name is there already."""
        known = self.batches()
        if name in known:
            return False
        title = T.note_title(F.col("path"), F.col("text")) if title is None else title
        number = F.monotonically_increasing_id()
        texts, lists = f"{self.path}/texts/{name}", f"{self.path}/postings/{name}"
        (
            notes.select("path", F.coalesce("text", F.lit("")).alias("text"), title.alias("title"), number.alias("number"))
            .select(F.shiftright("number", PLACE_BITS).alias("block"), F.col("number").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("place"),
                    "path", "title", "text")
            .write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(texts)
        )
        self._postings(self._texts(name)).repartition(BUCKETS, "bucket").sortWithinPartitions("trigram", "block").write.mode(
            "overwrite"
        ).partitionBy("bucket").parquet(lists)
        return create_new(self.spark, f"{self.path}/published/{name}", json.dumps({"at": len(known)}))

    def _texts(self, name: str) -> DataFrame:
        return self.spark.read.schema("block long, place int, path string, title string, text string").parquet(f"{self.path}/texts/{name}")

    def _postings(self, texts: DataFrame) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                blocks, places = (batch.column(k).to_numpy() for k in (0, 1))
                own = [packed(t.as_py()) for t in batch.column(2)]
                sizes = [len(o) for o in own]
                trigram = np.concatenate([*own, np.zeros(0, dtype=np.int64)])
                block, place = np.repeat(blocks, sizes), np.repeat(places, sizes)
                order = np.lexsort((place, trigram, block))
                trigram, block, place = trigram[order], block[order], place[order]
                new = np.append(True, (trigram[1:] != trigram[:-1]) | (block[1:] != block[:-1]))[: trigram.size]
                starts = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trigram[starts]), pa.array(block[starts]),
                     pa.ListArray.from_arrays(pa.array([*starts, trigram.size], pa.int32()), pa.array(place, pa.int32()))],
                    names=["trigram", "block", "places"],
                )

        parts = texts.select("block", "place", fulltext.FOLDS[self.fold][0](F.col("text")).alias("body")).mapInArrow(run, "trigram long, block long, places array<int>")
        whole = F.sort_array(F.flatten(F.collect_list("places")))  # a block's places at most
        return parts.groupBy("trigram", "block").agg(whole.alias("places")).withColumn("bucket", bucket(F.col("trigram")))

    def _lists(self, trigrams: list[int] | None) -> DataFrame:
        """Postings of all batches; of some trigrams, only from the buckets that hold them."""
        found = None
        for order, name in enumerate(self.batches()):
            own = self.spark.read.schema("trigram long, block long, places array<int>, bucket int").parquet(f"{self.path}/postings/{name}")
            if trigrams is not None:
                named = self.spark.range(1).select(F.explode(F.array(*[F.lit(t).cast("long") for t in trigrams])).alias("t"))
                buckets = sorted({r["b"] for r in named.select(bucket(F.col("t")).alias("b")).collect()})
                own = own.filter(F.col("bucket").isin(buckets) & F.col("trigram").isin(trigrams))
            own = own.select(F.lit(order).alias("batch"), "trigram", "block", "places")
            found = own if found is None else found.unionByName(own)
        return found if found is not None else self.spark.createDataFrame([], "batch int, trigram long, block long, places array<int>")

    def candidates(self, query: str) -> DataFrame:
        """batch, block, place of the notes that may hold every term; no text is read."""
        terms = sorted(set(fulltext.query_terms(query, self.fold)))
        needed = sorted({t for term in terms for t in inner(term)})
        lists = None
        if needed:
            lists = self._lists(needed).select("batch", "block", "places")
        for term in terms:
            if len(term) < 3:
                letters = [F.shiftrightunsigned("trigram", 42), F.shiftrightunsigned("trigram", 21).bitwiseAND(_LOW), F.col("trigram").bitwiseAND(_LOW)]
                p = [ord(c) for c in term]
                at = [reduce(lambda a, b: a & b, [letters[k + i] == p[i] for i in range(len(p))]) for k in range(4 - len(p))]
                own = self._lists(None).filter(reduce(lambda a, b: a | b, at)).groupBy("batch", "block").agg(
                    F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")  # a block's places at most
                )
                lists = own if lists is None else lists.unionByName(own)
        wanted = len(needed) + sum(len(term) < 3 for term in terms)
        shortest_first = F.array_sort(F.collect_list(F.struct(F.size("places").alias("size"), "places")))
        both = F.aggregate(F.slice("all", 2, wanted), F.col("all")[0]["places"], lambda a, b: F.array_intersect(a, b["places"]))
        return (
            lists.groupBy("batch", "block").agg(shortest_first.alias("all")).filter(F.size("all") == wanted)
            .select("batch", "block", F.explode(both).alias("place"))
        )

    def texts_of(self, found: DataFrame) -> DataFrame:
        """path, title, text of the notes in ``found`` (batch, block, place), the last of each path."""
        blocks = found.select("batch", "block").distinct().limit(NAMED_BLOCKS + 1).collect()
        rows = paths = None
        for order, name in enumerate(self.batches()):
            texts = self._texts(name)
            every = texts.select(F.lit(order).alias("batch"), "path")
            paths = every if paths is None else paths.unionByName(every)
            mine = [r["block"] for r in blocks if r["batch"] == order]
            if len(blocks) <= NAMED_BLOCKS:
                if not mine:
                    continue
                # Few blocks: the scan passes over the others by the statistics of the files.
                texts = texts.filter(reduce(lambda a, b: a | b, [F.col("block") == b for b in mine]))
            own = texts.join(found.filter(F.col("batch") == order).select("block", "place"), ["block", "place"], "left_semi").select(
                F.lit(order).alias("batch"), "path", "title", "text"
            )
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            return self.spark.createDataFrame([], "path string, title string, text string")
        rows = cut(rows, "candidates")
        last = paths.join(rows.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["path", "batch"], "left_semi").select("path", "title", "text")

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """What :func:`fulltext.search` gives over all notes of the index."""
        return self.search_counted(query, limit)[0]

    def search_counted(self, query: str, limit: int = 10) -> tuple[DataFrame, int]:
        """The result, and how many texts were read for it."""
        if limit < 1:
            raise ValueError("limit must be at least 1")
        with temporary() as keep:
            found = cut(self.candidates(query), "found")
            rows = self.texts_of(found)
            best = keep(cut(fulltext.search(rows.select("path", "text", "title"), query, limit, F.col("title"), self.fold), "best"))
            return best.orderBy(F.desc("score"), "path"), found.count()

    def drop(self) -> None:
        delete(self.spark, self.path)
