"""Numbers accepted in turn, over scopes of any length.

A number is accepted when it is the one due; then the next one is due. What a block of
rows does to the number due can be said without knowing it: for every number x of the
block, the number that is due behind the block if x is due before it; other numbers pass
unchanged. Such summaries compose: two neighbours make the summary of both, by one join
on the number, so a scope becomes a tree of joins in as many rounds as its blocks can be
halved. On the way down every block learns what is due at its start, and all blocks are
then read at once. No task reads a scope.

Orders are whole numbers, unique within a scope; rows of one order number are taken in
any order. Null numbers are never due.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from marginalia.scratch import cut, temporary

#: Successive order numbers of a block.
BLOCK = 4_096


def with_blocks(rows: DataFrame, order: str, block: int) -> DataFrame:
    return rows.withColumn("block_", F.floor(F.col(order).cast("long") / F.lit(block)).cast("long"))


def summaries(rows: DataFrame, key: str, order: str, numbers: str, last: int | None = None) -> DataFrame:
    """key, block_, x, due: what is due behind each block for every number x due before it.

    rows: key, block_, the order and an array of numbers. A block is read backwards: what
    x leads to is what x + 1 leads to in the rest of the block.
    """

    def run(batches):
        import pandas as pd

        own, leads = None, {}

        def ready():
            if own is None or not leads:
                return []
            return [pd.DataFrame({key: [own[0]] * len(leads), "block_": own[1], "x": list(leads), "due": list(leads.values())})]

        for frame in batches:
            for name, block, found in zip(frame[key], frame["block_"], frame[numbers], strict=True):
                name = None if pd.isna(name) else name
                if own is None or own != (name, block):
                    yield from ready()
                    own, leads = (name, block), {}
                for x in reversed([] if found is None else list(found)):
                    if x is not None and not pd.isna(x) and (last is None or x <= last):
                        leads[int(x)] = leads.get(int(x) + 1, int(x) + 1)
        yield from ready()

    ordered = rows.select(key, "block_", order, numbers).repartition(key, "block_").sortWithinPartitions(key, "block_", F.desc(order))
    schema = S.StructType([rows.schema[key], *S.StructType.fromDDL("block_ long, x long, due long").fields])
    return ordered.select(key, "block_", numbers).mapInPandas(run, schema)


def due_at(rows: DataFrame, key: str, order: str, numbers: str, first: int, last: int | None = None) -> DataFrame:
    """key, block_, due: the number due at the start of every block of ``rows`` that has one."""
    with temporary() as keep:
        every = Window.partitionBy(key).orderBy("block_")
        blocks = cut(rows.groupBy(key, "block_").agg(F.lit(1)).withColumn("node", (F.row_number().over(every) - 1).cast("long")).select(key, "block_", "node"), "blocks")
        same = F.col("a.scope_").eqNullSafe(F.col("b.scope_"))
        named = blocks.withColumnRenamed(key, "scope_")
        leaves = summaries(rows, key, order, numbers, last).withColumnRenamed(key, "scope_")
        level = cut(leaves.alias("a").join(named.alias("b"), same & (F.col("a.block_") == F.col("b.block_"))).select("a.scope_", "node", "x", "due"), "leaves")
        levels, most = [level], blocks.agg(F.max("node")).first()[0] or 0
        while most > 0:
            left, right = (level.filter(F.col("node") % 2 == side).withColumn("node", F.floor(F.col("node") / 2)) for side in (0, 1))
            pair = same & (F.col("a.node") == F.col("b.node"))
            through = left.alias("a").join(right.alias("b"), pair & (F.col("a.due") == F.col("b.x")), "left").select(
                "a.scope_", "a.node", "a.x", F.coalesce("b.due", "a.due").alias("due")
            )
            alone = right.alias("a").join(left.alias("b"), pair & (F.col("a.x") == F.col("b.x")), "left_anti")
            level = cut(through.unionByName(alone.select("scope_", "node", "x", "due")), "level")
            levels.append(level)
            most //= 2
        # Down again: the left half starts as the whole does, the right half behind the left one.
        nodes = cut(named.select("scope_").distinct().select("scope_", F.lit(0).cast("long").alias("node"), F.lit(first).cast("long").alias("due")), "roots")
        for level in reversed(levels[:-1]):
            left = nodes.select("scope_", (2 * F.col("node")).alias("node"), "due")
            behind = left.alias("a").join(
                level.alias("b"), same & (F.col("a.node") == F.col("b.node")) & (F.col("a.due") == F.col("b.x")), "left"
            ).select("a.scope_", (F.col("a.node") + 1).alias("node"), F.coalesce("b.due", "a.due").alias("due"))
            nodes = cut(left.unionByName(behind), "nodes")
        found = nodes.alias("a").join(named.alias("b"), same & (F.col("a.node") == F.col("b.node")))
        return keep(cut(found.select(F.col("a.scope_").alias(key), "block_", "due"), "due"))


def start_of_blocks(rows: DataFrame, key: str, due: DataFrame) -> DataFrame:
    """The rows (with ``block_``) with the number due at the start of their block."""
    name = due.columns[0]
    own = due.select(F.col(name).alias("scope_"), F.col("block_").alias("start_"), "due")
    return rows.join(own, F.col(key).eqNullSafe(F.col("scope_")) & (F.col("block_") == F.col("start_"))).drop("scope_", "start_")


def accepted(rows: DataFrame, key: str, order: str, number: str, first: int = 1, last: int | None = None, block: int = BLOCK) -> DataFrame:
    """key, order, number of the rows that are accepted in turn, from ``first`` up to ``last``."""
    own = with_blocks(rows.select(key, order, F.col(number).cast("long").alias("number_")), order, block)
    due = due_at(own.withColumn("numbers_", F.array("number_")), key, order, "numbers_", first, last)

    def run(batches):
        import pandas as pd

        at, now = None, None
        for frame in batches:
            keep = []
            for k, (name, start, found, at_start) in enumerate(zip(frame[key], frame["block_"], frame["number_"], frame["due"], strict=True)):
                here = (None if pd.isna(name) else name, start)
                if here != at:
                    at, now = here, at_start
                if found == now and (last is None or now <= last):
                    keep.append(k)
                    now += 1
            out = frame.iloc[keep][[key, order, "number_"]]
            yield out.astype({"number_": "int64"})

    ordered = start_of_blocks(own, key, due).repartition(key, "block_").sortWithinPartitions(key, "block_", order)
    schema = S.StructType([rows.schema[key], rows.schema[order], S.StructField("number_", S.LongType())])
    return ordered.select(key, order, "block_", "number_", "due").mapInPandas(run, schema).withColumnRenamed("number_", number)
