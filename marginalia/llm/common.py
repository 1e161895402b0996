"""What the training-data operators share: scratch tables, row keys, texts in portions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.scratch import (  # noqa: F401  the operators take these from here
    FILE_ROWS, create_new, cut, delete, listed, read_small, release, run_folder, scratch_path, shared_dir, small_batches, sweep, temporary,
)
from marginalia.sketch import HashBitmap, hash_bitmap  # noqa: F401


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text falls in the fold that no model learns labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters that a Python worker holds as separate strings at a time.
PORTION = 1_000_000


def portions(texts):
    """The texts of an Arrow column, null as empty, in lists of about ``PORTION`` characters."""
    own, size = [], 0
    for text in texts:
        own.append(text.as_py() or "")
        size += len(own[-1])
        if size >= PORTION:
            yield own
            own, size = [], 0
    if own:
        yield own


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that no column of ``df`` has, in whatever case: the wanted ones, lengthened if need be."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def keep_rows(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``stay`` names by doc_id and text_key, one of equal rows.

    Texts are shuffled once; a row named once needs no further look. A null doc_id names
    rows with a null doc_id; other columns pass, whatever their names.
    """
    i, key, n, h = fresh_names(docs, "id_", "key_", "n_", "h_")
    named = cut(stay.groupBy(F.col("doc_id").alias(i), F.col("text_key").alias(key)).agg(F.count("*").alias(n)), "stay")
    kept = docs.withColumn(h, text_key()).join(named, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(key)))
    repeats = kept.filter(F.col(n) > 1).dropDuplicates([i, key])
    return kept.filter(F.col(n) == 1).unionByName(repeats).select(*own_columns(docs))


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over rows with texts; the session bounds a batch, in rows and in bytes."""
    return df.mapInArrow(run, schema)
