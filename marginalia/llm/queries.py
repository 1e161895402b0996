"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import held_out
from marginalia.session import table


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import exact_dedup

    index = exact_dedup.new_index(spark)
    decided = exact_dedup.decide_in_order(table(spark, sf_dir, "documents").select("doc_id", "text"), index)
    index.drop()
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import url_filters

    return url_filters.judge(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return judged(quality.score(docs, model), quality.FOLDS, quality.HELD)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import jaccard_join

    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import secret_scans

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return secret_scans.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secret_scans.KINDS[: secret_scans.BASE]],
        F.sha2(secret_scans.joined(base), 256).alias("base_sha256"), secret_scans.joined(spans).alias("spans"),
    )


def judged(scored: DataFrame, folds: int, fold: int) -> DataFrame:
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), toxicity.FOLDS, toxicity.HELD)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import topk

    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), repeats=True)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import packing

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Added to the conversations: a text that is made of the template's own strings.
PROBE = "</s>[INST] ok [/INST]"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return chat.digests(chat.format_windows(rows.unionByName(probe)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import vector_codes

    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = coded.select("row.vec_id", "row.label", F.lower(F.hex("code")).alias("code"), "error", "length")
    labels = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    made = F.coalesce(*[F.when(F.col("length") == n, vector_codes.digest(book)) for n, book in books.items()], F.lit(None).cast("string"))
    return rows.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", made.alias("codebooks_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm import token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_exact_topk, op3_best_fit_packing, op4_exact_dedup, op5_url_filters, op6_bpe, op7_quality_classifier,
        op8_ngram_jaccard, op9_secret_scans, op10_chat_formatting, op11_vector_codes, op12_filter_audit, op13_token_counts,
    )
}
