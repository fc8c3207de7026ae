"""The queries that apply each operator to whole tables, and the pipeline's registration."""

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bagminhash import near_duplicates
from .bpe import bpe_digests
from .common import fold_of, small_batches, table
from .jpegmedia import media_columns
from .langid import fit_language_model, predict_language
from .linededup import dedup_lines
from .mixing import mix
from .puquality import fit_quality_model, quality_score
from .repetition import TIGHT_LIMITS, TIGHT_LINE_LIMIT, repetition, repetition_with
from .sharding import place
from .toxicity import fit_toxicity_model, toxicity_score

#: Where the public vocabulary lies; its path is a parameter of the operators.
VOCABULARY = "word_bpe_49k.json"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe_digests(spark, vocabulary_path())("text").alias("d")).select("doc_id", "d.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = fit_language_model(docs.where(~held_out), "text", "lang", "doc_id")
    return docs.select("doc_id", held_out.alias("held_out"), predict_language(docs, model)("text").alias("p")).select("doc_id", "held_out", "p.*")


def op3_repetition(spark: SparkSession, sf_dir: str, measured=repetition) -> DataFrame:
    small_batches(spark)
    made = table(spark, sf_dir, "documents").select("doc_id", measured("text").alias("r"))
    return made.select("doc_id", *(f"r.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op3_repetition_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the stricter limits, under which the shares reject texts that the base rule lets pass."""
    return op3_repetition(spark, sf_dir, repetition_with(TIGHT_LIMITS, TIGHT_LINE_LIMIT))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality_model(docs, labels.where(fold_of(F.col("doc_id"), 5) != 0))
    scored = docs.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), quality_score(docs, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return dedup_lines(table(spark, sf_dir, "documents"), digest=True)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", media_columns("text").alias("m")).select("doc_id", "m.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity_model(docs, labels.where(fold_of(F.col("doc_id"), 5) != 0))
    scored = docs.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity_score(docs, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_bpe, op2_language_id, op3_repetition, op3_repetition_tight, op4_quality, op5_mixing, op6_sharding, op7_line_dedup, op8_near_duplicates, op9_media, op10_toxicity, pipeline)
    return {f.__name__: f for f in found}
