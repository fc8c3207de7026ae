"""From raw documents to tokens: language ID, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's ``docs``. All but the last return the columns of ``documents``. Rows with
null texts leave at the first stage; empty tables pass through.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.bagminhash import without_near_duplicates
from quillmill.llm.bpe import bpe_round_trip
from quillmill.llm.common import discard, fold_of, mark, small_batches, table, written
from quillmill.llm.langid import UNKNOWN, fit_language_model, predict_language
from quillmill.llm.linededup import dedup_lines
from quillmill.llm.mixing import mixed_documents
from quillmill.llm.queries import vocabulary_path

#: Documents whose language is less likely than this are rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no language that the model is sure of. Where no row has a text and a language to learn from, none is known to be wrong, so all documents with a letter stay."""
    small_batches(spark)
    model = fit_language_model(docs.where(fold_of(F.col("doc_id"), 4) != 2), "text", "lang", "doc_id")
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = docs.withColumn("__quillmill_language", predict_language(docs, model)("text"))
    kept = (F.col("__quillmill_language.lang_pred") != UNKNOWN) & (F.col("__quillmill_language.score") >= LEAST_SCORE)
    return judged.where(kept).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents hold, but for one copy."""
    small_batches(spark)
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    small_batches(spark)
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as often as the mixture takes them: a row for each pass."""
    small_batches(spark)
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row's text, and the text decoded from them."""
    small_batches(spark)
    made = docs.select("doc_id", "lang", "source", bpe_round_trip(spark, vocabulary_path())("text").alias("b"))
    return made.select("doc_id", "lang", "source", "b.*")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: Signatures, a regression and a tokenizer can't be written in SQL; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Of the tables in the shared folder each stage's result stays until the next one's is written."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        discard(spark, since, keep_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
