"""Readers and writers of documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of a folder of Parquet tables; only ``columns`` are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files give fewer partitions than there are cores (a small table in one row group); else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < cores else df


def read_texts(spark: SparkSession, path: str, kind: str = "parquet", text: str = "text", key: str | None = None, **options) -> DataFrame:
    """Documents (doc_id, text) from Parquet, JSON lines, CSV or plain text files (one document a file). Without a key column ids are made up."""
    if kind == "text":
        df = spark.read.text(path, wholetext=True, **options).select(F.col("value").alias("text"))
    else:
        df = spark.read.format(kind).options(**options).load(path)
        df = df.select(*([F.col(key).alias("doc_id")] if key else []), F.col(text).alias("text"))
    return df if key and kind != "text" else df.select(F.monotonically_increasing_id().alias("doc_id"), "text")


def write_results(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Nested results as Parquet, ORC or JSON lines."""
    df.write.format(kind).mode(mode).save(path)
