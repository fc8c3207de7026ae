"""Documents as a stream. The analysis adds columns to a row, so it is the same on a stream: no state and no watermark."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import api


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def score_stream(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    return api.score(docs, text, **how)


def analyze_with_catalogue(docs: DataFrame, persona: Callable[[], dict], sink: Callable[[DataFrame, int], None], checkpoint: str, **how):
    """Starts a stream that reads the persona anew for each batch, so that a changed file holds from the next batch on; a file that is not valid keeps the last valid persona."""
    last: dict = {}

    def batch(rows: DataFrame, number: int) -> None:
        last.update({"persona": persona() or last.get("persona")})
        sink(api.analyze(rows, persona=last.get("persona"), **how), number)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
