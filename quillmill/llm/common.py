"""Helpers that the operators of this subpackage share."""

import os
import shutil
import tempfile
import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run without the space and the five control characters of white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters that one numpy pass handles at a time; bounds a Python worker's memory.
CHUNK_CHARS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Lower the rows of an Arrow batch, so that whole long texts fit a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. A local session without one gets a folder of its own; a cluster's is never a machine's temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        atexit.register(shutil.rmtree, path[len("file://"):], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_WRITTEN: list[str] = []


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors. ``discard`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmill-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the order of tables that ``written`` made, for ``discard``."""
    return len(_WRITTEN)


def discard(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Delete the tables that ``written`` made after ``since``, but the last one if that is to stay. For results that are saved: what reads a deleted table fails."""
    paths = _WRITTEN[since:]
    left = paths[-1:] if keep_last else []
    for path in paths[: len(paths) - len(left)]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN[since:] = left


def rows_with_ids(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``df`` and the name of a column that names its rows: ``key`` itself where its values are
    distinct and there are no nulls, as should be; else a number that is written beside the rows."""
    counts = df.groupBy(F.col(key).alias("key")).count().where("key is null or count > 1")
    if counts.isEmpty():
        return df, key
    row = "__quillmill_row"
    return written(df.withColumn(row, F.monotonically_increasing_id())), row


def chunks(texts, limit: int = CHUNK_CHARS):
    """Slices (start, stop) of ``texts`` of about ``limit`` characters, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def fold_of(column, n: int):
    """crc32 of the id as text, modulo n; a null id is the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def fraction_of(*columns):
    """A uniform number in [0, 1) that a row's values fix."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31)).cast("double") / float(1 << 31)


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<int>": T.ArrayType(T.IntegerType())}


def fields(ddl: str) -> T.StructType:
    """A schema of plain types, parsed without a session."""
    return T.StructType([T.StructField(*(lambda name, kind: (name, _TYPES[kind]))(*f.strip().split(" ", 1))) for f in ddl.split(",")])
