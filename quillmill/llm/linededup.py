"""Line dedup over levelled, sorted runs of line hashes.

A ``LineRuns`` store keeps, for each line key ever seen, the number of documents that hold it and
the largest id among them. It consists of runs: tables bucketed and sorted by the 128-bit hash of
the key. Adding a batch of lines: the batch is aggregated by key and merge-anti-joined with every
run; keys that no run has become a new run of level 0, increments for known keys go to an
increments run. When a level holds ``fanout`` runs they are merged into one of the next level, and
so are as many increments into one.
Runs have distinct keys, so compaction only merges. Runs and batches have equal buckets, each one
sorted file, so these joins merge the files as they lie: no shuffle and no sort of the runs.

``dedup_lines`` deals the documents to batches by a hash of the id (each id lies in one batch, so
counts add up), feeds them to a store, and drops the lines of keys found in ``min_docs`` documents
except in the largest id that holds them.

Skew: lines go through partial aggregation before the shuffle, so a line that a third of all
documents hold is a row a task; where documents meet the frequent keys, such a line's rows are dealt
to ``SALTS`` tasks. Texts are shuffled once, by id, to meet their dropped keys.

Cases: null and empty texts are one empty line. A key that a document has several times counts
once. Rows that share an id are one document; so are rows with a null id, which is the least of
ids. Keys of under ``min_length`` code points always stay. Hashes have 128 bits.
"""

import hashlib
import json
import uuid
from contextlib import contextmanager
from functools import reduce
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields, written

#: The characters stripped at both ends of a line.
STRIPPED = b"\x20\x09\x0a\x0b\x0c\x0d"
_HASHES = ["h1", "h2"]
#: Tasks that the documents of one frequent line are dealt to.
SALTS = 16


def line_key(line: str) -> bytes:
    """The line, stripped, A-Z lower-cased (bytes.lower changes no other byte), in UTF-8."""
    return line.encode("utf-8", "surrogatepass").strip(STRIPPED).lower()


def key_hashes(text: str | None, min_length: int) -> list[bytes | None]:
    """The 16-byte hash of each line's key, or None for keys that are too short."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        # A key has no more code points than its line, so short lines need no closer look.
        key = line_key(line) if len(line) >= min_length else b""
        long = len(key) >= min_length and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_length)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _line_rows(min_length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts = [], []
            for text in batch.column("text").to_pylist():
                own = set(key_hashes(text, min_length)) - {None}
                digests += own
                counts.append(len(own))
            pairs = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            of = pa.array(np.repeat(np.arange(len(counts)), counts))
            columns = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), batch.column("doc_id").take(of), batch.column("batch").take(of)]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc_id", "batch"])

    return rows


@contextmanager
def sorted_scans(spark: SparkSession):
    """Lets plans made within take the order of bucketed tables of one file a bucket from their files; the session's setting returns after."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LineRuns:
    """The store. Its tables lie in the database that is current when it is made.

    With a ``name`` it lasts: a table of that name holds a manifest, one row for each state, written
    after the state's tables; a store of that name opens at the last one, and tables that a lost
    driver left beside it are dropped. Without one it is dropped with ``drop``, as by leaving a ``with``."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3, name: str | None = None):
        self.spark, self.fanout, self.name = spark, fanout, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = spark.catalog.currentDatabase()
        self.prefix = f"quillmill_run_{name or uuid.uuid4().hex}_"
        self.manifest = f"{self.database}.quillmill_store_{name}" if name else None
        self.levels: list[list[str]] = [[]]
        self.increments: list[str] = []
        self.version = 0
        if self.manifest and spark.catalog.tableExists(self.manifest):
            last = spark.table(self.manifest).orderBy(F.desc("version")).first()
            if last:
                self.version, state = last["version"], json.loads(last["state"])
                self.levels, self.increments, self.buckets = state["levels"], state["increments"], state["buckets"]
            self._sweep()

    def __enter__(self) -> "LineRuns":
        return self

    def __exit__(self, *_) -> None:
        if not self.name:
            self.drop()

    def _save(self, df: DataFrame) -> str:
        name = f"{self.database}.{self.prefix}{uuid.uuid4().hex}"
        with sorted_scans(self.spark):
            df.write.bucketBy(self.buckets, *_HASHES).sortBy(*_HASHES).format("parquet").saveAsTable(name)
        return name

    @property
    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _sweep(self) -> None:
        """Drop the store's tables that its state does not name."""
        known = {n.split(".")[-1] for n in (*self.runs, *self.increments)}
        for t in self.spark.catalog.listTables(self.database, f"{self.prefix}*"):
            if t.name not in known:
                self._drop(f"{self.database}.{t.name}")

    def add(self, lines: DataFrame) -> None:
        """``lines``: h1, h2, doc_id, one row for each key of each document, of documents that no earlier
        batch held. Old tables are dropped once the new state is written; if a step fails, the state stays."""
        batch = lines.groupBy(*_HASHES).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).repartition(self.buckets, *_HASHES)
        levels, increments = [list(x) for x in self.levels], list(self.increments)
        try:
            whole = self._save(batch)
            if not self.runs:
                levels[0].append(whole)
            else:
                fresh = self.spark.table(whole)
                for name in self.runs:
                    fresh = fresh.join(self.spark.table(name).select(*_HASHES), _HASHES, "left_anti")
                new = self._save(fresh)
                increments.append(self._save(self.spark.table(whole).join(self.spark.table(new).select(*_HASHES), _HASHES, "left_anti")))
                levels[0].append(new)
            self._compact(levels)
            if len(increments) >= self.fanout:
                increments = [self._summed(increments)]
        except Exception:
            self._sweep()
            raise
        self.levels, self.increments, self.version = levels, increments, self.version + 1
        if self.manifest:
            state = json.dumps({"levels": levels, "increments": increments, "buckets": self.buckets})
            self.spark.createDataFrame([(self.version, state)], "version long, state string").coalesce(1).write.mode("append").saveAsTable(self.manifest)
        self._sweep()

    def _compact(self, levels: list[list[str]]) -> None:
        """Merge the runs of each level that is full into one of the next."""
        for k in range(len(levels)):
            if len(levels[k]) < self.fanout:
                continue
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append(self._save(self._union(levels[k]).repartition(self.buckets, *_HASHES)))
            levels[k] = []

    def _summed(self, increments: list[str]) -> str:
        """One table of increments: a key has a row for each of them at most."""
        return self._save(self._union(increments).repartition(self.buckets, *_HASHES).groupBy(*_HASHES).agg(F.sum("n").alias("n"), F.max("last").alias("last")))

    def _union(self, names: list[str]) -> DataFrame:
        """The rows of several tables, read as plain files of the places that the catalogue names: a union of bucketed scans may pass for bucketed and isn't."""
        places = [self.spark.sql(f"DESCRIBE TABLE EXTENDED {n}").where("col_name = 'Location'").first()["data_type"] for n in names]
        return self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*places)

    def frequent(self, min_docs: int) -> DataFrame:
        """h1, h2, last of the keys found in ``min_docs`` documents at least."""
        if not self.runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, last long")
        if not self.increments:
            return self._union(self.runs).where(F.col("n") >= min_docs).select(*_HASHES, "last")
        if len(self.increments) > 1:
            self.increments = [self._summed(self.increments)]
        more = self.spark.table(self.increments[0]).select(*_HASHES, F.col("n").alias("more"), F.col("last").alias("later"))
        out = []
        for name in self.runs:
            both = self.spark.table(name).join(more, _HASHES, "left")
            both = both.where(F.col("n") + F.coalesce("more", F.lit(0)) >= min_docs)
            out.append(both.select(*_HASHES, F.greatest("last", "later").alias("last")))
        return reduce(DataFrame.unionByName, out)

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        """The store and all its tables."""
        self.levels, self.increments = [[]], []
        self._sweep()
        if self.manifest:
            self._drop(self.manifest)


def dropped_keys(docs: DataFrame, text: str, key: str, min_length: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """doc_id, dropped: for each document that loses lines, the hashes of their keys, joined."""
    spark = docs.sparkSession
    ids = docs.select(F.col(key).cast("long").alias("doc_id"))
    own = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(batches)).cast("long")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), own.alias("batch"), F.col(text).alias("text"))
    lines = written(rows.mapInArrow(_line_rows(min_length), fields("h1 long, h2 long, doc_id long, batch long")), "batch")
    if not ids.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows that share an id are one document
        lines = written(lines.distinct(), "batch")
    with LineRuns(spark, fanout=fanout) as runs:
        for b in range(batches):
            runs.add(lines.where(F.col("batch") == b).select("h1", "h2", "doc_id"))
        with sorted_scans(spark):
            frequent = written(runs.frequent(min_docs))
    # A line that a third of all documents hold is dealt to SALTS tasks.
    salts = F.explode(F.array(*(F.lit(k) for k in range(SALTS))))
    salted = lines.select("h1", "h2", "doc_id", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)), F.lit(0)).cast("int").alias("salt"))
    # A merge join at every size: frequent keys grow with the corpus and are no side to broadcast.
    lost = salted.join(frequent.withColumn("salt", salts).hint("merge"), [*_HASHES, "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    whole = F.unhex(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")))
    return written(lost.select("doc_id", whole.alias("key")).groupBy("doc_id").agg(F.array_sort(F.collect_list("key")).alias("dropped")))


def _split(text: str | None, dropped, min_length: int) -> tuple[int, list[str]]:
    """Number of lines, lines that stay."""
    lines = (text or "").split("\n")
    if dropped is None or not len(dropped):
        return len(lines), lines
    gone = set(map(bytes, dropped))
    return len(lines), [x for x, h in zip(lines, key_hashes(text, min_length)) if h is None or h not in gone]


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3, digest: bool = False) -> DataFrame:
    """The rows of ``docs`` with their lines deduplicated: all columns, ``text`` replaced. With
    ``digest`` instead: doc_id, n_lines, n_dropped and the hash of the text that stays."""
    lost = dropped_keys(docs, text, key, min_length, min_docs, batches, fanout).select(F.col("doc_id").alias("__quillmill_id"), F.col("dropped").alias("__quillmill_dropped"))

    @F.pandas_udf(fields("n_lines long, n_dropped long, kept_sha256 string"))
    def summary(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, dropped in batches:
            rows = []
            for t, d in zip(texts, dropped):
                n, kept = _split(t, d, min_length)
                rows.append((n, n - len(kept), hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_sha256"])

    @F.pandas_udf("string")
    def stays(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, dropped in batches:
            yield pd.Series([t if d is None else "\n".join(_split(t, d, min_length)[1]) for t, d in zip(texts, dropped)], dtype=object)

    # A merge join at every size: what documents lose grows with them, so it is no side to broadcast.
    joined = (docs.select(key, text) if digest else docs).join(lost.hint("merge"), docs[key].cast("long").eqNullSafe(lost["__quillmill_id"]), "left").drop("__quillmill_id")
    if digest:
        s = summary(F.col(text), F.col("__quillmill_dropped"))
        return joined.select(F.col(key).alias("doc_id"), s.alias("s")).select("doc_id", "s.*")
    return joined.withColumn(text, stays(F.col(text), F.col("__quillmill_dropped"))).select(*docs.columns)
