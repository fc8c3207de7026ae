"""Lookup and search in a catalogue of personas, or of anything with a name, a text and a vector."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .compare import cosine


def shadowed(personas: DataFrame) -> DataFrame:
    """Of each name the row of the first tier; in a tier that of the first path. Columns name, tier_rank, path."""
    order = Window.partitionBy("name").orderBy("tier_rank", "path")
    return personas.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def merged(personas: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed rows (equal columns, and ``valid``) replace those of their name from an equal or later tier; invalid ones change nothing."""
    old = personas.withColumn("__new", F.lit(0))
    new = changed.where("valid").drop("valid").withColumn("__new", F.lit(1))
    order = Window.partitionBy("name").orderBy("tier_rank", F.desc("__new"), "path")
    return old.unionByName(new).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__new")


def removed(personas: DataFrame, deleted: DataFrame) -> DataFrame:
    """Without the rows of a deleted file's name and tier (columns name, tier_rank)."""
    return personas.join(deleted.select("name", "tier_rank"), ["name", "tier_rank"], "left_anti")


def with_tags(personas: DataFrame, tags: list[str]) -> DataFrame:
    """Rows that have all the tags, whatever their case."""
    wanted = F.array(*(F.lit(t.lower()) for t in tags)) if tags else F.expr("cast(array() as array<string>)")
    return personas.where(F.size(F.array_except(wanted, F.transform("tags", F.lower))) == 0)


def substring_search(personas: DataFrame, wanted: str, limit: int = 10) -> DataFrame:
    """1 for an equal name, 0.5 for a name or description that holds the text; best first, in catalogue order."""
    q = F.lit(wanted.lower())
    name, text = F.lower("name"), F.lower(F.coalesce("description", F.lit("")))
    score = F.when(name == q, 1.0).when(F.contains(name, q) | F.contains(text, q), 0.5)
    return personas.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "tier_rank", "path").limit(limit)


def semantic_search(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows of the highest cosine similarity: one pass, and a top-k on each partition before the merge."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, cosine(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)
