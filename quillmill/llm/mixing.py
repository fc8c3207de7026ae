"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Targets. Sources, in order of code points with null last, weigh 5, 2, 1, repeating, and share
   the words of all documents; a target stops at ``epochs`` times its source's size and the
   excess is shared anew by weight until none is above.
2. Quotas. The words are counted in blocks of ``block`` words. The blocks go to the sources by the
   highest quotients target / (2k + 1), and those of a source to its shards by the highest
   quotients of the shards' sizes, so that each shard has an integer quota. What a source's target
   is above or below its blocks goes to its shards' last blocks, so that targets are met to a word.
3. Selection. A source's documents are dealt to shards by a hash of id and text. In a shard they
   stand in the order of a seeded hash, and a block is a run of whole documents: those that start
   within the same ``block`` words. A quota takes all blocks as often as it holds the whole shard;
   the rest of it is filled with blocks in the order of a second, keyed hash of their numbers (a
   permutation, as equal hashes are told apart by number). Only the document at which a shard's
   quota is full is cut, so texts stay whole but for one a shard.

Scale. Ids and sizes are shuffled once; both orders are windows over the same shards, of
``shard_words`` words or more, and the words of a hot source lie in many of them. Only totals of
sources and shards reach the driver: ``max_sources`` and ``max_shards`` rows at most. Highest
quotients are found by bisection for the divisor, not one by one, so their number may be in the billions.

Cases: null and empty texts have size 0, take nothing and stay in the result. Null sources form
one source, the last. Repeated rows are documents of their own; those of equal id and text may
change places. With no words at all targets are 0. Sources above ``max_sources`` raise an error,
since a mixture is given by source.
"""

import heapq
import math
import re
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, rows_with_ids, written

WEIGHTS = (5, 2, 1)
#: Words of a block.
BLOCK = 1000


def source_targets(sizes: list[int], weights: list[float], epochs: int = 3) -> list[float]:
    """The words to take of each source; their sum is that of the sizes."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in set(open_))
        scale = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / scale > epochs * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / scale
            break
        for i in over:
            out[i] = float(epochs * sizes[i])
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1), k being the seats held; of equal quotients
    the first party's goes first. ``most``: the most seats a party can hold."""
    most = most or [seats] * len(votes)
    seats = min(seats, sum(m for v, m in zip(votes, most) if v > 0))
    if seats <= 0:
        return [0] * len(votes)

    def held(divisor: float) -> list[int]:
        # A party has a seat for each odd number 2k + 1 up to votes / divisor.
        return [min(m, math.floor((v / divisor + 1) / 2)) if v > 0 else 0 for v, m in zip(votes, most)]

    low, high = min(v for v in votes if v > 0) / (2.0 * seats + 2), 2 * max(votes)
    for _ in range(200):
        middle = math.sqrt(low * high)
        if sum(held(middle)) > seats:
            low = middle
        else:
            high = middle
        if high / low < 1 + 1e-15:
            break
    out = held(high)
    queue = [(-v / (2 * k + 1), i) for i, (v, k, m) in enumerate(zip(votes, out, most)) if v > 0 and k < m]
    heapq.heapify(queue)
    while sum(out) < seats and queue:
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * out[i] + 1), i))
    return out


def whole_words(targets: list[float], most: list[int]) -> list[int]:
    """The targets as integers of the same sum: each rounded down, and one more for those of the largest remainders."""
    out = [min(m, math.floor(t)) for t, m in zip(targets, most)]
    left = round(sum(targets)) - sum(out)
    for i in sorted(range(len(out)), key=lambda i: (out[i] - targets[i], i))[: max(0, left)]:
        out[i] += out[i] < most[i]
    return out


def shard_quotas(words: int, blocks: int, sizes: list[int], block: int, epochs: int) -> list[int]:
    """The words that each shard of a source gives: its blocks by highest quotients, and the remainder in the first shards that have room for it."""
    out = [k * block for k in sainte_lague([float(n) for n in sizes], blocks, [epochs * n // block for n in sizes])]
    left = words - sum(out)
    for i, n in enumerate(sizes):
        more = min(left, epochs * n - out[i]) if left > 0 else -min(-left, out[i])
        out[i], left = out[i] + more, left - more
    return out


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block: int = BLOCK, epochs: int = 3, shard_words: int = 1_000_000, max_shards: int = 8192, max_sources: int = 100_000, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry``, size, source_size, target, taken, passes (how often the whole text is taken) and rest (words of its beginning that are taken once more) for each row of ``docs``."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    rows = written(docs.select(F.col(key).alias("doc_id"), *carry, F.col(source).cast("string").alias("source"), size.alias("size"), name.alias("name")))
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be", "surrogatepass")))
    sizes = [r["size"] for r in totals]
    targets = source_targets(sizes, [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(sizes))], epochs)
    unit = max(shard_words, -(-sum(r["size"] + r["docs"] for r in totals) // max_shards))
    parts = [max(1, -(-(r["size"] + r["docs"]) // unit)) for r in totals]
    sources = spark.createDataFrame(
        [(r["source"], i, r["size"], t, n) for i, (r, t, n) in enumerate(zip(totals, targets, parts))],
        "source string, place long, source_size long, target double, parts long",
    )
    dealt = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["source"])).drop("source")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("name", F.lit(seed)), "parts"))
    shards = sorted(dealt.groupBy("place", "shard").agg(F.sum("size").alias("size")).collect())  # max_shards + max_sources rows at most

    by_source: dict[int, list[tuple[int, int]]] = {}
    for r in shards:
        if r["size"]:
            by_source.setdefault(r["place"], []).append((r["shard"], r["size"]))
    words = whole_words(targets, [epochs * n for n in sizes])
    plan = []
    for i, k in enumerate(sainte_lague(targets, sum(sizes) // block, [epochs * n // block for n in sizes])):
        own = by_source.get(i, [])
        for (shard, n), quota in zip(own, shard_quotas(words[i], k, [n for _, n in own], block, epochs)):
            plan.append((i, shard, quota // n, quota % n))
    quotas = spark.createDataFrame(plan, "place long, shard long, whole long, extra long")

    stand = [F.xxhash64("name", F.lit(seed + 1)), F.col("name"), F.col("doc_id").asc_nulls_last(), F.col("size"), *(F.col(c).asc_nulls_last() for c in carry)]
    shard = Window.partitionBy("place", "shard")
    before = lambda *order: F.sum("size").over(shard.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.withColumn("block", F.floor(before(*stand) / block)).withColumn("turn", F.xxhash64("block", "place", "shard", F.lit(seed + 2)))
    placed = placed.withColumn("since", before("turn", "block", *stand)).join(F.broadcast(quotas), ["place", "shard"], "left")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("since"))).cast("long")
    some = F.col("size") > 0
    placed = placed.withColumns({"passes": F.when(some, F.coalesce("whole", F.lit(0))).otherwise(0).cast("long"), "rest": F.when(some, F.coalesce(rest, F.lit(0))).otherwise(0).cast("long")})
    return placed.select("doc_id", *carry, "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("rest")).alias("taken"), "passes", "rest")


def first_words(text: str, n: int, word=re.compile(WORD)) -> str:
    """The text up to the end of its ``n``-th word."""
    end = 0
    for k, m in enumerate(word.finditer(text), 1):
        if k > n:
            break
        end = m.end()
    return text[:end]


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The mixture itself: rows of ``docs``, all columns, once for each pass in which the mix takes them; ``text`` is whole but for the one document a shard that is cut."""
    rows, row = rows_with_ids(docs, key)
    plan = mix(rows, text, source, row, **how).where("taken > 0").select(F.col("doc_id").alias("__quillmill_id"), F.col("passes").alias("__quillmill_passes"), F.col("rest").alias("__quillmill_rest"), (F.col("rest") == F.col("size")).alias("__quillmill_all"))
    met = rows.join(plan, rows[row] == plan["__quillmill_id"])

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, ns in batches:
            yield pd.Series([None if t is None else first_words(t, int(n)) for t, n in zip(texts, ns)], dtype=object)

    partly = (F.col("__quillmill_rest") > 0) & ~F.col("__quillmill_all")
    # Only texts that are cut go to a Python worker.
    met = met.withColumn("__quillmill_cut", cut(F.when(partly, F.col(text)), F.col("__quillmill_rest")))
    times = (F.col("__quillmill_passes") + F.when(F.col("__quillmill_all"), 1).otherwise(0)).cast("int")
    copies = F.concat(F.array_repeat(F.col(text), times), F.array_repeat(F.col("__quillmill_cut"), F.when(partly, 1).otherwise(0)))
    out = met.withColumn("__quillmill_text", F.explode_outer(copies))
    return out.select(*[F.col("__quillmill_text").alias(c) if c == text else rows[c] for c in docs.columns])
