"""Near-duplicate detection by BagMinHash signatures of word shingles.

A document is the multiset of its shingles of five words (of all its words, if it has fewer).
Weights are counts, discretised at the integers: a shingle of count w takes part in the Poisson
processes of the weight ranges [0, 1), [1, 2), [2, 4), ... up to w. The process of a shingle and a
range is the same in every document and has a rate of the range's width. It is a hierarchy: at
each point a process splits into those of the two halves of its range, a fair coin says which half
has the point, halves from w on are dropped, and a point counts when its range is one unit wide.
It then falls on a random slot of the signature. A slot keeps its earliest point. Points come in
order of time, so a process stops once it is past the slowest slot. Two slots agree with a
probability of the weighted Jaccard similarity, so the share of agreeing slots estimates it without bias.

Documents of equal multisets are first folded into one class. Bands of signature rows give the
candidates; their estimate, then the exact multiset overlap, decides. In each band each class is
compared with the least class of its bucket, and links are joined to components. Then, in buckets
whose other members are still in several components, signatures of different components are
compared block by block; members that have a likely partner there, and only those, are compared
again with their contents, until components have met or all their candidates are tried, so that no
candidate link between components is lost. Components are found on the cluster, by taking turns of
linking to the least neighbour.

Skew: copies fold by partial aggregation; the first comparison is linear in a bucket, and the rows
of a bucket and of its star are dealt to ``SALTS`` parts. The second sees only what is left, in
blocks of ``block`` members: of m such members each signature (256 bytes) goes to m / ``block``
blocks, and contents only where signatures agree. A block returns its spanning links. Nothing of
all documents reaches the driver.

Cases: null texts and texts without words are in a class of their own. Documents with a null id
link to nothing and have a null class. Rows that share an id each have a result row, with the class
of their own text. Whole texts are used.
"""

import hashlib
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fields, rows_with_ids, written
from .wordtable import WordTable, mixed, rolled

SHINGLE, SIMILARITY = 5, 0.8
#: Signature slots; bands x rows of them are used for candidates: a pair of similarity 0.8 is missed by all bands with a probability of 5e-5.
SLOTS, BANDS, ROWS = 128, 25, 5
#: Least share of agreeing slots for a closer look: 4.2 standard deviations below 0.8.
ESTIMATE = 0.65
_STEP, _LOW, _HIGH = np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
#: Parts that the rows of one star, or of one bucket, are dealt to in joins.
SALTS = 16


def shingles(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit hash of each shingle occurrence, in order of text. Words are lower-cased."""
    table = WordTable([t.lower() if t else t for t in texts])
    doc, grams = table.doc, None
    per = np.bincount(doc, minlength=table.rows)
    short_docs, short_keys = [], []
    for k in range(1, n + 1):
        if len(doc) < k:
            break
        grams = rolled(table.hashes, grams, k)
        if k < n:  # texts of k words: one shingle
            firsts = np.cumsum(per) - per
            which = np.flatnonzero(per == k)
            short_docs.append(which)
            short_keys.append(mixed(grams[firsts[which]] + np.uint64(k)))
        else:
            inside = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
            short_docs.append(doc[inside])
            short_keys.append(mixed(grams[inside] + np.uint64(n)))
    if not short_docs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    docs, keys = np.concatenate(short_docs), np.concatenate(short_keys)
    order = np.lexsort((keys, docs))
    return docs[order], keys[order]


def counted(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text and their counts, from sorted occurrences."""
    if not len(docs):
        return docs, keys, np.zeros(0, dtype=np.int64)
    new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])]))
    return docs[new], keys[new], np.diff(new, append=len(docs))


def signatures(docs: np.ndarray, keys: np.ndarray, counts: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """A row of 16-bit slot values for each text; texts without shingles have zeros.

    A process has a range of weights (``width``, of which the count covers ``room``), the time it has
    come to, and, if it came from a split, whether there is a point at that time (``due``)."""
    levels = np.maximum(0, np.ceil(np.log2(counts)).astype(np.int64)) if len(counts) else counts
    parts = [(np.arange(len(docs)), np.zeros(len(docs), dtype=np.int64))]
    for level in range(1, int(levels.max(initial=0)) + 1):
        which = np.flatnonzero(levels >= level)
        parts.append((which, np.full(len(which), level)))
    of, level = (np.concatenate(x) for x in zip(*parts))
    doc, width = docs[of], np.left_shift(1, np.maximum(level - 1, 0))
    room = counts[of] - np.where(level > 0, width, 0)
    state = mixed(keys[of] + level.astype(np.uint64) * _STEP)
    time, due = np.zeros(len(of)), np.zeros(len(of), dtype=bool)
    best = np.full(rows * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    slowest = np.full(rows, np.inf)
    while len(doc):
        state = np.where(due, state, mixed(state + _STEP))
        uniform = ((state >> np.uint64(40)).astype(np.float64) + 0.5) / (1 << 24)
        time = np.where(due, time, time - np.log(uniform) / width)
        alive = time < slowest[doc]
        doc, width, room, state, time = doc[alive], width[alive], room[alive], state[alive], time[alive]
        other = mixed(state ^ _STEP)
        single = width == 1
        # Earliest point: time in the high half (the bits of a positive float grow with it), identity in the low half.
        value = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (other & np.uint64(0xFFFFFFFF))
        place = doc * slots + ((state & np.uint64(0xFFFFFF)) * np.uint64(slots) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(best, place[single], value[single])
        late = (best.reshape(rows, slots) >> np.uint64(32)).max(axis=1).astype(np.uint32)
        slowest = np.where(late == 0xFFFFFFFF, np.inf, late.view(np.float32).astype(np.float64))
        due = np.zeros(len(doc), dtype=bool)
        if single.all():
            continue
        # Every wider process splits at its point, whatever the count, so that all texts see the same
        # points: the half that holds the point has it due, and halves that no count reaches go.
        wide = np.flatnonzero(~single)
        half, upper = width[wide] >> 1, (other[wide] >> np.uint64(63)).astype(bool)
        low, high = mixed(state[wide] ^ _LOW), mixed(state[wide] ^ _HIGH)
        reached = room[wide] > half
        up = wide[reached]
        doc = np.concatenate([doc[single], doc[wide], doc[up]])
        width = np.concatenate([width[single], half, half[reached]])
        room = np.concatenate([room[single], room[wide], room[up] - half[reached]])
        time = np.concatenate([time[single], time[wide], time[up]])
        due = np.concatenate([due[single], ~upper, upper[reached]])
        state = np.concatenate([state[single], low, high[reached]])
    out = (mixed(best & np.uint64(0xFFFFFFFF)) >> np.uint64(48)).astype("<u2").reshape(rows, slots)
    out[np.bincount(docs, minlength=rows) == 0] = 0
    return out


def bag_digests(docs: np.ndarray, keys: np.ndarray, rows: int) -> list[bytes | None]:
    """16 bytes that equal multisets share; None without shingles."""
    sums = []
    for salt in (1, 2):
        values = mixed(keys ^ mixed(np.full(1, salt, dtype=np.uint64)))
        sums.append(np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)]))
    n = np.bincount(docs, minlength=rows)
    ends = np.cumsum(n)
    first, second = (s[ends] - s[ends - n] for s in sums)
    return [None if not k else hashlib.blake2b(b"%d,%d,%d" % (k, a, b), digest_size=16).digest() for k, a, b in zip(n.tolist(), first.tolist(), second.tolist())]


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket for each text and band."""
    key = np.repeat(mixed(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(signature), axis=0)
    used = signature[:, : bands * rows].astype(np.uint64).reshape(len(signature), bands, rows)
    for r in range(rows):
        key = mixed(key * _STEP + used[:, :, r])
    return key.astype(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in chunks(texts):
            docs, keys = shingles(texts[a:b])
            sigs = signatures(*counted(docs, keys), b - a)
            bags = bag_digests(docs, keys, b - a)
            columns = [batch.column("doc_id").slice(a, b - a), pa.array(bags, pa.binary()), pa.array([None if g is None else s.tobytes() for g, s in zip(bags, sigs)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "bag", "sig"])


def _bands(bands: int, rows: int):
    @F.pandas_udf("array<bigint>")
    def keys(sigs: pd.Series) -> pd.Series:
        return pd.Series(list(band_keys(np.frombuffer(b"".join(sigs), dtype="<u2").reshape(-1, SLOTS), bands, rows))) if len(sigs) else pd.Series([], dtype=object)

    return keys


def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), dtype="<u2").reshape(-1, SLOTS) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def overlap(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets: sorted values and their counts."""
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int(np.minimum(nx[at], ny)[x[at] == y].sum())
    return both / (int(nx.sum()) + int(ny.sum()) - both)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets given as sorted values with repeats."""
    return overlap(*np.unique(a, return_counts=True), *np.unique(b, return_counts=True))


def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")) for x, y in zip(a, b)], dtype=float)


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = list(batch["text"])
        for a, b in chunks(texts):
            docs, keys = shingles(texts[a:b])
            ends = np.searchsorted(docs, np.arange(b - a), side="right")
            starts = np.searchsorted(docs, np.arange(b - a))
            yield pd.DataFrame({"bag": bag_digests(docs, keys, b - a), "content": [keys[i:j].astype("<u8").tobytes() for i, j in zip(starts, ends)]}).dropna()


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of the component of each linked node. ``links``: columns a, b.

    Large-star and small-star steps in turn: each node's greater neighbours, then its lesser ones,
    link to its least neighbour; after few rounds every component is a star around its least node."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:  # ends: each round links nodes to lesser ones or changes nothing
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        new = written(small)
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class _Linker:
    """Candidate pairs of classes to verified links."""

    def __init__(self, docs: DataFrame, text: str, key: str, classes: DataFrame, estimate: float, least: float):
        self.docs, self.text, self.key, self.classes, self.estimate, self.least = docs, text, key, classes, estimate, least

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose signatures agree often enough."""
        agreement = F.pandas_udf(_agreement, "double")
        return self._met(pairs, self.classes.select("bag", F.col("sig").alias("value"))).where(agreement("va", "vb") >= self.estimate).select("a", "b")

    def _met(self, pairs: DataFrame, values: DataFrame) -> DataFrame:
        """Pairs with the values (columns bag, value) of both. Many pairs may share their star b, so its value is first put to each part of its pairs."""
        pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
        stars = pairs.select("b", "salt").distinct().join(values.select(F.col("bag").alias("b"), F.col("value").alias("vb")), "b")
        return pairs.join(values.select(F.col("bag").alias("a"), F.col("value").alias("va")), "a").join(stars, ["b", "salt"])

    def contents(self, bags: DataFrame) -> DataFrame:
        """bag, content (all shingle hashes, sorted) of the given classes, from the text of one document each."""
        wanted = written(self.classes.join(bags, "bag").select("doc_id"))
        if wanted.count() <= 1_000_000:  # 8 MB of ids can be broadcast; more are met by a shuffle
            wanted = F.broadcast(wanted)
        rows = self.docs.select(F.col(self.key).cast("long").alias("doc_id"), F.col(self.text).alias("text")).join(wanted, "doc_id", "left_semi")
        return written(rows.select("text").mapInPandas(_contents, fields("bag binary, content binary")).dropDuplicates(["bag"]))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose multisets overlap enough."""
        pairs = written(pairs)
        contents = self.contents(pairs.select(F.col("a").alias("bag")).union(pairs.select("b")).distinct())
        share = F.pandas_udf(_overlap, "double")
        met = self._met(pairs, contents.select("bag", F.col("content").alias("value")))
        return written(met.where(share("va", "vb") >= self.least).select("a", "b"))


class _Block:
    """One pair of blocks (x, y) of a bucket: which members are to be compared there."""

    def __init__(self, group: pd.DataFrame, bands: int, rows: int):
        self.sig = np.frombuffer(b"".join(group["sig"]), dtype="<u2").reshape(-1, SLOTS)
        self.start, self.side = pd.factorize(group["root"].map(bytes))[0], group["side"].to_numpy()
        self.own = bool((group["x"] == group["y"]).all())
        self.keys = band_keys(self.sig, bands, rows)
        self.band = int(np.flatnonzero(self.keys[0] == group["bucket"].iloc[0])[0])

    def partners(self, estimate: float) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with those of other components that agree often enough, the likeliest first. A pair
        that shares several buckets is compared in that of the first shared band alone; if one of the
        two is that bucket's star, they have been compared before."""
        for i in range(len(self.sig)) if self.own else np.flatnonzero(self.side == 0):
            others = np.arange(i + 1, len(self.sig)) if self.own else np.flatnonzero(self.side == 1)
            others = others[self.start[others] != self.start[i]]
            others = others[~(self.keys[others, : self.band] == self.keys[i, : self.band]).any(axis=1)]
            agreement = (self.sig[others] == self.sig[i]).mean(axis=1)
            order = np.argsort(-agreement, kind="stable")
            yield i, others[order[agreement[order] >= estimate]]


def _likely_apart(group: pd.DataFrame, estimate: float, bands: int, rows: int) -> pd.DataFrame:
    """The members of one block that have a likely partner of another component there."""
    likely = np.zeros(len(group), dtype=bool)
    for i, others in _Block(group, bands, rows).partners(estimate):
        likely[others] = True
        likely[i] |= len(others) > 0
    return pd.DataFrame({"bucket": group["bucket"][likely], "bag": group["bag"][likely]})


def _links_apart(group: pd.DataFrame, estimate: float, least: float, bands: int, rows: int) -> pd.DataFrame:
    """Links between different components in one block: likely pairs are verified, unless their
    components have met meanwhile. So a block returns fewer links than it has members, and none is lost."""
    block = _Block(group, bands, rows)
    bag = [bytes(x) for x in group["bag"]]
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    parent = list(range(int(block.start.max()) + 1))

    def bag_of(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in held:
            held[i] = np.unique(np.frombuffer(group["content"].iloc[i], dtype="<u8"), return_counts=True)
        return held[i]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, others in block.partners(estimate):
        for j in others:
            a, b = find(block.start[i]), find(block.start[j])
            if a != b and overlap(*bag_of(i), *bag_of(j)) >= least:
                parent[a] = b
                out.append((bag[i], bag[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _in_blocks(rest: DataFrame, block: int, *values: str) -> DataFrame:
    """Rows of bucket, bag, root and ``values`` in each pair of blocks (x, y) of their bucket, of about ``block`` members each."""
    parts = rest.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    dealt = _salted(rest, parts).withColumn("own", F.pmod(F.xxhash64("bag", F.lit(5)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return dealt.select(
        "bucket", "bag", "root", *values, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side")
    )


def _salted(rows: DataFrame, of_bucket: DataFrame) -> DataFrame:
    """``rows`` (with bag and bucket) joined with one row a bucket; a bucket's rows are dealt to ``SALTS`` tasks."""
    salts = F.explode(F.array(*(F.lit(k) for k in range(SALTS))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("bag"), F.lit(SALTS)).cast("int")).join(of_bucket.withColumn("salt", salts), ["bucket", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY, estimate: float = ESTIMATE, block: int = 1000, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id for each row of ``docs``; class_id is the least id of the component."""
    described = written(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_describe, fields("doc_id long, bag binary, sig binary")))
    known = described.where("doc_id is not null and bag is not null")
    classes = written(known.groupBy("bag").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")))
    banded = written(classes.select("bag", F.explode(_bands(bands, rows)("sig")).alias("bucket")))
    shared = banded.groupBy("bucket").agg(F.min("bag").alias("star"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(_salted(banded, shared))
    linker = _Linker(docs, text, key, classes, estimate, least)
    links = linker.verified(linker.likely(members.where("bag <> star").select(F.col("bag").alias("a"), F.col("star").alias("b")).distinct()))
    roots = written(components(links))

    # What the first comparison leaves open: buckets with members, besides the star, in several components.
    rest = members.where("bag <> star and n > 2").select("bucket", "bag").join(roots.withColumnRenamed("node", "bag"), "bag", "left").withColumn("root", F.coalesce("root", "bag"))
    rest = written(rest)
    mixed_up = rest.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    rest = written(_salted(rest, mixed_up).join(classes.select("bag", "sig"), "bag"))
    if not rest.isEmpty():
        likely = written(_in_blocks(rest, block, "sig").groupBy("bucket", "x", "y").applyInPandas(lambda g: _likely_apart(g, estimate, bands, rows), fields("bucket long, bag binary")).distinct())
        rest = rest.join(likely, ["bucket", "bag"], "left_semi").join(linker.contents(likely.select("bag").distinct()), "bag")
        more = written(_in_blocks(rest, block, "sig", "content").groupBy("bucket", "x", "y").applyInPandas(lambda g: _links_apart(g, estimate, least, bands, rows), fields("a binary, b binary")))
        if not more.isEmpty():
            roots = written(components(links.unionByName(more)))

    of_class = classes.select("bag", "doc_id").join(roots.withColumnRenamed("node", "bag"), "bag", "left").withColumn("root", F.coalesce("root", "bag"))
    ids = of_class.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    found = of_class.join(ids, "root").select("bag", "class_id")
    out = described.select("doc_id", "bag").join(found, "bag", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def without_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays for each class (that of the least id; null ids come last). Rows that share an id, or have none, are compared like others."""
    rows, row = rows_with_ids(docs, key)
    classes = near_duplicates(rows, text, row, **how)
    if row == key:
        kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias("__quillmill_kept"))
        return docs.join(kept, F.col(key) == F.col("__quillmill_kept"), "left_semi")
    ids = rows.select(F.col(row).alias("doc_id"), F.col(key).isNull().alias("last"), F.col(key).alias("id"))
    best = classes.join(ids, "doc_id").groupBy("class_id").agg(F.min(F.struct("last", "id", "doc_id")).alias("best"))
    return rows.join(best.select(F.col("best.doc_id").alias(row)), row, "left_semi").select(*docs.columns)
