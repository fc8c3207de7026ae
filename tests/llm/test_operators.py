"""Each operator against a brute-force version, and its edge cases."""

import hashlib
import json
import os
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import bagminhash as B
from quillmill.llm import jpegmedia as J
from quillmill.llm import langid as LI
from quillmill.llm import linededup as LD
from quillmill.llm import mixing as MX
from quillmill.llm import puquality as PU
from quillmill.llm import queries as Q
from quillmill.llm import repetition as RP
from quillmill.llm import sharding as SH
from quillmill.llm import toxicity as TX
from quillmill.llm.bpe import BoundaryBPE, bpe_decode, bpe_encode

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(5)
VOCABULARY = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(random.choices(VOCABULARY, k=n))


LONG = "\n".join(prose(12) for _ in range(400))
BASE_DOCS = [prose(40) for _ in range(12)]
EDGES = [None, "", " \n\t ", "one", "two words", "ÄÖ ñ 12 !!! 日本 Σς İ", LONG, "the " * 50, BASE_DOCS[0], BASE_DOCS[0], BASE_DOCS[0] + " tail"]


def documents(spark, texts, extra=True):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], -1, 7) for i, t in enumerate(texts)]
    rows += [(None, texts[-1], None, None, 0, 0), (0, texts[0], "en", "a", 0, 0)]
    # Columns that an operator may use itself.
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, score long")
    return df if extra else df.where("doc_id is not null").dropDuplicates(["doc_id"])


def small(spark, tmp_path, texts, quality=None):
    """A folder of tables as queries read them."""
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, (i + 1) % 2) for i in range(len(texts))] + [(0, 1, 0), (None, 1, 1), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


ALL = [q for q in Q.queries() if q != "pipeline"]


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    return small(spark, tmp_path_factory.mktemp("edges"), EDGES + BASE_DOCS)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    documents(spark, EDGES).limit(0).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ALL)
def test_one_row_a_document(spark, edge_dir, empty_dir, name):
    got = Q.queries()[name](spark, edge_dir)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got.select("doc_id").collect())
    want = sorted((r.doc_id is None, r.doc_id or 0) for r in spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id").collect())
    assert ids == want
    assert Q.queries()[name](spark, empty_dir).count() == 0


def test_pipeline_on_edges(spark, edge_dir, empty_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    assert P.run(spark, empty_dir).count() == 0
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, edge_dir).columns == docs.columns
    assert P.run(spark, edge_dir).where("decoded is null or ids is null").count() == 0


# --- 1 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    path = Q.vocabulary_path()
    with open(path, "rb") as f:
        return BoundaryBPE(f.read()), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(alphabet="abcXYZ éßΣς'sdll0123 \n!?…<|>") | st.sampled_from(["<|endoftext|>a", "x<|startoftext|><|endoftext|>", "I'LL they've"]))
def test_bpe_equals_the_library(bpe, text):
    own, library = bpe
    text = text.encode("utf-8", "ignore").decode()
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "the", "aé", "ab"])
def test_bpe_of_very_long_words(bpe, letters):
    word = "".join(random.choices(letters, k=20_000))
    began = time.time()
    ids = bpe[0].encode(word + " end")
    assert time.time() - began < 1 and ids == bpe[1].encode(word + " end", add_special_tokens=False).ids
    assert word not in bpe[0].words


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError):
        BoundaryBPE(json.dumps({"model": {"type": "BPE", "byte_fallback": True, "end_of_word_suffix": "</w>"}}).encode())


def test_bpe_digests(spark, edge_dir, bpe):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{edge_dir}/documents.parquet").collect()}
    for r in Q.op1_bpe(spark, edge_dir).collect():
        ids = bpe[1].encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bpe[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    path = Q.vocabulary_path()
    df = documents(spark, EDGES).select(bpe_encode(spark, path)("text").alias("ids"))
    assert df.select(bpe_decode(spark, path)("ids").alias("t")).where("t is null").count() == 0


# --- 2 -----------------------------------------------------------------------------------------


def test_language_on_held_out(spark):
    got = Q.op2_language_id(spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    right, n = got.where("held_out").join(truth, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 10 and right > 0.95
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_without_letters():
    model = LI.LanguageModel(["en"], np.ones(LI.DIMS), np.zeros((1, LI.DIMS)), 1.0)
    assert [model.predict(t) for t in (None, "", "12 !?", "a")] == [("und", 0.0)] * 3 + [("en", 1.0)]


def test_ftrl_equals_a_dense_version():
    """Coordinate by coordinate, by the published update rule."""
    rng, rows = np.random.default_rng(3), []
    for _ in range(40):
        where = np.sort(rng.choice(12, 4, replace=False))
        rows.append((where, rng.normal(size=4), int(rng.integers(3))))
    model = LI.FTRL(3, 12)
    z, n = [[0.0] * 12 for _ in range(3)], [[0.0] * 12 for _ in range(3)]

    def weight(c, k):
        if abs(z[c][k]) <= model.l1:
            return 0.0
        return -(z[c][k] - np.sign(z[c][k]) * model.l1) / ((model.beta + n[c][k] ** 0.5) / model.alpha + model.l2)

    for where, values, label in rows:
        model.learn(where, values, label)
        ws = [[weight(c, k) for k in where] for c in range(3)]
        e = np.exp([sum(w * v for w, v in zip(row, values)) for row in ws])
        for c in range(3):
            for k, v, w in zip(where, values, ws[c]):
                g = (e[c] / e.sum() - (c == label)) * v
                s = ((n[c][k] + g * g) ** 0.5 - n[c][k] ** 0.5) / model.alpha
                z[c][k] += g - s * w
                n[c][k] += g * g
    assert model.weights() == pytest.approx(np.array([[weight(c, k) for k in range(12)] for c in range(3)]))


def test_language_sample_is_bounded(spark):
    rows = spark.range(3000).selectExpr("id", "concat('l', id % 60) as lang", "'text' as text")
    got = LI.language_sample(rows, "text", "lang", "id", 700, 300, 600)
    assert got.select("label").distinct().count() >= 55 and 400 < got.count() < 800


def test_ftrl_learns_sparse_weights():
    rng = np.random.default_rng(0)
    model = LI.FTRL(2, 50)
    for _ in range(600):
        y = int(rng.integers(2))
        where = np.array([y, *rng.integers(2, 50, 5)])
        model.learn(where, np.ones(6), y)
    w = model.weights()
    assert w[0, 0] > w[1, 0] and w[1, 1] > w[0, 1]
    assert LI.best_temperature(np.array([[9.0, 9.0], [0.0, 0.0]]), np.array([0, 1])) > 1


# --- 3 -----------------------------------------------------------------------------------------


def brute_repetition(text):
    text = text or ""
    words = [(m.start(), m.end()) for m in WORDS.finditer(text)]
    ws = [text[a:b] for a, b in words]
    inside = {}
    for n in (*RP.LENGTHS,):
        grams = Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
        inside[n] = {i + k for i in range(len(ws) - n + 1) if grams[tuple(ws[i : i + n])] > 1 for k in range(n)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORDS.search(line)) and line in seen
        seen.add(line)
    chars = sum(map(len, ws))
    covered = {n: sum(len(ws[i]) for i in inside[n]) / max(1, chars) for n in inside}
    return len(ws), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside[5]), covered


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(["ab", "c", "#x|", "日", "\n", "\n\n", "ab\nc", "\x0b", "\x85"]), max_size=40).map(" ".join), min_size=1, max_size=5))
def test_repetition_equals_brute_force(texts):
    got = RP.measure(texts)
    for t, r in zip(texts, got.itertuples()):
        n, chars, symbols, dup, repeat, covered = brute_repetition(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        for k, share in covered.items():
            assert getattr(r, f"covered_{k}") == pytest.approx(share)
        assert not (r.kept and r.base_failed)


# --- 4 -----------------------------------------------------------------------------------------


def test_quality_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op4_quality(spark, d)
    truth = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = got.where("held_out").join(truth, "doc_id").select("score", "quality", "predicted").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_repeated_ids_keep_the_sample_bounded(spark):
    docs = spark.createDataFrame([(1, t) for t in ("b", "a", None, "c")] + [(2, None), (3, "x")], "doc_id long, text string")
    ids = spark.createDataFrame([(1, 0), (2, 1)], "key long, y int")
    assert sorted(map(tuple, PU.texts_of(docs, ids, "doc_id", "text").collect())) == [(1, 0, "a"), (2, 1, None)]


@pytest.mark.parametrize("seed", range(4))
def test_bag_equals_risk_of_known_classes(seed):
    """A brute-force check: with both classes known, the bag separates them whatever the split of the prior's estimate."""
    rng = np.random.default_rng(seed)
    positive = rng.normal(1.5, 1, (400, 4)).astype(np.float32)
    truth = rng.random(900) < 0.85
    mixed = np.where(truth[:, None], rng.normal(1.5, 1, (900, 4)), rng.normal(-2.5, 1, (900, 4))).astype(np.float32)
    w, prior = PU.fit_bag(positive, mixed, rng)
    score = PU._sigmoid(mixed @ w[:-1] + w[-1])
    assert abs(prior - 0.85) < 0.1
    assert ((score >= 0.3) == truth).mean() > 0.95


def test_prior_is_estimated():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, (2000, 3)).astype(np.float32)
    mixed = np.concatenate([rng.normal(2, 1, (1400, 3)), rng.normal(-3, 1, (600, 3))]).astype(np.float32)
    prior = PU.estimate_prior(positive, rng.permutation(mixed))
    assert abs(prior - 0.7) < 0.08
    w = PU.fit_nnpu(positive, mixed, prior)
    score = mixed @ w[:-1] + w[-1] > 0
    assert score[:1400].mean() > 0.97 and score[1400:].mean() < 0.03


# --- 5 -----------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 20)), min_size=1, max_size=6), st.integers(0, 80))
def test_sainte_lague_equals_brute_force(parties, seats):
    votes, most = [float(v) for v, _ in parties], [m for _, m in parties]
    held = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i, v in enumerate(votes) if v > 0 and held[i] < most[i]]
        if not open_:
            break
        best = max(open_, key=lambda i: (votes[i] / (2 * held[i] + 1), -i))
        held[best] += 1
    assert MX.sainte_lague(votes, seats, most) == held


def test_targets_share_the_excess():
    sizes = [10, 1000, 500]
    t = MX.source_targets(sizes, [5.0, 2.0, 1.0])
    assert t[0] == 30 and sum(t) == pytest.approx(sum(sizes)) and t[1] == pytest.approx(2 * t[2])
    assert MX.source_targets([0, 0], [5.0, 2.0]) == [0.0, 0.0] and MX.source_targets([], []) == []


def hashed(*values):
    """Spark's xxhash64 of texts (str), longs (int) and ints (float stands for them), as a signed number."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v) if isinstance(v, int) else struct.pack("<i", int(v))
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_mix(rows, block, shard_words, epochs=3, seed=17):
    """taken by place of the row, one document and one seat at a time. Rows of equal id and text are not told apart."""
    size = [len(WORDS.findall(t or "")) for _, t, _ in rows]
    names = [hashed("" if i is None else str(i), t or "") for i, t, _ in rows]
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    of = {s: [k for k, r in enumerate(rows) if r[2] == s] for s in order}
    sizes = [sum(size[k] for k in of[s]) for s in order]
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))]
    fixed = {}
    while True:
        left, scale = sum(sizes) - sum(fixed.values()), sum(w for i, w in enumerate(weights) if i not in fixed)
        over = [i for i, w in enumerate(weights) if i not in fixed and left * w / scale > epochs * sizes[i]]
        if not over:
            break
        fixed |= {i: float(epochs * sizes[i]) for i in over}
    targets = [fixed.get(i, left * w / scale if scale else 0.0) for i, w in enumerate(weights)]

    def seats(votes, n, most):
        held = [0] * len(votes)
        for _ in range(n):
            free = [i for i, v in enumerate(votes) if v > 0 and held[i] < most[i]]
            if free:
                held[max(free, key=lambda i: (votes[i] / (2 * held[i] + 1), -i))] += 1
        return held

    words = [min(epochs * n, int(t)) for t, n in zip(targets, sizes)]
    for i in sorted(range(len(words)), key=lambda i: (words[i] - targets[i], i))[: round(sum(targets)) - sum(words)]:
        words[i] += words[i] < epochs * sizes[i]
    taken = [0] * len(rows)
    for i, k in enumerate(seats(targets, sum(sizes) // block, [epochs * n // block for n in sizes])):
        parts = max(1, -(-(sizes[i] + len(of[order[i]])) // shard_words))
        shards = {}
        for d in of[order[i]]:
            shards.setdefault(hashed(names[d], 17.0) % parts, []).append(d)
        shards = {x: ds for x, ds in sorted(shards.items()) if sum(size[d] for d in ds)}
        full = [sum(size[d] for d in ds) for ds in shards.values()]
        quota = [n * block for n in seats([float(n) for n in full], k, [epochs * n // block for n in full])]
        left = words[i] - sum(quota)
        for x, n in enumerate(full):
            more = min(left, epochs * n - quota[x]) if left > 0 else -min(-left, quota[x])
            quota[x], left = quota[x] + more, left - more
        for (shard, ds), q, n in zip(shards.items(), quota, full):
            ds = sorted(ds, key=lambda d: (hashed(names[d], seed + 1.0), names[d], rows[d][0] is None, rows[d][0] or 0, size[d]))
            start, at = {}, 0
            for d in ds:
                start[d], at = at, at + size[d]
            extra = q % n
            for d in sorted(ds, key=lambda d: (hashed(start[d] // block, i, shard, seed + 2.0), start[d] // block, ds.index(d))):
                more = min(size[d], extra)
                taken[d], extra = q // n * size[d] + more, extra - more
    return taken


@pytest.mark.parametrize("block,shard_words", [(50, 400), (7, 100_000), (1000, 1_000_000)])
def test_mixture_equals_brute_force(spark, block, shard_words):
    docs = documents(spark, [*EDGES, *BASE_DOCS, *(prose(n) for n in range(3, 60, 4))])
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = sorted(zip(((i is None, i or 0, len(WORDS.findall(t or ""))) for i, t, _ in rows), brute_mix(rows, block, shard_words)))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.size), r.taken) for r in MX.mix(docs, block=block, shard_words=shard_words).collect())
    assert got == want
    other = {r.doc_id: r.taken for r in MX.mix(docs, block=block, shard_words=shard_words, seed=18).collect()}
    assert block > 50 or other != {r[0][1]: r[1] for r in got}


def test_mixture(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op5_mixing(spark, d).collect()
    again = {r.doc_id: r.taken for r in Q.op5_mixing(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {r.doc_id: r for r in docs.select("doc_id", "text", "source").collect()}
    by_source = Counter()
    for r in got:
        assert r.size == len(WORDS.findall(texts[r.doc_id].text or ""))
        assert 0 <= r.taken <= 3 * r.size and again[r.doc_id] == r.taken
        by_source[texts[r.doc_id].source, r.source_size, r.target] += r.taken
    for (_, _, target), taken in by_source.items():
        assert abs(taken - target) <= 1
    assert sum(t for _, _, t in by_source) == pytest.approx(sum(r.size for r in got))
    whole = Counter(r.text for r in texts.values())
    cut = [r for r in MX.mixed_documents(docs).collect() if r.text not in whole]
    assert len(cut) <= len(by_source)  # one a shard


def test_mixed_texts_hold_the_taken_words(spark):
    docs = documents(spark, EDGES + BASE_DOCS)
    taken = MX.mix(docs, block=4).agg(F.sum("taken")).first()[0]
    out = MX.mixed_documents(docs, block=4)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(len(WORDS.findall(r.text)) for r in rows) == taken
    texts = [r.text or "" for r in docs.collect()]
    assert all(any(t.startswith(r.text) for t in texts) for r in rows)


# --- 6 -----------------------------------------------------------------------------------------


def test_lookup_table_is_even_and_stable():
    shards = [f"s{i}" for i in range(10)]
    a, b = SH.lookup_table(shards, 1009), SH.lookup_table(shards[:-1], 1009)
    counts = np.bincount(a)
    assert counts.max() - counts.min() <= 1
    kept = a < 9
    assert (a[kept] == b[kept]).mean() > 0.75
    with pytest.raises(ValueError):
        SH.lookup_table(shards, 1000)


def test_placement(spark, tmp_path):
    owner = SH.lookup_table(Q.SHARDS)
    docs = documents(spark, EDGES).withColumn("slot", F.lit("mine")).withColumn("shard", F.lit("mine"))
    for r in SH.place(docs, "doc_id", Q.SHARDS, slot="at", shard="to").collect():
        slot = int(hashlib.md5(str("null" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % SH.TABLE_SIZE
        assert (r.at, r.to, r.slot) == (slot, Q.SHARDS[owner[slot]], "mine")
    SH.write_shards(documents(spark, EDGES), str(tmp_path / "out"), "doc_id", ["a", "b"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(EDGES) + 2


# --- 7 -----------------------------------------------------------------------------------------


def brute_lines(rows, min_docs=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    last = {k: max(-1 if i is None else i for i in ids) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout,batches", [(2, 5), (3, 1)])
def test_line_dedup_equals_brute_force(spark, fanout, batches):
    shared = ["Licence line that many documents hold, " + prose(6) for _ in range(6)] + ["short", "é" * 40]
    texts = []
    for i in range(40):
        lines = [prose(10), *random.sample(shared, 3), prose(3)]
        texts.append("\n".join(random.choice([x, f" {x.upper()}\t" if x.isascii() else x]) for x in lines))
    docs = documents(spark, [*EDGES, *texts])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = LD.dedup_lines(docs, fanout=fanout, batches=batches, digest=True).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_lines(rows)
    whole = LD.dedup_lines(docs, fanout=fanout, batches=batches)
    assert whole.columns == docs.columns and whole.count() == docs.count()


def test_runs_take_new_batches(spark):
    runs = LD.LineRuns(spark, buckets=2, fanout=2)
    frame = lambda rows: spark.createDataFrame(rows, "h1 long, h2 long, doc_id long")
    for b in range(5):
        runs.add(frame([(1, 1, b), (2, 2, 10 + b), (2, 2, 20 + b), (3 + b, 3, b)]))
    assert {(r.h1, r["last"]) for r in runs.frequent(5).collect()} == {(1, 4), (2, 24)}
    assert sum(spark.table(t).count() for t in runs.runs) == 7
    runs.drop()


def test_a_named_store_lasts(spark):
    frame = lambda rows: spark.createDataFrame(rows, "h1 long, h2 long, doc_id long")
    spark.sql("CREATE DATABASE IF NOT EXISTS elsewhere")
    first = LD.LineRuns(spark, buckets=2, fanout=2, name="lasting")
    try:
        first.add(frame([(1, 1, 1), (2, 2, 1)]))
        first._save(frame([(9, 9, 9)]))  # as a lost driver leaves it
        spark.sql("USE elsewhere")
        first.add(frame([(1, 1, 2), (3, 3, 2)]))
        spark.sql("USE default")
        again = LD.LineRuns(spark, name="lasting")
        assert (again.levels, again.increments, again.buckets) == (first.levels, first.increments, 2)
        with pytest.raises(Exception):
            again.add(frame([(1, 1, 3)]).withColumn("doc_id", F.raise_error(F.lit("lost")).cast("long")))
        again.fanout = 2
        again.add(frame([(1, 1, 3)]))
        assert len(again.increments) <= 2
        assert {(r.h1, r["last"]) for r in LD.LineRuns(spark, name="lasting").frequent(3).collect()} == {(1, 3)}
    finally:
        spark.sql("USE default")
        LD.LineRuns(spark, name="lasting").drop()
        spark.sql("DROP DATABASE elsewhere")
    assert not [t for t in spark.catalog.listTables() if "lasting" in t.name]


def test_line_dedup_in_another_database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS other")
    spark.sql("USE other")
    try:
        docs = spark.createDataFrame([(i, "a line that very many of the documents hold, word by word") for i in range(6)], "doc_id long, text string")
        assert sorted(map(tuple, LD.dedup_lines(docs).collect()))[:2] == [(0, ""), (1, "")]
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillmill_run")]
    finally:
        spark.sql("USE default")


def test_discard(spark):
    from quillmill.llm.common import discard, mark, written

    since, df = mark(), spark.range(3)
    one, two = written(df), written(df)
    discard(spark, since, keep_last=True)
    assert two.count() == 3
    with pytest.raises(Exception):
        one.count()
    discard(spark, since)


# --- 8 -----------------------------------------------------------------------------------------


def bag(text):
    ws = WORDS.findall((text or "").lower())
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)] if ws else [])


def brute_classes(texts, least=0.8):
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both / sum((bags[i] | bags[j]).values()) >= least:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("block", [3, 1000])
def test_near_duplicates_equal_brute_force(spark, block):
    texts = [*EDGES, *BASE_DOCS]
    for base in BASE_DOCS[:4]:
        chain = base.split()
        for _ in range(15):
            chain = list(chain)
            chain[random.randrange(len(chain))] = random.choice(VOCABULARY)
            texts.append(" ".join(chain))
    texts += ["tiny one", "Tiny ONE", "again " * 30, "again " * 31, "again " * 60]
    docs = documents(spark, texts, extra=False).select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in B.near_duplicates(docs, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    kept = {r.doc_id for r in B.without_near_duplicates(docs).collect()}
    assert kept == {c for c in got.values()}


def test_a_bucket_of_unlike_members(spark, monkeypatch):
    """A band without rows puts all members in one bucket; no two alike but a few: signatures alone meet, and no link is lost."""
    texts = [" ".join(f"{random.random():.9f}" for _ in range(12)) for _ in range(5000)]
    texts += [texts[i] + " tail" for i in (10, 20, 30)] + [texts[40] + " one", texts[40] + " two"]
    sent = []
    contents = B._Linker.contents
    monkeypatch.setattr(B._Linker, "contents", lambda self, bags: sent.append(bags.count()) or contents(self, bags))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in B.near_duplicates(docs, bands=1, rows=0).collect()}
    assert got == {i: i for i in range(5000)} | {5000: 10, 5001: 20, 5002: 30, 5003: 40, 5004: 40}
    assert sent[-1] <= 20


def test_signature_is_unbiased():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(120):
        keys = np.sort(rng.integers(0, 2**63, rng.integers(20, 200)).astype(np.uint64))
        wa = rng.integers(0, 12, len(keys))
        wb = np.maximum(0, wa + rng.integers(-4, 5, len(keys)))
        sig = [B.signatures(*B.counted(np.zeros(w.sum(), dtype=np.int64), np.repeat(keys, w)), 1)[0] for w in (wa, wb)]
        errors.append((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


@pytest.mark.parametrize("a,b", [(1, 7), (5, 9), (33, 63), (64, 65), (1000, 1300)])
def test_signature_of_one_shingle_of_two_counts(a, b):
    keys = np.random.default_rng(a).integers(0, 2**63, 400).astype(np.uint64)
    rows, ones = np.arange(400), np.ones(400, dtype=np.int64)
    x, y = (B.signatures(rows, keys, ones * n, 400) for n in (a, b))
    assert abs((x == y).mean() - a / b) < 0.015


# --- 9 -----------------------------------------------------------------------------------------


def slow_samples(stream):
    """Baseline decoder, a block and a bit at a time, with the inverse cosine transform."""
    at, tables, quant, restart, size, out = 2, {}, None, 0, None, []
    while True:
        kind, n = stream[at + 1], int.from_bytes(stream[at + 2 : at + 4], "big")
        body, at = stream[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            quant = list(body[1:65])
        elif kind == 0xC4:
            code, k, table = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code *= 2
            tables[body[0]] = table
        elif kind == 0xC0:
            size = int.from_bytes(body[3:5], "big") // 8, int.from_bytes(body[1:3], "big") // 8
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xDA:
            break
    for part in re.split(b"\xff[\xd0-\xd9]", stream[at:])[:-1]:
        bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff"))
        pos, last = 0, 0

        def symbol(table):
            nonlocal pos
            code = 0
            for length in range(1, 17):
                code = code * 2 + int(bits[pos])
                pos += 1
                if (length, code) in table:
                    return table[length, code]

        for _ in range(restart):
            s = symbol(tables[0])
            v = int(bits[pos : pos + s] or "0", 2)
            pos += s
            last += v if s == 0 or v >> (s - 1) else v - (1 << s) + 1
            assert symbol(tables[0x10]) == 0
            out.append(round(last * quant[0] / 8) + 128)  # a block with DC alone is flat
    assert len(out) == size[0] * size[1]
    return bytes(out)


@settings(max_examples=25, deadline=None)
@given(st.binary(min_size=1, max_size=900))
def test_media_round_trip(data):
    payload = np.frombuffer(data + b" " * (-len(data) % 192), dtype=np.uint8)
    stream = J.encode_many([payload])[0]
    width, height, image = J.thumbnails([stream])[0][0]
    assert (width, height) == (1536, len(payload) // 24) and image.tobytes() == payload.tobytes()
    assert slow_samples(stream) == payload.tobytes()


def test_media_of_a_very_long_text():
    n, payload = J.padded("z" * (192 * 8191 + 5))
    stream = J.encode_many([payload])[0]
    images = J.thumbnails([stream])[0]
    assert len(images) == 2 and b"".join(i.tobytes() for _, _, i in images) == payload.tobytes()


def colour_image(width, height, rng):
    """A colour JPEG (4:2:0) with AC coefficients and restart intervals, and the luminance DC values it holds."""
    dc, ac = J.canonical(J.DC_LENGTHS, J.DC_VALUES), J.canonical(bytes([0, 2, 2] + [0] * 13), bytes([0x00, 0x11, 0xF0, 0x23]))
    across, down, step = -(-width // 16), -(-height // 16), 3
    bits, scan, luma, last = "", b"", [], [0, 0, 0]

    def put(code, n, extra="", k=0):
        nonlocal bits
        bits += f"{code:0{n}b}" + extra

    def number(v, s):
        return f"{v if v > 0 else v + (1 << s) - 1:0{s}b}" if s else ""

    for m in range(across * down):
        for c, blocks in ((0, 4), (1, 1), (2, 1)):
            for _ in range(blocks):
                v = int(rng.integers(-60, 60))
                d, last[c] = v - last[c], v
                s = abs(d).bit_length()
                put(*dc[s], number(d, s))
                if rng.random() < 0.5:
                    put(*ac[0xF0])
                    put(*ac[0x23], number(int(rng.integers(4, 8)), 3))
                put(*ac[0x00])
                if c == 0:
                    luma.append(v)
        if (m + 1) % step == 0 or m + 1 == across * down:
            bits += "1" * (-len(bits) % 8)
            raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
            scan += raw + (bytes([0xFF, 0xD0 + (m // step) % 8]) if m + 1 < across * down else b"")
            bits, last = "", [0, 0, 0]
    head = b"\xff\xd8" + J._segment(0xE0, b"JFIF\0") + J._segment(0xDB, bytes([0] + [16] * 64))
    head += J._segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += J._segment(0xC4, bytes([0]) + J.DC_LENGTHS + J.DC_VALUES) + J._segment(0xC4, bytes([0x10, 0, 2, 2] + [0] * 13 + [0x00, 0x11, 0xF0, 0x23]))
    head += J._segment(0xDD, step.to_bytes(2, "big")) + J._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    grid = np.array(luma).reshape(down, across, 2, 2).transpose(0, 2, 1, 3).reshape(down * 2, across * 2)
    return head + scan + b"\xff\xd9", np.clip((grid * 16 + 4) // 8 + 128, 0, 255)[: -(-height // 8), : -(-width // 8)]


@pytest.mark.parametrize("width,height", [(16, 16), (50, 37), (100, 20)])
def test_colour_images(width, height):
    stream, want = colour_image(width, height, np.random.default_rng(width))
    w, h, image = J.thumbnails([stream])[0][0]
    assert (w, h) == (width, height) and (image == want).all()


@pytest.mark.parametrize("broken", [b"", b"x", b"\xff\xd8", b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00"])
def test_broken_images(broken):
    if broken:
        with pytest.raises(ValueError):
            J.thumbnails([broken])
    else:
        assert J.thumbnails([broken]) == [[]]


def test_media_digest(spark, edge_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{edge_dir}/documents.parquet").collect()}
    for r in Q.op9_media(spark, edge_dir).collect():
        n, payload = J.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload.tobytes()).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload.tobytes()[-16:])
    media = documents(spark, EDGES).select("text", J.to_media("text").alias("m"))
    back = media.select("text", J.from_media("m").alias("b")).collect()
    assert all(bytes(r.b) == J.padded(r.text)[1].tobytes() for r in back)


# --- 10 ----------------------------------------------------------------------------------------


def brute_kernel(a, b):
    def weights(s):
        out = Counter()
        for i in range(len(s)):
            for k in range(i + 2, min(len(s), i + TX.SPAN)):
                for j in range(i + 1, k):
                    out[s[i] + s[j] + s[k]] += TX.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(x[u] * y[u] for u in x) / TX._NORM[len(a)] / TX._NORM[len(b)]


def test_kernel_equals_brute_force():
    code = np.zeros(TX.CODES, dtype=np.int8)
    for i, c in enumerate("abcdefgh", 1):
        code[ord(c)] = i
    strings = ["abcdef", "aXbcd", "hgfe", "abcabcabc", "ab", "aabbcc"]
    plain = ["abcdef", "abcd", "hgfe", "abcabcabc", "ab", "aabbcc"]
    got = TX._kernel_rows(plain, code, TX._expanded(plain, code))
    want = [[brute_kernel(a, b) for b in plain] for a in plain]
    assert got == pytest.approx(np.array(want), rel=1e-4)
    assert len(strings) == len(plain)


def test_toxic_words_with_gaps():
    clean = [[w for w in prose(30).split() if len(w) > 2] for _ in range(300)]
    toxic = [random.sample(x, 5) + [random.choice(["villain", "scoundrel", "rascal"])] for x in clean[:120]]
    model = TX.fit_from_units(toxic, clean)
    high = model.score(["you vi-ll-ain", "a s c o u n d r e l here", "what a rascal", "RASCAL!", "ras.cal"])
    low = model.score([None, "", "12 3", prose(200), "ab cd"])
    assert (high >= 0.5).all() and (low < 0.5).all()
    assert (TX.fit_from_units([], clean).score(["villain"]) == 0).all()


def test_toxic_words_of_any_script():
    clean = [[w for w in prose(30).split() if len(w) > 2] for _ in range(300)]
    clean = [x + [random.choice(["добрый", "привет", "𐐨𐐩𐐪𐐫𐐬"])] for x in clean]
    toxic = [random.sample(x, 5) + random.sample(["негодяй", "подлец", "𐐭𐐮𐐯𐐰𐐱𐐲"], 2) for x in clean[:120]]
    model = TX.fit_from_units(toxic, clean)
    assert (model.score(["ты негод-яй", "п о д л е ц", "𐐭𐐮𐐯𐐰𐐱𐐲", "ПОДЛЕЦ"]) >= 0.5).all()
    assert (model.score(["добрый привет", "𐐨𐐩𐐪𐐫𐐬", prose(100)]) < 0.5).all()


def test_toxicity_on_held_out(spark):
    """Labels have noise: some toxic ones are on texts of symbols or one repeated word."""
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in Q.op10_toxicity(spark, d).where("held_out").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").distinct().collect()}
    toxic, clean = ([got[i].predicted for i, t in labels.items() if i in got and (t == 1) == y] for y in (True, False))
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.03


def test_guard():
    """The entry imports without the subpackage; the pipeline does not swallow errors."""
    import subprocess
    import sys

    code = "import sys; sys.modules['quillmill.llm'] = None; import __spark_entry__ as e; assert 'op1_bpe' not in e.queries() and e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
