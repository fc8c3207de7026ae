"""Queries over whole tables against brute-force versions in Python."""

import os
import re
import unicodedata
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.functions.sentiment import sentiment
from quillmill.operators import rules as R
from quillmill.plans import more_queries as MQ
from quillmill.plans import registry

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def brute_repetition(text, wanted=()):
    seen, out = defaultdict(list), []
    for m in re.finditer(r"\b\w+\b", text):
        word = m.group().lower()
        seen[word].append(m.start())
        if len(seen[word]) > 1 and (not wanted or word in wanted):
            start = seen[word][1]
            out.append((word, text[:start].count("\n") + 1, start - text.rfind("\n", 0, start), None))
    return out


@pytest.mark.parametrize("wanted", [[], ["the", "B"], ["none"]])
def test_repetition_by_brute_force(spark, wanted):
    texts = ["", "one", "The the\nend the b a\nB b a", "é É x\n\n éa é", "a b " * 300 + "\nc a the"]
    rule = {"type": "repetition", "tokens": wanted}
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.compile_rule(rule, F.col("t")).alias("m")).collect()
    assert {r.i: [tuple(m) for m in r.m] for r in got} == {i: brute_repetition(t, [w.lower() for w in wanted]) for i, t in enumerate(texts)}


@tables
def test_rule_repetition(spark):
    docs = documents(spark)
    got = {r.doc_id: r.n_matches for r in registry.queries()["rule_repetition"](spark, DATA).collect()}
    assert any(len(d.text or "") >= 3000 for d in docs.values())
    assert got == {i: len(brute_repetition(d.text or "", ["the", "of"])) for i, d in docs.items()}


def test_every_language(spark, tmp_path):
    texts = {1: ("en", "The end of the nation."), 2: ("fr", "éthe the, thé the\nOf the"), 3: (None, "the_ the-the annulation"), 4: ("de", "and übthat that"), 5: ("es", "")}
    spark.createDataFrame([(i, t, lang, "s") for i, (lang, t) in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    count = lambda t, *ps: sum(len(re.findall(p, t, re.I)) for p in ps)
    for name, patterns in {"rule_existence": (r"\bthe\b", r"\bof the\b", "an[a-z]+ion"), "rule_substitution": (r"\band\b", r"\bthat\b")}.items():
        got = {r.doc_id: r.n_matches for r in registry.queries()[name](spark, str(tmp_path)).collect()}
        assert got == {i: count(t, *patterns) for i, (_, t) in texts.items()}


@tables
@pytest.mark.parametrize("name", ["rule_metric", "tone_dimensions", "top_suggestions", "hedge_counts"])
def test_whole_reads_every_document(spark, name):
    got = {r.doc_id for r in registry.queries()[name](spark, DATA).select("doc_id").collect()}
    docs = documents(spark)
    if name == "rule_metric":
        assert got == {i for i, d in docs.items() if (d.text or "").strip()}
    assert {docs[i].lang for i in got} == {d.lang for d in docs.values() if (d.text or "").strip()}


def brute_sentiment(text):
    raw = text.split()
    low = [w.lower().strip(".,;:!?\"'()[]") for w in raw]
    caps = [w == w.upper() for w in raw]
    but = low.index("but") if "but" in low else None
    x = 0.0
    for i, w in enumerate(low):
        v = MQ.LEXICON.get(w, 0.0)
        if not v:
            continue
        sign = 1 if v > 0 else -1
        if any(caps) and not all(caps) and caps[i] and any(unicodedata.category(c) == "Lu" for c in raw[i]):
            v += sign * 0.733
        for back, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i >= back:
                v += sign * fade * 0.293 * MQ.BOOSTERS_FOUND.get(low[i - back], 0)
        if any(n in MQ.NEGATIONS_FOUND for n in low[max(0, i - 3) : i]):
            v *= -0.74
        if but is not None and i != but:
            v *= 0.5 if i < but else 1.5
        x += v
    asked = text.count("?")
    emphasis = min(text.count("!"), 4) * 0.292 + (0.96 if asked > 3 else asked * 0.18 if asked > 1 else 0)
    x += emphasis * (x > 0) - emphasis * (x < 0)
    return x / (x * x + 15) ** 0.5


def equals_brute_sentiment(spark, folder, texts):
    got = {r.doc_id: r.compound for r in registry.queries()["sentiment_compound"](spark, folder).collect()}
    assert got == {i: pytest.approx(brute_sentiment(t), abs=2e-6) for i, t in texts.items() if t.strip()}


@tables
def test_sentiment_on_every_document(spark):
    equals_brute_sentiment(spark, DATA, {i: d.text or "" for i, d in documents(spark).items()})


def test_sentiment_with_every_rule(spark, tmp_path):
    texts = dict(enumerate(["THE end!", "the END", "very the de", "not so the la", "in the and but of LA!!", "the? la? de!", "??? ???? and", "never really de 12 La!!!!!", " ", "que DE que la, slightly 'the'"]))
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    equals_brute_sentiment(spark, str(tmp_path), texts)


def test_sentiment_that_cancels(spark, tmp_path):
    """Valences that come to 0 in decimals but not in doubles take no emphasis, as in SQL."""
    zero = ["not the x x x " * 3 + "not and x x x " * 6 + "end!", "in DE de LA z?????"]
    texts = dict(enumerate([*zero, *(t + " the" for t in zero), *(t + " and" for t in zero)]))
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.compound for r in registry.queries()["sentiment_compound"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert got == dict(db.sql(registry.oracle_sql()["sentiment_compound"]).select("doc_id", "compound").fetchall())
    assert got[0] == got[1] == 0 and 0 not in [got[i] for i in range(2, 6)]


@pytest.mark.parametrize("valence", [0.1, 1e-5, 0.123456789012, 12.5, 1e12])
def test_sentiment_of_any_valence(spark, valence):
    """Many places or large valences fall back to doubles; the others cancel exactly."""
    lexicon = {"up": valence, "upper": round(3 * valence, 12), "down": -valence}
    df = spark.createDataFrame([("up x x x " * 3 + "down x x x " * 3 + "x!",), ("down " * 3 + "upper!",), ("not up",), ("very up x but down!",)], "t string")
    got = [r[0] for r in df.select(sentiment(F.col("t"), lexicon)).collect()]
    unit = lambda x: x / (x * x + 15) ** 0.5
    if valence in (0.1, 1e-5, 12.5):
        assert [g.compound for g in got[:2]] == [0, 0]
    x = 0.5 * (valence + 0.293) - 1.5 * valence
    assert [g.compound for g in got[2:]] == pytest.approx([unit(-0.74 * valence), unit(x + (0.292 if x > 0 else -0.292))])
    turned, up, down = 0.74 * valence + 1, 0.5 * (valence + 0.293) + 1, 1.5 * valence + 1
    assert got[2][1:] == pytest.approx((0, turned / (turned + 1), 1 / (turned + 1)))
    assert got[3][1:] == pytest.approx((up / (up + down + 3), down / (up + down + 3), 3 / (up + down + 3)))
