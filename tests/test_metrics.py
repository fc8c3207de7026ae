"""Hand-computed values and plain-Python versions of the document metrics."""

import math
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill import api
from quillmill.functions import lexicons as L
from quillmill.functions import metrics as M
from quillmill.functions import text as T
from quillmill.functions.sentiment import sentiment
from quillmill.operators import analysis as A

TEXTS = [
    "The cat sat. The dog ran fast! Did it stop? It did not; the cat sat.",
    "One. Two. Three.",
    "   ",
    "",
    None,
    "We don't know, i.e. we guess. Perhaps it's sort of a bit vague, and more or less a demonstration of happiness.",
    "However, this works. Therefore it stays. I can't, e.g. on 12 May 2024, agree.",
    "Élan vital est là.\n\nNouveau paragraphe ici ! Ça va ?",
    "word " * 60 + "end.",
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def split(text):
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", (text or "").strip())) if s]


def test_sentences_and_words_equal_python(df):
    for r in A.with_tokens(df, max_tokens=50).orderBy("doc_id").collect():
        text = TEXTS[r.doc_id] or ""
        assert r.sentences == split(text)
        assert r.words == text.split()
        code = "TEXT_TOO_SHORT" if not text.split() else "TEXT_TOO_LONG" if len(text.split()) > 50 else None
        assert r.error_code == code


def test_naturalness_equals_python(df):
    for r in A.with_naturalness(A.with_tokens(df)).collect():
        text = TEXTS[r.doc_id] or ""
        lens = [len(s.split()) for s in split(text)]
        mean = sum(lens) / len(lens) if lens else 0
        spread = math.sqrt(sum((x - mean) ** 2 for x in lens) / len(lens)) if lens else 0
        assert r.burstiness == pytest.approx(spread / mean if mean else 0)
        counts = Counter(text.lower().split())
        assert r.hapax_ratio == pytest.approx(sum(n == 1 for n in counts.values()) / len(counts) if counts else 0)
        marks = Counter(c for c in " ".join(text.split()) if c in string.punctuation)
        n = sum(marks.values())
        assert r.punctuation_entropy == pytest.approx(-sum(k / n * math.log2(k / n) for k in marks.values()) if n else 0)
        if counts and len(set(counts.values())) > 1:
            xs = [math.log(i) for i in range(1, len(counts) + 1)]
            ys = [math.log(v) for v in sorted(counts.values(), reverse=True)]
            mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
            sxy = sum((x - mx) * (y - my) for x, y in zip(xs, ys))
            assert r.zipf_r_squared == pytest.approx(sxy**2 / sum((x - mx) ** 2 for x in xs) / sum((y - my) ** 2 for y in ys))


def test_mtld_equals_python(df):
    def one(ws):
        types, n, factors = set(), 0, 0.0
        for w in ws:
            types.add(w)
            n += 1
            if len(types) / n <= 0.72:
                types, n, factors = set(), 0, factors + 1
        if n:
            factors += (1 - len(types) / n) / (1 - 0.72)
        return len(ws) / factors if factors else 0

    for r in A.with_vocabulary(A.with_tokens(df)).collect():
        ws = [w for w in (x.lower().strip(".,;:!?\"'()[]") for x in (TEXTS[r.doc_id] or "").split()) if w]
        a, b = one(ws), one(ws[::-1])
        assert r.mtld == pytest.approx((a + b) / 2 if len(ws) >= 10 and a and b else 0)


def test_default_word_lists(df):
    found = {r.doc_id: r for r in A.with_derived_signals(A.with_tone(A.with_vocabulary(A.with_sentence_signals(A.with_naturalness(A.with_tokens(df)))))).collect()}
    assert found[5].signals[2].hedge_words == ["sort of", "a bit", "more or less", "perhaps"]
    assert found[5].contraction_density == pytest.approx(2 / len(TEXTS[5].split()))
    assert "i.e." in found[5].latin
    assert found[5].nominal == ["demonstration", "happiness"]
    assert found[0].question_ratio == pytest.approx(1 / 4)
    assert found[0].exclamation_density == pytest.approx(2 / 4)
    first = found[6].signals[0]
    assert first.coherence_to_next == pytest.approx(0.10)  # "therefore"
    assert found[6].signals[-1].coherence_to_next is None


def test_gaussian_anchor_values(spark):
    got = spark.range(1).select(
        *(M.gaussian_score(F.lit(g), F.lit(10.0), F.lit(4.0)).alias(f"g{i}") for i, g in enumerate((6.0, 14.0, 10.0, 400.0)))
    ).first()
    assert [round(x, 2) for x in got] == [85.21, 64.12, 100.0, 5.0]


@pytest.mark.parametrize("score,grade,status", [(85.0, "A", "good"), (70.0, "B", "warning"), (55.0, "C", "warning"), (40.0, "D", "warning"), (39.9, "F", "poor"), (70.1, "B", "good")])
def test_grades(spark, score, grade, status):
    assert tuple(spark.range(1).select(M.letter_grade(F.lit(score)), M.status(F.lit(score))).first()) == (grade, status)


def test_composite_shares_the_weight_of_missing_dimensions(spark):
    null = F.lit(None).cast("double")
    given = {"readability": F.lit(80.0), "naturalness": null, "vocabulary": F.lit(40.0), "semantic_preservation": null, "tone_compliance": null}
    weights = {d: F.lit(w) for d, w in L.DEFAULT_WEIGHTS.items()}
    value = (0.25 * 80 + 0.20 * 40) / 0.45
    got = spark.range(1).select(M.composite(given, weights), M.composite(given, {d: F.lit(0.0) for d in given})).first()
    assert got[0] == pytest.approx(value, abs=0.05) and got[1] == 60.0
    assert A.weights_for("readability")["readability"] == 0.70
    assert A.weights_for("nonsense") == L.DEFAULT_WEIGHTS
    assert A.weights_for("readability", None, {"vocabulary": 1.0}) == {"vocabulary": 1.0}


def test_suggestions_are_ranked(spark):
    text = "This is perhaps maybe a sentence. Short one. " + "word " * 31 + "here. Short one."
    r = api.analyze(spark.createDataFrame([(1, text)], "doc_id long, text string"), suggestions=True).first().result
    impacts = [s.impact for s in r.suggestions]
    assert impacts == sorted(impacts, reverse=True) and len(impacts) == 5
    assert r.suggestions[0].flag_code == "HIGH_HEDGE_COUNT"
    assert "REDUNDANT" in [f.code for f in r.flags[3]]
    assert r.flags_summary.errors == 0


def test_errors_are_rows(spark):
    got = api.analyze(spark.createDataFrame([(1, ""), (2, None), (3, "Fine text here.")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [g.error.code if g.error else None for g in got] == ["TEXT_TOO_SHORT", "TEXT_TOO_SHORT", None]
    assert [g.result is None for g in got] == [True, True, False]


def test_sentiment_rules(spark):
    lexicon = {"good": 2.0, "bad": -2.0}
    texts = ["good", "very good", "not good", "good but bad", "GOOD thing", "good!!!", "plain"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sentiment(F.col("t"), lexicon)["compound"]).collect()]
    unit = lambda x: x / math.sqrt(x * x + 15)
    assert got == pytest.approx([unit(2), unit(2.293), unit(2 * -0.74), unit(1 - 3), unit(2.733), unit(2 + 0.876), 0])


def test_plans_stay_on_the_jvm_and_need_no_shuffle(df, capsys):
    api.score(df).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Exchange" not in plan


def test_run_lengths(spark):
    got = spark.createDataFrame([(["a", "a", "b"],), ([],), (["x"],)], "x array<string>").select(T.run_lengths(F.col("x"))).collect()
    assert [r[0] for r in got] == [[2, 1], [], [1]]
