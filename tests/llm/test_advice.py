"""Cases of a review: limits of repetition, spaced insults, stages."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill.llm import bagminhash as B
from quillmill.llm import queries as Q
from quillmill.llm import repetition as RP
from quillmill.llm import toxicity as TX

DATA = "/root/testdata/sf0.001"


def kept(text):
    """By brute force under the stricter limits."""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    total, fine = max(1, sum(map(len, ws))), len(ws) >= 10
    for n, limit in RP.TIGHT_LIMITS.items():
        grams = Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
        inside = {i + k for i in range(len(ws) - n + 1) if grams[tuple(ws[i : i + n])] > 1 for k in range(n)}
        fine &= sum(len(ws[i]) for i in inside) / total <= limit and (n > 5 or 100 * len(inside) <= 20 * len(ws))
    lines = (text or "").split("\n")
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    return fine and sum(len("".join(re.findall(r"[^\x20\x09-\x0D]+", x))) for x in again) / total <= RP.TIGHT_LINE_LIMIT


def test_tight_limits_reject_a_copied_line():
    line = " ".join(f"a{i}" for i in range(13))
    text = "\n".join([line, " ".join(f"b{i}" for i in range(140)), line])
    assert RP.measure([text]).kept[0]
    assert not RP.measure([text], RP.TIGHT_LIMITS, RP.TIGHT_LINE_LIMIT).kept[0] and not kept(text)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_tight_limits_on_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.kept for r in Q.op3_repetition_tight(spark, DATA).collect()}
    assert got == {i: kept(t) for i, t in docs.items()}


@pytest.mark.parametrize("text", ["i - d - i - o - t", "i d 12 i -- o . t", "we i - d - i - o - t see"])
def test_words_without_letters_do_not_end_a_run(text):
    assert "idiot" in TX.Units(["x", text, "y"]).strings()
    assert "stupid" in TX.Units(["you", "the st up - id man"]).strings()
    assert "abcd" not in TX.Units(["a b", "- c d"]).strings()
    assert "aid" not in TX.Units(["a - be i - d"]).strings()


def test_near_dedup_of_repeated_and_null_ids(spark):
    first, second, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, first), (1, second), (2, first), (None, third), (None, third + " more"), (None, first), (3, second), (None, None), (1, first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, B.without_near_duplicates(docs).collect()), key=str)
    kept_third = [r for r in got if r[0] is None and r[1]]
    assert len(kept_third) == 1 and kept_third[0][1].startswith(third)
    assert [r for r in got if r not in kept_third] == sorted([(1, first), (1, second), (None, None)], key=str)


def test_pipeline_by_brute_force(spark, tmp_path):
    """The rows after each stage of a small corpus, worked out by hand and by the tokenizers library."""
    import random

    import corpus_pipeline as P
    from tokenizers import Tokenizer

    rng = random.Random(2)
    english = [" ".join(rng.choices(["the", "house", "with", "that", "river", "and", "water", "under", "bridge"], k=60)) for _ in range(40)]
    german = [" ".join(rng.choices(["das", "haus", "mit", "fluss", "und", "wasser", "unter", "brücke", "nicht"], k=60)) for _ in range(40)]
    shared = "this very line stands in a good many of the documents of this corpus"
    texts = [t + "\n" + shared if i % 8 == 0 else t for i, t in enumerate(english + german)]
    rows = [(i, t, "en" if i < 40 else "de", "ab"[i % 2]) for i, t in enumerate(texts)]
    rows += [(80, texts[1], "en", "a"), (81, texts[1] + " more", None, "b"), (82, None, "en", "a"), (83, "12 !?", "en", "a"), (84, "", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(P.STAGES)

    def of(df):
        return {r.doc_id: r.text for r in df.collect()}

    one = stages["language_id"](spark, docs, str(tmp_path))
    assert of(one) == {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    two = stages["line_dedup"](spark, one, str(tmp_path))
    last = max(i for i, t in enumerate(texts) if shared in t)
    assert of(two) == {i: t if i == last else t.replace("\n" + shared, "") for i, t in of(one).items()}
    three = stages["near_dedup"](spark, two, str(tmp_path))
    assert of(three) == {i: t for i, t in of(two).items() if i not in (80, 81)}
    four = stages["mixing"](spark, three, str(tmp_path))
    whole = of(three)
    mixed = [(r.doc_id, r.text) for r in four.collect()]
    assert sum(len(t.split()) for _, t in mixed) == sum(len(t.split()) for t in whole.values())
    assert all(whole[i].startswith(t) for i, t in mixed) and sum(t != whole[i] for i, t in mixed) <= 2
    library = Tokenizer.from_file(Q.vocabulary_path())
    for r in stages["bpe"](spark, four, str(tmp_path)).collect():
        assert list(r.ids) in [library.encode(t, add_special_tokens=False).ids for i, t in mixed if i == r.doc_id]
        assert r.decoded == library.decode(list(r.ids), skip_special_tokens=False)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(of(stages["language_id"](spark, unlabelled, str(tmp_path)))) == sorted(of(one))
