"""Rules against Python's re, and personas."""

import re

import pytest
from pyspark.sql import functions as F

from quillmill import api
from quillmill.operators import compare as C
from quillmill.operators import deep as D
from quillmill.operators import rules as R
from quillmill.operators import search as S
from quillmill.sources import personas as P

TEXT = "The the end.\nWe use colour and color, e.g. here.\n\nA Colour too. and AND.\nThe"


def run(spark, rule, text=TEXT):
    return [tuple(m) for m in spark.createDataFrame([(text,)], "t string").select(R.compile_rule(rule, F.col("t"))).first()[0]]


def place(text, start):
    before = text[:start]
    return before.count("\n") + 1, start - before.rfind("\n")


@pytest.mark.parametrize("token", ["the", "colour", "and", "we use", "e.g", "missing"])
def test_existence_positions(spark, token):
    expected = [(m.group(), *place(TEXT, m.start()), None) for m in re.finditer(rf"\b{re.escape(token)}\b", TEXT, re.I)]
    assert run(spark, {"type": "existence", "tokens": [token]}) == expected


def test_other_types(spark):
    assert [m[3] for m in run(spark, {"type": "substitution", "swap": {"colour": "color"}})] == ["color", "color"]
    assert len(run(spark, {"type": "occurrence", "tokens": ["the"], "max": 2})) == 1
    assert run(spark, {"type": "occurrence", "max": 2, "metric": "words"}) == []
    assert [m[0] for m in run(spark, {"type": "consistency", "either": {"colour": "color"}})] == ["color"]
    assert run(spark, {"type": "consistency", "either": {"colour": "nothing"}}) == []
    assert run(spark, {"type": "conditional", "tokens": ["the"], "match": "color"}) == []
    assert len(run(spark, {"type": "conditional", "tokens": ["the"], "match": "zebra"})) == 3
    assert [m[:3] for m in run(spark, {"type": "repetition", "tokens": ["the"]})] == [("the", 1, 5)] * 2
    assert run(spark, {"type": "tone"}) == [] and run(spark, {"type": "existence", "raw": ["("]}) == []
    with pytest.raises(NotImplementedError):
        run(spark, {"type": "script"})


@pytest.mark.parametrize("kind,text,n", [("$title", "The Cat of the House", 0), ("$title", "the Cat", 1), ("$sentence", "lower first", 1), ("$lower", "all low", 0), ("$upper", "ALL Up", 1), ("other", "any", 0)])
def test_capitalization(spark, kind, text, n):
    assert len(run(spark, {"type": "capitalization", "match": kind}, text)) == n


def test_scopes(spark):
    rule = {"type": "existence", "tokens": ["a", "we", "the"]}
    assert [m[1] for m in run(spark, rule | {"scope": "paragraph"})] == [2, 1, 1, 1, 2]
    assert len(run(spark, rule | {"scope": "heading"})) == 2
    assert {m[1] for m in run(spark, rule | {"scope": "sentence"})} == {1}


def test_metric(spark):
    assert run(spark, {"type": "metric", "metric": "ari", "max": -100}, "word " * 30)[0][0] == ("word " * 30)[:50] + "..."
    assert run(spark, {"type": "metric", "metric": "unknown", "max": 0}) == []


def test_rule_flags_and_alignment(spark):
    persona = {"name": "mine", "tone": {"formality": 0.9}, "vocabulary": {"prohibited": ["Zebra"]}, "rules": [{"id": "x", "type": "existence", "level": "error", "message": "has %s", "tokens": ["cat"]}, {"id": "y", "type": "existence", "tokens": ["dog"]}]}
    r = api.analyze(spark.createDataFrame([(1, "The cat sat on a mat today. A zebra doesn't care about that at all.")], "doc_id long, text string"), persona=persona).first().result
    assert [f.code for f in r.flags[0] if f.code.startswith("RULE")] == ["RULE_x"]
    assert {"AVOID_WORD_HIT", "CASUAL_IN_FORMAL"} <= {f.code for f in r.flags[1]}
    assert tuple(r.rules) == (1, 1)
    assert 0 <= r.persona_alignment.overall_compliance <= 1


GOOD = "name: mine\nversion: 1.0.0\ntone: {formality: 0.5}\nrules:\n  - {id: a, type: existence, tokens: [x]}\n"


@pytest.mark.parametrize(
    "text,code",
    [
        (GOOD, None),
        ("a: [", "INVALID_YAML"),
        ("- 1", "INVALID_YAML"),
        ("name: x", "MISSING_REQUIRED_FIELD"),
        (GOOD.replace("name: mine", "name: 3"), "INVALID_FIELD_TYPE"),
        (GOOD + "channels: [nowhere]", "INVALID_ENUM_VALUE"),
        (GOOD.replace("0.5", "1.5"), "INVALID_RANGE"),
        (GOOD.replace("1.0.0", "'1.0'"), "INVALID_SEMVER"),
        (GOOD + "  - {id: a, type: metric}\n", "DUPLICATE_RULE_ID"),
        (GOOD + "  - {id: b, type: existence, raw: ['(']}\n", "INVALID_REGEX"),
        (GOOD + "  - {id: b, type: guess}\n", "INVALID_RULE_TYPE"),
        (GOOD + "health_score_weights: {readability: 1, naturalness: 1, vocabulary: 0, semantic_preservation: 0, tone_compliance: 0}", "INVALID_WEIGHTS_SUM"),
    ],
)
def test_validation_codes(text, code):
    result = P.validate_yaml(text)
    assert result["valid"] == (code is None)
    assert code is None or code in [e["code"] for e in result["errors"]]


@pytest.mark.parametrize("more", ["  - {id: b, type: existence, raw: 5}", "  - {id: [1], type: existence}", "  - foo", "  - {id: c, type: existence, tokens: abc}", "  - {id: d, type: existence, scope: 4}", "tags: [1]", "health_score_weights: {readability: 1.0}", "vocabulary: 3"])
def test_malformed_personas_are_errors(more, tmp_path):
    assert not P.validate_yaml(GOOD + more)["valid"]
    (tmp_path / "x.yaml").write_text(GOOD + more)
    assert P.parse_file(tmp_path / "x.yaml") is None
    assert not P.validate_yaml(GOOD.replace("0.5", "high"))["valid"]
    (tmp_path / "y.yaml").write_bytes(b"\xff\xfe name: x")
    assert P.scan([(str(tmp_path), "user")]) == []


def test_builtin_rules(spark):
    personas = P.builtin_personas()
    assert sum(len(p["rules"]) for p in personas) == 53 and all(P.validate(p)["valid"] for p in personas)
    text = "Furthermore, we do not agree. It is what it is."
    r = api.analyze(spark.createDataFrame([(1, text)], "doc_id long, text string"), persona=next(p for p in personas if p["name"] == "slack-casual")).first().result
    assert "RULE_slack-no-formal-language" in [f.code for f in r.flags[0]] and r.rules.rule_violations >= 1
    assert [x.sentence_index for x in r.sentences] == [0, 1] and all(x.readability_grade is not None and x.sentiment == 0 for x in r.sentences)
    low = api.analyze(spark.createDataFrame([(1, text)], "doc_id long, text string"), persona={"name": "far", "tone": dict.fromkeys(("formality", "confidence", "directness"), 0.0) | dict.fromkeys(("warmth", "verbosity", "energy"), 1.0)}).first().result
    assert low.persona_alignment.overall_compliance >= 0.5 or any("get_persona far" in s for s in low.next_steps)


def test_patterns_run_as_java_does(spark):
    assert [m[0] for m in run(spark, {"type": "existence", "raw": [r"(?P<a_b>t)he (?P=a_b)he"]})] == ["The the"]
    assert run(spark, {"type": "existence", "raw": [r"(?<x>the)", r"(?a)the"]}) == []


def test_compliance_delta(spark):
    pairs = spark.createDataFrame([(1, "We don't care at all, do we?", "One must act."), (2, "Same text here.", "Same text here.")], "pair_id long, original string, rewritten string")
    got = {r.pair_id: r.persona_compliance_delta for r in api.compare(pairs, persona={"name": "p", "tone": {"formality": 0.9}}).collect()}
    assert got[2] == 0 and got[1] is not None
    assert "persona_compliance_delta" not in api.compare(pairs).columns


def test_secrets_are_warnings():
    result = P.validate_yaml(GOOD + "api_key: abc\nnote: AKIA" + "A" * 16)
    assert result["valid"] and [w["code"] for w in result["warnings"]] == ["SECRET_DETECTED"] * 2


def test_examples(spark):
    data = {"rules": [{"id": "a", "type": "existence", "tokens": ["bad"], "examples": {"valid": ["good", "bad"], "invalid": ["bad", "fine"]}}]}
    assert len(P.check_examples(spark, data)) == 2


def test_catalogue(spark, tmp_path):
    path = P.create_persona(GOOD.replace("mine", "blog-post"), str(tmp_path))
    with pytest.raises(P.PersonaError) as e:
        P.create_persona(GOOD.replace("mine", "blog-post"), str(tmp_path))
    assert e.value.code == "PERSONA_EXISTS"
    with pytest.raises(P.PersonaError):
        P.create_persona(GOOD.replace("mine", "../x"), str(tmp_path))
    (tmp_path / "broken.yaml").write_text("a: [")
    found = P.load_catalogue(spark, [(str(tmp_path), "user")])
    assert found.count() == 12
    whole = P.get_persona(found, "blog-post")
    assert whole["path"] == path and whole["tier"] == "user" and whole["rules"] == [{"id": "a", "type": "existence", "tokens": ["x"]}]
    assert P.get_persona(found, "technical-d")["name"] == "technical-docs"
    assert S.with_tags(found, ["CHAT"]).first().name == "slack-casual"
    with pytest.raises(P.PersonaError):
        P.get_persona(found, "zzz")
    assert P.tier_of(path, [(str(tmp_path), "user")]) == "user" and P.tier_of("/else", []) == "unknown"


def test_compare(spark):
    pairs = spark.createDataFrame([(1, "One two three. Four five.", "One two three."), (2, "Same text here.", "Same text here.")], "pair_id long, original string, rewritten string")
    got = {r.pair_id: r for r in api.compare(pairs).collect()}
    assert got[2].overall_improvement == 0 and got[2].naturalness_delta == 0
    assert [a.rewritten for a in got[1].alignment] == ["One two three.", ""]
    assert "Meaning drift" in got[1].next_steps[0] or "regressed" in got[1].next_steps[0]
    vectors = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    assert tuple(vectors.select(C.cosine(F.col("a"), F.col("b")), C.cosine(F.col("a"), F.col("z"))).first()) == (1.0, 0.0)


def test_model_output(spark):
    one = spark.range(1)
    v = one.select(D.validated_label(F.lit(" Formal "), F.lit(0.7), ["formal"], "neutral", 0.65).alias("a"), D.validated_label(F.lit("odd"), F.lit(0.9), ["formal"], "neutral", 0.65).alias("b")).first()
    assert tuple(v.a) == ("formal", 0.7, False) and tuple(v.b) == ("neutral", 0.0, True)
    t = one.select(D.parsed_tone(F.lit("Formality: high, confidence: low"), F.lit(0.9)).alias("t"), D.parsed_tone(F.lit("formality: high"), F.lit(0.1)).alias("u")).first()
    assert {k: tuple(x) for k, x in t.t.items()} == {"formality": ("high", 0.9, False), "confidence": ("low", 0.9, False)}
    assert {k: tuple(x) for k, x in t.u.items()} == {"formality": ("medium", 0.0, True)}
    w = one.select(D.parsed_tone(F.lit("mood = Great, directness: low"), F.lit(0.9)).alias("t"), D.validated_label(F.lit(" Any text "), F.lit(0.1), None, None, None).alias("f")).first()
    assert {k: tuple(x) for k, x in w.t.items()} == {"mood": ("medium", 0.0, True), "directness": ("low", 0.9, False)} and tuple(w.f) == ("Any text", 0.1, False)
    c = one.select(D.parsed_compliance(F.lit("minor-violation: too long"), F.lit(0.9)).alias("c")).first().c
    assert tuple(c) == ("minor-violation", "too long", 0.9)
    with pytest.raises(ValueError):
        D.prompt("persona_compliance", F.lit("x"))
    assert one.select(D.operating_tier(F.lit(True), F.lit(False), F.lit(True), F.lit(True))).first()[0] == 1


def test_token_table(spark):
    tokens = spark.createDataFrame([(1, 0, 0, "It", "PRON", "nsubjpass", True), (1, 0, 1, "fell", "VERB", "root", True), (1, 1, 0, "Dogs", "NOUN", "nsubj", True)], "doc_id long, sent_idx int, tok_idx int, text string, pos string, dep string, is_alpha boolean")
    assert D.passive_ratio(tokens).first().passive_voice_ratio == 0.5
    docs = spark.createDataFrame([(1, 0.1, 2, 50, 0.2), (2, 0.0, 0, 1, 0.0)], "doc_id long, contraction_density double, formal_marker_count long, token_count long, personal_density double")
    got = {r.doc_id: r.formality for r in D.pos_formality(tokens, docs).collect()}
    assert got == {1: pytest.approx(0.35 * (1 / 3 - 2 / 3 + 1) / 2 * 0.8 + 0.35 * 0.9 + 0.15 + 0.15 * 0.8), 2: 0.5}
    assert {r.sent_idx: r.information_density for r in D.token_metrics(tokens).collect()} == {0: 0.5, 1: 1.0}


def test_stream(spark, tmp_path):
    from quillmill.streaming.documents import read_stream, score_stream

    docs = spark.createDataFrame([(1, "A short text. It ends here.")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = score_stream(read_stream(spark, str(tmp_path / "in"), docs.schema)).select("doc_id", "composite").writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").first().composite == api.score(docs).first().composite
