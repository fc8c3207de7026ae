"""Preparing and checking model output for sentences; the model itself is a function that is given."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

#: Name, prompt, most new tokens, threshold, labels, fallback, beam search.
TASKS = [
    ("style_classification", "Classify the writing style of this sentence as formal, informal, or neutral: {sentence}", 8, 0.65, ["formal", "informal", "neutral"], "neutral", True),
    (
        "ai_pattern_detection",
        "Identify the AI writing pattern in this sentence. Choose one: formulaic-transition, list-heavy, hedge-stacking, over-qualification, filler-phrase, repetitive-structure, none-obvious: {sentence}",
        8,
        0.55,
        ["formulaic-transition", "list-heavy", "hedge-stacking", "over-qualification", "filler-phrase", "repetitive-structure", "none-obvious"],
        "none-obvious",
        True,
    ),
    ("paraphrase_hints", "Suggest a brief directive for improving this sentence (do not rewrite it): {sentence}", 20, None, None, None, False),
    ("core_meaning", "Extract the core meaning of this sentence in 10 words or fewer: {sentence}", 15, None, None, None, False),
    (
        "sentence_function",
        "Classify the function of this sentence. Choose one: claim, evidence, background, transition, conclusion: {sentence}",
        8,
        0.60,
        ["claim", "evidence", "background", "transition", "conclusion"],
        "background",
        True,
    ),
    ("tone_assessment", "Assess the tone of this sentence on three dimensions (formality, confidence, directness) as low, medium, or high: {sentence}", 20, 0.60, ["low", "medium", "high"], "medium", True),
    (
        "persona_compliance",
        "Given the persona tone targets ({context}), classify this sentence's compliance as compliant, minor-violation, or major-violation, and briefly state the issue: {sentence}",
        25,
        0.65,
        ["compliant", "minor-violation", "major-violation"],
        "compliant",
        True,
    ),
]
ALWAYS = ["style_classification", "core_meaning", "sentence_function", "tone_assessment"]


def gated_tasks(ai_signal: Column, suggestions: Column | bool = False, persona: Column | bool = False) -> Column:
    """Names of the tasks to run, in their fixed order."""
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    listed = [F.lit(t) for t in ALWAYS]
    listed += [F.when(ai_signal == "likely-ai", "ai_pattern_detection"), F.when(flag(suggestions), "paraphrase_hints"), F.when(flag(persona), "persona_compliance")]
    return F.filter(F.array(*listed), lambda t: t.isNotNull())


def prompt(task: str, sentence: Column, context: Column | None = None) -> Column:
    template = next(t[1] for t in TASKS if t[0] == task)
    if "{context}" in template and context is None:
        raise ValueError(f"{task} needs a context")
    filled = F.replace(F.lit(template), F.lit("{context}"), context) if context is not None else F.lit(template)
    return F.replace(filled, F.lit("{sentence}"), sentence)


def estimated_subwords(ws: Column) -> Column:
    return F.ceil(1.3 * F.size(ws)).cast("long")


def truncated(sentence: Column, overhead: Column, budget: int = 512) -> Column:
    """The sentence's first words that fit the budget beside ``overhead`` subwords."""
    room = F.greatest(F.lit(0), F.floor((F.lit(budget) - overhead) / 1.3).cast("int"))
    return T.let(T.words(sentence), lambda ws: F.when(F.size(ws) > room, F.array_join(F.slice(ws, 1, room), " ")).otherwise(sentence))


def context_packets(sentences: Column, most_words: int = 30) -> Column:
    """For each sentence its neighbours, cut to 30 words, and its class of length."""
    cut = lambda s: F.array_join(F.slice(T.words(s), 1, most_words), " ")

    def of(xs: Column) -> Column:
        return F.transform(
            xs,
            lambda s, i: T.let(
                F.size(T.words(s)),
                lambda n: F.struct(
                    i.alias("sentence_index"),
                    F.when(i > 0, cut(F.get(xs, i - 1))).alias("previous"),
                    F.when(i + 1 < F.size(xs), cut(F.get(xs, i + 1))).alias("next"),
                    F.when(n < 10, "short").when(n <= 25, "medium").otherwise("long").alias("length_class"),
                    n.alias("n_words"),
                ),
            ),
        )

    return T.let(sentences, of)


def listed_hits(sentence: Column, phrases: list[str]) -> Column:
    """Which of the phrases a sentence holds, whatever its case, in the order of the list."""
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(sentence), F.lower(p))) if phrases else F.expr("cast(array() as array<string>)")


def context_string(
    packet: Column, grade: Column | None = None, sentiment: Column | None = None, ai: Column | None = None, tone: dict[str, float] | None = None, avoid: Column | None = None, prefer: Column | None = None
) -> Column:
    """A packet of ``context_packets`` and what else is known, as one line for a prompt. Parts that are null or empty are left out."""

    def part(name: str, value: Column | None) -> Column:
        return F.lit(None).cast("string") if value is None else F.when(value != "", F.concat(F.lit(f"{name}: "), value))

    first = lambda hits: None if hits is None else F.array_join(F.slice(hits, 1, 5), ", ")
    known = ", ".join(f"{k}={v:.1f}" for k, v in (tone or {}).items())
    return F.concat_ws(
        " | ",
        part("prev", packet["previous"]),
        part("next", packet["next"]),
        part("grade", None if grade is None else F.format_string("%.1f", grade)),
        part("length", packet["length_class"]),
        part("sentiment", sentiment),
        part("ai", ai),
        part("tone", F.lit(known) if known else None),
        part("avoid", first(avoid)),
        part("prefer", first(prefer)),
    )


def sentiment_label(compound: Column) -> Column:
    return F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")


def validated_label(raw: Column, confidence: Column, labels: list[str] | None, fallback: str | None, threshold: float | None) -> Column:
    """The label, if it is one of the task's and sure enough; else the fallback with confidence 0, marked
    as such. Tasks without labels take any text."""
    if labels is None:
        return F.struct(T.stripped(raw).alias("label"), confidence.alias("confidence"), F.lit(False).alias("is_fallback"))
    label = F.lower(T.stripped(raw))
    fine = F.coalesce(label.isin(labels) & ((confidence >= threshold) if threshold is not None else F.lit(True)), F.lit(False))
    return F.struct(F.when(fine, label).otherwise(fallback or "").alias("label"), F.when(fine, confidence).otherwise(0.0).alias("confidence"), (~fine).alias("is_fallback"))


def parsed_tone(raw: Column, confidence: Column, threshold: float = 0.60) -> Column:
    """``dimension: value`` pairs, whatever the dimension's name, as a map to label, confidence and
    is_fallback: a value other than low, medium or high, or one that is not sure enough, becomes medium
    with confidence 0. Of a dimension that is named twice the last value holds."""
    pattern = F.lit(r"(?U)(\w+)\s*[:=]\s*(\w+)")
    text = F.lower(F.coalesce(raw, F.lit("")))

    def of(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
        return F.map_from_entries(F.transform(names, lambda k: F.struct(k, validated_label(last(k), confidence, ["low", "medium", "high"], "medium", threshold))))

    return T.let(F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("v")), of)


def parsed_compliance(raw: Column, confidence: Column, threshold: float = 0.65) -> Column:
    """``label: issue``; compliant, with confidence 0, if the label is unknown or unsure."""
    label = F.lower(T.stripped(F.substring_index(raw, ":", 1)))
    issue = F.when(F.contains(raw, F.lit(":")), T.stripped(F.regexp_extract(raw, r"(?s)^[^:]*:(.*)$", 1)))
    fine = F.coalesce(label.isin("compliant", "minor-violation", "major-violation") & (confidence >= threshold), F.lit(False))
    return F.struct(
        F.when(fine, label).otherwise("compliant").alias("label"),
        F.when(fine & (issue != ""), issue).alias("issue"),
        F.when(fine, confidence).otherwise(0.0).alias("confidence"),
    )


def pivoted(outputs: DataFrame) -> DataFrame:
    """doc_id, sent_idx and one column a task, from rows of doc_id, sent_idx, task, raw."""
    return outputs.groupBy("doc_id", "sent_idx").pivot("task", [t[0] for t in TASKS]).agg(F.first("raw"))


def operating_tier(parser: Column, detector: Column, deep: Column, vectors: Column) -> Column:
    """0 to 4: each part counts only if those before it are there."""
    return F.when(~parser, 0).when(~detector, 1).when(~deep, 2).when(~vectors, 3).otherwise(4)


# --- with a table of parsed tokens (doc_id, sent_idx, tok_idx, text, pos, dep, is_alpha, like_num) ---


def token_metrics(tokens: DataFrame) -> DataFrame:
    """By sentence: passive, information_density, n_tokens from a parse."""
    alpha = F.col("is_alpha")
    return tokens.groupBy("doc_id", "sent_idx").agg(
        F.max(F.col("dep").isin(L.PASSIVE_DEPS)).alias("passive"),
        T.ratio(F.count_if(alpha & F.col("pos").isin(L.CONTENT_POS)), F.count_if(alpha)).alias("information_density"),
        F.count(F.lit(1)).alias("n_tokens"),
    )


def passive_ratio(tokens: DataFrame) -> DataFrame:
    """By document: share of sentences with a passive token, and passive tokens a sentence (1 at most)."""
    per = tokens.groupBy("doc_id", "sent_idx").agg(F.count_if(F.col("dep").isin(L.PASSIVE_DEPS)).alias("n"))
    return per.groupBy("doc_id").agg(F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).alias("passive_voice_ratio"), F.least(F.avg("n"), F.lit(1.0)).alias("passive_token_ratio"))


def pos_formality(tokens: DataFrame, docs: DataFrame, contraction_density="contraction_density", formal_markers="formal_marker_count", n_words="token_count", personal_density="personal_density") -> DataFrame:
    """By document (doc_id, formality) the formality of Heylighen and Dewaele with the contraction, marker
    and pronoun parts, which are columns of ``docs``. Documents without alphabetic tokens have 0.5."""
    alpha, of = F.col("is_alpha"), lambda c: c if isinstance(c, Column) else F.col(c)
    share = lambda tags: 100 * T.ratio(F.count_if(alpha & F.col("pos").isin(tags)), F.count_if(alpha))
    f = T.clip((share(L.FORMAL_POS) - share(L.INFORMAL_POS) + 100) / 200)
    got = tokens.groupBy("doc_id").agg(F.count_if(alpha).alias("__alpha"), f.alias("__f"), F.countDistinct("sent_idx").alias("__sentences"))
    joined = docs.join(got, "doc_id", "left")
    short = F.when(F.col("__alpha") / F.col("__sentences") < 10, 0.8).otherwise(1.0)
    value = 0.35 * F.col("__f") * short + 0.35 * (1 - of(contraction_density)) + 0.15 * F.least(F.lit(1.0), of(formal_markers) / F.greatest(of(n_words) / 100, F.lit(1.0))) + 0.15 * (1 - of(personal_density))
    return joined.select("doc_id", F.when(F.col("__alpha") > 0, T.clip(value)).otherwise(F.lit(0.5)).alias("formality"))
