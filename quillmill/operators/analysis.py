"""Documents to metrics, scores, flags and suggestions.

All steps add columns to one row a document: sentences and words are arrays, so nothing is
shuffled; ``explode`` where rows of sentences are wanted. A document that cannot be analysed gets an
``error_code``; its metrics are those of an empty text, and no job fails for it.
"""

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import metrics as M
from ..functions import text as T

MAX_TOKENS = 8000


def with_tokens(df: DataFrame, text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds words, sentences, token_count, error_code (TEXT_TOO_SHORT, TEXT_TOO_LONG or null)."""
    given = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"words": T.words(given), "sentences": T.sentences(given)}).withColumn("token_count", F.size("words").cast("long"))
    code = F.when(F.col("token_count") == 0, "TEXT_TOO_SHORT").when(F.col("token_count") > max_tokens, "TEXT_TOO_LONG")
    return df.withColumn("error_code", code)


def with_naturalness(df: DataFrame) -> DataFrame:
    """Adds lengths, burstiness, length_skewness, hapax_ratio, zipf_r_squared, punctuation_entropy, starter_diversity."""
    df = df.withColumns(
        {
            "lengths": M.sentence_lengths(F.col("sentences")),
            "lowered": F.transform("words", F.lower),
            "starters": F.transform("sentences", T.first_word),
        }
    ).withColumn("frequencies", M.word_frequencies(F.col("lowered")))
    return df.withColumns(
        {
            "burstiness": M.burstiness(F.col("lengths")),
            "length_skewness": M.length_skewness(F.col("lengths")),
            "hapax_ratio": M.hapax_ratio(F.col("frequencies")),
            "zipf_r_squared": M.zipf_r2(F.col("frequencies")),
            "punctuation_entropy": M.punctuation_entropy(F.array_join("words", " ")),
            "starter_diversity": M.starter_diversity(F.col("starters")),
        }
    )


def with_vocabulary(df: DataFrame) -> DataFrame:
    """Adds bare, ttr, mtld, passive_voice_ratio (0 without a parse)."""
    df = df.withColumn("bare", T.bare_words(F.col("words")))
    spoken = F.filter("bare", lambda w: w != "")
    return df.withColumns({"ttr": M.type_token_ratio(F.transform("words", F.lower)), "mtld": M.mtld(spoken), "passive_voice_ratio": F.lit(0.0)})


def with_readability(df: DataFrame, easy_words: list[str] | None = None) -> DataFrame:
    """Adds the seven grades, consensus_grade, flesch_reading_ease."""
    ws = F.col("words")
    df = df.withColumns({"counts": M.text_counts(ws, F.size("sentences"), easy_words), "ends": M.linsear_sentences(ws)})
    df = df.withColumns(M.grade_columns(F.col("counts"), F.col("ends")))
    mean = sum((F.col(g) for g in M.GRADES), F.lit(0.0)) / len(M.GRADES)
    return df.withColumns({"consensus_grade": F.round(mean, 1) + 0.0, "flesch_reading_ease": M.flesch_ease(F.col("counts"))})


def sentence_grade(sentence: Column) -> Column:
    """The consensus grade of one sentence."""

    def of(v: Column) -> Column:
        return F.round(sum(M.grade_columns(v.c, v.ends).values(), F.lit(0.0)) / len(M.GRADES), 1) + 0.0

    return T.let(T.let(T.words(sentence), lambda ws: F.struct(M.text_counts(ws, F.lit(1)).alias("c"), M.linsear_sentences(ws).alias("ends"))), of)


def with_tone(df: DataFrame, contractions: list[str] = L.CONTRACTIONS, compound: Column | None = None) -> DataFrame:
    """Adds contraction_density, latin, nominal, formal_marker_count, compound (given, or 0)."""
    df = df.withColumns(
        {
            "contraction_density": T.ratio(T.count_in(F.transform("words", F.lower), contractions), F.size("words")),
            "latin": M.latin_abbreviations(F.array_join("words", " ")),
            "nominal": M.nominalisations(F.col("bare")),
            "compound": compound if compound is not None else F.lit(0.0),
        }
    )
    return df.withColumn("formal_marker_count", (F.size("latin") + F.size("nominal")).cast("long"))


def sentence_signals(lists: dict[str, list[str]] | None = None) -> Column:
    """For each sentence of ``sentences``: text, word_count, hedges, densities, coherence to the next. ``lists`` replaces word lists by name."""
    lists = lists or {}
    split = F.transform(
        "sentences",
        lambda s: F.struct(s.alias("text"), T.words(s).alias("ws")),
    )
    rich = F.transform(
        split,
        lambda x: F.struct(
            x.text.alias("text"),
            x.ws.alias("ws"),
            M.content_words(x.ws).alias("content"),
            T.bare_first_word(x.text).alias("opens"),
            M.hedges(x.text, T.bare_words(x.ws), lists.get("hedge_phrases", L.HEDGE_PHRASES), lists.get("hedge_words", L.HEDGE_WORDS)).alias("hedges"),
        ),
    )
    return rich


def with_sentence_signals(df: DataFrame, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``signals`` (array of structs) and the means over a document."""
    lists = lists or {}
    bridging, markers = lists.get("bridging_pronouns", L.BRIDGING_PRONOUNS), lists.get("discourse_markers", L.DISCOURSE_MARKERS)

    def signal(rich: Column, x: Column, i: Column) -> Column:
        after = F.get(rich, i + 1)
        to_next = M.coherence(M.jaccard(x.content, after.content), after.opens.isin(bridging), after.opens.isin(markers))
        return F.struct(
            i.alias("sentence_index"),
            x.text.alias("text"),
            F.size(x.ws).alias("word_count"),
            x.hedges.alias("hedge_words"),
            F.size(x.hedges).alias("hedge_count"),
            M.information_density(x.ws).alias("information_density"),
            M.specificity(x.text, x.ws, lists.get("abstract_suffixes", L.NOMINAL_SUFFIXES)).alias("specificity"),
            F.when(i + 1 < F.size(rich), to_next).alias("coherence_to_next"),
        )

    df = df.withColumn("signals", T.let(sentence_signals(lists), lambda rich: F.transform(rich, lambda x, i: signal(rich, x, i))))
    linked = F.filter(F.transform("signals", lambda s: s.coherence_to_next), lambda c: c.isNotNull())
    return df.withColumns(
        {
            # A sentence has a fixed density or none: a count is exact whatever the order of sentences.
            "mean_density": T.ratio(M.DENSITY * F.size(F.filter("signals", lambda s: s.information_density > 0)), F.size("signals")),
            "mean_specificity": T.mean(F.transform("signals", lambda s: s.specificity)),
            "mean_coherence": T.mean(linked),
        }
    )


def with_derived_signals(df: DataFrame, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds the densities and ratios that the tone dimensions are made of. Needs ``bare``, ``signals``, ``burstiness``, ``contraction_density``."""
    lists = lists or {}
    n, s = F.size("words"), F.size("sentences")
    known = F.filter("bare", lambda w: w != "")
    of = lambda key, default: T.ratio(T.count_in(F.col("bare"), lists.get(key, default)), F.greatest(n, F.lit(1)))
    share = lambda condition, default=0.0: T.ratio(F.size(F.filter("sentences", condition)), s, default)
    hedged = F.aggregate("signals", F.lit(0), lambda a, x: a + x.hedge_count)
    return df.withColumns(
        {
            "hedge_density": T.ratio(hedged, F.greatest(n, F.lit(1))),
            "info_density_mean": F.when(s > 0, F.col("mean_density")).otherwise(F.lit(0.5)),
            "modal_density": of("modals", L.MODALS),
            "assertion_ratio": T.ratio(F.size(F.filter("signals", lambda x: x.hedge_count == 0)), s, 0.5),
            "passive_ratio": F.lit(0.0),
            "exclamation_density": share(lambda x: x.rlike(r"[!?]$")),
            "inclusive_density": of("inclusive_pronouns", L.INCLUSIVE_PRONOUNS),
            "imperative_ratio": share(lambda x: T.bare(F.get(T.words(x), F.lit(0))).isin(lists.get("imperatives", L.IMPERATIVES))),
            "question_ratio": share(lambda x: x.endswith("?")),
            "length_variation": F.when(s > 0, F.least(F.col("burstiness"), F.lit(1.0))).otherwise(F.lit(0.5)),
            "filler_density": of("fillers", L.FILLERS),
            "personal_density": of("personal_pronouns", L.PERSONAL_PRONOUNS),
            "avg_sentence_length": T.ratio(n, F.greatest(s, F.lit(1))),
        }
    )


def with_tone_dimensions(df: DataFrame) -> DataFrame:
    """Adds the six tone dimensions, each from 0 to 1."""
    c, one = F.col, F.lit(1.0)
    least = lambda x: F.least(x, one)
    return df.withColumns(
        {
            "formality": T.clip(0.75 * (1 - c("contraction_density")) + 0.125),
            "confidence": T.clip(
                0.40 * (1 - least(10 * c("hedge_density"))) + 0.30 * (1 - least(10 * c("modal_density"))) + 0.20 * c("assertion_ratio") + 0.10 * F.abs("compound")
            ),
            "warmth": T.clip(
                0.35 * least(20 * c("inclusive_density")) + 0.35 * F.greatest(F.lit(0.0), c("compound")) + 0.20 * (1 - F.lit(0.0)) + 0.10 * least(c("exclamation_density"))
            ),
            "directness": T.clip(
                0.35 * (1 - least(10 * c("hedge_density"))) + 0.30 * (1 - c("passive_ratio")) + 0.20 * c("imperative_ratio") + 0.15 * (1 - c("question_ratio"))
            ),
            "energy": T.clip(0.35 * least(c("burstiness")) + 0.25 * least(c("exclamation_density")) + 0.25 * (1 - c("passive_ratio")) + 0.15 * least(c("length_variation"))),
            "verbosity": T.clip(0.35 * least(c("avg_sentence_length") / 30) + 0.25 * least(20 * c("filler_density")) + 0.25 * (1 - c("info_density_mean"))),
        }
    )


def weights_for(focus: str | None = None, explicit: dict[str, float] | None = None, persona: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of a persona before given ones before those of a focus; an unknown focus has the default weights."""
    if persona or explicit:
        return dict(persona or explicit)
    primary = L.FOCUS_MODES.get((focus or "full").lower())
    return {d: (L.FOCUS_PRIMARY if d == primary else L.FOCUS_OTHER) for d in L.DIMENSIONS} if primary else dict(L.DEFAULT_WEIGHTS)


def with_health(df: DataFrame, weights: dict[str, float] | None = None, persona: str | None = None, semantic: Column | None = None) -> DataFrame:
    """Adds the dimension scores, ``composite``, ``grade`` and statuses. Dimensions without a score are left out and their weight is shared."""
    target, sigma = L.READABILITY_TARGETS.get(persona or "", L.DEFAULT_TARGET)
    df = df.withColumns(
        {
            "readability": M.gaussian_score(F.col("consensus_grade"), F.lit(target), F.lit(sigma)),
            "naturalness": M.naturalness_score(F.col("burstiness"), F.col("hapax_ratio"), F.col("zipf_r_squared"), F.col("starter_diversity")),
            "vocabulary": M.vocabulary_score(F.col("mtld"), F.col("ttr")),
            "semantic_preservation": semantic if semantic is not None else F.lit(None).cast("double"),
            "tone_compliance": M.tone_score(F.col("compound"), F.col("contraction_density")),
        }
    )
    used = weights or L.DEFAULT_WEIGHTS
    scores = {d: F.col(d) for d in L.DIMENSIONS}
    df = df.withColumn("composite", M.composite(scores, {d: F.lit(float(used.get(d, 0.0))) for d in L.DIMENSIONS}))
    return df.withColumns({"grade": M.letter_grade(F.col("composite"))} | {f"{d}_status": F.when(F.col(d).isNotNull(), M.status(F.col(d))) for d in L.DIMENSIONS})


def analysed(df: DataFrame, text: str = "text", persona: str | None = None, weights: dict[str, float] | None = None, compound: Column | None = None, easy_words: list[str] | None = None) -> DataFrame:
    """Every metric up to the health score."""
    df = with_tone(with_readability(with_vocabulary(with_naturalness(with_tokens(df, text))), easy_words), compound=compound)
    return with_health(df, weights, persona)


def flag(code: str, severity: str, message: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message")))


def sentence_flags(s: Column, redundant: Column | None = None, tone: dict[str, float] | None = None, prohibited: list[str] | None = None) -> Column:
    """The flags of one sentence (a struct of ``signals``), in their order. ``tone``: that of a persona."""
    text = F.format_string
    listed = [
        flag("LONG_SENTENCE", "warning", text("Sentence has %d words (>30)", s.word_count), s.word_count > 30),
        flag("SHORT_SENTENCE", "suggestion", text("Sentence has only %d words", s.word_count), s.word_count < 5),
        flag("HIGH_HEDGE_COUNT", "warning", text("High hedging (%d hedge words)", s.hedge_count), s.hedge_count >= 2),
        flag("LOW_DENSITY", "warning", text("Low information density (%.2f)", s.information_density), s.information_density < 0.35),
        flag("VAGUE", "suggestion", text("Low specificity (%.2f)", s.specificity), s.specificity < 0.25),
        flag("LOW_COHERENCE", "suggestion", text("Low coherence to next sentence (%.2f)", s.coherence_to_next), s.coherence_to_next < 0.10),
    ]
    if prohibited:
        hit = F.get(F.filter(F.array(*map(F.lit, prohibited)), lambda w: F.contains(F.lower(s.text), F.lower(w))), F.lit(0))
        listed.append(flag("AVOID_WORD_HIT", "error", F.concat(F.lit("Prohibited word '"), hit, F.lit("' detected")), hit.isNotNull()))
    if tone and tone.get("formality", 0.5) < 0.3:
        listed.append(flag("FORMAL_IN_CASUAL", "error", F.lit("Formal language detected in casual persona"), s.text.rlike("(?iuU)" + L.FORMAL_PATTERN)))
    if tone and tone.get("formality", 0.5) > 0.7:
        listed.append(flag("CASUAL_IN_FORMAL", "error", F.lit("Contractions detected in formal persona"), s.text.rlike("(?iuU)" + L.CONTRACTION_PATTERN)))
    if redundant is not None:
        listed.append(flag("REDUNDANT", "suggestion", F.lit("Sentence is highly similar to an earlier sentence"), redundant))
    return F.filter(F.array(*listed), lambda f: f.isNotNull())


def _repeats(sets: list[frozenset], threshold: float) -> list[int]:
    """Indices of the sets that are alike (Jaccard) to an earlier one.

    Two sets of similarity t share a word among the rarest n - ceil(t n) + 1 of each, so only sets
    that an index of those words yields are compared, and those within t of the other's size."""
    known = Counter(w for s in sets for w in s)
    seen: set[frozenset] = set()
    holders: defaultdict[str, list[int]] = defaultdict(list)
    out = []
    for i, own in enumerate(sets):
        n = len(own)
        if not n:
            continue
        if own in seen:
            out.append(i)
            continue
        rare = sorted(own, key=lambda w: (known[w], w))[: n - math.ceil(threshold * n - 1e-9) + 1]
        tried: set[int] = set()
        for w in rare:
            found = False
            for j in holders[w]:
                if j not in tried:
                    tried.add(j)
                    other = sets[j]
                    if min(n, len(other)) >= threshold * max(n, len(other)):
                        both = len(own & other)
                        if both / (n + len(other) - both) >= threshold:
                            found = True
                            break
            if found:
                out.append(i)
                break
        # A set that equals an earlier one brings no candidate that the earlier one does not.
        seen.add(own)
        for w in rare:
            holders[w].append(i)
    return out


def redundant_indices(sentences: Column, threshold: float = 0.6) -> Column:
    """Indices of the sentences whose words are alike to those of an earlier one: an Arrow batch of documents at a time, since Catalyst has no index to look candidates up in."""

    @F.pandas_udf("array<int>")
    def repeats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for docs in batches:
            yield pd.Series([_repeats([frozenset(s.split()) for s in d], threshold) for d in docs], dtype=object)

    return repeats(F.transform(sentences, F.lower))


def with_redundancy(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Adds ``redundant``: indices of sentences that repeat an earlier one."""
    return df.withColumn("redundant", redundant_indices(F.col("sentences"), threshold))


def with_flags(df: DataFrame, tone: dict[str, float] | None = None, prohibited: list[str] | None = None) -> DataFrame:
    """Adds ``flags``: for each sentence an array of code, severity, message. Needs ``signals`` and ``redundant``."""
    def of(redundant: Column) -> Column:
        return F.transform("signals", lambda s: sentence_flags(s, F.array_contains(redundant, s.sentence_index), tone, prohibited))

    return df.withColumn("flags", T.let(F.col("redundant"), of))


def hint_for(code: Column, severity: Column, message: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in L.HINTS.items() for x in pair))
    rule = F.when(severity == "error", F.concat(F.lit("Remove or fix: "), message)).when(severity == "warning", F.concat(F.lit("Consider rephrasing: "), message)).otherwise(F.concat(F.lit("Review: "), message))
    return F.coalesce(F.try_element_at(known, code), F.when(code.startswith("RULE_"), rule).otherwise(F.concat(F.lit("Review issue: "), code)))


def with_suggestions(df: DataFrame, most: int = 5) -> DataFrame:
    """Adds ``suggestions``: the first ``most`` of all flags by impact, then sentence, then the order of flags. Sorted within the row."""
    impact = lambda s: F.when(s == "error", L.IMPACTS["error"]).when(s == "warning", L.IMPACTS["warning"]).otherwise(L.IMPACTS["suggestion"])
    ranked = F.flatten(
        F.transform(
            "flags",
            lambda fs, i: F.transform(
                fs,
                lambda f, j: F.struct((-impact(f.severity)).alias("rank"), i.alias("sentence_index"), j.alias("place"), f.code.alias("flag_code"), f.severity.alias("severity"), f.message.alias("message")),
            ),
        )
    )
    top = F.slice(F.array_sort(ranked), 1, most)
    return df.withColumn(
        "suggestions",
        F.transform(top, lambda x: F.struct(x.sentence_index.alias("sentence_index"), x.flag_code.alias("flag_code"), hint_for(x.flag_code, x.severity, x.message).alias("hint"), (-x.rank).alias("impact"))),
    )


def flags_summary() -> Column:
    """Counts by severity and the first five codes in document order."""
    every = F.flatten("flags")
    count = lambda s: F.size(F.filter(every, lambda f: f.severity == s)).cast("long")
    return F.struct(count("error").alias("errors"), count("warning").alias("warnings"), count("suggestion").alias("suggestions"), F.slice(F.transform(every, lambda f: f.code), 1, 5).alias("top_codes"))
