"""Document metrics as Column expressions over arrays of words and sentences."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import bare, clip, is_alphabetic, let, mean, ratio, run_lengths, total, words


# --- naturalness -------------------------------------------------------------------------------


def sentence_lengths(sentences: Column) -> Column:
    return F.transform(sentences, lambda s: F.size(words(s)).cast("double"))


def burstiness(lengths: Column) -> Column:
    """Population standard deviation of sentence lengths over their mean."""

    def of(xs: Column) -> Column:
        return let(mean(xs), lambda m: ratio(F.sqrt(mean(F.transform(xs, lambda x: (x - m) * (x - m)))), m))

    return let(lengths, of)


def length_skewness(lengths: Column) -> Column:
    """Population skewness; 0 below three sentences or without variance."""

    def of(xs: Column) -> Column:
        moments = let(
            mean(xs),
            lambda m: F.struct(mean(F.transform(xs, lambda x: (x - m) * (x - m))).alias("two"), mean(F.transform(xs, lambda x: (x - m) * (x - m) * (x - m))).alias("three")),
        )
        return let(moments, lambda v: F.when((F.size(xs) >= 3) & (v.two > 1e-12), ratio(v.three, F.pow(v.two, 1.5))).otherwise(F.lit(0.0)))

    return let(lengths, of)


def word_frequencies(lowered: Column) -> Column:
    """Counts of distinct words, largest first."""
    return F.sort_array(run_lengths(F.sort_array(lowered)), asc=False)


def hapax_ratio(frequencies: Column) -> Column:
    return let(frequencies, lambda fs: ratio(F.size(F.filter(fs, lambda n: n == 1)), F.size(fs)))


def zipf_r2(frequencies: Column) -> Column:
    """R squared of a line through (ln rank, ln count); 1 if the counts do not differ, 0 without words."""
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("x", "y", "xx", "yy", "xy")))

    def add(a: Column, p: Column) -> Column:
        return F.struct(
            (a.x + p.x).alias("x"), (a.y + p.y).alias("y"), (a.xx + p.x * p.x).alias("xx"), (a.yy + p.y * p.y).alias("yy"), (a.xy + p.x * p.y).alias("xy")
        )

    def of(fs: Column) -> Column:
        n = F.size(fs).cast("double")
        points = F.transform(fs, lambda f, i: F.struct(F.ln(i + F.lit(1.0)).alias("x"), F.ln(f.cast("double")).alias("y")))
        fit = F.aggregate(points, zero, add, lambda a: ratio(F.pow(n * a.xy - a.x * a.y, 2.0), (n * a.xx - a.x * a.x) * (n * a.yy - a.y * a.y), 1.0))
        flat = F.get(fs, F.lit(0)) == F.get(fs, F.size(fs) - 1)
        return F.when(n == 0, F.lit(0.0)).when(flat, F.lit(1.0)).otherwise(fit)

    return let(frequencies, of)


def punctuation_entropy(text: Column) -> Column:
    """Shannon entropy, in bits, over the 32 ASCII punctuation characters."""

    def of(only: Column) -> Column:
        counts = F.filter(F.array(*(F.length(only) - F.length(F.replace(only, F.lit(c), F.lit(""))) for c in L.PUNCTUATION)), lambda k: k > 0)
        return let(F.length(only).cast("double"), lambda n: F.when(n > 0, -total(F.transform(counts, lambda k: k / n * F.log2(k / n)))).otherwise(F.lit(0.0)))

    return let(F.regexp_replace(text, r"[^!-/:-@\[-`{-~]", ""), of)


def starter_diversity(first_words: Column) -> Column:
    return ratio(F.size(F.array_distinct(first_words)), F.size(first_words))


def naturalness_score(b: Column, h: Column, z: Column, starters: Column) -> Column:
    raw = 40 * clip((b - 0.20) / 0.15) + 30 * clip((h - 0.35) / 0.10) + 15 * clip((0.96 - z) / 0.01) + 15 * F.least(starters, F.lit(1.0))
    return clip(raw, 0.0, 100.0)


# --- vocabulary --------------------------------------------------------------------------------


def type_token_ratio(lowered: Column) -> Column:
    return let(F.filter(lowered, is_alphabetic), lambda ws: ratio(F.size(F.array_distinct(ws)), F.size(ws)))


def neighbour_places(ws: Column) -> Column:
    """For each word in order ``p``, the place of its previous occurrence, or -1, and ``q``, how far from the end the next one lies, or -1: two sorts serve both directions."""
    found = F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def linked(s: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1), F.get(s, k + 1)
            return F.struct(
                x.i.alias("i"),
                F.when((k > 0) & (before.w == x.w), before.i).otherwise(-1).alias("p"),
                F.when(after.w == x.w, F.size(s) - 1 - after.i).otherwise(-1).alias("q"),
            )

        return F.transform(s, one)

    return F.sort_array(let(found, linked))


def mtld_factors(places: Column, threshold: float = 0.72) -> Column:
    """Number of factors of one direction, from the places of previous occurrences. A word is a new type of its factor if that place lies before the factor's start, so the fold's state is four numbers."""
    start = F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("types"), F.lit(0.0).alias("factors"))

    def step(a, p):
        types = a.types + F.when(p < a.start, 1).otherwise(0)
        n = a.n + 1
        ended = types / n <= threshold
        return F.when(ended, F.struct((a.start + n).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("types"), (a.factors + 1.0).alias("factors"))).otherwise(
            F.struct(a.start.alias("start"), n.alias("n"), types.alias("types"), a.factors.alias("factors"))
        )

    def end(a):
        return a.factors + F.when(a.n > 0, (1.0 - a.types / F.greatest(a.n, F.lit(1))) / (1.0 - threshold)).otherwise(F.lit(0.0))

    return F.aggregate(places, start, step, end)


def mtld(ws: Column) -> Column:
    """Mean of both directions over bare words; 0 below ten words or without a factor."""

    def of(v: Column) -> Column:
        forward = mtld_factors(F.transform(v, lambda x: x.p))
        back = mtld_factors(F.transform(F.reverse(v), lambda x: x.q))
        per = let(F.struct(forward.alias("f"), back.alias("b")), lambda p: (ratio(F.size(v), p.f) + ratio(F.size(v), p.b)) / 2 * F.when((p.f > 0) & (p.b > 0), 1.0).otherwise(0.0))
        return F.when(F.size(v) >= 10, per).otherwise(F.lit(0.0))

    return let(neighbour_places(ws), of)


def vocabulary_score(mtld_: Column, ttr: Column) -> Column:
    return clip(60 * F.least(mtld_ / 100, F.lit(1.0)) + 40 * F.least(ttr, F.lit(1.0)), 0.0, 100.0)


# --- readability -------------------------------------------------------------------------------

#: The seven grades, in order.
GRADES = [
    "flesch_kincaid_grade",
    "gunning_fog",
    "coleman_liau_index",
    "smog_index",
    "automated_readability_index",
    "dale_chall_readability_score",
    "linsear_write_formula",
]


def syllables(word: Column) -> Column:
    """Groups of vowels, less a silent final e; one at least. A rule, not a dictionary."""

    def of(w: Column) -> Column:
        groups = F.regexp_count(w, F.lit("[aeiouyà-öø-ÿ]+"))
        return let(groups, lambda n: F.when(n <= 1, 1).when(w.rlike(r"[^aeiouyl\W]e\W*$"), n - 1).otherwise(n))

    return let(F.lower(word), of)


def text_counts(ws: Column, n_sentences: Column, easy_words: list[str] | None = None) -> Column:
    """What the formulas need. Difficult words are those that are not in ``easy_words``, or, without a list, those of three syllables or more."""
    count = lambda xs: F.size(xs).cast("double")

    def of(ys: Column) -> Column:
        poly = count(F.filter(ys, lambda y: y >= 3))
        return F.struct(
            F.size(ws).cast("double").alias("w"),
            n_sentences.cast("double").alias("s"),
            F.aggregate(ys, F.lit(0).cast("long"), lambda a, y: a + y).cast("double").alias("y"),
            F.length(F.regexp_replace(F.array_join(ws, ""), r"[^\p{L}\p{N}]+", "")).cast("double").alias("c"),
            poly.alias("poly"),
            (count(F.filter(ws, lambda w: ~bare(w).isin(easy_words))) if easy_words else poly).alias("hard"),
            F.aggregate(F.slice(ys, 1, 100), F.lit(0), lambda a, y: a + F.when(y >= 3, 3).otherwise(1)).cast("double").alias("points"),
        )

    return let(F.transform(ws, syllables), of)


def grade_columns(c: Column, ends: Column) -> dict[str, Column]:
    """Published formulas over ``text_counts``; the last one over the first hundred words."""
    difficult = 100 * ratio(c.hard, c.w)
    out = {
        "flesch_kincaid_grade": 0.39 * ratio(c.w, c.s) + 11.8 * ratio(c.y, c.w) - 15.59,
        "gunning_fog": 0.4 * (ratio(c.w, c.s) + 100 * ratio(c.poly, c.w)),
        "coleman_liau_index": 0.0588 * (100 * ratio(c.c, c.w)) - 0.296 * (100 * ratio(c.s, c.w)) - 15.8,
        "smog_index": 1.043 * F.sqrt(30 * ratio(c.poly, c.s)) + 3.1291,
        "automated_readability_index": 4.71 * ratio(c.c, c.w) + 0.5 * ratio(c.w, c.s) - 21.43,
        "dale_chall_readability_score": 0.1579 * difficult + 0.0496 * ratio(c.w, c.s) + F.when(difficult > 5, 3.6365).otherwise(0.0),
        "linsear_write_formula": linsear(c.points, ends),
    }
    return {k: F.when(c.w > 0, v).otherwise(F.lit(0.0)) for k, v in out.items()}


def linsear_sentences(ws: Column) -> Column:
    """Sentence ends among the first hundred words; one at least."""
    return F.greatest(F.size(F.filter(F.slice(ws, 1, 100), lambda w: w.rlike("[.!?]$"))), F.lit(1)).cast("double")


def linsear(points: Column, n_sentences: Column) -> Column:
    r = ratio(points, n_sentences)
    return F.when(r > 20, r / 2).otherwise((r - 2) / 2)


def flesch_ease(c: Column) -> Column:
    return F.when(c.w > 0, 206.835 - 1.015 * ratio(c.w, c.s) - 84.6 * ratio(c.y, c.w)).otherwise(F.lit(0.0))


def gaussian_score(grade: Column, target: Column, sigma: Column) -> Column:
    """Falls faster above the target than below; 5 at least."""
    deviation = grade - target
    width = F.when(deviation > 0, 1.5 * sigma).otherwise(2.5 * sigma)
    return clip(100 * F.exp(-(deviation / width) * (deviation / width)), 5.0, 100.0)


# --- tone --------------------------------------------------------------------------------------


def latin_abbreviations(text: Column, patterns: list[str] = L.LATIN_ABBREVIATIONS) -> Column:
    none = F.expr("cast(array() as array<string>)")
    found = F.flatten(F.array(none, *(F.regexp_extract_all(text, F.lit("(?iuU)" + p), F.lit(0)) for p in patterns)))
    return F.when(text.rlike("(?iuU)(?:" + "|".join(patterns) + ")"), found).otherwise(none) if patterns else none


def nominalisations(bare_: Column, suffixes: list[str] = L.NOMINAL_SUFFIXES) -> Column:
    return F.array_distinct(F.filter(bare_, lambda w: (F.length(w) >= 6) & w.rlike("(" + "|".join(suffixes) + ")$")))


def tone_score(compound: Column, contraction_density: Column) -> Column:
    raw = 40 * F.greatest(F.lit(0.0), 1 - F.abs(compound)) + 30 + 40 * (1 - contraction_density)
    return clip(raw, 0.0, 100.0)


def hedges(sentence: Column, bare_: Column, phrases: list[str] = L.HEDGE_PHRASES, listed: list[str] = L.HEDGE_WORDS) -> Column:
    """Phrases, in the order of the list, then single words, in the order of the text; all lower case."""
    none = F.expr("cast(array() as array<string>)")
    found = F.flatten(F.array(none, *(F.transform(F.regexp_extract_all(sentence, F.lit(rf"(?iuU)\b{p}\b"), F.lit(0)), F.lower) for p in phrases)))
    if phrases:  # most sentences hold none: one search instead of one a phrase
        found = F.when(sentence.rlike(r"(?iuU)\b(?:" + "|".join(phrases) + r")\b"), found).otherwise(none)
    return F.concat(found, F.filter(bare_, lambda w: w.isin(listed)))


#: Fixed value: the information density of a sentence that has an alphabetic word, where there are no part-of-speech tags.
DENSITY = 0.6


def information_density(ws: Column) -> Column:
    return F.when(F.exists(ws, is_alphabetic), F.lit(DENSITY)).otherwise(F.lit(0.0))


def specificity(sentence: Column, ws: Column, suffixes: list[str] = L.NOMINAL_SUFFIXES) -> Column:
    numeric = F.size(F.filter(ws, lambda w: w.rlike(r"\p{Nd}")))
    nouns = F.filter(F.transform(ws, F.lower), lambda w: w.rlike(r"^\p{L}{4,}$"))
    abstract = F.size(F.filter(nouns, lambda w: w.rlike("(" + "|".join(suffixes) + ")$")))
    raw = F.when(F.size(ws) > 0, clip(0.3 * ratio(numeric, F.size(ws)) + 0.3 * (1 - ratio(abstract, F.size(nouns))))).otherwise(F.lit(0.0))
    return F.when(sentence.endswith("?"), F.greatest(raw, F.lit(0.15))).otherwise(raw)


def content_words(ws: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(ws, F.lower), lambda w: w.rlike(r"^\p{L}{3,}$")))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def coherence(overlap: Column, bridge: Column, marker: Column, similarity: Column | None = None, entities: Column | None = None) -> Column:
    """Similarity of vectors and shared entities are 0 unless given."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return 0.35 * (similarity if similarity is not None else F.lit(0.0)) + 0.25 * overlap + 0.20 * (entities if entities is not None else F.lit(0.0)) + 0.10 * flag(bridge) + 0.10 * flag(marker)


# --- detection, grades -------------------------------------------------------------------------


def probability_class(p: Column) -> Column:
    return F.when(p >= 0.7, "likely-ai").when(p <= 0.3, "likely-human").otherwise("uncertain")


def stylometric_class(b: Column, h: Column, z: Column) -> Column:
    return F.when((b < 0.20) & (h < 0.35) & (z > 0.96), "likely-ai").when((b > 0.35) & (h > 0.45), "likely-human").otherwise("uncertain")


def stylometric_probability(b: Column, h: Column, z: Column) -> Column:
    return 0.4 * clip(1 - b) + 0.3 * clip(1 - h) + 0.3 * clip(z)


def letter_grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")


def status(score: Column) -> Column:
    return F.when(score > 70, "good").when(score >= 40, "warning").otherwise("poor")


def composite(scores: dict[str, Column], weights: dict[str, Column]) -> Column:
    """Weighted mean of the scores that are not null; unweighted where those weights sum to 0. Rounded to one place."""
    weight = sum((F.when(s.isNotNull(), weights[k]).otherwise(0.0) for k, s in scores.items()), F.lit(0.0))
    value = sum((F.coalesce(s * weights[k], F.lit(0.0)) for k, s in scores.items()), F.lit(0.0))
    n = sum((F.when(s.isNotNull(), 1.0).otherwise(0.0) for s in scores.values()), F.lit(0.0))
    plain = ratio(sum((F.coalesce(s, F.lit(0.0)) for s in scores.values()), F.lit(0.0)), n)
    return F.round(clip(F.coalesce(F.try_divide(value, weight), plain), 0.0, 100.0), 1)
