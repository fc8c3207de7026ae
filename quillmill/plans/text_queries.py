"""Queries over the tables of documents, each beside its equivalent in DuckDB SQL.

Values that are computed in floating point are rounded to six places on both sides. Word lists
that never occur in the shipped tables are replaced by lists of words that do, so that a match
means something; ``tests`` cover the default lists on texts that hold them.
"""

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import metrics as M
from ..functions import text as T
from ..operators import analysis as A
from ..sources.tables import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Lists of words that the shipped texts hold.
COMMON = {
    "hedge_phrases": ["of the", "in the", "on the", "la de"],
    "hedge_words": ["and", "that", "with", "pour", "und", "para"],
    "bridging_pronouns": ["the", "it", "la", "die", "that"],
    "discourse_markers": ["and", "to", "is", "le", "las"],
    "modals": ["is", "be", "are"],
    "inclusive_pronouns": ["he", "you", "la"],
    "personal_pronouns": ["it", "he", "de"],
    "fillers": ["of", "in", "that"],
    "imperatives": ["the", "to", "la"],
}
CONTRACTIONS_FOUND = ["the", "of", "and", "la", "de"]
LATIN_FOUND = [r"\bthat\b", r"\bof\s+the\b", r"\ban[a-z]+\."]


def listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: Words (ws) and sentences (ss) of each document.
BASE = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT doc_id, lang, source, text,
    list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss
  FROM d
), s AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS idx FROM t),
w AS (SELECT doc_id, unnest(ws) AS word FROM t)
"""
WORDS_OF = r"list_filter(string_split_regex({x}, '\s+'), lambda y: y <> '')"
BARE = "trim(lower({x}), '.,;:!?\"''()[]')"
FIRST = "trim(lower(regexp_extract({x}, '^(\\S*)', 1)), '.,;:!?()[]')"
LENS = "list_transform(ss, lambda x: len(" + WORDS_OF.format(x="x") + ")::DOUBLE)"


def query(sql: str | None = None, base: bool = True):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (BASE if base else "") + sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    """Six places, as SQL engines round: the product with 10^6 to the nearest integer, halves away from 0. Rounding the decimal text instead would part from them on ties."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


def mean_of_tenths(c: str) -> Column:
    """The mean of a non-negative column of one decimal place, to four places, half up. Tenths are summed as integers, so the order of rows and ties do not matter."""
    total, n = F.sum(F.round(F.col(c) * 10).cast("long")), F.count(c)
    return F.floor((2000 * total + n) / (2 * n)) / 10000.0


_MEAN_OF_TENTHS = "floor((2000 * sum(round({c} * 10)::BIGINT) + count({c})) / (2 * count({c}))) / 10000.0"


#: Unicode words: DuckDB's \b knows ASCII ones only, so each character outside words is put between two marks, and a boundary is a mark or an end.
def marked(of: str) -> str:
    return rf"regexp_replace({of}, '([^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}])', chr(1) || '\1' || chr(1), 'g')"


def bounded(pattern: str) -> str:
    """A pattern with \b and spaces, for texts that ``marked`` has changed."""
    pattern = pattern.replace(r"\s+", " ").replace(" ", r"\x01 \x01").replace(r"\.", r"\x01\.")
    return "(?i)" + re.sub(r"\\b(?=\w)", r"(?:^|\\x01)", pattern).replace(r"\b", r"(?:\x01|$)")


def n_found(pattern: str, of: str) -> str:
    return f"len(regexp_extract_all({marked(of)}, '{bounded(pattern)}'))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_tokens(spread(read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "text"])))


def with_words(df: DataFrame) -> DataFrame:
    """Documents that have a word. The condition is on the text alone: one on words or sentences would be pushed below them, and so compute them twice."""
    return df.where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))


def worded(spark, sf_dir) -> DataFrame:
    return A.with_tokens(with_words(spread(read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "text"]))))


def one(spark, sf_dir, name: str, c: Column) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", c.alias(name))


# --- stage 0 -----------------------------------------------------------------------------------


@query("SELECT doc_id, len(ws) AS token_count, len(ss) AS n_sentences, CASE WHEN len(ws) = 0 THEN 'TEXT_TOO_SHORT' WHEN len(ws) > 8000 THEN 'TEXT_TOO_LONG' END AS error_code FROM t")
def doc_token_stats(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "token_count", F.size("sentences").cast("long").alias("n_sentences"), "error_code")


@query("SELECT doc_id, idx, sentence FROM s")
def sentence_split(spark, sf_dir):
    return T.each(docs(spark, sf_dir), "sentences", ["doc_id"], into="sentence")


@query("SELECT doc_id, len(ws) AS token_count, len(ws) > 1000 AS too_long FROM t WHERE len(ws) > 1000 OR len(ws) = 0")
def text_too_long(spark, sf_dir):
    found = A.with_tokens(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), max_tokens=1000)
    return found.where("error_code is not null").select("doc_id", "token_count", (F.col("error_code") == "TEXT_TOO_LONG").alias("too_long"))


# --- naturalness -------------------------------------------------------------------------------


@query("SELECT doc_id, idx, len(" + WORDS_OF.format(x="sentence") + ") AS n_words FROM s")
def sentence_lengths(spark, sf_dir):
    found = T.each(docs(spark, sf_dir), M.sentence_lengths(F.col("sentences")), ["doc_id"], into="n_words")
    return found.select("doc_id", "idx", F.col("n_words").cast("long").alias("n_words"))


@query(f"SELECT doc_id, round(coalesce(list_stddev_pop(lens) / nullif(list_avg(lens), 0), 0), 6) AS burstiness FROM (SELECT doc_id, {LENS} AS lens FROM t)")
def burstiness(spark, sf_dir):
    return one(spark, sf_dir, "burstiness", r6(M.burstiness(M.sentence_lengths(F.col("sentences")))))


@query(
    f"""SELECT doc_id, round(CASE WHEN len(lens) >= 3 AND m2 > 1e-12 THEN m3 / pow(m2, 1.5) ELSE 0 END, 6) AS length_skewness FROM (
  SELECT doc_id, lens, list_avg(list_transform(lens, lambda x: pow(x - m, 2))) AS m2, list_avg(list_transform(lens, lambda x: pow(x - m, 3))) AS m3
  FROM (SELECT doc_id, lens, list_avg(lens) AS m FROM (SELECT doc_id, {LENS} AS lens FROM t)))"""
)
def length_skewness(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("lens", M.sentence_lengths(F.col("sentences"))).select("doc_id", r6(M.length_skewness(F.col("lens"))).alias("length_skewness"))


@query(", f AS (SELECT doc_id, lower(word) AS word, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, round(count(*) FILTER (WHERE n = 1) / count(*), 6) AS hapax_ratio FROM f GROUP BY doc_id")
def hapax_ratio(spark, sf_dir):
    found = worded(spark, sf_dir).withColumn("f", M.word_frequencies(F.transform("words", F.lower)))
    return found.select("doc_id", r6(M.hapax_ratio(F.col("f"))).alias("hapax_ratio"))


@query(
    """, f AS (SELECT doc_id, lower(word) AS word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS k FROM f)
SELECT doc_id, round(CASE WHEN min(n) = max(n) THEN 1.0 ELSE regr_r2(ln(n), ln(k)) END, 6) AS zipf_r_squared FROM r GROUP BY doc_id"""
)
def zipf_r2(spark, sf_dir):
    found = worded(spark, sf_dir).withColumn("f", M.word_frequencies(F.transform("words", F.lower)))
    return found.select("doc_id", r6(M.zipf_r2(F.col("f"))).alias("zipf_r_squared"))


@query(r"SELECT doc_id, round(coalesce(list_entropy(list_filter(string_split(array_to_string(ws, ' '), ''), lambda c: regexp_matches(c, '[!-/:-@\[-`{-~]'))), 0), 6) AS punctuation_entropy FROM t")
def punctuation_entropy(spark, sf_dir):
    return one(spark, sf_dir, "punctuation_entropy", r6(M.punctuation_entropy(F.array_join("words", " "))))


@query(r"SELECT doc_id, round(count(DISTINCT lower(regexp_extract(sentence, '^(\S*)', 1))) / count(*), 6) AS starter_diversity FROM s GROUP BY doc_id")
def starter_diversity(spark, sf_dir):
    return worded(spark, sf_dir).select("doc_id", r6(M.starter_diversity(F.transform("sentences", T.first_word))).alias("starter_diversity"))


NATURAL = f"""
, f AS (SELECT doc_id, lower(word) AS word, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS k FROM f),
z AS (SELECT doc_id, count(*) FILTER (WHERE n = 1) / count(*) AS h, CASE WHEN min(n) = max(n) THEN 1.0 ELSE regr_r2(ln(n), ln(k)) END AS z FROM r GROUP BY doc_id),
st AS (SELECT doc_id, count(DISTINCT lower(regexp_extract(sentence, '^(\\S*)', 1))) / count(*) AS starters FROM s GROUP BY doc_id),
b AS (SELECT doc_id, coalesce(list_stddev_pop(lens) / nullif(list_avg(lens), 0), 0) AS b FROM (SELECT doc_id, {LENS} AS lens FROM t)),
nat AS (SELECT t.doc_id, t.lang, t.source, coalesce(b, 0) AS b, coalesce(h, 0) AS h, coalesce(z, 0) AS z, coalesce(starters, 0) AS starters FROM t LEFT JOIN b USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN st USING (doc_id)),
ns AS (SELECT *, least(100, greatest(0, 40 * least(1, greatest(0, (b - 0.20) / 0.15)) + 30 * least(1, greatest(0, (h - 0.35) / 0.10)) + 15 * least(1, greatest(0, (0.96 - z) / 0.01)) + 15 * least(starters, 1))) AS naturalness FROM nat)
"""


@query(NATURAL + "SELECT doc_id, round(naturalness, 6) AS naturalness FROM ns")
def naturalness_score(spark, sf_dir):
    found = A.with_naturalness(docs(spark, sf_dir))
    return found.select("doc_id", r6(M.naturalness_score(F.col("burstiness"), F.col("hapax_ratio"), F.col("zipf_r_squared"), F.col("starter_diversity"))).alias("naturalness"))


@query(
    NATURAL
    + """SELECT doc_id, CASE WHEN b < 0.20 AND h < 0.35 AND z > 0.96 THEN 'likely-ai' WHEN b > 0.35 AND h > 0.45 THEN 'likely-human' ELSE 'uncertain' END AS stylometric_class,
 round(0.4 * least(1, greatest(0, 1 - b)) + 0.3 * least(1, greatest(0, 1 - h)) + 0.3 * least(1, greatest(0, z)), 6) AS probability FROM nat"""
)
def stylometric_class(spark, sf_dir):
    found = A.with_naturalness(docs(spark, sf_dir))
    three = [F.col(c) for c in ("burstiness", "hapax_ratio", "zipf_r_squared")]
    return found.select("doc_id", M.stylometric_class(*three).alias("stylometric_class"), r6(M.stylometric_probability(*three)).alias("probability"))


@query("SELECT doc_id, 'uncertain' AS classification, 0.5::DOUBLE AS ai_probability, 'stylometric' AS detection_method FROM t")
def detection_default(spark, sf_dir):
    """What the pipeline reports without a detector, which never sees the naturalness metrics."""
    return docs(spark, sf_dir).select("doc_id", M.probability_class(F.lit(0.5)).alias("classification"), F.lit(0.5).alias("ai_probability"), F.lit("stylometric").alias("detection_method"))


@query(NATURAL + ", l AS (SELECT DISTINCT doc_id, quality FROM labels) SELECT quality, count(*) AS n, round(avg(naturalness), 6) AS mean_naturalness FROM ns JOIN l USING (doc_id) GROUP BY quality")
def calibration_by_label(spark, sf_dir):
    found = A.with_naturalness(docs(spark, sf_dir)).select("doc_id", M.naturalness_score(F.col("burstiness"), F.col("hapax_ratio"), F.col("zipf_r_squared"), F.col("starter_diversity")).alias("v"))
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"]).distinct()
    return found.join(labels, "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v")).alias("mean_naturalness"))


# --- vocabulary --------------------------------------------------------------------------------


@query(r"SELECT doc_id, round(coalesce(count(DISTINCT lower(word)) FILTER (WHERE regexp_matches(word, '^\p{L}+$')) / nullif(count(*) FILTER (WHERE regexp_matches(word, '^\p{L}+$')), 0), 0), 6) AS ttr FROM w GROUP BY doc_id")
def type_token_ratio(spark, sf_dir):
    return worded(spark, sf_dir).select("doc_id", r6(M.type_token_ratio(F.transform("words", F.lower))).alias("ttr"))


_FACTORS = """list_reduce(list_prepend({{'types': []::VARCHAR[], 'n': 0.0::DOUBLE, 'f': 0.0::DOUBLE}}, list_transform({x}, lambda y: {{'types': [y], 'n': 1.0::DOUBLE, 'f': 0.0::DOUBLE}})), lambda a, y:
  CASE WHEN len(CASE WHEN list_contains(a.types, y.types[1]) THEN a.types ELSE list_append(a.types, y.types[1]) END) / (a.n + 1) <= 0.72
  THEN {{'types': []::VARCHAR[], 'n': 0.0::DOUBLE, 'f': a.f + 1}}
  ELSE {{'types': CASE WHEN list_contains(a.types, y.types[1]) THEN a.types ELSE list_append(a.types, y.types[1]) END, 'n': a.n + 1, 'f': a.f}} END)"""
MTLD = (
    ", bw AS (SELECT doc_id, list_filter(list_transform(ws, lambda x: " + BARE.format(x="x") + "), lambda x: x <> '') AS bs FROM t), "
    "fold AS (SELECT doc_id, len(bs) AS k, " + _FACTORS.format(x="bs") + " AS a, " + _FACTORS.format(x="list_reverse(bs)") + " AS b FROM bw), "
    "parts AS (SELECT doc_id, k, a.f + CASE WHEN a.n > 0 THEN (1 - len(a.types) / a.n) / (1 - 0.72) ELSE 0 END AS fa, b.f + CASE WHEN b.n > 0 THEN (1 - len(b.types) / b.n) / (1 - 0.72) ELSE 0 END AS fb FROM fold), "
    "mt AS (SELECT doc_id, CASE WHEN k >= 10 AND fa > 0 AND fb > 0 THEN (k / fa + k / fb) / 2 ELSE 0 END AS mtld FROM parts)"
)


@query(MTLD + " SELECT doc_id, round(mtld, 6) AS mtld FROM mt")
def mtld(spark, sf_dir):
    found = docs(spark, sf_dir).withColumn("bare", F.filter(T.bare_words(F.col("words")), lambda w: w != ""))
    return found.select("doc_id", r6(M.mtld(F.col("bare"))).alias("mtld"))


TTR = r", tt AS (SELECT doc_id, coalesce(count(DISTINCT lower(word)) FILTER (WHERE regexp_matches(word, '^\p{L}+$')) / nullif(count(*) FILTER (WHERE regexp_matches(word, '^\p{L}+$')), 0), 0) AS ttr FROM w GROUP BY doc_id)"


@query(MTLD + TTR + " SELECT doc_id, round(least(100, 60 * least(mtld / 100, 1) + 40 * least(coalesce(ttr, 0), 1)), 6) AS vocabulary FROM mt LEFT JOIN tt USING (doc_id)")
def vocabulary_score(spark, sf_dir):
    found = A.with_vocabulary(docs(spark, sf_dir))
    return found.select("doc_id", r6(M.vocabulary_score(F.col("mtld"), F.col("ttr"))).alias("vocabulary"))


@query("SELECT doc_id, 0.0::DOUBLE AS passive_voice_ratio FROM t")
def passive_ratio(spark, sf_dir):
    """Without a parse; ``deep.passive_ratio`` takes a table of tokens."""
    return one(spark, sf_dir, "passive_voice_ratio", F.lit(0.0))


# --- readability -------------------------------------------------------------------------------

_SYLL = "greatest(1, len(regexp_extract_all(lower({x}), '[aeiouyà-öø-ÿ]+')) - CASE WHEN regexp_matches(lower({x}), '[^aeiouyl\\W]e\\W*$') AND len(regexp_extract_all(lower({x}), '[aeiouyà-öø-ÿ]+')) > 1 THEN 1 ELSE 0 END)"
COUNTS = (
    ", sy AS (SELECT doc_id, len(ws)::DOUBLE AS w, len(ss)::DOUBLE AS s, ws, list_transform(ws, lambda x: " + _SYLL.format(x="x") + ") AS sy, "
    r"length(regexp_replace(array_to_string(ws, ''), '[^\p{L}\p{N}]', '', 'g'))::DOUBLE AS c FROM t), "
    "cn AS (SELECT doc_id, w, s, c, coalesce(list_sum(sy), 0)::DOUBLE AS y, len(list_filter(sy, lambda x: x >= 3))::DOUBLE AS poly, "
    "coalesce(list_sum(list_transform(sy[1:100], lambda x: CASE WHEN x >= 3 THEN 3 ELSE 1 END)), 0)::DOUBLE AS points, greatest(1, len(list_filter(ws[1:100], lambda x: regexp_matches(x, '[.!?]$'))))::DOUBLE AS ends FROM sy), "
    """gr AS (SELECT doc_id, 0.39 * w / s + 11.8 * y / w - 15.59 AS fk, 0.4 * (w / s + 100 * poly / w) AS fog, 0.0588 * (100 * c / w) - 0.296 * (100 * s / w) - 15.8 AS cli,
 1.043 * sqrt(30 * poly / s) + 3.1291 AS smog, 4.71 * c / w + 0.5 * w / s - 21.43 AS ari, 0.1579 * (100 * poly / w) + 0.0496 * w / s + CASE WHEN 100 * poly / w > 5 THEN 3.6365 ELSE 0 END AS dc,
 CASE WHEN points / ends > 20 THEN points / ends / 2 ELSE (points / ends - 2) / 2 END AS lw, 206.835 - 1.015 * w / s - 84.6 * y / w AS fre FROM cn WHERE w > 0)"""
)


def readable(spark, sf_dir) -> DataFrame:
    return A.with_readability(worded(spark, sf_dir))


@query(COUNTS + " SELECT doc_id, round(ari, 6) AS automated_readability_index, round(cli, 6) AS coleman_liau_index FROM gr")
def ari_and_coleman_liau(spark, sf_dir):
    return readable(spark, sf_dir).select("doc_id", r6("automated_readability_index").alias("automated_readability_index"), r6("coleman_liau_index").alias("coleman_liau_index"))


@query(COUNTS + " SELECT doc_id, round(fk, 6) AS flesch_kincaid_grade, round(fre, 6) AS flesch_reading_ease, round(fog, 6) AS gunning_fog, round(smog, 6) AS smog_index FROM gr")
def flesch_family(spark, sf_dir):
    return readable(spark, sf_dir).select("doc_id", *(r6(c).alias(c) for c in ("flesch_kincaid_grade", "flesch_reading_ease", "gunning_fog", "smog_index")))


@query(COUNTS + " SELECT doc_id, round(lw, 6) AS linsear_write_formula, round(dc, 6) AS dale_chall_readability_score FROM gr")
def linsear_and_dale_chall(spark, sf_dir):
    return readable(spark, sf_dir).select("doc_id", r6("linsear_write_formula").alias("linsear_write_formula"), r6("dale_chall_readability_score").alias("dale_chall_readability_score"))


CONSENSUS = COUNTS + ", cg AS (SELECT doc_id, round((fk + fog + cli + smog + ari + dc + lw) / 7, 1) + 0.0 AS grade FROM gr)"


@query(CONSENSUS + " SELECT doc_id, grade AS consensus_grade FROM cg")
def consensus_grade(spark, sf_dir):
    return readable(spark, sf_dir).select("doc_id", "consensus_grade")


_GAUSS = "least(100, greatest(5, 100 * exp(-pow(({g} - {t}) / (CASE WHEN {g} > {t} THEN 1.5 ELSE 2.5 END * {s}), 2))))"


@query(CONSENSUS + " SELECT doc_id, round(" + _GAUSS.format(g="grade", t="10.0", s="4.0") + ", 6) AS readability, round(" + _GAUSS.format(g="grade", t="14.0", s="3.0") + ", 6) AS for_technical_docs FROM cg")
def gaussian_readability(spark, sf_dir):
    score = lambda persona: r6(M.gaussian_score(F.col("consensus_grade"), *(F.lit(x) for x in L.READABILITY_TARGETS.get(persona, L.DEFAULT_TARGET))))
    return readable(spark, sf_dir).select("doc_id", score("").alias("readability"), score("technical-docs").alias("for_technical_docs"))


_SENT_COUNTS = (
    COUNTS.replace("FROM t)", "FROM st2)", 1).replace("SELECT doc_id, len(ws)", "SELECT key AS doc_id, len(ws)", 1)
)


@query(
    ", st2 AS (SELECT doc_id || ':' || idx AS key, " + WORDS_OF.format(x="sentence") + " AS ws, [sentence] AS ss FROM s)" + _SENT_COUNTS
    + " SELECT split_part(doc_id, ':', 1)::BIGINT AS doc_id, split_part(doc_id, ':', 2)::BIGINT AS idx, round((fk + fog + cli + smog + ari + dc + lw) / 7, 1) + 0.0 AS grade FROM gr"
)
def sentence_grades(spark, sf_dir):
    rows = T.each(docs(spark, sf_dir), "sentences", ["doc_id"], into="sentence")
    found = A.with_readability(rows.select("doc_id", "idx", T.words(F.col("sentence")).alias("words"), F.array("sentence").alias("sentences")))
    return found.select("doc_id", "idx", F.col("consensus_grade").alias("grade"))


# --- tone --------------------------------------------------------------------------------------


@query(f"SELECT doc_id, round(count(*) FILTER (WHERE lower(word) IN ({listed(CONTRACTIONS_FOUND)})) / count(*), 6) AS density, round(count(*) FILTER (WHERE lower(word) IN ({listed(L.CONTRACTIONS)})) / count(*), 6) AS by_default FROM w GROUP BY doc_id")
def contraction_density(spark, sf_dir):
    of = lambda listed_: r6(T.ratio(T.count_in(F.transform("words", F.lower), listed_), F.size("words")))
    return worded(spark, sf_dir).select("doc_id", of(CONTRACTIONS_FOUND).alias("density"), of(L.CONTRACTIONS).alias("by_default"))


@query("SELECT doc_id, " + " + ".join(n_found(p, "array_to_string(ws, ' ')") for p in LATIN_FOUND) + " AS n_found FROM t")
def latin_abbreviations(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", M.latin_abbreviations(F.array_join("words", " "), LATIN_FOUND).alias("x"))
    return found.select("doc_id", F.size("x").cast("long").alias("n_found"))


NOMINAL = "list_filter(list_transform(ws, lambda x: " + BARE.format(x="x") + "), lambda x: length(x) >= 6 AND regexp_matches(x, '(" + "|".join(L.NOMINAL_SUFFIXES) + ")$'))"


@query(f"SELECT doc_id, len(list_distinct({NOMINAL})) AS n_distinct, array_to_string(list_sort(list_distinct({NOMINAL})), ' ') AS nominalisations FROM t")
def nominalisations(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", M.nominalisations(T.bare_words(F.col("words"))).alias("x"))
    return found.select("doc_id", F.size("x").cast("long").alias("n_distinct"), F.array_join(F.sort_array("x"), " ").alias("nominalisations"))


@query(f"SELECT doc_id, round(least(100, 40 + 30 + 40 * (1 - coalesce((SELECT count(*) FROM w WHERE w.doc_id = t.doc_id AND lower(word) IN ({listed(L.CONTRACTIONS)})) / nullif(len(ws), 0), 0))), 6) AS tone_compliance FROM t")
def tone_score(spark, sf_dir):
    found = docs(spark, sf_dir).withColumn("cd", T.ratio(T.count_in(F.transform("words", F.lower), L.CONTRACTIONS), F.size("words")))
    return found.select("doc_id", r6(M.tone_score(F.lit(0.0), F.col("cd"))).alias("tone_compliance"))


# --- sentence signals --------------------------------------------------------------------------

_HEDGES = "(" + " + ".join(n_found(rf"\b{p}\b", "sentence") for p in COMMON["hedge_phrases"]) + ") + len(list_filter(list_transform(" + WORDS_OF.format(x="sentence") + ", lambda x: " + BARE.format(x="x") + f"), lambda x: x IN ({listed(COMMON['hedge_words'])})))"
SIGNALS = (
    r""", q AS (SELECT doc_id, idx, sentence, """ + WORDS_OF.format(x="sentence") + " AS sw, " + _HEDGES + " AS hedge_count, " + FIRST.format(x="sentence") + r""" AS opens FROM s),
v AS (SELECT *, list_filter(list_transform(sw, lambda x: lower(x)), lambda x: regexp_matches(x, '^\p{L}{4,}$')) AS nouns, list_distinct(list_filter(list_transform(sw, lambda x: lower(x)), lambda x: regexp_matches(x, '^\p{L}{3,}$'))) AS content FROM q),
g AS (SELECT doc_id, idx, sentence, sw, hedge_count, opens, content,
  CASE WHEN len(list_filter(sw, lambda x: regexp_matches(x, '^\p{L}+$'))) > 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS density,
  greatest(CASE WHEN sentence LIKE '%?' THEN 0.15 ELSE 0 END, 0.3 * len(list_filter(sw, lambda x: regexp_matches(x, '\p{Nd}'))) / len(sw) + 0.3 * (1 - coalesce(len(list_filter(nouns, lambda x: regexp_matches(x, '(""" + "|".join(L.NOMINAL_SUFFIXES) + r""")$'))) / nullif(len(nouns), 0), 0)))::DOUBLE AS specificity,
  lead(content) OVER n AS next_content, lead(opens) OVER n AS next_opens FROM v WINDOW n AS (PARTITION BY doc_id ORDER BY idx)),
h AS (SELECT *, CASE WHEN next_opens IS NOT NULL THEN 0.25 * coalesce(len(list_intersect(content, next_content)) / nullif(len(list_distinct(list_concat(content, next_content))), 0), 0)
  + CASE WHEN next_opens IN (""" + listed(COMMON["bridging_pronouns"]) + ") THEN 0.1 ELSE 0 END + CASE WHEN next_opens IN (" + listed(COMMON["discourse_markers"]) + ") THEN 0.1 ELSE 0 END END::DOUBLE AS coherence FROM g)\n"
)


def signalled(spark, sf_dir) -> DataFrame:
    return A.with_sentence_signals(docs(spark, sf_dir), COMMON)


@query(SIGNALS + "SELECT doc_id, idx, hedge_count FROM h")
def hedge_counts(spark, sf_dir):
    found = T.each(signalled(spark, sf_dir), "signals", ["doc_id"])
    return found.select("doc_id", "idx", F.col("x.hedge_count").cast("long").alias("hedge_count"))


@query(SIGNALS + "SELECT doc_id, idx, round(density, 6) AS information_density, round(specificity, 6) AS specificity, round(coherence, 6) AS coherence_to_next FROM h")
def sentence_signals(spark, sf_dir):
    found = T.each(signalled(spark, sf_dir), "signals", ["doc_id"])
    return found.select("doc_id", "idx", r6("x.information_density").alias("information_density"), r6("x.specificity").alias("specificity"), r6("x.coherence_to_next").alias("coherence_to_next"))


@query(SIGNALS + "SELECT doc_id, round(0.6 * count(*) FILTER (WHERE density > 0) / count(*), 6) AS mean_density, round(avg(specificity), 6) AS mean_specificity, round(coalesce(avg(coherence), 0), 6) AS mean_coherence FROM h GROUP BY doc_id")
def signal_means(spark, sf_dir):
    return A.with_sentence_signals(worded(spark, sf_dir), COMMON).select("doc_id", *(r6(c).alias(c) for c in ("mean_density", "mean_specificity", "mean_coherence")))


def _share(key: str) -> str:
    return f"len(list_filter(bs, lambda x: x IN ({listed(COMMON[key])}))) / greatest(len(ws), 1)"


DERIVED = SIGNALS + (
    ", ds AS (SELECT doc_id, sum(hedge_count) AS hedges, 0.6::DOUBLE * count(*) FILTER (WHERE density > 0) / count(*) AS info, count(*) FILTER (WHERE hedge_count = 0) / count(*) AS assertion, count(*) FILTER (WHERE regexp_matches(sentence, '[!?]$')) / count(*) AS excl, "
    "count(*) FILTER (WHERE sentence LIKE '%?') / count(*) AS quest, count(*) FILTER (WHERE " + BARE.format(x="sw[1]") + f" IN ({listed(COMMON['imperatives'])})) / count(*) AS imper FROM h GROUP BY doc_id), "
    "bt AS (SELECT doc_id, lang, ws, ss, list_transform(ws, lambda x: " + BARE.format(x="x") + f") AS bs, coalesce(list_stddev_pop({LENS}) / nullif(list_avg({LENS}), 0), 0) AS burst FROM t WHERE len(ss) > 0), "
    "dv AS (SELECT bt.doc_id, lang, hedges / greatest(len(ws), 1) AS hedge, info, " + _share("modals") + " AS modal, assertion, excl, " + _share("inclusive_pronouns") + " AS incl, imper, quest, burst, least(burst, 1) AS lenvar, "
    + _share("fillers") + " AS filler, " + _share("personal_pronouns") + f" AS pers, len(ws) / greatest(len(ss), 1) AS asl, len(list_filter(ws, lambda x: lower(x) IN ({listed(L.CONTRACTIONS)}))) / greatest(len(ws), 1) AS cd FROM bt JOIN ds USING (doc_id))"
)
_DERIVED_NAMES = {
    "hedge": "hedge_density", "info": "info_density_mean", "modal": "modal_density", "assertion": "assertion_ratio", "excl": "exclamation_density", "incl": "inclusive_density",
    "imper": "imperative_ratio", "quest": "question_ratio", "lenvar": "length_variation", "filler": "filler_density", "pers": "personal_density", "asl": "avg_sentence_length",
}


def derived(spark, sf_dir) -> DataFrame:
    found = A.with_naturalness(A.with_sentence_signals(worded(spark, sf_dir), COMMON))
    return A.with_derived_signals(A.with_tone(found.withColumn("bare", T.bare_words(F.col("words")))), COMMON)


@query(DERIVED + " SELECT doc_id, " + ", ".join(f"round({k}, 6) AS {v}" for k, v in _DERIVED_NAMES.items()) + " FROM dv")
def derived_signals(spark, sf_dir):
    return derived(spark, sf_dir).select("doc_id", *(r6(c).alias(c) for c in _DERIVED_NAMES.values()))


TONE6 = """, td AS (SELECT doc_id, lang, 0.75 * (1 - cd) + 0.125 AS formality, 0.4 * (1 - least(10 * hedge, 1)) + 0.3 * (1 - least(10 * modal, 1)) + 0.2 * assertion AS confidence,
 0.35 * least(20 * incl, 1) + 0.2 + 0.1 * least(excl, 1) AS warmth, 0.35 * (1 - least(10 * hedge, 1)) + 0.3 + 0.2 * imper + 0.15 * (1 - quest) AS directness,
 0.35 * least(burst, 1) + 0.25 * least(excl, 1) + 0.25 + 0.15 * least(lenvar, 1) AS energy, 0.35 * least(asl / 30, 1) + 0.25 * least(20 * filler, 1) + 0.25 * (1 - info) AS verbosity FROM dv)"""


@query(DERIVED + TONE6 + " SELECT doc_id, " + ", ".join(f"round({d}, 6) AS {d}" for d in L.TONE_DIMENSIONS) + " FROM td")
def tone_dimensions(spark, sf_dir):
    return A.with_tone_dimensions(derived(spark, sf_dir)).select("doc_id", *(r6(d).alias(d) for d in L.TONE_DIMENSIONS))


# --- health ------------------------------------------------------------------------------------

HEALTH = NATURAL + MTLD + TTR + CONSENSUS + (
    f", cd AS (SELECT doc_id, count(*) FILTER (WHERE lower(word) IN ({listed(L.CONTRACTIONS)})) / count(*) AS cd FROM w GROUP BY doc_id), "
    "dim AS (SELECT ns.doc_id, ns.lang, ns.source, " + _GAUSS.format(g="grade", t="10.0", s="4.0") + " AS readability, naturalness, least(100, 60 * least(mtld / 100, 1) + 40 * least(ttr, 1)) AS vocabulary, least(100, 70 + 40 * (1 - cd)) AS tone_compliance "
    "FROM ns JOIN mt USING (doc_id) JOIN tt USING (doc_id) JOIN cg USING (doc_id) JOIN cd USING (doc_id)), "
    "comp AS (SELECT *, round((0.25 * readability + 0.30 * naturalness + 0.20 * vocabulary + 0.10 * tone_compliance) / 0.85, 1) AS composite FROM dim), "
    "graded AS (SELECT *, CASE WHEN composite >= 85 THEN 'A' WHEN composite >= 70 THEN 'B' WHEN composite >= 55 THEN 'C' WHEN composite >= 40 THEN 'D' ELSE 'F' END AS grade FROM comp)"
)
_STATUS = "CASE WHEN {d} > 70 THEN 'good' WHEN {d} >= 40 THEN 'warning' ELSE 'poor' END AS {d}_status"
SCORED = [d for d in L.DIMENSIONS if d != "semantic_preservation"]


def health(spark, sf_dir, **how) -> DataFrame:
    return A.analysed(with_words(spread(read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "text"]))), **how)


@query(HEALTH + " SELECT doc_id, " + ", ".join(f"round({d}, 6) AS {d}, " + _STATUS.format(d=d) for d in SCORED) + " FROM dim")
def dimension_scores(spark, sf_dir):
    return health(spark, sf_dir).select("doc_id", *(r6(d).alias(d) for d in SCORED), *(f"{d}_status" for d in SCORED))


@query(HEALTH + " SELECT doc_id, composite, grade FROM graded")
def composite_health(spark, sf_dir):
    return health(spark, sf_dir).select("doc_id", "composite", "grade")


@query(HEALTH + " SELECT lang, grade, count(*) AS n, " + _MEAN_OF_TENTHS.format(c="composite") + " AS mean_composite FROM graded GROUP BY lang, grade")
def grade_distribution(spark, sf_dir):
    return health(spark, sf_dir).groupBy("lang", "grade").agg(F.count(F.lit(1)).alias("n"), mean_of_tenths("composite").alias("mean_composite"))


@query(HEALTH + " SELECT lang, source, count(*) AS n, " + _MEAN_OF_TENTHS.format(c="composite") + " AS mean_composite FROM graded GROUP BY CUBE (lang, source)")
def health_cube(spark, sf_dir):
    """Extension: corpus rollups by language and source."""
    return health(spark, sf_dir).cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), mean_of_tenths("composite").alias("mean_composite"))


def _focus_sql(primary: str) -> str:
    return "round((" + " + ".join(f"{0.70 if d == primary else 0.075} * {d}" for d in SCORED) + f") / {0.70 + 3 * 0.075}, 1)"


@query(HEALTH + " SELECT doc_id, " + ", ".join(f"{_focus_sql(p)} AS {m}" for m, p in L.FOCUS_MODES.items()) + " FROM dim")
def focus_weight_scores(spark, sf_dir):
    found = health(spark, sf_dir)
    scores = {d: F.col(d) for d in L.DIMENSIONS}
    made = {f"focus_{m}": M.composite(scores, {d: F.lit(w) for d, w in A.weights_for(m).items()}) for m in L.FOCUS_MODES}
    return found.withColumns(made).select("doc_id", *(F.col(f"focus_{m}").alias(m) for m in L.FOCUS_MODES))


# --- flags -------------------------------------------------------------------------------------

REDUNDANT = """, us AS (SELECT doc_id, idx, list_distinct(list_transform(""" + WORDS_OF.format(x="sentence") + """, lambda x: lower(x))) AS u FROM s),
red AS (SELECT a.doc_id, a.idx FROM us a WHERE EXISTS (SELECT 1 FROM us b WHERE b.doc_id = a.doc_id AND b.idx < a.idx
  AND least(len(a.u), len(b.u)) >= 0.6 * greatest(len(a.u), len(b.u)) AND len(list_intersect(a.u, b.u)) / (len(a.u) + len(b.u) - len(list_intersect(a.u, b.u))) >= 0.6))"""


@query(REDUNDANT + " SELECT doc_id, idx FROM red")
def redundant_sentences(spark, sf_dir):
    found = A.with_redundancy(docs(spark, sf_dir))
    return T.each(found, "redundant", ["doc_id"], "nth").select("doc_id", F.col("x").cast("long").alias("idx"))


FLAGS = SIGNALS + REDUNDANT + """, fl AS (
 SELECT doc_id, idx, 1 AS place, 'LONG_SENTENCE' AS code, 'warning' AS severity FROM h WHERE len(sw) > 30
 UNION ALL SELECT doc_id, idx, 2, 'SHORT_SENTENCE', 'suggestion' FROM h WHERE len(sw) < 5
 UNION ALL SELECT doc_id, idx, 3, 'HIGH_HEDGE_COUNT', 'warning' FROM h WHERE hedge_count >= 2
 UNION ALL SELECT doc_id, idx, 4, 'LOW_DENSITY', 'warning' FROM h WHERE density < 0.35
 UNION ALL SELECT doc_id, idx, 5, 'VAGUE', 'suggestion' FROM h WHERE specificity < 0.25
 UNION ALL SELECT doc_id, idx, 6, 'LOW_COHERENCE', 'suggestion' FROM h WHERE coherence < 0.10
 UNION ALL SELECT doc_id, idx, 7, 'REDUNDANT', 'suggestion' FROM red)"""


def flagged(spark, sf_dir) -> DataFrame:
    return A.with_flags(A.with_redundancy(signalled(spark, sf_dir)))


@query(FLAGS + " SELECT doc_id, idx, place, code, severity FROM fl")
def sentence_flags(spark, sf_dir):
    order = F.create_map(*(F.lit(x) for i, c in enumerate(("LONG_SENTENCE", "SHORT_SENTENCE", "HIGH_HEDGE_COUNT", "LOW_DENSITY", "VAGUE", "LOW_COHERENCE", "REDUNDANT"), 1) for x in (c, i)))
    listed_ = F.flatten(F.transform("flags", lambda fs, i: F.transform(fs, lambda f: F.struct(i.cast("long").alias("idx"), f.code.alias("code"), f.severity.alias("severity")))))
    found = T.each(flagged(spark, sf_dir), listed_, ["doc_id"], "nth").select("doc_id", "x.*")
    return found.select("doc_id", "idx", order[F.col("code")].alias("place"), "code", "severity")


@query(FLAGS + ", rk AS (SELECT *, CASE severity WHEN 'error' THEN 0.9 WHEN 'warning' THEN 0.7 ELSE 0.4 END::DOUBLE AS impact FROM fl), tp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY impact DESC, idx, place) AS rank FROM rk) SELECT doc_id, rank, idx, code, impact FROM tp WHERE rank <= 5")
def top_suggestions(spark, sf_dir):
    found = T.each(A.with_suggestions(flagged(spark, sf_dir)), "suggestions", ["doc_id"], "rank")
    return found.select("doc_id", (F.col("rank") + 1).alias("rank"), F.col("x.sentence_index").cast("long").alias("idx"), F.col("x.flag_code").alias("code"), F.col("x.impact").alias("impact"))


@query(FLAGS + " SELECT doc_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'suggestion') AS suggestions, coalesce(array_to_string((list(code ORDER BY idx, place) FILTER (WHERE code IS NOT NULL))[1:5], ','), '') AS top_codes FROM t LEFT JOIN fl USING (doc_id) GROUP BY doc_id")
def flags_summary(spark, sf_dir):
    found = flagged(spark, sf_dir).select("doc_id", A.flags_summary().alias("s")).select("doc_id", "s.*")
    return found.withColumn("top_codes", F.array_join("top_codes", ","))
