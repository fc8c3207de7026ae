"""Queries for rules, personas, comparison, search and model output, beside their DuckDB SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import metrics as M
from ..functions import text as T
from ..operators import analysis as A
from ..operators import compare as C
from ..operators import deep as D
from ..operators import rules as R
from ..operators import search as S
from ..sources.tables import read_table, spread
from . import text_queries as Q
from .text_queries import BASE, QUERIES, SQL, query, r6

def texts(spark, sf_dir) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents", ["doc_id", "lang", "text"]))


def counted(spark, sf_dir, rule: dict) -> DataFrame:
    found = texts(spark, sf_dir).select("doc_id", R.compile_rule(rule, F.col("text")).alias("m"))
    return found.select("doc_id", F.size("m").cast("long").alias("n_matches"))


def hits(token: str, of: str = "text") -> str:
    return Q.n_found(rf"\b{token}\b", of)


@query(f"SELECT doc_id, {hits('the')} + {hits('of the')} + len(regexp_extract_all(text, '(?i)an[a-z]+ion')) AS n_matches FROM documents", base=False)
def rule_existence(spark, sf_dir):
    return counted(spark, sf_dir, {"type": "existence", "tokens": ["the", "of the"], "raw": ["an[a-z]+ion", "("]})


@query(f"SELECT doc_id, {hits('and')} + {hits('that')} AS n_matches FROM documents", base=False)
def rule_substitution(spark, sf_dir):
    return counted(spark, sf_dir, {"type": "substitution", "swap": {"and": "&", "that": "which"}})


@query(f"SELECT doc_id, (CASE WHEN {hits('the')} > 5 THEN 1 ELSE 0 END + CASE WHEN {hits('is')} > 5 THEN 1 ELSE 0 END)::BIGINT AS n_matches FROM documents", base=False)
def rule_occurrence(spark, sf_dir):
    return counted(spark, sf_dir, {"type": "occurrence", "tokens": ["the", "is"], "max": 5})


@query(f"SELECT doc_id, greatest(0, {hits('the')} - 1) + greatest(0, {hits('of')} - 1) AS n_matches FROM documents", base=False)
def rule_repetition(spark, sf_dir):
    return counted(spark, sf_dir, {"type": "repetition", "tokens": ["the", "of"]})


@query(f"SELECT doc_id, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE least(a, b) END AS n_matches FROM (SELECT doc_id, {hits('with')} AS a, {hits('from')} AS b FROM documents)", base=False)
def rule_consistency(spark, sf_dir):
    return counted(spark, sf_dir, {"type": "consistency", "either": {"with": "from"}})


@query(f"SELECT doc_id, CASE WHEN regexp_matches({Q.marked("text")}, '{Q.bounded(r"\bnot\b|stre")}') THEN 0 ELSE {hits('the')} END AS n_matches FROM documents", base=False)
def rule_conditional(spark, sf_dir):
    return counted(spark, sf_dir, {"type": "conditional", "tokens": ["the"], "match": r"\bnot\b|stre"})


@query(", e AS (SELECT doc_id, ss FROM t) SELECT doc_id, len(list_filter(ss, lambda x: NOT regexp_matches(x, '^\\p{Lu}'))) AS n_sentence, (CASE WHEN text <> '' AND text <> upper(text) THEN 1 ELSE 0 END)::BIGINT AS n_upper FROM e JOIN (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM d) USING (doc_id)")
def rule_capitalization(spark, sf_dir):
    rule = lambda match, scope: F.size(R.compile_rule({"type": "capitalization", "match": match, "scope": scope}, F.col("text"))).cast("long")
    return texts(spark, sf_dir).select("doc_id", rule("$sentence", "sentence").alias("n_sentence"), rule("$upper", "text").alias("n_upper"))


@query(Q.COUNTS + " SELECT doc_id, (CASE WHEN ari > 12 OR ari < 4 THEN 1 ELSE 0 END)::BIGINT AS n_ari, (CASE WHEN fre < 30 THEN 1 ELSE 0 END)::BIGINT AS n_fre FROM gr")
def rule_metric(spark, sf_dir):
    rule = lambda **how: F.size(R.compile_rule({"type": "metric"} | how, F.col("text"))).cast("long")
    return Q.with_words(texts(spark, sf_dir)).select("doc_id", rule(metric="ari", min=4, max=12).alias("n_ari"), rule(metric="fre", min=30).alias("n_fre"))


@query(f", e AS (SELECT doc_id, unnest(ss) AS s FROM t) SELECT doc_id, sum({hits('the', 's')})::BIGINT AS n_matches FROM e GROUP BY doc_id")
def rule_scope_sentence(spark, sf_dir):
    found = Q.with_words(texts(spark, sf_dir))
    return found.select("doc_id", F.size(R.compile_rule({"type": "existence", "tokens": ["the"], "scope": "sentence"}, F.col("text"))).cast("long").alias("n_matches"))


@query("SELECT doc_id, instr(lower(text), 'tion') AS first_place, length(left(text, instr(lower(text), 'tion') - 1)) - length(replace(left(text, instr(lower(text), 'tion') - 1), chr(10), '')) + 1 AS line FROM documents WHERE contains(lower(text), 'tion')", base=False)
def rule_positions(spark, sf_dir):
    """Place of the first hit: line as a rule reports it, and the offset that line and column stand for."""
    found = texts(spark, sf_dir).select("doc_id", "text", F.get(R.compile_rule({"type": "existence", "raw": ["tion"]}, F.col("text")), F.lit(0)).alias("m")).where("m is not null")
    before = F.aggregate(F.slice(F.split("text", "\n"), F.lit(1), F.col("m.line") - 1), F.lit(0), lambda a, x: a + F.length(x) + 1)
    return found.select("doc_id", (before + F.col("m.col")).cast("long").alias("first_place"), F.col("m.line").cast("long").alias("line"))


RULES = [
    {"id": "no-the", "type": "existence", "level": "error", "message": "Found '%s'", "tokens": ["wher", "stre"]},
    {"id": "use-which", "type": "substitution", "level": "suggestion", "message": "Prefer which", "swap": {"that": "which"}},
    {"id": "from-alone", "type": "existence", "level": "warning", "message": "from", "tokens": ["from"]},
]


@query(f"SELECT doc_id, {hits('wher')} + {hits('stre')} + {hits('from')} AS rule_violations, CASE WHEN {hits('wher')} + {hits('stre')} = 0 THEN 1 ELSE 0 END + CASE WHEN {hits('that')} = 0 THEN 1 ELSE 0 END + CASE WHEN {hits('from')} = 0 THEN 1 ELSE 0 END AS rule_passes FROM documents", base=False)
def rule_violations(spark, sf_dir):
    found = texts(spark, sf_dir).select("doc_id", R.rule_matches(RULES, F.col("text")).alias("m"))
    return found.select("doc_id", T.let(F.col("m"), lambda m: R.violations_and_passes(m, RULES)).alias("v")).select("doc_id", "v.*")


@query(
    f""", e AS (SELECT s.doc_id, idx, sentence, text FROM s JOIN d USING (doc_id)),
 n AS (SELECT doc_id, idx, sentence, {hits('wher', 'text')} AS a, {hits('from', 'text')} AS b FROM e)
 SELECT doc_id, idx, a * contains(lower(sentence), 'wher')::INT + b * contains(lower(sentence), 'from')::INT AS n_flags FROM n WHERE a * contains(lower(sentence), 'wher')::INT + b * contains(lower(sentence), 'from')::INT > 0"""
)
def rule_sentence_flags(spark, sf_dir):
    rules = [{"id": "w", "type": "existence", "tokens": ["wher"]}, {"id": "f", "type": "existence", "tokens": ["from"]}]
    found = texts(spark, sf_dir).select("doc_id", R.rule_flags(R.rule_matches(rules, F.col("text")), T.sentences(F.col("text"))).alias("flags"))
    rows = T.each(found, "flags", ["doc_id"], into="f").where(F.size("f") > 0)
    return rows.select("doc_id", "idx", F.size("f").cast("long").alias("n_flags"))


TARGETS = {"formality": 0.8, "confidence": 0.8, "warmth": 0.3, "directness": 0.7, "energy": 0.3, "verbosity": 0.5}


@query(Q.DERIVED + Q.TONE6 + " SELECT doc_id, round(greatest(0, 1 - (" + " + ".join(f"abs({d} - {v})" for d, v in TARGETS.items()) + ") / 6), 3) AS overall_compliance, " + ", ".join(f"round({d} - {v}, 6) AS {d}_delta" for d, v in TARGETS.items()) + " FROM td")
def persona_alignment(spark, sf_dir):
    found = A.with_tone_dimensions(Q.derived(spark, sf_dir)).select("doc_id", R.alignment(TARGETS).alias("a"))
    return found.select("doc_id", "a.overall_compliance", *(r6(f"a.{d}").alias(f"{d}_delta") for d in TARGETS))


# --- comparison --------------------------------------------------------------------------------

TURNS = "(SELECT conv_id * 1000 + turn AS doc_id, role AS lang, '' AS source, text FROM conversations)"


def turn_pairs(spark, sf_dir) -> DataFrame:
    """Each turn as the original, the next one of its conversation as the rewritten text."""
    turns = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("rewritten"))
    return turns.withColumnRenamed("text", "original").join(after, ["conv_id", "turn"])


@query()
def compare_turns(spark, sf_dir):
    found = C.compare(turn_pairs(spark, sf_dir))
    return found.select("conv_id", "turn", "original_composite", "rewritten_composite", "overall_improvement", *(r6(f"{d}_delta").alias(f"{d}_delta") for d in C.COMPARED))


SQL["compare_turns"] = (BASE + Q.HEALTH).replace("FROM documents)", f"FROM {TURNS})", 1) + (
    ", z2 AS (SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, composite, " + ", ".join(C.COMPARED) + " FROM graded) "
    "SELECT a.conv_id, a.turn, a.composite AS original_composite, b.composite AS rewritten_composite, round(b.composite - a.composite, 1) AS overall_improvement, "
    + ", ".join(f"round(b.{d} - a.{d}, 6) AS {d}_delta" for d in C.COMPARED)
    + " FROM z2 a JOIN z2 b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
)


@query()
def sentence_alignment(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir)
    found = T.each(pairs, C.sentence_alignment(F.col("original"), F.col("rewritten"), C.semantic_similarity()), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "idx", "x.original", "x.rewritten", "x.similarity")


SQL["sentence_alignment"] = BASE.replace("FROM documents)", f"FROM {TURNS})", 1) + (
    ", z2 AS (SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, ss FROM t), p AS (SELECT a.conv_id, a.turn, a.ss AS o, b.ss AS r FROM z2 a JOIN z2 b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) "
    "SELECT conv_id, turn, k - 1 AS idx, o[k] AS original, coalesce(r[k], '') AS rewritten, 0.0::DOUBLE AS similarity FROM (SELECT *, unnest(range(1, len(o) + 1)) AS k FROM p)"
)


@query(Q.HEALTH + """, m AS (SELECT *, least(readability, naturalness, vocabulary, tone_compliance) AS low FROM graded) SELECT doc_id, CASE WHEN grade IN ('D', 'F') THEN 'Call `analyze` with `include_suggestions=true` to identify specific issues'
 WHEN grade IN ('B', 'C') THEN 'Weakest dimension is ' || CASE low WHEN readability THEN 'readability' WHEN naturalness THEN 'naturalness' WHEN vocabulary THEN 'vocabulary' ELSE 'tone_compliance' END || ' (' || round(low, 0)::BIGINT || ') — focus rewriting there'
 ELSE 'Score is A — text quality is strong' END AS next_step FROM m""")
def score_next_steps(spark, sf_dir):
    return Q.health(spark, sf_dir).select("doc_id", F.get(C.score_steps(), F.lit(0)).alias("next_step"))


# --- search ------------------------------------------------------------------------------------


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) DESC, vec_id LIMIT 10", base=False)
def embedding_topk(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    asked = vectors.where("vec_id = 0").first()  # one vector
    return S.semantic_search(vectors, asked["embedding"] if asked else [], 10).select("vec_id", r6("similarity").alias("similarity"))


#: A catalogue to search: name, tier_rank, path, description, tags.
CATALOGUE = [
    ("slack-casual", 3, "a.yaml", "Casual messages", ["slack", "Chat"]),
    ("slack-casual", 1, "b.yaml", "Ours", ["slack"]),
    ("slack-casual", 1, "a.yaml", "Ours, first", ["slack", "team"]),
    ("technical-docs", 3, "c.yaml", "Reference for an API", ["docs", "api"]),
    ("technical-docs", 2, "d.yaml", "Cached docs", ["docs"]),
    ("blog-post", 3, "e.yaml", "Posts for the docs team", ["Blog", "docs"]),
]


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "name string, tier_rank long, path string, description string, tags array<string>")


_VALUES = "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {r}::BIGINT, '{p}', '{d}', [{', '.join(repr(t) for t in ts)}])" for n, r, p, d, ts in CATALOGUE) + ") AS v(name, tier_rank, path, description, tags)), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier_rank, path) AS n FROM p), c AS (SELECT * FROM k WHERE n = 1) "


@query(_VALUES + "SELECT name, tier_rank, path, description FROM c", base=False)
def tier_shadowing(spark, sf_dir):
    return S.shadowed(catalogue(spark)).select("name", "tier_rank", "path", "description")


@query(_VALUES + "SELECT name FROM c WHERE list_has_all(list_transform(tags, lambda x: lower(x)), ['docs'])", base=False)
def tag_filter(spark, sf_dir):
    return S.with_tags(S.shadowed(catalogue(spark)), ["DOCS"]).select("name")


@query(_VALUES + "SELECT name, CASE WHEN lower(name) = 'docs' THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM c WHERE contains(lower(name), 'docs') OR contains(lower(description), 'docs')", base=False)
def substring_search(spark, sf_dir):
    return S.substring_search(S.shadowed(catalogue(spark)), "Docs").select("name", "score")


@query(_VALUES + "SELECT name, tier_rank, path FROM c WHERE NOT (name = 'blog-post' AND tier_rank = 3) AND name <> 'technical-docs' UNION ALL SELECT 'technical-docs', 2, 'z.yaml'", base=False)
def catalogue_changes(spark, sf_dir):
    """A valid change of an equal tier, an invalid one, one of a later tier, then a deletion."""
    changed = spark.createDataFrame(
        [("technical-docs", 2, "z.yaml", "", [], True), ("slack-casual", 1, "y.yaml", "", [], False), ("slack-casual", 3, "x.yaml", "", [], True)],
        "name string, tier_rank long, path string, description string, tags array<string>, valid boolean",
    )
    deleted = spark.createDataFrame([("blog-post", 3), ("technical-docs", 3)], "name string, tier_rank long")
    return S.removed(S.merged(S.shadowed(catalogue(spark)), changed), deleted).select("name", "tier_rank", "path")


# --- model input and output --------------------------------------------------------------------

_CUT = "array_to_string((" + Q.WORDS_OF + ")[1:30], ' ')"


@query(", x AS (SELECT doc_id, idx, sentence, len(" + Q.WORDS_OF.format(x="sentence") + ") AS n_words, lag(sentence) OVER o AS p, lead(sentence) OVER o AS n FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY idx)) SELECT doc_id, idx, n_words, CASE WHEN n_words < 10 THEN 'short' WHEN n_words <= 25 THEN 'medium' ELSE 'long' END AS length_class, CASE WHEN p IS NOT NULL THEN " + _CUT.format(x="p") + " END AS previous, CASE WHEN n IS NOT NULL THEN " + _CUT.format(x="n") + " END AS next FROM x")
def context_packet(spark, sf_dir):
    found = T.each(Q.docs(spark, sf_dir), D.context_packets(F.col("sentences")), ["doc_id"])
    return found.select("doc_id", "idx", F.col("x.n_words").cast("long").alias("n_words"), "x.length_class", "x.previous", "x.next")


@query(
    ", x AS (SELECT doc_id, idx, len(" + Q.WORDS_OF.format(x="sentence") + ") AS n_words, lag(sentence) OVER o AS p, lead(sentence) OVER o AS n FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY idx)) SELECT doc_id, idx, concat_ws(' | ', 'prev: ' || CASE WHEN p IS NOT NULL THEN "
    + _CUT.format(x="p") + " END, 'next: ' || CASE WHEN n IS NOT NULL THEN " + _CUT.format(x="n") + " END, 'length: ' || CASE WHEN n_words < 10 THEN 'short' WHEN n_words <= 25 THEN 'medium' ELSE 'long' END, 'sentiment: neutral', 'tone: formality=0.8, warmth=0.3') AS context FROM x"
)
def context_string(spark, sf_dir):
    found = T.each(Q.docs(spark, sf_dir), D.context_packets(F.col("sentences")), ["doc_id"], into="p")
    made = D.context_string(F.col("p"), sentiment=D.sentiment_label(F.lit(0.0)), tone={"formality": 0.8, "warmth": 0.3})
    return found.select("doc_id", "idx", made.alias("context"))


@query(Q.NATURAL + " SELECT doc_id, (4 + CASE WHEN b < 0.20 AND h < 0.35 AND z > 0.96 THEN 1 ELSE 0 END + CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS n_tasks FROM nat")
def task_gating(spark, sf_dir):
    found = A.with_naturalness(Q.docs(spark, sf_dir))
    signal = M.stylometric_class(F.col("burstiness"), F.col("hapax_ratio"), F.col("zipf_r_squared"))
    return found.select("doc_id", F.size(D.gated_tasks(signal, persona=F.col("lang") == "en")).cast("long").alias("n_tasks"))


@query("SELECT doc_id, idx, ceil(1.3 * len(" + Q.WORDS_OF.format(x="sentence") + "))::BIGINT AS n_subwords, 'Extract the core meaning of this sentence in 10 words or fewer: ' || sentence AS prompt FROM s")
def prompts(spark, sf_dir):
    found = T.each(Q.docs(spark, sf_dir), "sentences", ["doc_id"], into="s")
    return found.select("doc_id", "idx", D.estimated_subwords(T.words(F.col("s"))).alias("n_subwords"), D.prompt("core_meaning", F.col("s")).alias("prompt"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND value >= 50 THEN event_type ELSE 'view' END AS label, CASE WHEN event_type IN ('click', 'view') AND value >= 50 THEN value ELSE 0 END::DOUBLE AS confidence, NOT coalesce(event_type IN ('click', 'view') AND value >= 50, false) AS is_fallback FROM events", base=False)
def label_validation(spark, sf_dir):
    """Event types stand for raw labels and values for confidences."""
    found = read_table(spark, sf_dir, "events", ["event_id", "event_type", "value"])
    v = D.validated_label(F.upper("event_type"), F.col("value"), ["click", "view"], "view", 50.0)
    return found.select("event_id", v.alias("v")).select("event_id", "v.*")


_LEVEL = "CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' ELSE 'odd' END"


@query(f"WITH e AS (SELECT event_id, event_type, value / 100 AS c, lower({_LEVEL}) AS f FROM events) SELECT event_id, CASE WHEN c >= 0.6 AND f <> 'odd' THEN f ELSE 'medium' END AS formality, CASE WHEN c >= 0.6 AND f <> 'odd' THEN c ELSE 0 END::DOUBLE AS confidence, NOT coalesce(c >= 0.6 AND f <> 'odd', false) AS is_fallback, 2::BIGINT AS n_dimensions, 'medium' AS other FROM e", base=False)
def tone_parsing(spark, sf_dir):
    """Raw outputs made of event types and numbers; any name is a dimension."""
    found = read_table(spark, sf_dir, "events", ["event_id", "event_type", "value"])
    raw = F.concat(F.lit("Formality: odd, formality : "), F.expr(_LEVEL), F.lit("; "), F.col("event_type"), F.lit("= medium"))
    rows = found.select("event_id", "event_type", D.parsed_tone(raw, F.col("value") / 100).alias("t"))
    one = F.col("t")["formality"]
    return rows.select("event_id", one["label"].alias("formality"), one["confidence"].alias("confidence"), one["is_fallback"].alias("is_fallback"), F.size("t").cast("long").alias("n_dimensions"), F.element_at("t", F.lower("event_type"))["label"].alias("other"))
