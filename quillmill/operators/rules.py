"""Style rules compiled to Column expressions.

A rule is a dict as in a persona's YAML. The driver turns its tokens, patterns and maps into
literal patterns, so that Spark compiles each once; nothing is joined. Each rule yields, for one
row, an array of matches: matched_text, line and col (from 1, in the scoped segment), replacement.

Rules of the types sequence, llm_eval, tone and brand_voice match nothing; script is refused.
Patterns are written in Python's syntax and translated to Java's; one that either refuses is
skipped when the rule is compiled.
"""

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import metrics as M
from ..functions import text as T

RULE_TYPES = "existence substitution occurrence repetition consistency conditional capitalization metric sequence script llm_eval tone brand_voice".split()
PLACEHOLDERS = ["sequence", "llm_eval", "tone", "brand_voice"]
SCOPES = ["text", "sentence", "paragraph", "heading", "raw"]
LEVELS = ["error", "warning", "suggestion"]
METRICS = {
    "fre": "flesch_reading_ease", "fkgl": "flesch_kincaid_grade", "fog": "gunning_fog", "cli": "coleman_liau_index", "smog": "smog_index", "ari": "automated_readability_index",
}
_FLAGS = "(?iuU)"
MATCH = "array<struct<matched_text: string, line: int, col: int, replacement: string>>"


def quoted(token: str) -> str:
    """The token, taken literally, between word boundaries."""
    return r"\b" + re.sub(r"([^\w\s])", r"\\\1", token) + r"\b"


def java_pattern(pattern: str) -> str:
    """A pattern of Python's syntax in Java's: named groups, their back references, the end of the text."""
    named = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m[1].replace('_', '')}>", named).replace(r"\Z", r"\z")


def compiles(pattern: str) -> bool:
    """Whether both Python, whose syntax rules are written in, and Java, which runs them, accept a pattern."""
    from pyspark import SparkContext

    try:
        re.compile(pattern)
        running = SparkContext._active_spark_context
        if running is not None:
            running._jvm.java.util.regex.Pattern.compile(_FLAGS + java_pattern(pattern))
        return True
    except (re.error, IllegalArgumentException):
        return False


def segments(text: Column, scope: str) -> Column:
    """The parts of a text that a scope looks at; an unknown scope is the whole text."""
    if scope == "sentence":
        return T.sentences(text)
    if scope == "paragraph":
        return F.filter(F.transform(F.split(text, r"\n(?U)\s*\n"), T.stripped), lambda p: p != "")
    if scope == "heading":
        return F.filter(F.array(T.stripped(F.substring_index(text, "\n", 1))), lambda h: h != "")
    return F.array(text)


def match(text: Column, line: Column | int = 1, col: Column | int = 1, replacement: Column | None = None) -> Column:
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(text.alias("matched_text"), number(line).alias("line"), number(col).alias("col"), (replacement if replacement is not None else F.lit(None).cast("string")).alias("replacement"))


def split_at(segment: Column, pattern: str) -> Column:
    """Hits of a pattern and ``at``: the line of each and the characters before it in that line."""
    p = _FLAGS + pattern
    found = F.struct(F.regexp_extract_all(segment, F.lit(p), F.lit(0)).alias("hits"), F.split(segment, p, -1).alias("pieces"))
    return T.let(found, lambda v: F.struct(v.hits.alias("hits"), _places(v).alias("at")))


def _span(s: Column) -> Column:
    """How a stretch of text moves a place: lines further, and characters since the last line feed."""
    broken = F.contains(s, F.lit("\n"))
    return F.when(broken, F.struct((F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))).alias("lines"), F.length(F.substring_index(s, "\n", -1)).alias("behind"))).otherwise(
        F.struct(F.lit(0).alias("lines"), F.length(s).alias("behind"))
    )


def _moved(a: Column, b: Column) -> Column:
    return F.struct((a.lines + b.lines).alias("lines"), F.when(b.lines > 0, b.behind).otherwise(a.behind + b.behind).alias("behind"))


def _places(v: Column) -> Column:
    """Pieces and hits alternate, so a hit starts after all pieces up to it and all hits before it.

    The running sums are made by doubling: in pass k each place adds that of 2^k places before, so n
    hits cost n log n steps however long the text is."""
    spans = F.transform(v.hits, lambda h, k: F.struct(_span(F.get(v.pieces, k)).alias("piece"), _span(h).alias("hit")))

    def of(xs: Column) -> Column:
        passes = F.slice(F.sequence(F.lit(0), F.lit(30)), F.lit(1), F.ceil(F.log2(F.greatest(F.size(xs), F.lit(1)))).cast("int"))
        whole = F.transform(xs, lambda x: _moved(x.piece, x.hit))
        # The bound array is named once a pass, so that no pass computes the one before it twice.
        sums = F.aggregate(passes, whole, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= F.call_function("shiftleft", F.lit(1), k), _moved(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), x)).otherwise(x)))
        return T.let(sums, lambda done: F.transform(xs, lambda x, i: F.when(i == 0, x.piece).otherwise(_moved(F.get(done, i - 1), x.piece))))

    return T.let(spans, of)


def hit_at(v: Column, k: Column, replacement: Column | None = None) -> Column:
    """The match of hit ``k`` (from 0) of ``split_at``."""
    place = F.get(v.at, k)
    return match(F.get(v.hits, k), place.lines + 1, place.behind + 1, replacement)


def occurrences(segment: Column, pattern: str, replacement: Column | None = None) -> Column:
    """Every hit with its place."""
    return T.let(split_at(segment, pattern), lambda v: F.transform(v.hits, lambda _, k: hit_at(v, k, replacement)))


def _patterns(rule: dict) -> list[str]:
    return [quoted(t) for t in rule.get("tokens") or []] + [java_pattern(r) for r in rule.get("raw") or [] if compiles(r)]


def _joined(arrays: list[Column]) -> Column:
    return F.concat(*arrays) if arrays else F.expr(f"cast(array() as {MATCH})")


def existence(s: Column, rule: dict) -> Column:
    return _joined([occurrences(s, p) for p in _patterns(rule)])


def substitution(s: Column, rule: dict) -> Column:
    return _joined([occurrences(s, quoted(a), F.lit(b)) for a, b in (rule.get("swap") or {}).items()])


def occurrence(s: Column, rule: dict) -> Column:
    """One match at a token's first hit if it has more than ``max``."""
    most = rule.get("max")
    if most is None or not rule.get("tokens"):
        return _joined([])
    return _joined([T.let(occurrences(s, quoted(t)), lambda hits: F.when(F.size(hits) > most, F.slice(hits, 1, 1)).otherwise(F.slice(hits, 1, 0))) for t in rule["tokens"]])


def repetition(s: Column, rule: dict) -> Column:
    """For each word that came before: a match at the word's second occurrence. Equal words are brought together by a sort; only second occurrences are placed."""
    wanted = [t.lower() for t in rule.get("tokens") or []]

    def of(v: Column) -> Column:
        named = F.transform(v.hits, lambda h, i: F.struct(F.lower(h).alias("w"), i.alias("i")))
        named = F.filter(named, lambda x: x.w.isin(wanted)) if wanted else named

        def again(xs: Column) -> Column:
            """Of the sorted words those that came before, by runs of equal ones, each with its run's match."""
            starts = F.filter(F.sequence(F.lit(0), F.size(xs)), lambda k: (k == 0) | (k == F.size(xs)) | (F.get(xs, k - 1).w != F.get(xs, k).w))
            runs = T.let(starts, lambda b: F.zip_with(F.slice(b, 1, F.size(b) - 1), F.slice(b, 2, F.size(b) - 1), lambda a, z: F.struct(a.alias("a"), (z - a).alias("n"))))
            second = lambda r: T.let(hit_at(v, F.get(xs, r.a + 1).i), lambda m: F.transform(F.slice(xs, r.a + 2, r.n - 1), lambda x: F.struct(x.i.alias("i"), match(x.w, m.line, m.col).alias("m"))))
            return F.flatten(F.transform(F.filter(runs, lambda r: r.n > 1), second))

        return F.transform(F.sort_array(T.let(F.sort_array(named), again)), lambda x: x.m)

    return T.let(split_at(s, r"\b\w+\b"), of)


def consistency(s: Column, rule: dict) -> Column:
    """If both forms occur, the hits of the rarer one; of equal ones, those of the first."""
    out = []
    for a, b in (rule.get("either") or {}).items():
        both = F.struct(occurrences(s, quoted(a), F.lit(b)).alias("a"), occurrences(s, quoted(b), F.lit(a)).alias("b"))
        out.append(T.let(both, lambda v: F.when((F.size(v.a) == 0) | (F.size(v.b) == 0), F.slice(v.a, 1, 0)).when(F.size(v.a) <= F.size(v.b), v.a).otherwise(v.b)))
    return _joined(out)


def conditional(s: Column, rule: dict) -> Column:
    """Hits of the tokens where the pattern ``match`` is absent."""
    if not rule.get("match") or not compiles(rule["match"]):
        return _joined([])
    hits = _joined([occurrences(s, quoted(t)) for t in rule.get("tokens") or []])
    return F.when(s.rlike(_FLAGS + java_pattern(rule["match"])), F.expr(f"cast(array() as {MATCH})")).otherwise(hits)


def is_title_case(s: Column) -> Column:
    """First and last word start upper-case; so do the others, but for small words."""

    def of(ws: Column) -> Column:
        upper = lambda w: w.rlike(r"^\p{Lu}")
        fine = F.transform(ws, lambda w, i: upper(w) | ((i > 0) & (i < F.size(ws) - 1) & F.lower(w).isin(L.TITLE_EXEMPT)))
        return F.forall(fine, lambda x: x)

    return T.let(T.words(s), of)


def capitalization(s: Column, rule: dict) -> Column:
    kind = rule.get("match")
    text = T.stripped(s)
    conforms = {
        "$title": is_title_case(text),
        "$sentence": text.rlike(r"^\p{Lu}"),
        "$lower": text == F.lower(text),
        "$upper": text == F.upper(text),
    }.get(kind, F.lit(True))
    return F.when((text != "") & ~conforms, F.array(match(text))).otherwise(F.expr(f"cast(array() as {MATCH})"))


def metric(s: Column, rule: dict) -> Column:
    """A match if a readability figure is below ``min`` or above ``max``."""
    name = METRICS.get(rule.get("metric") or "")
    if not name:
        return _joined([])

    def of(v: Column) -> Column:
        made = M.grade_columns(v.counts, v.ends) | {"flesch_reading_ease": M.flesch_ease(v.counts)}
        low, high = rule.get("min"), rule.get("max")
        broken = F.lit(False) if low is None else made[name] < float(low)
        broken = broken if high is None else broken | (made[name] > float(high))
        head = F.when(F.length(s) > 50, F.concat(F.substring(s, 1, 50), F.lit("..."))).otherwise(s)
        return F.when(broken, F.array(match(head))).otherwise(F.expr(f"cast(array() as {MATCH})"))

    counts = lambda ws: F.struct(M.text_counts(ws, F.size(T.sentences(s))).alias("counts"), M.linsear_sentences(ws).alias("ends"))
    return T.let(T.let(T.words(s), counts), of)


_HANDLERS = {f.__name__: f for f in (existence, substitution, occurrence, repetition, consistency, conditional, capitalization, metric)}


def compile_rule(rule: dict, text: Column) -> Column:
    """The matches of one rule in a text."""
    kind = rule["type"]
    if kind == "script":
        raise NotImplementedError("rules of type script are not run")
    handler = _HANDLERS.get(kind)
    if handler is None:
        return F.expr(f"cast(array() as {MATCH})")
    return F.flatten(F.transform(segments(text, rule.get("scope") or "text"), lambda s: T.let(s, lambda x: handler(x, rule))))


def _named(rule: dict):
    """A match with what its rule says."""
    action = (rule.get("action") or {}).get("name")
    params = (rule.get("action") or {}).get("params")
    given = F.lit(params if action in ("replace", "suggest") and isinstance(params, str) else None).cast("string")

    def of(m: Column) -> Column:
        return F.struct(
            F.lit(rule["id"]).alias("rule_id"),
            F.lit(rule["type"]).alias("rule_type"),
            F.lit(rule.get("level") or "warning").alias("level"),
            F.lit(rule.get("message") or "").alias("message"),
            F.lit(rule.get("scope") or "text").alias("scope"),
            m.matched_text.alias("matched_text"),
            m.line.alias("line"),
            m.col.alias("col"),
            F.lit("replace" if rule["type"] == "substitution" else action).cast("string").alias("action"),
            F.coalesce(m.replacement, given).alias("replacement"),
        )

    return of


NAMED = "array<struct<rule_id: string, rule_type: string, level: string, message: string, scope: string, matched_text: string, line: int, col: int, action: string, replacement: string>>"


def rule_matches(rules: list[dict], text: Column) -> Column:
    """All rules' matches, in rule order: array of rule_id, rule_type, level, message, scope, action and the match."""
    out = [F.transform(compile_rule(rule, text), _named(rule)) for rule in rules if rule["type"] != "script"]
    return F.concat(*out) if out else F.expr(f"cast(array() as {NAMED})")


def rule_flags(matches: Column, sentences: Column) -> Column:
    """For each sentence the flags of the matches it holds (lower-cased substring); a match that none holds goes to the first."""

    def of(v: Column) -> Column:
        placed = F.transform(v.m, lambda m: F.struct(m.alias("m"), F.exists(v.s, lambda s: F.contains(F.lower(s), F.lower(m.matched_text))).alias("found")))
        flag = lambda p: F.struct(
            F.concat(F.lit("RULE_"), p.m.rule_id).alias("code"),
            F.when(p.m.level.isin(LEVELS), p.m.level).otherwise("warning").alias("severity"),
            F.replace(p.m.message, F.lit("%s"), p.m.matched_text).alias("message"),
        )
        return T.let(
            placed,
            lambda ps: F.transform(
                v.s, lambda s, i: F.transform(F.filter(ps, lambda p: F.contains(F.lower(s), F.lower(p.m.matched_text)) | (~p.found & (i == 0))), flag)
            ),
        )

    return T.let(F.struct(matches.alias("m"), sentences.alias("s")), of)


def violations_and_passes(matches: Column, rules: list[dict]) -> Column:
    """Matches at the levels error and warning; rules without any match."""
    return F.struct(
        F.size(F.filter(matches, lambda m: m.level.isin("error", "warning"))).cast("long").alias("rule_violations"),
        (F.lit(len(rules)) - F.size(F.array_distinct(F.transform(matches, lambda m: m.rule_id)))).cast("long").alias("rule_passes"),
    )


def alignment(targets: dict[str, float]) -> Column:
    """Deltas of the tone dimensions from a persona's targets (0.5 where it has none), and the compliance: 1 less their mean size."""
    deltas = {d: F.col(d) - F.lit(float(targets.get(d, 0.5))) for d in L.TONE_DIMENSIONS}
    mean = sum((F.abs(x) for x in deltas.values()), F.lit(0.0)) / len(deltas)
    return F.struct(F.round(T.clip(1 - mean), 3).alias("overall_compliance"), *(x.alias(d) for d, x in deltas.items()))
