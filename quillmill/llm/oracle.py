"""DuckDB SQL for the operators of this subpackage that SQL can express."""

from .repetition import LIMITS, LINE_LIMIT

#: Lower-casing of A-Z alone.
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = (
    r"""
WITH lines AS (
  SELECT doc_id, pos, line, """
    + _LOWER.format(x=r"trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")
    + r""" AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), frequent AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL AND l.doc_id <> f.last) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE f.key IS NULL OR l.doc_id = f.last), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.key = f.key GROUP BY l.doc_id
"""
)


_LIMITS = ", ".join(f"({n}, {limit})" for n, limit in LIMITS.items())

OP3 = (
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d),
g AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (VALUES """
    + _LIMITS
    + r""") AS v(n, top))),
r AS (SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, gram) AS c FROM g) WHERE c > 1),
p AS (SELECT DISTINCT doc_id, n, i + k AS place FROM (SELECT *, unnest(range(0, n)) AS k FROM r)),
c AS (SELECT doc_id, n, count(*) AS words, sum(length(ws[place])) AS chars FROM p JOIN d USING (doc_id) GROUP BY ALL),
x AS (SELECT doc_id, max(CASE WHEN n = 5 THEN words END) AS n_repeat_words, bool_or(chars / greatest(word_chars, 1) > top) AS repeats
  FROM c JOIN b USING (doc_id) JOIN (VALUES """
    + _LIMITS
    + r""") AS v(n, top) USING (n) GROUP BY doc_id),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
y AS (SELECT doc_id, count(*) AS n_dup_lines, sum(list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: length(x)))) AS dup_chars
  FROM l WHERE nth > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
z AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(repeats, false) OR coalesce(dup_chars, 0) / greatest(word_chars, 1) > """
    + str(LINE_LIMIT)
    + r""" AS rejected FROM b LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR rejected) AS kept FROM z
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op3_repetition": OP3, "op7_line_dedup": OP7}
