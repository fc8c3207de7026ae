"""Quality rules on repetition: how much of a text lies inside duplicated n-grams and lines.

Words are runs without ASCII white space. Each word gets a 64-bit hash; the hashes of the n-grams
of all lengths in ``LENGTHS`` roll from length to length over the whole chunk of texts in numpy.
A character counts as covered at length n if its word lies in an n-gram that the text has at
least twice, the first one included. A text is rejected if the covered share of its word
characters is above the limit of any length, or that of its duplicated lines is.

Cases: null and empty texts have no words, counts of 0, and fail the base rules. Whole texts are
measured, however long. Equal texts get equal results; no other row is looked at.
"""

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import chunks, fields
from .wordtable import WordTable, mixed, rolled

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Longest allowed share of characters in duplicated n-grams of a length; short lengths repeat by chance in long texts.
LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
LENGTHS = tuple(LIMITS)
#: The longest allowed share of characters in lines that an earlier line equals.
LINE_LIMIT = 0.30
#: Stricter ones: slack at 5 and 6 alone, where chance repeats occur.
TIGHT_LIMITS = {5: 0.25, 6: 0.24, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
TIGHT_LINE_LIMIT = 0.20


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def apart(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only within one text."""
    return mixed(keys ^ mixed(doc.astype(np.uint64) + np.uint64(1)))


def covered_words(hashes: np.ndarray, doc: np.ndarray, lengths=LENGTHS) -> dict[int, np.ndarray]:
    """By length: the words inside a duplicated n-gram of their text. ``doc`` numbers each word's text, ascending."""
    out: dict[int, np.ndarray] = {}
    grams = None
    for n in range(1, max(lengths) + 1):
        if len(hashes) < n:
            break
        grams = rolled(hashes, grams, n)
        if n not in lengths:
            continue
        inside = np.flatnonzero(doc[: len(hashes) - n + 1] == doc[n - 1 :])
        starts = inside[repeated(apart(grams[inside], doc[inside]))]
        edge = np.zeros(len(hashes) + 1, dtype=np.int32)
        edge[starts] += 1
        edge[starts + n] -= 1
        out[n] = np.cumsum(edge[:-1]) > 0
    return out


def measure(texts: list[str | None], limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> pd.DataFrame:
    """Counts and covered shares of whole texts. ``limits`` has the lengths of ``LENGTHS``."""
    table, rows = WordTable(texts), len(texts)
    doc, chars = table.doc, table.ends - table.starts

    def per_text(of: np.ndarray, weights=None) -> np.ndarray:
        return np.bincount(of, weights, rows).astype(np.int64)

    n_words, total = per_text(doc), per_text(doc, chars)
    symbols = np.flatnonzero(np.isin(table.points, [ord(c) for c in SYMBOLS]))
    out = {"n_words": n_words, "word_chars": total, "n_symbols": per_text(np.searchsorted(table.text_ends, symbols, side="right"))}
    starts, ends, of = table.lines()
    words_before = np.concatenate([[0], np.cumsum(chars)])
    line_chars = words_before[np.searchsorted(table.starts, ends)] - words_before[np.searchsorted(table.starts, starts)]
    some = np.flatnonzero(line_chars)
    keys = apart(table.stretch(starts[some], ends[some]), of[some])
    later = np.ones(len(some), dtype=bool)
    later[np.unique(keys, return_index=True)[1]] = False
    again = some[later]
    out["n_dup_lines"] = per_text(of[again])
    least = np.maximum(total, 1)
    out_lines = per_text(of[again], line_chars[again]) / least
    inside, none = covered_words(table.hashes, doc), np.zeros(rows, dtype=np.int64)
    out["n_repeat_words"] = per_text(doc[inside[5]]) if 5 in inside else none
    verdict = out_lines <= line_limit
    for n, limit in limits.items():
        share = np.bincount(doc, chars * inside[n], rows) / least if n in inside else none
        out[f"covered_{n}"] = share + 0.0
        verdict &= share <= limit
    out["covered_lines"] = out_lines
    out["base_failed"] = (n_words < 10) | (100 * out["n_repeat_words"] > 20 * n_words)
    out["kept"] = verdict & ~out["base_failed"]
    return pd.DataFrame(out)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + "".join(f"covered_{n} double, " for n in LENGTHS) + "covered_lines double, base_failed boolean, kept boolean"


def repetition_with(limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT):
    """A function of a text column: struct of the counts, the shares and the verdict."""

    @F.pandas_udf(fields(FIELDS))
    def repetition(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = list(texts)
            yield pd.concat([measure(texts[a:b], limits, line_limit) for a, b in chunks(texts)] or [measure([])], ignore_index=True)

    return repetition


repetition = repetition_with()
