"""Text to words and sentences, as Column expressions.

Everything here is a built-in expression over one document: no shuffle and no Python. Arrays are
built once as columns and reused, since Catalyst does not fold a costly expression that is used twice.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicons import FIRST_STRIP, WORD_STRIP

#: White space as in Unicode, with the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def words(text: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Pieces between white space that follows ``.``, ``!`` or ``?``."""
    pieces = F.split(stripped(text), r"(?U)(?<=[.!?])[\s\x1c-\x1f]+")
    return F.filter(F.transform(pieces, stripped), lambda s: s != "")


def bare(word: Column) -> Column:
    """Lower case, without punctuation around it."""
    return F.btrim(F.lower(word), F.lit(WORD_STRIP))


def bare_words(ws: Column) -> Column:
    return F.transform(ws, bare)


def first_word(sentence: Column) -> Column:
    """Of a stripped sentence, lower case."""
    return F.lower(F.regexp_extract(sentence, r"(?U)^([^\s\x1c-\x1f]*)", 1))


def bare_first_word(sentence: Column) -> Column:
    return F.btrim(first_word(sentence), F.lit(FIRST_STRIP))


def is_alphabetic(word: Column) -> Column:
    return word.rlike(r"^\p{L}+$")


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or the default where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def count_in(ws: Column, listed: list[str]) -> Column:
    return F.size(F.filter(ws, lambda w: w.isin(listed)))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column, default: float = 0.0) -> Column:
    """Of an array of doubles without nulls."""
    return ratio(total(xs), F.size(xs), default)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once. Inside a lambda an expression would be computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run_lengths(ordered: Column) -> Column:
    """How often each value of a sorted array occurs, in its order: the distances between the ends of runs. Linear in the array, and no explode."""

    def of(xs: Column) -> Column:
        n = F.size(xs)
        ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == n) | (F.get(xs, i - 1) != F.get(xs, i)))
        steps = let(ends, lambda e: F.zip_with(e, F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)), lambda a, b: a - b))
        return F.when(n > 0, steps).otherwise(F.expr("cast(array() as array<int>)"))

    return let(ordered, of)


def each(df: DataFrame, array: Column | str, keep: list[str], idx: str = "idx", into: str = "x") -> DataFrame:
    """A row for each element of an array: the columns ``keep``, its place from 0, the element. The outer
    form, with the empty rows dropped after it: the other one would have Spark test the array for
    elements first, and so compute it anew for each test."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(idx, into)).where(F.col(idx).isNotNull())
    return rows.withColumn(idx, F.col(idx).cast("long"))
