"""Words and shingles as Column expressions, for operators that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that part words.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACES), "")


def _each(words_col: str, n: int, make) -> Column:
    """make(words of a shingle) for every run of n words; a shorter text is one shingle, an empty one has none.

    words_col must name a column, not an expression: it is read n times for each word.
    """
    w = F.col(words_col)
    long = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: make([w[i + k] for k in range(n)]))
    return F.when(F.size(w) >= n, long).when(F.size(w) > 0, F.array(make([F.array_join(w, " ")]))).otherwise(F.array().cast(f"array<{'bigint' if make is _hash else 'string'}>"))


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _join(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def shingle_hashes(words_col: str, n: int) -> Column:
    return _each(words_col, n, _hash)


def shingles(words_col: str, n: int) -> Column:
    return _each(words_col, n, _join)
