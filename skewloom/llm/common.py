"""Column expressions and small helpers that the text operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words without punctuation, after ASCII lower-casing: digits, a-z and everything beyond ASCII. And what stands between them.
ALNUM, NOT_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between the same words before lower-casing.
NOT_ALNUM_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Runs of anything but the six ASCII white-space characters.
SPACED = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of at most so many rows is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A pure ASCII text takes the byte-wise path of ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def alnum_words(text: Column) -> Column:
    """The ``ALNUM`` words of a text. Splitting takes a sixth of the time of matching the words' own, negated, class."""
    return F.array_remove(F.split(ascii_lower(text), NOT_ALNUM), "")


def count_alnum(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, NOT_ALNUM_ANY_CASE), "")).cast("long")


def hash_of(array: Column, start: Column, k: int) -> Column:
    """One 64-bit hash of ``k`` consecutive elements."""
    return F.xxhash64(*[F.get(array, start + c) for c in range(k)])


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= limit else df


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
