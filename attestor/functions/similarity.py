"""String similarities as column expressions: Python runs on the executors for ``matching_blocks`` and ``alike`` alone."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def bound(f, *columns: Column) -> Column:
    """``f`` of the columns, each of them computed once for a row, however often ``f`` uses it."""
    one = F.array(F.struct(*[c.alias(f"v{i}") for i, c in enumerate(columns)]))
    return F.get(F.transform(one, lambda p: f(*[p[f"v{i}"] for i in range(len(columns))])), 0)


#: Characters of the shorter string up to which one integer holds its places.
WORD = 62


def letters(s: Column) -> Column:
    """The characters of a string."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def places(s: Column) -> Column:
    """For each character of a string of up to WORD characters, the bits of its places, as a map."""

    def of(chars):
        kinds = F.array_distinct(chars)
        bits = lambda c: F.aggregate(F.transform(chars, lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda t, x: t + x)
        return F.map_from_arrays(kinds, F.transform(kinds, bits))

    return bound(of, letters(s))


def common_with(map_of_places: Column, size: Column, chars: Column) -> Column:
    """Length of the longest common subsequence of ``chars`` and a string of ``size`` characters, given its ``places``.

    One bit for each place of the string says where the table's row does not step up; a character takes
    four integer operations for all places at once.
    """
    zero, full = F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), size) - F.lit(1).cast("long")
    marks = F.transform(chars, lambda c: F.coalesce(F.try_element_at(map_of_places, c), zero))
    step = lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)
    return size - F.bit_count(F.aggregate(marks, full, step)).cast("int")


def _by_rows(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence by the usual table, for strings of any length."""
    row = lambda previous, x: F.aggregate(
        F.sequence(F.lit(1), F.length(b)),
        F.array(F.lit(0)),
        lambda current, j: F.array_append(current, F.when(F.substring(b, j, F.lit(1)) == x, F.get(previous, j - 1) + 1).otherwise(F.greatest(F.get(previous, j), F.get(current, j - 1)))),
    )
    return F.aggregate(letters(a), F.array_repeat(F.lit(0), F.length(b) + 1), row, lambda last: F.get(last, F.length(b)))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""

    def of(short, long):
        fits = F.length(short) <= WORD
        return F.when(F.length(short) == 0, 0).when(fits, bound(common_with, places(short), F.length(short), letters(long))).otherwise(_by_rows(short, long))

    return bound(of, F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a))


def _share(common: Column, a: Column, b: Column) -> Column:
    """Twice the common length over both lengths, in whole percent, halves to even."""
    return F.bround(F.lit(200.0) * common / (a + b), 0).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """Indel similarity from 0 to 100: twice the common subsequence over both lengths, halves to even; empty strings have 0."""

    def of(a, b):
        return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(a == b, 100).otherwise(_share(common_length(a, b), F.length(a), F.length(b)))

    return bound(of, a, b)


def tokens(s: Column) -> Column:
    """Distinct lower-case words of letters and digits, sorted."""
    return F.sort_array(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "), " "), lambda t: t != "")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio among: shared words, shared and rest of a, shared and rest of b."""

    def of(x, y):
        both = F.array_join(F.array_intersect(x, y), " ")
        one = F.trim(F.concat(both, F.lit(" "), F.array_join(F.array_except(x, y), " ")))
        two = F.trim(F.concat(both, F.lit(" "), F.array_join(F.array_except(y, x), " ")))
        best = bound(lambda both, one, two: F.greatest(ratio(both, one), ratio(both, two), ratio(one, two)), both, one, two)
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0).otherwise(best)

    return bound(of, tokens(a), tokens(b))


def partial_ratio(a: Column, b: Column) -> Column:
    """The best ratio of the shorter string with any window of its length in the longer one."""

    def of(short, long):
        n = F.length(short)
        starts = F.sequence(F.lit(1), F.length(long) - n + 1)
        windows = lambda m, size: F.array_max(F.transform(starts, lambda i: common_with(m, size, letters(F.substring(long, i, size)))))
        best = F.when(n <= WORD, bound(windows, places(short), n)).otherwise(F.array_max(F.transform(starts, lambda i: _by_rows(short, F.substring(long, i, n)))))
        return F.when(n == 0, 0).when(F.contains(long, short), 100).otherwise(_share(best, n, n))

    return bound(of, F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a))


# Letters from rare to frequent. Any order gives the same pairs; this one gives few.
RARE_FIRST = "qzxjkvbpygfwmucldrhsnioate "


def _ordered(s: Column) -> Column:
    """A string's characters from rare to frequent, those outside RARE_FIRST before all, each with its number among equals."""
    ordered = lambda chars: F.transform(chars, lambda c, i: F.concat(c, F.lit(":"), (i - F.array_position(chars, c)).cast("string")))
    return bound(ordered, F.sort_array(F.transform(letters(s), lambda c: F.format_string("%02d%s", F.call_function("locate", c, F.lit(RARE_FIRST)), c))))


def alike_keys(s: Column, least: float, left: bool) -> Column:
    """Keys of a string: any two strings with a ratio of ``least`` (a share) or more have one in common, if one's are made as of the left side and the other's as of the right.

    Such strings of n and m characters have least * (n + m) / 2 characters in common, so in any order of
    characters their beginnings of n (or m) less that many, and one more, share one. The keys hold that
    character and both lengths.
    """

    def of(chars):
        n = F.size(chars)
        common = lambda m: F.ceil(least * (n + m) / 2 - 1e-9).cast("int")
        reach = F.sequence(F.greatest(F.ceil(n * (least / (2 - least)) - 1e-9), F.lit(1)).cast("int"), F.floor(n * ((2 - least) / least) + 1e-9).cast("int"))
        sizes = lambda m: F.concat_ws("/", n, m) if left else F.concat_ws("/", m, n)
        entries = lambda m: F.transform(F.slice(chars, 1, F.greatest(n - common(m) + 1, F.lit(0))), lambda c: F.concat_ws("/", sizes(m), c))
        return F.when(n > 0, F.flatten(F.transform(reach, entries))).otherwise(F.array().cast("array<string>"))

    return bound(of, _ordered(s))


def alike_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Pairs (a, b) of the distinct strings of two tables, a superset of those with a ratio of ``least`` (a share) or more."""
    keyed = lambda df, name, side: df.select(name, F.explode(alike_keys(F.col(name), least, side)).alias("_key"))
    return keyed(left, a, True).join(keyed(right, b, False), "_key").select(a, b).distinct()


def closed_set_score(a: Column, b: Column) -> Column:
    """Weighted similarity of two cleaned names, from 0 to 1."""
    return bound(_weighted, a, b)


def _weighted(a: Column, b: Column) -> Column:
    return ratio(a, b) / 100.0 * 0.45 + token_set_ratio(a, b) / 100.0 * 0.40 + partial_ratio(a, b) / 100.0 * 0.15


@F.pandas_udf(DoubleType())
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; not symmetric, and nothing that built-in functions express."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


# ---------------------------------------------------------------- the same in Python, for pairs made there


@lru_cache(maxsize=1 << 16)
def _words(s: str) -> tuple[str, ...]:
    """As ``tokens``."""
    kept = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in s)
    return tuple(sorted(set(kept.split())))


def _percent(a: str, b: str) -> int:
    """As ``ratio``."""
    if not a or not b:
        return 0
    if a == b:
        return 100
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    marks: dict[str, int] = {}
    for i, c in enumerate(short):
        marks[c] = marks.get(c, 0) | 1 << i
    full = v = (1 << len(short)) - 1
    for c in long:
        if m := marks.get(c):
            v = (v + (v & m) | v & ~m) & full
    return round(200.0 * (len(short) - v.bit_count()) / (len(a) + len(b)))


@lru_cache(maxsize=1 << 20)
def alike(a: str, b: str) -> int:
    """The better of ``ratio`` and ``token_set_ratio`` of two lower-case strings."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return _percent(a, b)
    both = " ".join(w for w in x if w in y)
    one = " ".join([both, *(w for w in x if w not in y)]).strip(" ")
    two = " ".join([both, *(w for w in y if w not in x)]).strip(" ")
    return max(_percent(a, b), _percent(both, one), _percent(both, two), _percent(one, two))


@F.pandas_udf(DoubleType())
def alike_each(a: pd.Series, b: pd.Series) -> pd.Series:
    """``alike`` of two columns, 0 where one is null."""
    return pd.Series([0.0 if x is None or y is None else float(alike(x, y)) for x, y in zip(a, b)], dtype="float64")


@lru_cache(maxsize=1 << 18)
def _shared_blocks(a: str, b: str) -> float:
    """As ``matching_blocks``."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def _each_with_each(of):
    def run(names: pd.Series) -> pd.Series:
        return pd.Series([[1.0 if x == y and x != "" else of(x, y) for x in ns for y in ns] for ns in names])

    return F.pandas_udf(run, ArrayType(DoubleType()))


#: For similarities of columns: those of all pairs of the strings of an array, row by row; equal strings that aren't empty have 1.
EACH_WITH_EACH = {"ratio": _each_with_each(lambda x, y: _percent(x, y) / 100.0), "matching_blocks": _each_with_each(_shared_blocks)}
