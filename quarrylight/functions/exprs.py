"""Column helpers that the operators share. Dictionaries and patterns are arguments: they are data, not code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("", "未提取到", "未明确")  # fixed values


def is_missing(c: Column) -> Column:
    return c.isNull() | c.isin(*MISSING)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space to single blanks, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def hits(text: Column, words: list[str]) -> Column:
    """The words, in their order, that the text contains; case doesn't matter."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(words_array(words), lambda w: F.contains(low, F.lower(w)))


def any_hit(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(text, F.lit("")).contains(w)
    return out


def map_first(text: Column, rules: list[tuple[str, list[str]]], default: str = "") -> Column:
    """The label of the first rule with a word in the text."""
    out = F.lit(default)
    for label, words in reversed(rules):
        out = F.when(any_hit(text, words), F.lit(label)).otherwise(out)
    return out


def map_all(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The labels of all rules with a word in the text, in order."""
    return F.array_compact(F.array(*[F.when(any_hit(text, words), F.lit(label)) for label, words in rules]))


def ordered_extract(text: Column, patterns: list[str], valid=None) -> Column:
    """struct(value, method): group 1 of the first pattern that matches and whose value is valid; else '' and miss."""
    found = []
    for p in patterns:
        v = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1))
        found.append(F.when((v != "") & (valid(v) if valid else F.lit(True)), v))
    value = F.coalesce(*found)
    return F.struct(F.coalesce(value, F.lit("")).alias("value"), F.when(value.isNotNull(), "regex").otherwise("miss").alias("method"))


def in_both(a: Column, b: Column) -> Column:
    """Either contains the other."""
    return F.contains(a, b) | F.contains(b, a)


def bands(c: Column, cuts: list[tuple[float, str]], last: str) -> Column:
    """The label of the first cut that lies above the value."""
    out = F.lit(last)
    for cut, label in reversed(cuts):
        out = F.when(c < cut, F.lit(label)).otherwise(out)
    return out
