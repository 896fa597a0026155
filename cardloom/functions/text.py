"""Column functions on text: trimming, blanks, slugs, literal and tolerant patterns. Classes are Unicode, as (?U) asks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Stripped, runs of white space as one space."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def plain(c: Column | str) -> Column:
    """Whether a text is of ASCII and has no white space but blanks: there `trim` strips it, and classes needn't be Unicode, which
    patterns take several times as long for."""
    text, other = col(c), F.lit(False)
    for space in "\t\n\v\f\r":
        other = other | F.contains(text, F.lit(space))
    return (F.octet_length(text) == F.char_length(text)) & ~other


def strip_column(name: str) -> Column:
    """`strip` of a column, without a pattern where the text is plain."""
    return F.when(plain(name), F.trim(F.col(name))).otherwise(strip(name))


def squeeze_column(name: str) -> Column:
    """`squeeze` of a column, without a pattern where the text is plain and has no two blanks together."""
    return F.when(plain(name) & ~F.contains(F.col(name), F.lit("  ")), F.trim(F.col(name))).otherwise(squeeze(name))


def label(c: Column | str) -> Column:
    """Stripped text; empty for null, blank, nan and none."""
    text = strip(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(F.lower(text).isin("nan", "none"), "").otherwise(text)


def is_blank(c: Column | str) -> Column:
    return label(c) == ""


def blank_or_uncategorized(c: Column | str) -> Column:
    """Null, blank or Uncategorized after stripping."""
    return strip(F.coalesce(col(c), F.lit(""))).isin("", "Uncategorized")


def slugify(c: Column | str, fallback: str = "unknown") -> Column:
    """Lower case, other characters than letters and digits as single hyphens, none at the ends."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(text == "", fallback).otherwise(text)


def escape(c: Column | str) -> Column:
    """The text as a pattern that matches it literally."""
    return F.regexp_replace(col(c), r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\$1")


def tolerant_pattern(c: Column | str) -> Column:
    """A case-insensitive pattern for the text in which any white space stands for any other."""
    return F.concat(F.lit("(?i)"), F.regexp_replace(escape(squeeze(c)), " ", r"\\s+"))


def fold_marks(c: Column | str) -> Column:
    """Typographic dashes and quotes as ASCII."""
    return F.translate(col(c), "‐‑‒–—−‘’“”", "------''\"\"")


def rule_pattern(c: Column | str) -> Column:
    return tolerant_pattern(fold_marks(c))


def title_if_upper(c: Column | str) -> Column:
    """Squeezed; title-cased word by word, also after apostrophes and hyphens, if all letters are upper case."""
    text = squeeze(c)
    parts = F.transform(F.split(text, r"(?<=[^\p{L}])|(?=[^\p{L}])"), lambda p: F.initcap(p))
    shouted = (text == F.upper(text)) & (text != F.lower(text))
    return F.when(text == "", None).when(shouted, F.array_join(parts, "")).otherwise(text)
