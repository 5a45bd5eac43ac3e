"""Tokenizers, as expressions that give an array of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that are stripped once, if two characters or more remain; longer ones first.
SUFFIXES = ["으로", "에서", "에게", "까지", "부터", "처럼", "보다", "은", "는", "이", "가", "을", "를", "에", "의", "도", "만", "와", "과", "로"]
MORE_SUFFIXES = [*SUFFIXES, "요", "야"]
NOT_WORD = r"[^\p{L}\p{N}]+"
ALNUM = "[0-9A-Za-z가-힣]+"


def strip_suffix(token: Column, suffixes: list[str]) -> Column:
    return F.regexp_replace(token, rf"(?s)^(..+?)(?:{'|'.join(suffixes)})$", "$1")


def _long(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= 2)


def _pieces(c: Column) -> Column:
    return F.split(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD)


def unicode_tokens(c: Column) -> Column:
    """Letters and digits of any script, lower case, endings stripped, two characters at least; repeats stay."""
    return _long(F.transform(_pieces(c), lambda t: strip_suffix(t, SUFFIXES)))


def evidence_tokens(c: Column) -> Column:
    """As unicode_tokens, as a set, with more endings."""
    return F.array_distinct(F.transform(_long(_pieces(c)), lambda t: strip_suffix(t, MORE_SUFFIXES)))


def guard_tokens(c: Column) -> Column:
    """Evidence tokens, and the words as they stand."""
    return F.array_union(evidence_tokens(c), _long(_pieces(c)))


def whitespace_tokens(c: Column) -> Column:
    return _long(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))


def alnum_tokens(c: Column) -> Column:
    """Digits, Latin letters and Hangul syllables; repeats and single characters stay."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ALNUM), F.lit(0)), F.lower)


PROFILES = {"online": unicode_tokens, "offline": alnum_tokens}


def tokenizer(name: str):
    """By a profile's or a configured name: what begins with `whitespace` is that, any other is unicode_tokens."""
    if name in PROFILES:
        return PROFILES[name]
    return whitespace_tokens if name.lower().startswith("whitespace") else unicode_tokens
