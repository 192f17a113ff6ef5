"""Spanish texts in the English phrases that the other rules read."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.spanish import MARKERS, REWRITES

#: Least number of marker words, and their least share of all words.
LEAST_MARKERS, LEAST_SHARE = 2, 0.15


@cache
def marked_letters() -> tuple[str, str]:
    """The Latin letters up to U+024F and from U+1E00 that carry marks, and the letters without them."""
    marked, bare = "", ""
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        first, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(map(unicodedata.combining, marks)):
            marked, bare = marked + chr(code), bare + first
    return marked, bare


def without_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, *marked_letters()), "[\u0300-\u036f]", "")


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    """text with the leftmost matches of the rules' patterns replaced; where several match at one place the first rule counts.

    One regular expression finds all of them. A pattern is a group of its own, so its number is the number of marks
    before the match in the replacement; the text between the matches stays.
    """
    fixed = [(p, r) for p, r in rules if "$" not in r]
    for pattern, with_groups in rules:
        if "$" in with_groups:
            text = F.regexp_replace(text, pattern, with_groups)
    every = "|".join(f"({p})" for p, _ in fixed)
    if all(p.startswith(r"\b") for p, _ in fixed):  # said once, so that only the bounds of words are tried
        every = rf"\b(?:{every})"
    hit = "\u0001" + "\u0002".join(f"${k + 1}" for k in range(len(fixed))) + "\u0001"
    parts = F.split(F.regexp_replace(F.regexp_replace(text, "[\u0001\u0002]", ""), every, hit), "\u0001")
    words = F.array(*(F.lit(r) for _, r in fixed))
    number = lambda x: F.length(x) - F.length(F.ltrim(x, F.lit("\u0002"))) + 1
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.element_at(words, number(x))).otherwise(x)), "")


def looks_spanish(text: Column) -> Column:
    """Whether marker words are two or more and 15 % of all words or more."""
    t = without_accents(F.lower(text))
    n = F.regexp_count(t, F.lit(MARKERS))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.coalesce((n >= LEAST_MARKERS) & (n / F.greatest(words, F.lit(1)) >= LEAST_SHARE), F.lit(False))


def to_english(text: Column) -> Column:
    """In lower case and without accents, with known phrases in English; other words stay."""
    t = without_accents(F.lower(text))
    for rules in REWRITES:
        t = rewritten(t, rules)
    return t

