"""Pinyin as Column expressions: parsing, tone marks, rendering in four styles; and its way back from marked text."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of tones 1 to 4 on each carrier, and by themselves, fixed values.
MARKS = {"a": "āáǎà", "e": "ēéěè", "i": "īíǐì", "o": "ōóǒò", "u": "ūúǔù", "ü": "ǖǘǚǜ", "A": "ĀÁǍÀ", "E": "ĒÉĚÈ", "I": "ĪÍǏÌ", "O": "ŌÓǑÒ", "U": "ŪÚǓÙ", "Ü": "ǕǗǙǛ"}
COMBINING = "̄́̌̀"
#: What a combining mark gives with a letter that Unicode composes, by Unicode's own rule.
COMPOSED = {c + m: x for c in "BCDFGHJKLMNPQRSTVWXYZbcdfghjklmnpqrstvwxyz" for m in COMBINING if len(x := unicodedata.normalize("NFC", c + m)) == 1}
#: The carrier: the first a, else the first o, else the first e, else the last of i, u, ü.
_CARRIERS = ("^([^aA]*)([aA])(.*)$", "^([^oO]*)([oO])(.*)$", "^([^eE]*)([eE])(.*)$", "^(.*)([iIuUüÜ])([^iIuUüÜ]*)$")
STYLES = ("diacritic", "spaced", "numeric", "toneless")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def umlaut(text: Column) -> Column:
    """u: and v become ü, in both cases."""
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), (("u:", "ü"), ("U:", "Ü"), ("v", "ü"), ("V", "Ü")), text)


def base(syllable: Column) -> Column:
    """Without its tone digit, ü spelled."""
    return umlaut(F.regexp_replace(syllable, "[1-5]$", ""))


def tone(syllable: Column) -> Column:
    return F.when(syllable.rlike("[1-5]$"), F.right(syllable, F.lit(1)).cast("int"))


def with_mark(b: Column, t: Column) -> Column:
    """A base with the mark of its tone; without a vowel the mark goes to the end, composed where Unicode can."""
    out = F.concat(b, F.substring(F.lit(COMBINING), t, F.lit(1)))
    end = _lookup(COMPOSED, F.right(out, F.lit(2)))
    out = F.when(end.isNotNull(), F.concat(F.left(b, F.length(b) - 1), end)).otherwise(out)
    for pattern in reversed(_CARRIERS):
        before, vowel, after = (F.regexp_extract(b, pattern, k) for k in (1, 2, 3))
        marked_vowel = F.substring(_lookup(MARKS, vowel), t, F.lit(1))
        out = F.when(b.rlike(pattern), F.concat(before, marked_vowel, after)).otherwise(out)
    return F.when(t.between(1, 4) & (b != ""), out).otherwise(b)


def marked(syllable: Column) -> Column:
    """The syllable with its tone mark."""
    return with_mark(base(syllable), F.coalesce(tone(syllable), F.lit(5)))


def numeric(b: Column, t: Column) -> Column:
    return F.concat(F.replace(F.replace(b, F.lit("ü"), F.lit("u:")), F.lit("Ü"), F.lit("U:")), t.cast("string"))


def token_tag(token: Column) -> Column:
    """syllable, separator, unknown or literal."""
    return F.when(token.isin(",", "·"), "separator").when(token.isin("xx5", "xx"), "unknown").when(token.rlike(r"^[\p{L}:]+[1-5]$"), "syllable").otherwise("literal")


def parse(field: Column) -> Column:
    """array of (tag, base, tone, text): pieces between spaces, with commas and middle dots by themselves."""
    pieces = F.regexp_extract_all(field, F.lit("[,·]|[^ ,·]+"), F.lit(0))

    def token(x: Column) -> Column:
        is_syllable = token_tag(x) == "syllable"
        return F.struct(token_tag(x).alias("tag"), F.when(is_syllable, base(x)).alias("base"), F.when(is_syllable, tone(x)).alias("tone"), x.alias("text"))

    return F.transform(pieces, token)


def needs_apostrophe(before: Column, after: Column) -> Column:
    """The next begins with a, e or o, and the one before ends in a vowel, n or ng."""
    return F.lower(after).rlike("^[aeo]") & F.lower(before).rlike("([aeiouü]|n|ng)$")


def display(tokens: Column, style: str = "diacritic") -> Column:
    """The tokens as one text in one of STYLES."""

    def one(x: Column, i: Column) -> Column:
        before = F.get(tokens, i - 1)
        shown = {"numeric": numeric(x.base, x.tone), "toneless": x.base}.get(style, with_mark(x.base, x.tone))
        apart = F.lit(True) if style in ("numeric", "spaced") else x.base.rlike(r"^\p{Lu}")
        joiner = F.when(i == 0, "").when(before.tag == "syllable", F.when(apart, " ").when(needs_apostrophe(before.base, x.base), "'").otherwise("")).when(before.text == ",", "").otherwise(" ")
        gap = F.when((i == 0) | (before.text == ","), "").otherwise(" ")
        return (
            F.when(x.tag == "syllable", F.concat(joiner, shown))
            .when(x.tag == "separator", F.when(x.text == ",", ", ").otherwise(x.text))
            .when(x.tag == "unknown", F.concat(gap, F.lit("xx5" if style == "numeric" else "?")))
            .otherwise(F.concat(gap, x.text))
        )

    return F.array_join(F.transform(tokens, one), "")


def stripped(token: Column) -> Column:
    """Toneless lower-case base, null if empty."""
    return F.nullif(F.regexp_replace(F.lower(token), "[0-9]$", ""), F.lit(""))


def from_marked(text: str) -> tuple[str, int] | None:
    """(base, tone) of one marked syllable; None if anything but letters remains."""
    found, left = 5, []
    for c in unicodedata.normalize("NFD", text):
        if c in COMBINING:
            found = COMBINING.index(c) + 1
        else:
            left.append(c)
    b = unicodedata.normalize("NFC", "".join(left))
    return (b, found) if b and all(c.isalpha() for c in b) else None


def syllables(text: str, bases: frozenset[str] | set[str], most: int = 6) -> list[tuple[str, int]] | None:
    """The split into known syllables, longest first with a way back; None if a part has none."""
    out: list[tuple[str, int]] = []
    for group in text.replace("’", "'").replace("-", "'").replace(" ", "'").split("'"):
        n = len(group)
        after: list = [None] * n + [[]]  # the split of the rest from each place
        for k in range(n - 1, -1, -1):
            for size in range(min(most, n - k), 0, -1):
                one = from_marked(group[k : k + size])
                if one and one[0].lower() in bases and after[k + size] is not None:
                    after[k] = [one, *after[k + size]]
                    break
        if after[0] is None:
            return None
        out += after[0]
    return out or None


def syllabified(text: Column, bases: frozenset[str] | set[str]) -> Column:
    """Numeric syllables of a marked text, joined by spaces; null if it has no split."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        each = [syllables(x, bases) if x else None for x in s]
        return pd.Series([" ".join(f"{b.replace('ü', 'u:').replace('Ü', 'U:')}{t}" for b, t in x) if x else None for x in each], dtype=object)

    return run(text)
