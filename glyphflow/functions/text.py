"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of the kinds of a character, fixed values: ideographs with the compatibility ranges, Latin letters, white space.
HAN = r"\x{3006}\x{3007}\x{3021}-\x{3029}\x{3038}-\x{303A}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{16FE4}\x{17000}-\x{18CD5}\x{18D00}-\x{18D08}\x{1B170}-\x{1B2FB}\x{20000}-\x{323AF}"
LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{1E00}-\x{1EFF}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}"
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PUNCTUATION = r"\p{P}\p{Sm}\p{Sc}\p{Sk}"
#: Tokens: runs of ideographs, Latin letters, digits or white space, and every other character by itself; marks go with what they follow.
RUN = rf"(?s)(?:[{HAN}]\p{{M}}*)+|(?:[{LATIN}]\p{{M}}*)+|(?:\p{{N}}\p{{M}}*)+|[{SPACE}]+|.\p{{M}}*"
CLASSES = {"han": f"[{HAN}]", "letter": r"\p{L}", "number": r"\p{N}", "whitespace": f"[{SPACE}]", "punctuation": f"[{PUNCTUATION}]"}
#: The kind of a token is that of its first character, the first that fits.
KINDS = {"han": f"^[{HAN}]", "whitespace": f"^[{SPACE}]", "number": r"^\p{N}", "latin": f"^[{LATIN}]", "punctuation": f"^[{PUNCTUATION}]"}
#: A line with its end, or the unterminated rest.
BLOCK = r"[^\n\x0B\f\r\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}])|[^\n\x0B\f\r\x{85}\x{2028}\x{2029}]+"
TERMINATORS, SEPARATORS, CLOSERS = r"。！？…；.!?;", r"，、：,:", r"”’）】》」』〉］｝\"')\]}"


def count_matching(text: Column, cls: str) -> Column:
    """Characters of a class."""
    return F.regexp_count(text, F.lit(cls))


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def kind(token: Column) -> Column:
    """han, whitespace, number, latin, punctuation or other of a token, by its first character."""
    out = F.lit("other")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(token.rlike(pattern), name).otherwise(out)
    return F.when(token.isNotNull(), out)


def blocks(text: Column) -> Column:
    """Lines with their ends."""
    return F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))


def scorable(text: Column) -> Column:
    """The characters that a dictation counts: ideographs, Latin letters and numbers, with their marks."""
    return F.regexp_extract_all(text, F.lit(rf"[{HAN}{LATIN}\p{{N}}]\p{{M}}*"), F.lit(0))


def utf16_width(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def preview(text: Column, chars: int = 120) -> Column:
    """White space runs become one space; leading and trailing ones go; then a prefix."""
    return F.substring(F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " ")), 1, chars)


def plausibility(text: Column) -> Column:
    """good / (good + bad): controls other than tab, LF, CR are bad, U+FFFD counts as eight."""
    bad = count_matching(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\p{Cn}\p{Co}]")
    lost = count_matching(text, "�")
    good = F.length(text) - bad - lost
    return F.when(F.length(text) == 0, 1.0).otherwise(good / (good + bad + 8 * lost))


#: From the first character that is no white space to a terminator and all terminators and closers after it, or to the end.
SENTENCE = rf"(?:[^{SPACE}{TERMINATORS}][^{TERMINATORS}]*)?[{TERMINATORS}][{TERMINATORS}{CLOSERS}]*|[^{SPACE}{TERMINATORS}][^{TERMINATORS}]*"


def sentences(text: Column) -> Column:
    """Sentences with their terminators and closers; an open rest loses its white space at the end."""
    return F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda x: F.regexp_replace(x, f"[{SPACE}]+$", ""))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)
