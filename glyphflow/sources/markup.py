"""Card markup: lines to tokens, tokens to senses, cards to entries.

Tags: [m1]..[m9] sense, [b] [i] [c name] styles, [p] grammar, [ex] example, [*] example
block, [ref] reference. A backslash takes the next character as it is; an unknown tag stays
in the text, and a bracket without its end makes the rest of the line text; both are
reported. Ranges are UTF-16 units of the sense's text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphflow.functions import text as X

_PIECE = re.compile(r"\\(.)|(\\)|\[((?:\\.|[^\]\\])*)\]|(\[.*)|([^\\\[]+)", re.S)
_TAGS = {"b": "bold", "i": "italic", "c": "colour", "p": "grammar", "ex": "example", "*": "block", "ref": "reference"}
_STYLES = {"bold": "bold", "italic": "italic", "colour": "highlighted"}
#: Grammar notes that name a part of speech; others are registers. Fixed values.
PARTS_OF_SPEECH = frozenset(("гл.", "сущ.", "прил.", "нареч.", "мест.", "числ.", "предлог", "союз", "частица", "межд.", "служ. сл.", "счётн. сл.", "собств.", "гл. А", "гл. Б", "гл. В", "усл.", "вспом. гл.", "послелог"))
_HAN = re.compile("[" + re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: chr(int(m[1], 16)), X.HAN) + "]")
_CJK_MARK = re.compile("[\u3000-\u303f\uff00-\uff65\u2018\u2019\u201c\u201d\u2014\u2026\u00b7]")
_LABEL = re.compile(r"[IVX]+(?= |\Z)|\d+\)|[^\W\d_]\)")
_WIDE_LATIN = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")


def tokens(line: str) -> tuple[list[tuple[str, object]], list[tuple[str, str]]]:
    """([(text, s) | (open, (tag, argument)) | (close, tag)], [(problem, what)])."""
    out: list[tuple[str, object]] = []
    problems: list[tuple[str, str]] = []
    held: list[str] = []

    def put(token=None):
        if held:
            out.append(("text", "".join(held)))
            held.clear()
        if token:
            out.append(token)

    for m in _PIECE.finditer(line):
        escaped, lone, tag, rest, plain = m.groups()
        if tag is None:
            held.append(escaped or lone or rest or plain or "")
            if rest:
                problems.append(("unterminated", rest))
            continue
        name, _, argument = tag.partition(" ")
        if tag.startswith("/") and (tag[1:] in _TAGS or tag[1:] == "m"):
            put(("close", _TAGS.get(tag[1:], "sense")))
        elif re.fullmatch("m[1-9]", tag):
            put(("open", ("sense", tag[1])))
        elif name in _TAGS and (tag == name or name == "c"):
            put(("open", (_TAGS[name], argument)))
        else:
            problems.append(("unknown", tag))
            held.append(m[0])
    put()
    return out, problems


def _units(s: str) -> int:
    return len(s) + sum(c > "\uffff" for c in s)


class _Assembly:
    """Reads tokens into flat senses, each with its level and the index of its parent."""

    def __init__(self):
        self.drafts: list[dict] = []
        self.open_at: dict[int, int] = {}  # the last sense of each level
        self.grammar = self.example = self.reference = None
        self.styles: dict[str, int] = {}

    def _here(self) -> dict:
        if not self.drafts:
            self._sense(0)
        return self.drafts[-1]

    def _length(self) -> int:
        return _units(self.drafts[-1]["text"]) if self.drafts else 0

    def _sense(self, level: int) -> None:
        self._settle()
        above = [k for k in self.open_at if k < level]
        self.open_at = {k: v for k, v in self.open_at.items() if k <= level}
        self.drafts.append({"level": level, "parent": self.open_at[max(above)] if above else None, "text": "", "pos": [], "registers": [], "examples": [], "styles": [], "refs": []})
        self.open_at[level] = len(self.drafts) - 1

    def _settle(self) -> None:
        for kind in ("grammar", "example", *_STYLES, "reference"):
            self._close(kind)

    def text(self, s: str) -> None:
        if self.grammar is not None:
            self.grammar += s
        elif self.example is not None:
            self.example += s
        else:
            self._here()["text"] += s

    def line(self) -> None:
        """A new line of the body is a space in what is open, unless it ends in one."""
        now = self.grammar if self.grammar is not None else self.example if self.example is not None else self.drafts[-1]["text"] if self.drafts else ""
        if now and not now.endswith(" "):
            self.text(" ")

    def open(self, tag: str, argument: str) -> None:
        if tag == "sense":
            self._sense(int(argument) - 1)
        elif tag == "grammar":
            self.grammar = ""
        elif tag == "example":
            self.example = ""
        elif tag in _STYLES:
            self.styles[tag] = self._length()
        elif tag == "reference":
            self.reference = self._length()

    def _close(self, tag: str) -> None:
        if tag == "grammar" and self.grammar is not None:
            note, self.grammar = self.grammar.strip(), None
            if note:
                self._here()["pos" if note in PARTS_OF_SPEECH else "registers"].append(note)
        elif tag == "example" and self.example is not None:
            raw, self.example = self.example.strip(), None
            if raw:
                self._here()["examples"].append(split_example(raw))
        elif tag in _STYLES and self.drafts and tag in self.styles:
            start = self.styles.pop(tag)
            if self._length() > start:
                self.drafts[-1]["styles"].append((_STYLES[tag], start, self._length()))
        elif tag == "reference" and self.drafts and self.reference is not None:
            start, self.reference = self.reference, None
            span = self.drafts[-1]["text"].encode("utf-16-le")[2 * start :].decode("utf-16-le")
            if word := span.strip():
                low = start + _units(span[: len(span) - len(span.lstrip())])
                self.drafts[-1]["refs"].append((word, low, low + _units(word)))

    def close(self, tag: str) -> None:
        self._settle() if tag == "sense" else self._close(tag)

    def senses(self) -> list[dict]:
        self._settle()
        return [_finished(k, x) for k, x in enumerate(self.drafts)]


def split_example(raw: str) -> dict:
    """The longest start of ideographs, their punctuation and spaces, and the rest."""
    end = k = 0
    while k < len(raw) and (raw[k] == " " or _HAN.match(raw[k]) or _CJK_MARK.match(raw[k])):
        k += 1
        end = end if raw[k - 1] == " " else k
    return {"chinese": raw[:end].strip(), "translation": raw[end:].strip(), "raw": raw}


def _finished(k: int, x: dict) -> dict:
    body = x["text"].lstrip()
    cut, label = _units(x["text"]) - _units(body), None
    if m := _LABEL.match(body):
        label, rest = m[0].strip(), body[m.end() :]
        cut += _units(m[0]) + _units(rest) - _units(rest.lstrip())
        body = rest.lstrip()
    body = body.rstrip()
    size = _units(body)
    moved = [(name, max(0, a - cut), min(size, b - cut)) for name, a, b in x["styles"]]
    refs = [(word, max(0, a - cut), min(size, b - cut)) for word, a, b in x["refs"]]
    kind = "reference" if x["refs"] and len(body) <= 24 else "label" if not body and (x["pos"] or x["registers"]) else "definition"
    keep = lambda spans: [{"value": v, "start": a, "end": b} for v, a, b in spans if a < b]
    return {"id": k, "kind": kind, "text": body, "level": x["level"], "parent": x["parent"], "label": label, "pos": x["pos"], "registers": x["registers"], "examples": x["examples"], "styles": keep(moved), "refs": keep(refs)}


def senses(body: Iterable[str]) -> tuple[list[dict], list[tuple[str, str]]]:
    """Senses of a card's body lines, and what was wrong in them."""
    a, problems = _Assembly(), []
    for k, line in enumerate(body):
        if k:
            a.line()
        found, wrong = tokens(line)
        problems += wrong
        for kind, value in found:
            if kind == "text":
                a.text(value)
            elif kind == "open":
                a.open(*value)
            else:
                a.close(value)
    return a.senses(), problems


def readings(line: str | None) -> list[str]:
    """Runs of words in Latin letters between commas and semicolons, markup left out."""
    text = "".join(v for k, v in tokens(line or "")[0] if k == "text")
    out = []
    for part in re.split("[,;]", text):
        run: list[str] = []
        for word in [*part.split(" "), None]:
            letters = [c for c in word or "" if c.isalpha()]
            if letters and all(_WIDE_LATIN.match(c) for c in letters):
                run.append(word)
            elif word != "" and run:
                out.append(" ".join(run))
                run = []
    return out


SENSE = "struct<id:int,kind:string,text:string,level:int,parent:int,label:string,pos:array<string>,registers:array<string>,examples:array<struct<chinese:string,translation:string,raw:string>>,styles:array<struct<value:string,start:int,end:int>>,refs:array<struct<value:string,start:int,end:int>>>"
CARD = f"struct<readings:array<string>,senses:array<{SENSE}>,problems:array<struct<problem:string,what:string>>>"


def card_content(reading: Column, body: Column) -> Column:
    """Readings, senses and problems of a card."""

    @F.pandas_udf(CARD)
    def run(r: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for line, lines in zip(r, b):
            found, wrong = senses(lines if lines is not None else ())
            rows.append((readings(line), found, wrong))
        return pd.DataFrame(rows, columns=["readings", "senses", "problems"])

    return run(reading, body)


def entries(cards):
    """One row for each headword and reading of cards (headwords, reading, body); senses are shared."""
    x = cards.withColumn("x", card_content(F.col("reading"), F.col("body")))
    x = x.select(*[c for c in cards.columns if c not in ("headwords", "reading", "body")], F.explode("headwords").alias("simplified"), "x.*")
    return x.withColumn("reading", F.explode_outer("readings")).drop("readings")


def header(line: Column) -> Column:
    """(key, value) of a header line such as #NAME "x", quotes taken off; null for other lines."""
    key, value = F.regexp_extract(line, r"^#([A-Z_]+)[ \t]", 1), F.trim(F.regexp_extract(line, r"^#[A-Z_]+[ \t]+(.*)$", 1))
    return F.when(key != "", F.struct(key.alias("key"), F.regexp_replace(value, '^"(.*)"$', "$1").alias("value")))


def licence(url: Column) -> Column:
    """The short name of a public licence's address."""
    kind, version = F.upper(F.regexp_extract(url, r"creativecommons\.org/licenses/([a-z-]+)/([0-9.]+)", 1)), F.regexp_extract(url, r"creativecommons\.org/licenses/([a-z-]+)/([0-9.]+)", 2)
    return F.when(kind != "", F.concat(F.lit("CC "), kind, F.lit(" "), version)).when(url.contains("creativecommons.org/publicdomain/zero"), "CC0")


def without_volume(name: Column) -> Column:
    """A name without the number of its volume, as (1/3)."""
    return F.trim(F.regexp_replace(name, r"\s*\(\d+/\d+\)\s*$", ""))


def version(name: Column) -> Column:
    """The first run of six digits or more."""
    return F.nullif(F.regexp_extract(name, r"\d{6,}", 0), F.lit(""))


_CROSS = re.compile(rf"([{_HAN.pattern[1:-1]}A-Za-z0-9，、·]*{_HAN.pattern}[{_HAN.pattern[1:-1]}A-Za-z0-9，、·]*)(?:\|([^\s\[\]|,;()]+))?(?:\[([^\]]*)\])?")


def cross_references(gloss: str) -> tuple[str, list[dict]]:
    """The gloss with each Trad|Simp[reading] as its simplified word, and their ranges; a bare word is none."""
    out, refs, at = [], [], 0
    for m in _CROSS.finditer(gloss):
        if m[2] is None and m[3] is None:
            continue
        out.append(gloss[at : m.start()])
        word = m[2] or m[1]
        start = sum(map(_units, out))
        refs.append({"simplified": word, "traditional": m[1] if m[2] and m[2] != m[1] else None, "reading": m[3], "start": start, "end": start + _units(word)})
        out.append(word)
        at = m.end()
    return "".join([*out, gloss[at:]]), refs


def linked(gloss: Column) -> Column:
    """(text, refs) of glosses."""

    @F.pandas_udf("struct<text:string,refs:array<struct<simplified:string,traditional:string,reading:string,start:int,end:int>>>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cross_references(x or "") for x in s], columns=["text", "refs"])

    return run(gloss)
