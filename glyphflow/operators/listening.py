"""Phrases of a text, their places on a timeline, and changes of their bounds.

Greedy passes (packing, merging, tidying) depend on what they have already put out, which
no window expresses. They run as folds over one text's ordered array, inside Arrow
functions, and cost time in proportion to the text. Positions are UTF-16 units.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.functions import text as X
from glyphflow.operators.align import align


def _python(pattern: str) -> str:
    """The class syntax of the JVM for Python: \\x{...} as the character, categories left out."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)


_SPACE = re.compile(f"[{_python(X.SPACE)}]")
_WORD = re.compile(f"[{_python(X.HAN)}{_python(X.LATIN)}]")
_SENTENCE_END = frozenset("。！？…；.!?;")
_CLAUSE_END = frozenset("，、：,:")
_CLOSER = frozenset("”’）】》」』〉］｝\"')]}")
MINIMUM = 0.25
LONGEST, SHORTEST = 29, 4


def counts(char: str) -> bool:
    """Is it an ideograph, a Latin letter or a number."""
    return bool(_WORD.match(char)) or char.isnumeric() and not char.isalpha() or char.isdigit()


class Measure:
    """Units and counted characters before each character of a text."""

    def __init__(self, text: str):
        self.text = text
        self.unit, self.counted = [0], [0]
        for c in text:
            self.unit.append(self.unit[-1] + 1 + (c > "\uffff"))
            self.counted.append(self.counted[-1] + counts(c))

    def count(self, span: tuple[int, int]) -> int:
        return self.counted[span[1]] - self.counted[span[0]]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans in characters: from no white space through terminators and what closes them."""
    out, at, n = [], 0, len(text)
    while at < n:
        if _SPACE.match(text[at]):
            at += 1
            continue
        end = at
        while end < n and text[end] not in _SENTENCE_END:
            end += 1
        if end == n:
            while _SPACE.match(text[end - 1]):
                end -= 1
            out.append((at, end))
            break
        while end < n and (text[end] in _SENTENCE_END or text[end] in _CLOSER):
            end += 1
        out.append((at, end))
        at = end
    return out


def _glued(spans: list[tuple[int, int]], joins) -> list[tuple[int, int]]:
    """Each span goes to the last one put out where joins(last, span) allows it."""
    out: list[tuple[int, int]] = []
    for span in spans:
        if out and joins(out[-1], span):
            out[-1] = (out[-1][0], span[1])
        else:
            out.append(span)
    return out


def phrases(text: str, longest: int = LONGEST, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Sentences; long ones by clauses packed as full as they may be; short pieces go to the one before."""
    longest, m = max(1, longest), Measure(text)
    shortest = max(0, min(shortest, longest))
    fits = lambda a, b: m.count((a[0], b[1])) <= longest
    out = []
    for low, high in sentences(text):
        if m.count((low, high)) <= longest:
            out.append((low, high))
            continue
        cuts = [k + 1 for k in range(low, high) if text[k] in _CLAUSE_END or text[k] in _SENTENCE_END]
        bounds = [low, *[k for k in cuts if k < high], high]
        out += _glued(list(zip(bounds, bounds[1:])), lambda a, b: m.count(b) == 0 or fits(a, b))
    return _glued(out, lambda a, b: m.count(b) < shortest and fits(a, b)) if shortest else out


def limits(characters: int, duration: float, seconds: float = 7.0, least: float = 1.0) -> tuple[int, int]:
    """Longest and shortest phrase for a recording's rate of speech; halves round up."""
    if duration <= 0 or characters <= 0:
        return LONGEST, SHORTEST
    rate = characters / duration
    longest = max(1, int(seconds * rate + 0.5))
    return longest, max(0, min(int(least * rate + 0.5), longest))


def cut_points(text: str, span: tuple[int, int]) -> list[int]:
    """Inner places after a separator or terminator and its closers."""
    out, pending = [], None
    for k in range(*span):
        if pending is not None and text[k] in _CLOSER:
            pending = k + 1
            continue
        if pending is not None:
            out.append(pending)
        pending = k + 1 if text[k] in _CLAUSE_END or text[k] in _SENTENCE_END else None
    if pending is not None:
        out.append(pending)
    return [k for k in out if span[0] < k < span[1]]


def tidy(spans: list[tuple[float, float]], duration: float) -> list[tuple[float, float]]:
    """Times in order, inside the recording, each MINIMUM long where there is room."""
    limit = duration if duration > 0 else max((b for _, b in spans), default=0.0)
    out, floor = [], 0.0
    for k, (a, b) in enumerate(spans):
        start = min(max(a, floor), limit)
        end = min(max(b, start), limit)
        if end <= start:
            after = spans[k + 1][0] if k + 1 < len(spans) else limit
            end = min(max(after, start + MINIMUM), limit)
        if end - start < MINIMUM:
            end = min(start + MINIMUM, limit)
        if end - start < MINIMUM:
            start = max(floor, max(0.0, end - MINIMUM))
            end = max(end, start)
        out.append((start, end))
        floor = end
    return out


def heard(segments: list[tuple[str, float, float]]) -> tuple[list[str], list[tuple[float, float]]]:
    """Counted characters of recognised segments, each with its even share of the segment's time."""
    chars, spans = [], []
    for text, start, end in segments:
        own = [c for c in text if counts(c)]
        step = max(0.0, end - start) / len(own) if own else 0.0
        for k, c in enumerate(own):
            chars.append(c)
            spans.append((start + k * step, start + k * step + step))
    return chars, spans


def force_align(text: str, spans: list[tuple[int, int]], segments: list[tuple[str, float, float]], duration: float, longest: float | None = 7.0) -> list[tuple[int, int, float, float, float]]:
    """(start, end in characters, start, end in seconds, confidence) of each phrase.

    Characters of the text that match recognised ones are anchors. A phrase lies between its
    first and last anchor, and reaches to its neighbours' anchors where its own ends have
    none. Phrases longer than so many seconds are cut first, at punctuation and at pauses.
    """
    places = [k for k, c in enumerate(text) if counts(c)]
    chars, times = heard(segments)
    if not places or not chars:
        step = max(duration, 0.0) / len(spans) if spans else 0.0
        return [(*s, k * step, (k + 1) * step, 0.0) for k, s in enumerate(spans)]
    anchor = {i: times[j] for how, i, j in align([text[k] for k in places], chars) if how == "match"}
    index = {k: i for i, k in enumerate(places)}
    if longest is not None:
        spans = _recut(text, spans, places, anchor, longest)
    out, before, keys = [], 0.0, sorted(anchor)
    for low, high in spans:
        own = [index[k] for k in range(low, high) if k in index]
        hit = [i for i in own if i in anchor]
        start = anchor[hit[0]][0] if hit else before
        end = anchor[hit[-1]][1] if hit else start
        if hit and hit[0] > own[0] and any(k < own[0] for k in keys):
            start = min(start, anchor[max(k for k in keys if k < own[0])][1])
        if hit and hit[-1] < own[-1] and any(k > own[-1] for k in keys):
            end = max(end, anchor[min(k for k in keys if k > own[-1])][0])
        out.append((low, high, start, end, len(hit) / len(own) if own else 0.0))
        before = end
    fixed = tidy([x[2:4] for x in out], duration)
    return [(x[0], x[1], a, b, x[4]) for x, (a, b) in zip(out, fixed)]


def _recut(text, spans, places, anchor, longest):
    def seconds(low: int, high: int) -> float | None:
        its = [anchor[i] for i, k in enumerate(places) if low <= k < high and i in anchor]
        return its[-1][1] - its[0][0] if its else None

    sizes = sorted(b - a for a, b in anchor.values() if b > a)
    pause = max(0.6, 3.0 * sizes[len(sizes) // 2]) if sizes else 0.6
    out = []
    for low, high in spans:
        whole = seconds(low, high)
        if whole is None or whole <= longest:
            out.append((low, high))
            continue
        cuts = set(cut_points(text, (low, high)))
        cuts |= {k for i, k in enumerate(places) if low < k < high and i in anchor and anchor[i][1] - anchor[i][0] > pause}
        bounds = [low, *sorted(cuts), high]
        out += _glued(list(zip(bounds, bounds[1:])), lambda a, b: (seconds(a[0], b[1]) or 0.0) <= longest)
    return out


def marks(expected: str, typed: str, readings: dict[str, list[str]]) -> dict[str, int]:
    """How many characters are correct, homophones, slips of tone, misheard, missing and extra."""
    a, b = ([c for c in x if counts(c)] for x in (expected, typed))
    out = dict.fromkeys(("correct", "homophone", "tone_slip", "misheard", "missing", "extra"), 0)
    for how, i, j in align(a, b):
        if how == "substitute":
            x, y = ({r.lower() for r in readings.get(c, ())} for c in (a[i], b[j]))
            bare = lambda s: {r[:-1] if r[-1:].isdigit() else r for r in s} - {""}
            how = "homophone" if x & y else "tone_slip" if bare(x) & bare(y) else "misheard"
        out[{"match": "correct", "delete": "missing", "insert": "extra"}.get(how, how)] += 1
    return out


def accuracy(m: dict[str, int], listening: bool = False) -> float:
    """Correct ones (and homophones) of all expected and extra ones; 1 where there are none."""
    scale = sum(m.values())
    return (m["correct"] + listening * m["homophone"]) / scale if scale else 1.0


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("n", T.IntegerType())]))


def phrase_spans(text: Column, longest: int = LONGEST, shortest: int = SHORTEST) -> Column:
    """array of (start, end, n): UTF-16 bounds and counted characters of the phrases of a text."""

    @F.pandas_udf(_SPANS)
    def split(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            m = Measure(x or "")
            out.append([(m.unit[a], m.unit[b], m.count((a, b))) for a, b in phrases(x or "", longest, shortest)])
        return pd.Series(out)

    return split(text)


_MARKS = ("correct", "homophone", "tone_slip", "misheard", "missing", "extra")


def dictation_marks(expected: Column, typed: Column, readings: Column) -> Column:
    """The counts of marks as a struct; readings: map of character to its numeric readings."""

    @F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in _MARKS]))
    def run(e: pd.Series, t: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([marks(a or "", b or "", {k: list(v) for k, v in dict(m or {}).items()}) for a, b, m in zip(e, t, r)], columns=list(_MARKS))

    return run(expected, typed, readings)
