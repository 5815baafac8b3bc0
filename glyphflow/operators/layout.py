"""Lines of measured items, by rules for what may begin and end a line."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that may not begin a line, and those that may not end one, fixed values.
NOT_FIRST = frozenset("。，、．：；！？）】》」』〉］｝”’〕…‥・ー々.,:;!?)]}")
NOT_LAST = frozenset("（【《「『〈［｛“‘〔([{")


def glued(text: str) -> bool:
    return len(text) == 1 and text in NOT_FIRST


def may_end(text: str) -> bool:
    return not (len(text) == 1 and text in NOT_LAST)


def lay_out(items: list[tuple[float, bool, bool, bool]], width: float) -> list[tuple[int, int, float]]:
    """(first, past the last, width) of lines of items (advance, glued, may end, white space).

    A line is filled, then cut at its last place where a break may be; without one it runs
    over to the next such place. White space takes no room at the start of a line.
    """
    n = len(items)
    legal = [True, *(not items[k][1] and items[k - 1][2] for k in range(1, n)), True]
    out, start = [], 0
    advance = lambda k: 0.0 if items[k][3] and k == start else items[k][0]
    while start < n:
        end, used = start, 0.0
        while end < n and (end == start or used + advance(end) <= width):
            used += advance(end)
            end += 1
        if end < n:
            back = end
            while back > start and not legal[back]:
                back -= 1
            if back > start:
                end = back
            else:
                end += 1
                while end < n and not legal[end]:
                    end += 1
                end = min(end, n)
        out.append((start, end, sum(advance(k) for k in range(start, end))))
        start = end
    return out


def measure(text: str) -> float:
    """A plain measure: two for wide characters, one for others. Any function of a text may take its place."""
    return float(sum(2 if ord(c) > 0x2E7F else 1 for c in text))


def lines(tokens: Column, width: float, measured: Callable[[str], float] = measure) -> Column:
    """array of (start, end, width) of the lines of an array of tokens."""

    @F.pandas_udf("array<struct<start:int,end:int,width:double>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([lay_out([(measured(t), glued(t), may_end(t), not t.strip()) for t in (x if x is not None else ())], width) for x in s])

    return run(tokens)
