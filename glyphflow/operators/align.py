"""Banded alignment with traceback, and marks for a dictation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS, BAND = 64_000_000, 4096


def align(a: list, b: list, slack: int = 128) -> list[tuple[str, int | None, int | None]]:
    """Steps (match, substitute, delete, insert); ties prefer diagonal, delete, insert.

    Beyond the budget of cells all of a is deleted and all of b inserted. The best path of
    the whole matrix is that of the band wherever it stays inside; else the band is filled.
    """
    n, m = len(a), len(b)
    band = max(1, abs(n - m) + slack)
    if band > BAND or (n + 1) * (2 * band + 1) > CELLS:
        return [("delete", i, None) for i in range(n)] + [("insert", None, j) for j in range(m)]
    steps = _whole(a, b, band) if n * m <= CELLS else None
    return _banded(a, b, band) if steps is None else steps


def _whole(a: list, b: list, band: int) -> list | None:
    """The path of the whole matrix, a column in one integer; None if it leaves the band.

    Of each column two vectors are kept: cells equal to their diagonal neighbour, and cells
    one above the neighbour before them in a.
    """
    n, m = len(a), len(b)
    mask, at = (1 << n) - 1, {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    vp, vn, same, up = mask, 0, [], []
    for x in b:
        eq = at.get(x, 0)
        d = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = (vn | ~(d | vp)) & mask, vp & d
        hp, hn = (hp << 1 | 1) & mask, hn << 1 & mask
        vp, vn = (hn | ~(d | hp)) & mask, hp & d
        same.append(d)
        up.append(vp)
    out, i, j = [], n, m
    while i and j:
        if abs(i - j) > band:
            return None
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("match", i, j))
        elif not same[j - 1] >> i - 1 & 1:
            i, j = i - 1, j - 1
            out.append(("substitute", i, j))
        elif up[j - 1] >> i - 1 & 1:
            i -= 1
            out.append(("delete", i, None))
        else:
            j -= 1
            out.append(("insert", None, j))
    if max(i, j) > band:
        return None
    out += [("delete", k, None) for k in range(i - 1, -1, -1)] + [("insert", None, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def _banded(a: list, b: list, band: int) -> list:
    """The best path that stays in the band, a row at a time."""
    n, m = len(a), len(b)
    ids: dict = {}
    x, y = (np.array([ids.setdefault(c, len(ids)) for c in s], np.int32) for s in (a, b))
    far, width = n + m + 1, 2 * band + 1
    move = np.zeros((n + 1, width), np.int8)
    before = np.full(width + 1, far, np.int32)  # cell k is column i - band + k
    slope = np.arange(width, dtype=np.int32)
    for i in range(n + 1):
        lo, hi = max(0, band - i), min(width, m - i + band + 1)
        best, how = np.full(width, far, np.int32), move[i]
        if i:
            j = slope[max(lo, band - i + 1) : hi] + (i - band)
            at = slice(max(lo, band - i + 1), hi)
            best[at] = before[:-1][at] + (x[i - 1] != y[j - 1])
            how[at] = 1
            down = before[1:] + 1
            less = down < best
            less[:lo] = less[hi:] = False
            best[less], how[less] = down[less], 2
        else:
            best[lo] = 0
        part = best[lo:hi]
        run = np.minimum.accumulate(part - slope[: hi - lo]) + slope[: hi - lo]
        how[lo:hi][run < part] = 3
        before[:] = far
        before[lo:hi] = run
    out, i, j = [], n, m
    while i or j:
        how = move[i, j - i + band]
        if how == 1:
            i, j = i - 1, j - 1
            out.append(("match" if a[i] == b[j] else "substitute", i, j))
        elif how == 2:
            i -= 1
            out.append(("delete", i, None))
        else:
            j -= 1
            out.append(("insert", None, j))
    return out[::-1]


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in ("matched", "substituted", "missing", "extra")]))
def alignment_counts(expected: pd.Series, typed: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(expected, typed):
        steps = [s[0] for s in align(list(x or ""), list(y or ""))]
        rows.append([steps.count(k) for k in ("match", "substitute", "delete", "insert")])
    return pd.DataFrame(rows, columns=["matched", "substituted", "missing", "extra"])
