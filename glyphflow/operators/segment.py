"""Word segmentation by a weighted lexicon, and repair by adjacent merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 6


def weight(length: int, senses: int = 1) -> float:
    return 1 / length + min(senses, 8) / 8


def split_words(text: str, lexicon: dict[str, float]) -> list[str]:
    """The split of largest weight; ties: fewer words, then the shortest last word."""
    n = len(text)
    best: list = [(0.0, 0, 0)] + [None] * n
    for end in range(1, n + 1):
        for size in range(1, min(MOST, end) + 1):
            w = lexicon.get(text[end - size : end], 0.0 if size == 1 else None)
            before = best[end - size]
            if w is None or before is None:
                continue
            total, words = before[0] + w, before[1] + 1
            if best[end] is None or total > best[end][0] or total == best[end][0] and words < best[end][1]:
                best[end] = (total, words, size)
    out = []
    while n:
        out.append(text[n - best[n][2] : n])
        n -= best[n][2]
    return out[::-1]


def merge_tokens(tokens: list[str], lexicon: dict[str, float], most_tokens: int = 4) -> list[str]:
    """From each token, the run of up to four tokens and six characters of largest weight."""
    out, k = [], 0
    while k < len(tokens):
        best, take = 0.0, 1
        for n in range(2, most_tokens + 1):
            word = "".join(tokens[k : k + n])
            if k + n > len(tokens) or len(word) > MOST:
                break
            if lexicon.get(word, 0.0) > best:
                best, take = lexicon[word], n
        out.append("".join(tokens[k : k + take]))
        k += take
    return out


def segment(texts: DataFrame, column: str, lexicon: DataFrame, most_words: int = 3_000_000) -> DataFrame:
    """Adds words. lexicon: word, weight; its rows are counted against the broadcast bound."""
    n = lexicon.count()
    if n > most_words:
        raise ValueError(f"the lexicon has {n} words; the bound is {most_words}")
    shared = texts.sparkSession.sparkContext.broadcast(dict(lexicon.select("word", "weight").toPandas().itertuples(index=False, name=None)))

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda x: split_words(x or "", shared.value))

    return texts.withColumn("words", split(column))


def merged(rows: DataFrame, column: str, lexicon: DataFrame, most_words: int = 3_000_000) -> DataFrame:
    """Adds merged: the tokens with runs joined that the lexicon (word, weight) has as one word."""
    n = lexicon.count()
    if n > most_words:
        raise ValueError(f"the lexicon has {n} words; the bound is {most_words}")
    shared = rows.sparkSession.sparkContext.broadcast(dict(lexicon.select("word", "weight").toPandas().itertuples(index=False, name=None)))

    @F.pandas_udf("array<string>")
    def join(s: pd.Series) -> pd.Series:
        return s.map(lambda x: merge_tokens(list(x) if x is not None else [], shared.value))

    return rows.withColumn("merged", join(column))
