"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths give, for each text, the characters that lie
inside n-grams found more than once, and inside repeated lines. A text whose repeated
share passes a limit is rejected, besides the plain base rule on word counts.

Defined cases: a null or empty text has no words and fails the base rule (fewer than ten
words); rows are judged each by its own text, also where they share an id; columns beyond
doc_id and text are kept by ``filter_quality`` whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.kernels import Bytes, SPACE, grams, slices, span_hash

#: Largest share of a text's word characters inside duplicated n-grams, by n.
NGRAM_LIMITS = {5: 0.30, 8: 0.25, 10: 0.20}
#: Largest share of a text's word characters in lines that repeat an earlier line.
LINE_LIMIT = 0.30
#: Largest share of symbols in a text's word characters.
SYMBOL_LIMIT = 0.25

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in NGRAM_LIMITS)


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where the value occurs more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """True where the value occurred at an earlier place."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.empty(len(s), bool)
    out[order] = np.concatenate(([False], s[1:] == s[:-1])) if len(s) else np.zeros(0, bool)
    return out


def measure(col: pa.Array) -> dict[str, np.ndarray]:
    """The figures of SCHEMA, without doc_id, for each text of a column."""
    source = Bytes(col)
    words = source.words(lower=False)
    data, first = source.data, words.first
    start_char = (data & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(start_char & ~SPACE[data], dtype=np.int64)))
    word_len = chars[words.ends] - chars[words.starts]
    salt = words.row.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    out = {"n_words": np.diff(first), "word_chars": chars[source.bounds[1:]] - chars[source.bounds[:-1]], "n_symbols": _per_row(_SYMBOL[data], source.bounds)}
    for n in NGRAM_LIMITS:
        covered = np.zeros(len(words) + 1, np.int64)
        if len(words) >= n:
            inside = words.row[: len(words) - n + 1] == words.row[n - 1 :]
            at = np.flatnonzero(inside)
            key = grams(words.hash, n)[at] + salt[at]
            hit = at[_repeated(key)]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + n, -1)
        mark = np.cumsum(covered[:-1]) > 0
        if n == 5:
            out["n_repeat_words"] = _per_row(mark, first)
        out[f"dup_chars_{n}"] = _per_row(np.where(mark, word_len, 0), first)
    newline = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate((source.bounds[:-1], newline + 1)))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.concatenate((starts[1:], [len(data)])) if len(starts) else starts, len(data))
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 0x0A))
    row = source.row_of(starts)
    full = chars[ends] > chars[starts]
    starts, ends, row = starts[full], ends[full], row[full]
    again = _later(span_hash(data, starts, ends) + row.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    out["n_dup_lines"] = np.bincount(row[again], minlength=source.rows)
    out["dup_line_chars"] = np.bincount(row[again], (chars[ends] - chars[starts])[again], source.rows).astype(np.int64)
    return out


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for part in slices(batch):
            found = measure(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.asarray(found[x], np.int64)) for x in names[1:])], names)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the figures, base_failed, and kept."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _verdict(d.mapInArrow(_measure_batches, SCHEMA))


def _verdict(m: DataFrame) -> DataFrame:
    """The measures with base_failed and kept."""
    chars = F.greatest("word_chars", F.lit(1))
    bad = F.lit(False)
    for n, most in NGRAM_LIMITS.items():
        bad = bad | (F.col(f"dup_chars_{n}") > most * chars)
    bad = bad | (F.col("dup_line_chars") > LINE_LIMIT * chars) | (F.col("n_symbols") > SYMBOL_LIMIT * chars)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.withColumn("base_failed", base).withColumn("kept", ~(base | bad))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text passes, with all columns; a verdict belongs to an id and a text."""
    of_text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    key = F.struct(docs["doc_id"].cast("long").alias("id"), of_text.alias("of_text"))
    judged = _verdict(docs.select(key.alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).mapInArrow(_measure_batches, SCHEMA.replace("doc_id long", "doc_id struct<id:bigint,of_text:bigint>")))
    gone = judged.where(~F.col("kept")).select(F.col("doc_id.id").alias("gone_id"), F.col("doc_id.of_text").alias("gone_text")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (of_text == gone["gone_text"]), "left_anti")
