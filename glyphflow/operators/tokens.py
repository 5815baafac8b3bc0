"""Token rows of texts, with running offsets in UTF-16 units, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.functions import text as X

ROWS = 100_000


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offsets are running sums inside each list of tokens, whose last row is numbered too."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            lists = part.column(1)
            tokens, bound = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            bound = bound - bound[0]
            size = np.diff(bound)
            if not len(tokens):
                continue
            # a character beyond the basic plane has four bytes and takes two units
            data = np.frombuffer(tokens.buffers()[2], np.uint8)
            place = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
            far = np.concatenate(([0], np.cumsum(data[place[0] : place[-1]] >= 0xF0)))
            width = pc.utf8_length(tokens).to_numpy(zero_copy_only=False) + far[place[1:] - place[0]] - far[place[:-1] - place[0]]
            end = np.cumsum(width)
            before = np.concatenate(([0], end))[bound[:-1]]
            end = end - np.repeat(before, size)
            row = np.repeat(np.arange(len(size)), size)
            idx = np.arange(len(tokens)) - np.repeat(bound[:-1], size)
            space = pc.utf8_is_space(tokens).to_numpy(zero_copy_only=False)
            follows = np.append(space[1:], False) & (np.append(row[1:], -1) == row)
            for low in range(0, len(tokens), ROWS):
                to = slice(low, low + ROWS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row[to])), pa.array(idx[to]), tokens.slice(low, ROWS), pa.array((end - width)[to]), pa.array(end[to]), pa.array(follows[to])],
                    ["doc_id", "idx", "text", "start", "end", "trailing_space"],
                )


def token_rows(texts: DataFrame) -> DataFrame:
    """doc_id, idx, text, start, end, trailing_space of each token of texts (doc_id, text)."""
    lists = texts.select(F.col("doc_id").cast("long").alias("doc_id"), X.runs(F.coalesce("text", F.lit(""))).alias("tokens"))
    return lists.mapInArrow(_offsets, "doc_id long, idx long, text string, start long, end long, trailing_space boolean")
