"""Packing by minimum bin slack over remaining lengths.

A document's ids are cut into full windows and one shorter rest. Full windows are
sequences by themselves. The rests enter only as a histogram of lengths, at most
window - 1 numbers whatever the corpus. A bitset subset-sum search starts from the
longest length left, finds the sum closest to the window among the remaining multiset,
and walks back to the counts that reach it; that pattern is used as often as the counts
allow, so each step uses up a length. The rests of one length are numbered across the
cluster and dealt to the patterns' places by arithmetic, without any global list.

A sequence whose length is a power of two needs no padding; others are padded to the
window.

Defined cases: a null or empty text has the end id only; rows with the same doc_id are
packed each on their own; an empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.llm.tokens import encoder
from glyphflow.plans.staging import Workspace

WINDOW = 2048


def fill(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {length: copies}) that use up all lengths of counts.

    Each takes the longest length left and the multiset of others whose sum comes closest
    to the window. Copies are limited by the counts through binary splitting.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    mask = (1 << (window + 1)) - 1
    while left:
        top = max(left)
        room = window - top
        reach, steps = 1, []
        for length in sorted(left, reverse=True):
            have = min(left[length] - (length == top), room // length)
            take = 1
            while have > 0:
                take = min(take, have)
                new = (reach | reach << (take * length)) & ((1 << (room + 1)) - 1) & mask
                if new != reach:
                    steps.append((length, take, reach))
                    reach = new
                have -= take
                take *= 2
            if reach >> room & 1:
                break
        best = reach.bit_length() - 1
        pick = {top: 1}
        for length, take, before in reversed(steps):
            if not before >> best & 1:
                pick[length] = pick.get(length, 0) + take
                best -= take * length
        times = min(left[k] // n for k, n in pick.items())
        out.append((times, pick))
        for k, n in pick.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def _pieces(path: str | None, window: int):
    """Rows of pieces; a row number in its batch keeps rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, flat, bounds in encoder(path).batches(batch):
                size = np.diff(bounds)
                pieces = -(-size // window)
                doc = np.repeat(np.arange(len(size)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, size[doc] - start)
                low, data = bounds[doc] + start, memoryview(flat).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + length).tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, size[doc]))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the bucket spreads equal lengths over many groups, each numbered by itself
    buckets = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(buckets))
    pieces = ws.keep(d.mapInArrow(_pieces(path, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long").withColumn("bucket", spread))
    per = ws.keep(pieces.groupBy("length", "bucket").count())
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most window rows
    first, places, rank_at = counts.get(window, 0), [], {window: 0}
    if first:
        places.append((window, 0, first, 1, 0, 0))
    sequence = first
    counts.pop(window, None)
    for times, pick in fill(counts, window):
        offset = 0
        for length in sorted(pick, reverse=True):
            n, low = pick[length], rank_at.get(length, 0)
            places.append((length, low, low + n * times, n, sequence, offset))
            rank_at[length] = low + n * times
            offset += n * length
        sequence += times
    table = spark.createDataFrame(places, "length long, low long, high long, per long, first_sequence long, first_offset long")
    before = per.select("length", "bucket", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    p = F.broadcast(table.withColumnRenamed("length", "at_length"))  # a few rows per length below the window
    local = F.col("rank") - F.col("low")
    out = ranked.join(p, (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(local / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(local, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )
    return ws.finish(out)
