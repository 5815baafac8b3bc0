"""Cards of an indented dictionary source: headword lines, then indented body lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble(lines: DataFrame) -> DataFrame:
    """file, card, headwords, reading, body from rows (file, offset, line).

    A headword line after a body line opens a card. The first body line is the reading if
    more follow and it has no unescaped [mN] tag. One file is one ordered group.
    """
    order = Window.partitionBy("file").orderBy("offset")
    own = lines.where((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("body", F.col("line").rlike("^[ \t]"))
    opened = own.withColumn("opens", (~F.col("body") & F.coalesce(F.lag("body").over(order), F.lit(True))).cast("int"))
    card = opened.withColumn("card", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.struct("offset", F.trim("line").alias("t"))
    whole = card.groupBy("file", "card").agg(F.sort_array(F.collect_list(F.when(~F.col("body"), piece))).alias("h"), F.sort_array(F.collect_list(F.when(F.col("body"), piece))).alias("b"))
    heads, body = F.transform("h", lambda x: x.t), F.transform("b", lambda x: x.t)
    first = F.try_element_at(body, F.lit(1))
    reads = (F.size(body) > 1) & ~first.rlike(r"(?<!\\)\[m[0-9]\]")
    return whole.select("file", "card", heads.alias("headwords"), F.when(reads, first).alias("reading"), F.when(reads, F.slice(body, F.lit(2), F.size(body) - 1)).otherwise(body).alias("body"))
