"""Compiles a dictionary file to a container, or verifies one.

    python -m glyphflow.compile cedict SOURCE TARGET [--least 100000]
    python -m glyphflow.compile cards SOURCE TARGET [--least 1]
    python -m glyphflow.compile verify TARGET
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.sources import cards, cedict, container, encodings, markup


def compile_cedict(spark: SparkSession, source: str, target: str, least: int = 100_000) -> DataFrame:
    """Fails on any line that cannot be read, on too few entries, and where the header counts others."""
    lines = cedict.read(spark, source)
    wrong = lines.where("kind = 'error'").select("line_no", "error").limit(3).collect()  # what the message shows
    if wrong:
        raise ValueError(f"lines that cannot be read, first {[(r.line_no, r.error) for r in wrong]}")
    entries = lines.where("kind = 'entry'").select("line_no", "simplified", "traditional", "reading", F.size("senses").alias("senses"))
    meta = {r.key: r.value for r in lines.where("kind = 'metadata'").select("key", "value").collect()}
    said = meta.get("entries")
    if said is not None and int(said) != (n := entries.count()):
        raise ValueError(f"{n} entries; the header says {said}")
    container.write(entries, target, meta, least)
    return container.verify(spark, target)


def compile_cards(spark: SparkSession, source: str, target: str, least: int = 1) -> DataFrame:
    files = spark.read.format("binaryFile").load(source)
    lines = files.select(F.col("path").alias("file"), F.explode(encodings.line_rows(F.col("content"))).alias("x")).select("file", "x.offset", "x.line")
    found = markup.entries(cards.assemble(lines)).withColumn("traditional", F.lit(None).cast("string"))
    container.write(found.select("file", "card", "simplified", "traditional", F.coalesce("reading", F.lit("")).alias("reading"), F.size("senses").alias("senses")), target, {}, least)
    return container.verify(spark, target)


def main() -> int:
    p = argparse.ArgumentParser(prog="glyphflow.compile")
    p.add_argument("what", choices=("cedict", "cards", "verify"))
    p.add_argument("paths", nargs="+")
    p.add_argument("--least", type=int)
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    how = {} if a.least is None else {"least": a.least}
    found = container.verify(spark, a.paths[0]) if a.what == "verify" else {"cedict": compile_cedict, "cards": compile_cards}[a.what](spark, *a.paths[:2], **how)
    rows = found.collect()
    for r in rows:
        print(f"{r.name}\t{r.n}\t{'ok' if r.ok else 'WRONG'}")
    return 0 if all(r.ok for r in rows) else 1


if __name__ == "__main__":
    raise SystemExit(main())
