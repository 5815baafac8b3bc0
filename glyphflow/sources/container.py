"""A compiled dictionary: a folder of tables that is put in its place as a whole.

Tables: entry (as given), lexeme, char_reading, syllable_base and meta (key, value). They
are written beside the target and moved at the end, so that a reader never sees a part of
one and a failed write leaves the old one. Derived tables follow from the stored entries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions import pinyin as P

TABLES = ("entry", "lexeme", "char_reading", "syllable_base", "meta")


def lexemes(entries: DataFrame, most: int = 6) -> DataFrame:
    """word, char_length, weight of entries (simplified, traditional, reading, senses)."""
    w = entries.select(F.explode(F.array_distinct(F.array("simplified", F.coalesce("traditional", "simplified")))).alias("word"), "senses").where(F.length("word").between(1, most) & (F.col("senses") > 0))
    return w.groupBy("word").agg(F.max(1 / F.length("word") + F.least("senses", F.lit(8)) / 8).alias("weight")).select("word", F.length("word").alias("char_length"), "weight")


def syllable_bases(entries: DataFrame) -> DataFrame:
    x = entries.select(F.explode(P.parse(F.col("reading"))).alias("x")).where("x.tag = 'syllable'")
    return x.select(F.lower("x.base").alias("base")).distinct()


def character_readings(entries: DataFrame) -> DataFrame:
    """character, numeric of entries of one ideograph or letter, by their first syllable."""
    x = entries.where(F.length("simplified") == 1).select(F.col("simplified").alias("character"), F.filter(P.parse(F.col("reading")), lambda t: t.tag == "syllable").alias("t")).where(F.size("t") > 0)
    return x.select("character", F.col("t")[0].text.alias("numeric")).distinct()


def _paths(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def free_name(spark: SparkSession, path: str, most: int = 1000) -> str:
    """The path, or the first of path-2, path-3, ... that is not there."""
    for k in range(1, most + 1):
        at = path if k == 1 else f"{path}-{k}"
        where, fs = _paths(spark, at)
        if not fs.exists(where):
            return at
    raise FileExistsError(path)


def write(entries: DataFrame, path: str, metadata: dict[str, str | None], least: int = 0) -> None:
    """Writes all tables and puts them at path; fewer than least entries are an error, and the old container stays."""
    spark = entries.sparkSession
    part = f"{path}.part-{uuid.uuid4().hex}"
    entries.write.parquet(f"{part}/entry")
    stored = spark.read.parquet(f"{part}/entry")
    n = stored.count()
    (gone, fs), (there, _) = _paths(spark, part), _paths(spark, path)
    if n < least:
        fs.delete(gone, True)
        raise ValueError(f"{n} entries; {least} are needed")
    rebuild(spark, part)
    meta = sorted((metadata | {"entryCount": str(n)}).items())
    spark.createDataFrame([x for x in meta if x[1] is not None], "key string, value string").coalesce(1).write.parquet(f"{part}/meta")
    fs.delete(there, True)
    fs.rename(gone, there)


def rebuild(spark: SparkSession, path: str) -> None:
    """Derives the tables anew from the stored entries; a second time gives the same."""
    stored = spark.read.parquet(f"{path}/entry")
    for name, table in (("lexeme", lexemes(stored)), ("char_reading", character_readings(stored)), ("syllable_base", syllable_bases(stored))):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    if table not in TABLES:
        raise ValueError(f"no table {table}")
    return spark.read.parquet(f"{path}/{table}")


def verify(spark: SparkSession, path: str, longest: int = 6) -> DataFrame:
    """name, n, ok: rows of each table, what the metadata says, and the longest word."""
    counts = [read(spark, path, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.lit(True).alias("ok")) for t in TABLES[:4]]
    entry = read(spark, path, "entry").agg(F.count("*").alias("n"))
    said = read(spark, path, "meta").where("key = 'entryCount'").select(F.col("value").cast("long").alias("said"))
    agree = said.crossJoin(entry).select(F.lit("entryCount").alias("name"), F.col("said").alias("n"), (F.col("said") == F.col("n")).alias("ok"))
    words = read(spark, path, "lexeme").agg(F.lit("longestWord").alias("name"), F.coalesce(F.max("char_length"), F.lit(0)).cast("long").alias("n")).withColumn("ok", F.col("n") <= longest)
    out = agree.unionByName(words)
    for c in counts:
        out = out.unionByName(c)
    return out


def catalogue(spark: SparkSession, folder: str, extension: str = "") -> DataFrame:
    """name, key, value of the containers in a folder, by name; one that cannot be read is a row with key 'unreadable'."""
    where, fs = _paths(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().endswith(extension) and ".part-" not in s.getPath().getName())
    rows = []
    for name in names:  # as many as there are dictionaries
        try:
            rows += [(name, r.key, r.value) for r in read(spark, f"{folder}/{name}", "meta").collect()]
        except Exception as e:  # noqa: BLE001
            rows.append((name, "unreadable", type(e).__name__))
    return spark.createDataFrame(rows, "name string, key string, value string")
