"""Lines of a bilingual dictionary, `trad simp [reading] /sense/sense/`, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Glosses with these beginnings point elsewhere, whatever their case, fixed values.
REFERENCE = ("variant of ", "old variant of ", "see ", "see also ", "abbr. for ", "abbr. of ", "used in ", "same as ", "equivalent to ")


def sense_kind(gloss: Column) -> Column:
    low = F.lower(gloss)
    points = F.lit(False)
    for x in REFERENCE:
        points = points | low.startswith(x)
    return F.when(low.startswith("surname "), "label").when(points, "reference").otherwise("definition")


def parse(lines: DataFrame) -> DataFrame:
    """line_no, kind (entry, metadata, comment, error), fields or the error by precedence."""
    x = F.trim("line")
    head = F.regexp_extract(x, r"^([^\[/]*)", 1)
    parts = F.filter(F.split(F.trim(head), " +"), lambda p: p != "")
    body = F.regexp_extract(x, "/(.*)/$", 1)
    error = F.when(F.size(F.split(x, " ")) < 3, "tooFewFields").when(F.size(parts) < 2, "emptyHeadword").when(~x.rlike(r"\[[^\]]*\]"), "missingPinyinBrackets").when(~x.rlike("/[^/]+/"), "missingDefinitions")
    kind = F.when(x.startswith("#!"), "metadata").when(x.startswith("#"), "comment").when(error.isNotNull(), "error").otherwise("entry")
    is_entry = kind == "entry"
    return lines.where(x != "").select(
        *[c for c in lines.columns if c != "line"], kind.alias("kind"), F.when(kind == "error", error).alias("error"),
        F.when(is_entry, F.try_element_at(parts, F.lit(2))).alias("simplified"),
        F.when(is_entry, F.nullif(F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)))).alias("traditional"),
        F.when(is_entry, F.regexp_extract(x, r"\[([^\]]*)\]", 1)).alias("reading"),
        F.when(is_entry, F.filter(F.split(body, "/"), lambda s: s != "")).alias("senses"),
        F.when(kind == "metadata", F.trim(F.regexp_extract(x, "^#!([^=]*)=", 1))).alias("key"),
        F.when(kind == "metadata", F.trim(F.regexp_extract(x, "^#![^=]*=(.*)$", 1))).alias("value"),
    )


def numbered(files: DataFrame) -> DataFrame:
    """file, line_no, line from rows (file, value) with whole files; numbers start at 1 in each file."""
    lines = files.select("file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("at", "line"))
    return lines.select("file", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def read(spark, path: str) -> DataFrame:
    """Rows of the files at path with their line numbers; malformed lines are rows of kind error."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse(numbered(whole))
