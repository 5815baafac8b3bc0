r"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut where its content says so: a chunk ends after the first anchor (a letter of
a fixed set and a space, or a line break) past MIN_CHARS characters, or at MAX_CHARS. A
chunk's fingerprint is a 64-bit hash; its verified identifier is the fingerprint with the
rank of the chunk's bytes among all different chunks of that fingerprint, which is 0
unless two chunks collide. The recipe of a text is its ordered list of identifiers, and
texts are equal exactly if their recipes are.

Movement: each chunk's bytes cross the network once per task that has it (map-side
distinct), to find collisions; documents themselves never move, only their recipes. Only
if a collision exists is a second pass made, over the chunks of colliding fingerprints.
Copies are counted by a partial aggregate; groups of one need no join back.

Defined cases: null counts as empty, and an empty text has the recipe of one empty chunk;
of equal texts the row with the largest doc_id stays; of rows that share doc_id and text
each is reported as kept by ``find_copies`` and one stays in ``drop_copies``; rows of one
doc_id with different texts have each their own fate; a null doc_id stays only if its group
has no other; further columns are ignored by ``find_copies`` and kept by ``drop_copies``,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.plans.staging import Workspace

MIN_CHARS, MAX_CHARS = 768, 8192
_ANCHOR = "[adgkptz][ \\n.]"


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; their concatenation is the text."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s)(?:.{{{MIN_CHARS},{MAX_CHARS - 2}}}?{_ANCHOR}|.{{1,{MAX_CHARS}}})"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def fingerprint(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _copies(ws: Workspace, docs: DataFrame, fp: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text_sha256 and the recipe of verified identifiers of each row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    recipe = F.transform(chunks(F.col("text")), fp)
    rows = ws.keep(d.select("doc_id", F.sha2("text", 256).alias("text_sha256"), recipe.alias("recipe")))
    each = d.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(fp(F.col("chunk")).alias("fp"), "chunk")
    clash = ws.keep(each.distinct().groupBy("fp").count().where("count > 1").select(F.col("fp").alias("clash")))
    if clash.limit(1).count() == 0:
        return rows
    # identifiers of colliding chunks: the rank of the bytes; the rest keep 0
    mine = d.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks(F.col("text"))).alias("pos", "chunk")).withColumn("fp", fp(F.col("chunk")))
    hit = mine.join(clash, F.col("fp") == F.col("clash")).drop("clash")
    from pyspark.sql import Window

    rank = hit.select("fp", "chunk").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("fp").orderBy("chunk")) - 1)
    named = hit.join(rank, ["fp", "chunk"]).groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", "rank"))).alias("ranks"))
    return ws.keep(rows.join(named, ["doc_id", "text_sha256"], "left").withColumn("recipe", F.concat("recipe", F.coalesce(F.flatten(F.transform("ranks", lambda x: F.array(x.pos.cast("long"), x.rank.cast("long")))), F.array().cast("array<bigint>")))).drop("ranks"))


def _grouped(ws: Workspace, docs: DataFrame, fp: Callable[[Column], Column]) -> DataFrame:
    rows = _copies(ws, docs, fp)
    groups = ws.keep(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("recipe", "of"))
    return rows.join(groups, F.col("recipe") == F.col("of"), "left").select(
        "doc_id",
        F.coalesce("keep", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("keep", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def find_copies(docs: DataFrame, fp: Callable[[Column], Column] = fingerprint) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    ws = Workspace(docs.sparkSession, "copies")
    return ws.finish(_grouped(ws, docs, fp))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns.

    Rows are known by doc_id and the hash of their text; the hash is a column for as long as
    rows of one doc_id and text are put together, under a name that docs does not have.
    """
    ws = Workspace(docs.sparkSession, "copies")
    rows = ws.keep(_grouped(ws, docs, fingerprint).select(F.col("doc_id").alias("its_id"), F.col("text_sha256").alias("its_text"), "kept"))
    text = "text_sha256"
    while text in docs.columns:
        text += "_"
    named = docs.withColumn(text, F.sha2(F.coalesce("text", F.lit("")), 256))
    same = lambda other: named["doc_id"].eqNullSafe(other["its_id"]) & (named[text] == other["its_text"])
    gone = rows.where(~F.col("kept")).drop("kept").distinct()
    twice = ws.keep(rows.where("kept").groupBy("its_id", "its_text").count().where("count > 1").drop("count"))
    left = named.join(gone, same(gone), "left_anti")
    if twice.count() == 0:
        return left.drop(text)
    once = left.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", text])
    return left.join(twice, same(twice), "left_anti").unionByName(once).drop(text)
