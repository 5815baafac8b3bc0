"""Dictionary formats over driver tables: files are made of the rows, read by the sources, and compared with the rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from glyphflow.plans.reading import _ENTRY, _FIELD, _W1, _W2, entries
from glyphflow.plans.staging import Workspace
from glyphflow.sources import cedict, codec, container, encodings, markup

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_LINE = f"""CASE p_partkey % 8 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '#! key' || p_size || '=a=' || p_type WHEN 2 THEN {_W1} || ' [x1]' WHEN 3 THEN {_W1} || ' {{0}} ' || ' [x1] /b/' WHEN 4 THEN {_W1} || ' ' || {_W2} || ' x1 /b/'
WHEN 5 THEN {_W1} || ' ' || {_W2} || ' [x1] //' ELSE {_W2} || ' ' || {_W1} || ' [' || p_size || '] /' || CASE WHEN p_size % 4 = 0 THEN 'Surname X' WHEN p_size % 4 = 1 THEN 'Used in ' || p_name WHEN p_size % 4 = 2 THEN 'also written so' ELSE p_type END || '/' || p_name || '/' END"""


@query(
    f"""SELECT p_partkey AS line_no, CASE p_partkey % 8 WHEN 0 THEN 'comment' WHEN 1 THEN 'metadata' WHEN 6 THEN 'entry' WHEN 7 THEN 'entry' ELSE 'error' END AS kind,
CASE p_partkey % 8 WHEN 2 THEN 'tooFewFields' WHEN 3 THEN 'missingPinyinBrackets' WHEN 4 THEN 'missingPinyinBrackets' WHEN 5 THEN 'missingDefinitions' END AS error,
CASE WHEN p_partkey % 8 > 5 THEN {_W1} END AS simplified, CASE WHEN p_partkey % 8 > 5 THEN nullif({_W2}, {_W1}) END AS traditional, CASE WHEN p_partkey % 8 > 5 THEN p_size::VARCHAR END AS reading,
CASE WHEN p_partkey % 8 > 5 THEN 2 ELSE 0 END::BIGINT AS n_senses, CASE WHEN p_partkey % 8 > 5 THEN CASE p_size % 4 WHEN 0 THEN 'label' WHEN 1 THEN 'reference' ELSE 'definition' END END AS first_kind,
CASE WHEN p_partkey % 8 = 1 THEN 'key' || p_size END AS key, CASE WHEN p_partkey % 8 = 1 THEN 'a=' || p_type END AS value FROM part WHERE p_partkey % 8 <> 3"""
)
def cedict_lines(spark, d):
    """Dictionary lines of every part: entries, comments, metadata and each kind of error."""
    lines = _t(spark, d, "part").where("p_partkey % 8 <> 3").select(F.col("p_partkey").alias("line_no"), F.expr(_LINE.replace("{0}", "")).alias("line"))
    x = cedict.parse(lines)
    is_entry = F.col("kind") == "entry"
    return x.select("line_no", "kind", "error", "simplified", "traditional", "reading", F.when(is_entry, F.size("senses")).otherwise(0).cast("long").alias("n_senses"), F.when(is_entry, cedict.sense_kind(F.try_element_at("senses", F.lit(1)))).alias("first_kind"), "key", "value")


_CODE = "doc_id % 4"


def _encoded(spark, d):
    """Documents as the bytes of files in several encodings, with and without marks."""

    @F.pandas_udf("binary")
    def write(text: pd.Series, how: pd.Series) -> pd.Series:
        make = (lambda t: t.encode(), lambda t: b"\xff\xfe" + t.encode("utf-16-le"), lambda t: b"\xef\xbb\xbf" + t.encode(), lambda t: b"\xfe\xff" + t.encode("utf-16-be"))
        return pd.Series([make[k](t) for t, k in zip(text, how)])

    return _t(spark, d, "documents").select("doc_id", "text", write(F.coalesce("text", F.lit("")), F.col("doc_id") % 4).alias("content"))


@query(f"SELECT doc_id, sha256(text) AS text_sha256, CASE {_CODE} WHEN 1 THEN 'utf-16-le' WHEN 3 THEN 'utf-16-be' ELSE 'utf-8' END AS encoding FROM documents")
def encoding_round_trip(spark, d):
    """Every document written in one of four ways, its encoding found again, and its text."""
    x = _encoded(spark, d).select("doc_id", encodings.detected("content").alias("x"))
    return x.select("doc_id", F.sha2("x.text", 256).alias("text_sha256"), "x.encoding")


@query(f"SELECT doc_id, CASE WHEN {_CODE} IN (0, 2) THEN sha256(text) END AS as_utf8, CASE WHEN {_CODE} = 1 THEN sha256(text) END AS as_utf16 FROM documents")
def forced_encoding(spark, d):
    """Reading in a named encoding: bytes that are not that give nothing."""
    x = _encoded(spark, d).select("doc_id", encodings.forced_text(F.col("content"), "utf-8").alias("a"), F.when(F.col("doc_id") % 4 == 1, encodings.forced_text(F.col("content"), "utf-16-le")).alias("b"))
    return x.select("doc_id", F.sha2("a", 256).alias("as_utf8"), F.sha2("b", 256).alias("as_utf16"))


@query(f"SELECT doc_id, CASE {_CODE} WHEN 1 THEN 'utf-16-le' WHEN 3 THEN 'utf-16-be' ELSE 'utf-8' END AS encoding, sha256(substring(text, 1, 400)) AS preview FROM documents WHERE length(text) <= 2000")
def encoding_previews(spark, d):
    """What its own encoding shows of the beginning of each text that one preview's bytes hold."""
    own = F.when(F.col("doc_id") % 4 == 1, "utf-16-le").when(F.col("doc_id") % 4 == 3, "utf-16-be").otherwise("utf-8")
    x = _encoded(spark, d).where(F.length("text") <= 2000).select("doc_id", own.alias("own"), F.explode(encodings.preview_rows(F.col("content"))).alias("x")).where("x.encoding = own")
    return x.select("doc_id", F.col("own").alias("encoding"), F.sha2("x.text", 256).alias("preview"))


_WIDTH = f"CASE WHEN {_CODE} IN (1, 3) THEN 2 * length(l[i]) ELSE strlen(l[i]) END + CASE WHEN {_CODE} IN (1, 3) THEN 2 ELSE 1 END"
_MARK = f"CASE {_CODE} WHEN 0 THEN 0 WHEN 2 THEN 3 ELSE 2 END"


@query(f"SELECT doc_id, count(*) FILTER (WHERE NOT (i = n AND l = '')) AS n_lines, coalesce(sum(o) FILTER (WHERE NOT (i = n AND l = '')), 0)::BIGINT AS offset_sum, coalesce(sum(length(l)), 0)::BIGINT AS n_chars FROM (SELECT doc_id, i, len(l) AS n, l[i] AS l, {_MARK} + coalesce(sum({_WIDTH}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) GROUP BY doc_id")
def byte_lines(spark, d):
    """Lines of files in four encodings by their byte offsets."""
    x = _encoded(spark, d).select("doc_id", encodings.line_rows(F.col("content")).alias("l"))
    total = lambda f: F.aggregate("l", F.lit(0).cast("long"), lambda a, y: a + f(y))
    return x.select("doc_id", F.size("l").cast("long").alias("n_lines"), total(lambda y: y.offset).alias("offset_sum"), total(lambda y: F.length(y.line)).alias("n_chars"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'NAME' WHEN 1 THEN 'INDEX_LANGUAGE' ELSE 'INCLUDE' END AS key, n_name AS value FROM nation")
def header_lines(spark, d):
    line = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "#NAME\t").when(F.col("n_nationkey") % 3 == 1, "#INDEX_LANGUAGE ").otherwise("#INCLUDE "), F.lit('"'), F.col("n_name"), F.lit('"'))
    return _t(spark, d, "nation").select("n_nationkey", markup.header(line).alias("x")).select("n_nationkey", "x.key", "x.value")


_BODY_TEXT = "'[x] ' || p_type || ' it'"


def _cards(spark, d):
    two, read = F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 2 == 0
    one, other = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    first = F.concat(F.lit("[m1][p]сущ.[/p] 1) \\[x\\] "), F.col("p_type"), F.lit(" [i]it[/i] [/m]"))
    second = F.concat(F.lit("[m2][ex]中文 пример "), other, F.lit("[/ex] II note[ref] "), one, F.lit(" [/ref][/m]"))
    third = F.lit("[m3][c red]w[/c][zz] [p]книжн.[/p]")
    return _t(spark, d, "part").select(
        F.col("p_partkey").alias("card"), F.when(two, F.array(one, other)).otherwise(F.array(one)).alias("headwords"),
        F.when(read, F.concat(F.lit("[b]"), one, F.lit("[/b] "), other, F.lit(", рус "), one, F.lit("; "), other)).alias("reading"), F.array(first, second, third).alias("body"),
    )


_HEADS = f"CASE WHEN p_partkey % 3 = 0 THEN [{_W1}, {_W2}] ELSE [{_W1}] END"
_READS = f"CASE WHEN p_partkey % 2 = 0 THEN [{_W1} || ' ' || {_W2}, {_W1}, {_W2}] ELSE [NULL] END"


@query(f"SELECT p_partkey AS card, simplified, reading, count(*) AS n FROM (SELECT p_partkey, simplified, unnest({_READS}) AS reading FROM (SELECT *, unnest({_HEADS}) AS simplified FROM part)) GROUP BY ALL")
def card_entries(spark, d):
    """One entry for each headword and reading of a card."""
    return markup.entries(_cards(spark, d)).groupBy("card", "simplified", "reading").agg(F.count("*").alias("n"))


@query(
    f"""SELECT p_partkey AS card, unnest([0, 1, 2]) AS id, unnest(['definition', 'reference', 'definition']) AS kind, unnest([{_BODY_TEXT}, 'note ' || {_W1}, 'w[zz]']) AS text, unnest([0, 1, 2]) AS level, unnest([NULL, 0, 1]) AS parent, unnest(['1)', 'II', NULL]) AS label,
unnest(['сущ.', '', '']) AS pos, unnest(['', '', 'книжн.']) AS registers, unnest([NULL, '中文|пример ' || {_W2}, NULL]) AS example, unnest(['italic:' || (4 + length(p_type) + 1) || ':' || (4 + length(p_type) + 3), '', 'highlighted:0:1']) AS styles, unnest(['', {_W1} || ':5:' || (5 + length({_W1})), '']) AS refs FROM part"""
)
def card_senses(spark, d):
    """Every sense of every card: level and parent, labels, grammar, examples, styles and references with their ranges."""
    x = _cards(spark, d).select("card", markup.card_content(F.col("reading"), F.col("body")).alias("x")).select("card", F.explode("x.senses").alias("s"))
    spans = lambda c: F.array_join(F.transform(c, lambda y: F.concat_ws(":", y.value, y.start, y.end)), ",")
    example = F.try_element_at("s.examples", F.lit(1))
    return x.select("card", "s.id", "s.kind", "s.text", "s.level", "s.parent", "s.label", F.array_join("s.pos", ",").alias("pos"), F.array_join("s.registers", ",").alias("registers"), F.concat(example.chinese, F.lit("|"), example.translation).alias("example"), spans(F.col("s.styles")).alias("styles"), spans(F.col("s.refs")).alias("refs"))


@query("SELECT p_partkey AS card, 'unknown' AS problem, 'zz' AS what FROM part")
def card_problems(spark, d):
    x = _cards(spark, d).select("card", F.explode(markup.card_content(F.col("reading"), F.col("body")).problems).alias("p"))
    return x.select("card", "p.problem", "p.what")


@query(f"SELECT p_partkey, 'see ' || {_W1} || ' and 电视 of ' || {_W2} AS text, 1::BIGINT AS n_refs, '电视:電視:dian4 shi4:' || (9 + length({_W1})) || ':' || (11 + length({_W1})) AS refs FROM part")
def gloss_references(spark, d):
    """Trad|Simp[reading] in a gloss becomes the simplified word, with its range."""
    one, two = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    x = _t(spark, d, "part").select("p_partkey", markup.linked(F.concat(F.lit("see "), one, F.lit(" and 電視|电视[dian4 shi4] of "), two)).alias("x"))
    return x.select("p_partkey", "x.text", F.size("x.refs").cast("long").alias("n_refs"), F.array_join(F.transform("x.refs", lambda r: F.concat_ws(":", r.simplified, r.traditional, r.reading, r.start, r.end)), ",").alias("refs"))


@query("SELECT p_partkey, p_name AS name, CASE WHEN p_size % 2 = 0 THEN '2024' || lpad(p_size::VARCHAR, 4, '0') END AS version, CASE p_partkey % 3 WHEN 0 THEN 'CC BY-SA 4.0' WHEN 1 THEN 'CC0' END AS licence FROM part")
def dictionary_names(spark, d):
    """Names without their volume, versions in them, and licences by their address."""
    p = _t(spark, d, "part")
    url = F.when(F.col("p_partkey") % 3 == 0, "https://creativecommons.org/licenses/by-sa/4.0/").when(F.col("p_partkey") % 3 == 1, "https://creativecommons.org/publicdomain/zero/1.0/").otherwise("https://example.org/terms")
    file = F.concat(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_2024"), F.lpad(F.col("p_size").cast("string"), 4, "0"))).otherwise("_12345"))
    return p.select("p_partkey", markup.without_volume(F.concat("p_name", F.lit(" ("), F.col("p_size"), F.lit("/60)"))).alias("name"), markup.version(file).alias("version"), markup.licence(url).alias("licence"))


_SENSES = "CASE WHEN p_size % 3 = 0 THEN 'reference' ELSE 'definition' END"


def _senses():
    kind = F.when(F.col("p_size") % 3 == 0, "reference").otherwise("definition")
    one = F.struct(F.lit(0).alias("id"), kind.alias("kind"), F.concat("p_name", F.lit(" 中")).alias("text"), F.lit(0).alias("level"))
    two = F.struct(F.lit(7).alias("id"), F.lit("label").alias("kind"), F.lit("").alias("text"), (F.col("p_size") * 10).alias("level"))
    return F.array(one, two)


@query(f"SELECT p_partkey, codec, unnest([0, 7]) AS id, unnest([{_SENSES}, 'label']) AS kind, unnest([p_name || ' 中', '']) AS text, unnest([0, p_size * 10]) AS level FROM part, (VALUES ('json'), ('compact-v1')) c(codec)")
def sense_codecs(spark, d):
    """Senses written by either codec and read again."""
    out = None
    for name in ("json", "compact-v1"):
        x = _t(spark, d, "part").select("p_partkey", F.lit(name).alias("codec"), codec.decode(codec.encode(_senses(), name), name).alias("s")).select("p_partkey", "codec", F.inline("s"))
        out = x if out is None else out.unionByName(x)
    return out


@query(
    f"""WITH e AS ({_ENTRY}), w AS (SELECT DISTINCT unnest([simplified, coalesce(traditional, simplified)]) AS word, id, senses FROM e), l AS (SELECT DISTINCT word FROM w WHERE length(word) BETWEEN 1 AND 6 AND senses > 0),
t AS (SELECT unnest(regexp_extract_all(reading, '[,·]|[^ ,·]+')) AS t FROM e) SELECT 'entry' AS name, count(*) AS n, true AS ok FROM e UNION ALL SELECT 'entryCount', count(*), true FROM e UNION ALL SELECT 'lexeme', count(*), true FROM l UNION ALL SELECT 'longestWord', max(length(word)), true FROM l
UNION ALL SELECT 'char_reading', 0, true UNION ALL SELECT 'syllable_base', count(DISTINCT lower(replace(replace(substring(t, 1, length(t) - 1), 'u:', 'ü'), 'v', 'ü'))), true FROM t WHERE regexp_full_match(t, '[\\p{{L}}:]+[1-5]') AND t <> 'xx5'"""
)
def container_verify(spark, d):
    """A dictionary written as a container, put in place, and its figures read back."""
    ws = Workspace(spark, "container")
    path = f"{ws.root}/dictionary"
    container.write(entries(spark, d), path, {"name": "parts", "licence": None})
    return ws.finish(container.verify(spark, path))


@query(f"SELECT simplified, count(*) AS n FROM ({_ENTRY}) GROUP BY simplified")
def container_scan(spark, d):
    """A full scan of stored entries, by headword."""
    ws = Workspace(spark, "scan")
    return ws.keep(entries(spark, d)).groupBy("simplified").agg(F.count("*").alias("n"))
