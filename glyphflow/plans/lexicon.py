"""Lexicon queries: words of part names, and inline dictionary fixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphflow.functions import pinyin as P
from glyphflow.operators.segment import segment
from glyphflow.plans.staging import Workspace
from glyphflow.sources import cards, cedict, encodings

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _words(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", "p_brand", F.explode(F.split("p_name", " ")).alias("word"))


def build(words, most: int = 6):
    """word, char_length, weight: the largest of 1/length + min(senses, 8)/8."""
    w = words.where(F.length("word").between(1, most)).groupBy("word", "p_brand").count()
    return w.groupBy("word").agg(F.max(1 / F.length("word") + F.least("count", F.lit(8)) / 8).alias("weight")).select("word", F.length("word").cast("long").alias("char_length"), "weight")


@query("SELECT word, length(word)::BIGINT AS char_length, round(max(1.0 / length(word) + least(n, 8) / 8.0), 9)::DOUBLE AS weight FROM (SELECT word, p_brand, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY ALL) WHERE length(word) BETWEEN 1 AND 6 GROUP BY word")
def lexicon_build(spark, d):
    return build(_words(spark, d)).withColumn("weight", F.round("weight", 9))


@query()
def max_match_segment(spark, d):
    """Part names without their space, split again by the lexicon of their own words."""
    lex = build(_words(spark, d)).withColumn("weight", 1 / F.col("char_length") + 1 / 8)
    names = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("joined"))
    return segment(names, "joined", lex).select("p_partkey", F.array_join("words", "|").alias("words"))


@query("SELECT word, p_brand, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, p_brand) - 1 AS rank FROM (SELECT word, p_brand, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY ALL)")
def reading_rank(spark, d):
    """Every candidate of every word by its rank."""
    c = _words(spark, d).groupBy("word", "p_brand").agg(F.count("*").alias("n"))
    return c.withColumn("rank", (F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "p_brand")) - 1).cast("long"))


@query("SELECT word, min(p_brand) FILTER (WHERE n = top) AS best, count(*) > 1 AS ambiguous FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM (SELECT word, p_brand, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY ALL)) GROUP BY word")
def best_reading(spark, d):
    c = _words(spark, d).groupBy("word", "p_brand").agg(F.count("*").alias("n"))
    return c.groupBy("word").agg(F.min_by("p_brand", F.struct(-F.col("n"), "p_brand")).alias("best"), (F.count("*") > 1).alias("ambiguous"))


@query("SELECT word, arg_max(p_brand, p_brand) AS last_source, max(p_partkey) FILTER (WHERE p_brand = b) AS last_part FROM (SELECT *, max(p_brand) OVER (PARTITION BY word) AS b FROM (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS word FROM part)) GROUP BY word")
def lexicon_merge_last(spark, d):
    return _words(spark, d).groupBy("word").agg(F.max("p_brand").alias("last_source"), F.max(F.struct("p_brand", "p_partkey")).alias("x")).select("word", "last_source", F.col("x.p_partkey").alias("last_part"))


@query("SELECT p_partkey FROM part WHERE p_name LIKE 'old %' OR p_type LIKE 'PROMO%'")
def headword_lookup(spark, d):
    """Either of two fields, as two equi-conditions united rather than an OR join."""
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.where(F.col("p_name").startswith("old ")).select("p_partkey").union(p.where(F.col("p_type").startswith("PROMO")).select("p_partkey")).distinct()


@query("SELECT DISTINCT lower(word) AS base FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)")
def syllable_bases(spark, d):
    return _words(spark, d).select(F.lower("word").alias("base")).distinct()


def _values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


_SYLLABLES = [("hao3", "hǎo"), ("lüe4", "lüè"), ("nu:3", "nǚ"), ("xiong2", "xióng"), ("gui4", "guì"), ("liu2", "liú"), ("ma5", "ma"), ("shuo1", "shuō"), ("dou1", "dōu"), ("m2", "ḿ"), ("bei4", "bèi"), ("jiu3", "jiǔ"), ("ai4", "ài")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SYLLABLES) + ") t(syllable, marked)")
def pinyin_tone_marks(spark, d):
    s = _values(spark, [(a,) for a, _ in _SYLLABLES], "syllable string")
    return s.select("syllable", P.marked(F.col("syllable")).alias("marked"))


_TOKENS = [("ni3", "syllable", "ni", 3), (",", "separator", None, None), ("xx5", "unknown", None, None), ("K", "literal", None, None), ("lu:4", "syllable", "lü", 4), ("·", "separator", None, None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{g}', {repr(b) if b else 'NULL::VARCHAR'}, {n or 'NULL::INT'})" for t, g, b, n in _TOKENS) + ") t(token, tag, base, tone)")
def pinyin_parse(spark, d):
    s = _values(spark, [(t,) for t, *_ in _TOKENS], "token string")
    is_syllable = P.token_tag(F.col("token")) == "syllable"
    return s.select("token", P.token_tag(F.col("token")).alias("tag"), F.when(is_syllable, P.base(F.col("token"))).alias("base"), F.when(is_syllable, P.tone(F.col("token"))).alias("tone"))


_LINES = ["# comment", "#! version=1", "你好 你好 [ni3 hao3] /hello/hi/", "國 国 [Guo2] /surname Guo/country/", "坏", "電視 电视 [dian4 shi4] /see 电视机/", "a b c /x/", "學 学 [xue2] no"]
_PARSED = [(1, "comment", None, None, None, 0, None), (2, "metadata", None, None, None, 0, None), (3, "entry", None, "你好", None, 2, "definition"), (4, "entry", None, "国", "國", 2, "label"), (5, "error", "tooFewFields", None, None, 0, None), (6, "entry", None, "电视", "電視", 1, "reference"), (7, "error", "missingPinyinBrackets", None, None, 0, None), (8, "error", "missingDefinitions", None, None, 0, None)]


def _lit(x):
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


@query("SELECT line_no::BIGINT AS line_no, kind, error, simplified, traditional, n_senses::BIGINT AS n_senses, first_kind FROM (VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in _PARSED) + ") t(line_no, kind, error, simplified, traditional, n_senses, first_kind)")
def cedict_parse(spark, d):
    x = cedict.parse(_values(spark, list(enumerate(_LINES, 1)), "line_no long, line string"))
    return x.select("line_no", "kind", "error", "simplified", "traditional", F.greatest(F.size("senses"), F.lit(0)).cast("long").alias("n_senses"), F.when(F.col("kind") == "entry", cedict.sense_kind(F.col("senses")[0])).alias("first_kind"))


_CARD_LINES = ["#NAME x", "一", " yī", " [m1]one[/m]", "二", "两", " [m1]two[/m]", " more", "三", " san"]


@query("SELECT * FROM (VALUES (1::BIGINT, '一', 'yī', 1), (2, '二,两', NULL, 2), (3, '三', NULL, 1)) t(card, headwords, reading, n_body)")
def card_assembly(spark, d):
    x = cards.assemble(_values(spark, [(0, k * 10, v) for k, v in enumerate(_CARD_LINES)], "file int, offset long, line string"))
    return x.select("card", F.array_join("headwords", ",").alias("headwords"), "reading", F.size("body").alias("n_body"))


@query("SELECT * FROM (VALUES ('a', 'utf-8', 1.0), ('b', 'utf-16-le', 1.0), ('c', 'gb18030', 1.0)) t(name, encoding, plausibility)")
def encoding_detect(spark, d):
    rows = [("a", "héllo 你".encode()), ("b", b"\xff\xfe" + "hi".encode("utf-16-le")), ("c", "你好世界".encode("gb18030"))]
    x = _values(spark, [(n, bytearray(b)) for n, b in rows], "name string, content binary").select("name", encodings.detected("content").alias("x"))
    return x.select("name", "x.encoding", "x.plausibility")


@query("WITH RECURSIVE e(a, b) AS (VALUES (1, 2), (2, 3), (3, 1), (3, 4), (5, 6)), r AS (SELECT 1 AS n UNION SELECT b FROM r JOIN e ON a = n) SELECT n FROM r")
def include_closure(spark, d):
    """Files reachable through includes, cycles allowed: each round follows the newly found ones only."""
    ws = Workspace(spark, "includes")
    edges = _values(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "a int, b int")
    found = new = ws.keep(_values(spark, [(1,)], "n int"))
    while True:
        new = ws.keep(new.join(edges, F.col("n") == F.col("a")).select(F.col("b").alias("n")).distinct().join(found, "n", "left_anti"))
        if new.count() == 0:
            return found
        found = found.union(new)


@query("SELECT * FROM (VALUES ('很', '长', 'chang2'), (NULL, '长', 'zhang3'), ('不', '了', 'le5')) t(context, character, reading)")
def heteronym_rule(spark, d):
    """A rule for the class of the word before, else the default of the character."""
    rules = _values(spark, [("degree", "长", "chang2"), (None, "长", "zhang3"), (None, "了", "le5")], "preceding string, character string, reading string")
    asked = _values(spark, [("很", "长"), (None, "长"), ("不", "了")], "context string, character string")
    cls = F.when(F.col("context").isin("很", "最", "太"), "degree").when(F.col("context").isin("不", "没"), "negator")
    a = asked.withColumn("cls", cls)
    exact = rules.where("preceding IS NOT NULL").select(F.col("preceding").alias("p"), F.col("character").alias("c"), F.col("reading").alias("r1"))
    default = rules.where("preceding IS NULL").select(F.col("character").alias("c2"), F.col("reading").alias("r2"))
    return a.join(exact, (F.col("cls") == F.col("p")) & (F.col("character") == F.col("c")), "left").join(default, F.col("character") == F.col("c2"), "left").select("context", "character", F.coalesce("r1", "r2").alias("reading"))
