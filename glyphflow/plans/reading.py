"""Lookups and readings over a dictionary made of the part table.

An entry is a part: its name's first word is the simplified headword, the second the
traditional one; its reading has both words as syllables, with tones by the part's size.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphflow.functions import pinyin as P

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


_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_CAP = "CASE WHEN p_partkey % 6 = 0 THEN upper(substring({0}, 1, 1)) || substring({0}, 2) ELSE {0} END"
_FIELD = f"CASE WHEN p_partkey % 11 = 0 THEN 'xx5' WHEN p_partkey % 13 = 0 THEN {_W1} || '2 , ' || {_W2} || '3' WHEN p_partkey % 17 = 0 THEN 'lu:e4 nv3·K ' || {_W1} || '1' ELSE {_CAP.format(_W1)} || (p_size % 5 + 1) || ' ' || {_W2} || (p_size % 4 + 1) END"
_ENTRY = f"SELECT p_partkey AS id, {_W1} AS simplified, nullif({_W2}, {_W1}) AS traditional, {_FIELD} AS reading, p_size % 9 AS senses, p_type, p_brand FROM part"


def entries(spark, d):
    """id, simplified, traditional, reading (numeric), senses, p_type, p_brand."""
    field = _FIELD.replace("||", "||")
    return _t(spark, d, "part").selectExpr("p_partkey AS id", f"{_W1} AS simplified", f"nullif({_W2}, {_W1}) AS traditional", f"{field} AS reading", "p_size % 9 AS senses", "p_type", "p_brand")


def both_scripts(e):
    """A row for each spelling of an entry."""
    return e.withColumn("word", F.explode(F.array_distinct(F.array("simplified", F.coalesce("traditional", "simplified")))))


_TOKENS = f"(SELECT id, i, len(l) AS n, l[i] AS t, lag(l[i]) OVER (PARTITION BY id ORDER BY i) AS pt FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, regexp_extract_all(reading, '[,·]|[^ ,·]+') AS l FROM ({_ENTRY}))))"
_TAG = "CASE WHEN {0} IN (',', '·') THEN 'separator' WHEN {0} IN ('xx5', 'xx') THEN 'unknown' WHEN regexp_full_match({0}, '[\\p{{L}}:]+[1-5]') THEN 'syllable' ELSE 'literal' END"
_BASE = "replace(replace(substring({0}, 1, length({0}) - 1), 'u:', 'ü'), 'v', 'ü')"


@query(f"SELECT id, i::BIGINT AS i, {_TAG.format('t')} AS tag, CASE WHEN {_TAG.format('t')} = 'syllable' THEN {_BASE.format('t')} END AS base, CASE WHEN {_TAG.format('t')} = 'syllable' THEN right(t, 1)::INT END AS tone FROM {_TOKENS}")
def reading_tokens(spark, d):
    x = entries(spark, d).select("id", F.posexplode(P.parse(F.col("reading"))).alias("i", "x"))
    return x.select("id", (F.col("i") + 1).cast("long").alias("i"), "x.tag", "x.base", "x.tone")


def _marked_sql(b: str, t: str) -> str:
    """The carrier's place by positions, and its mark by Unicode composition."""
    at = f"CASE WHEN regexp_matches({b}, '[aA]') THEN length(regexp_extract({b}, '^[^aA]*')) + 1 WHEN regexp_matches({b}, '[oO]') THEN length(regexp_extract({b}, '^[^oO]*')) + 1 WHEN regexp_matches({b}, '[eE]') THEN length(regexp_extract({b}, '^[^eE]*')) + 1 WHEN regexp_matches({b}, '[iuüIUÜ]') THEN length(regexp_extract({b}, '^.*[iuüIUÜ]')) ELSE length({b}) END"
    mark = f"CASE {t} WHEN '1' THEN chr(772) WHEN '2' THEN chr(769) WHEN '3' THEN chr(780) WHEN '4' THEN chr(768) ELSE '' END"
    return f"nfc_normalize(substring({b}, 1, {at}) || {mark} || substring({b}, {at} + 1))"


_SHOWN = {"diacritic": _marked_sql(_BASE.format("t"), "right(t, 1)"), "numeric": f"replace({_BASE.format('t')}, 'ü', 'u:') || right(t, 1)", "toneless": _BASE.format("t")}


def _render_sql(style: str) -> str:
    shown = _SHOWN["diacritic" if style == "spaced" else style]
    apart = "true" if style in ("numeric", "spaced") else r"regexp_matches(t, '^\p{Lu}')"
    joiner = f"CASE WHEN pt IS NULL OR pt = ',' THEN '' WHEN {_TAG.format('pt')} = 'syllable' THEN CASE WHEN {apart} THEN ' ' WHEN regexp_matches(lower(t), '^[aeo]') AND regexp_matches(lower({_BASE.format('pt')}), '([aeiouü]|n|ng)$') THEN '''' ELSE '' END ELSE ' ' END"
    gap = "CASE WHEN pt IS NULL OR pt = ',' THEN '' ELSE ' ' END"
    return f"CASE {_TAG.format('t')} WHEN 'syllable' THEN {joiner} || {shown} WHEN 'separator' THEN CASE WHEN t = ',' THEN ', ' ELSE t END WHEN 'unknown' THEN {gap} || '{'xx5' if style == 'numeric' else '?'}' ELSE {gap} || t END"


@query("SELECT id, " + ", ".join(f"string_agg({_render_sql(s)}, '' ORDER BY i) AS {s}" for s in P.STYLES) + f" FROM {_TOKENS} GROUP BY id")
def pinyin_render(spark, d):
    """Readings in all four styles."""
    tokens = P.parse(F.col("reading"))
    return entries(spark, d).select("id", *(P.display(tokens, s).alias(s) for s in P.STYLES))


@query(f"SELECT DISTINCT word, id FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) JOIN ({_ENTRY}) ON word = simplified OR word = traditional")
def headwords_both_scripts(spark, d):
    """All homographs of each asked word, in either script: an equi-join of spellings, not an OR."""
    asked = _t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("asked")).distinct()
    return asked.join(both_scripts(entries(spark, d)), F.col("asked") == F.col("word")).select("word", "id")


_SPELLED = f"(SELECT DISTINCT unnest([simplified, coalesce(traditional, simplified)]) AS word, id, reading, senses, p_type FROM ({_ENTRY}))"
_USABLE = f"(SELECT *, regexp_matches(reading, '(^|[ ,·])\\p{{Lu}}\\p{{L}}*[1-5]') AS capital, regexp_matches(reading, '5') AS neutral FROM {_SPELLED} WHERE reading <> '' AND NOT regexp_matches(reading, '(^| )xx5?( |$)'))"
#: Readings that take the place of the best one: by the class of the word before, or (None) always.
RULES = [("degreeAdverb", "old", "old2 bolt3"), (None, "red", "red4 gear1"), (None, "hot", "Hot1 ring2")]
_RULES = "(VALUES " + ", ".join(f"({repr(c) if c else 'NULL'}, '{w}', '{r}')" for c, w, r in RULES) + ") r(cls, rule_word, wanted)"
#: Words that grade or negate the one after them, fixed values.
DEGREE = "很 太 挺 真 好 最 更 够 夠 蛮 蠻 颇 頗 非常 特别 特別 比较 比較 十分 相当 相當 极 極 极其 極其 格外 尤其 异常 異常 这么 這麼 那么 那麼 多么 多麼 稍微 有点 有點 有点儿 有點兒 有些 过于 過於 越来越 越來越 不太".split()
NEGATORS = "不 并不 並不".split()


def word_class(word):
    return F.when(word.isin(*DEGREE), "degreeAdverb").when(word.isin(*NEGATORS), "negator")


def usable(e):
    """Spellings with a known reading, and what they are ranked by."""
    tokens = P.parse(F.col("reading"))
    known = (F.col("reading") != "") & ~F.exists(tokens, lambda x: x.tag == "unknown")
    capital, neutral = F.exists(tokens, lambda x: x.base.rlike(r"^\p{Lu}")), F.exists(tokens, lambda x: x.tone == 5)
    return both_scripts(e).where(known).withColumn("capital", F.coalesce(capital, F.lit(False))).withColumn("neutral", F.coalesce(neutral, F.lit(False)))


def _first(*then):
    """Names last, then a neutral tone first, more senses first, the smallest reading first."""
    return F.struct("capital", (~F.col("neutral")).alias("stressed"), (-F.col("senses")).alias("fewer"), "reading", *then)


@query(
    f"""WITH u AS {_USABLE}, b AS (SELECT word, arg_min(reading, {{'a': capital, 'b': NOT neutral, 'c': -senses, 'd': reading}}) AS best, count(DISTINCT lower(reading)) > 1 AS ambiguous FROM u GROUP BY word),
x AS (SELECT u.word, min(wanted) AS w FROM u JOIN {_RULES} ON rule_word = u.word AND cls IS NULL AND lower(u.reading) = lower(wanted) GROUP BY u.word)
SELECT b.word, coalesce((SELECT arg_min(reading, {{'a': capital, 'b': NOT neutral, 'c': -senses, 'd': reading}}) FROM u WHERE u.word = b.word AND lower(u.reading) = lower(x.w)), best) AS best, ambiguous FROM b LEFT JOIN x ON x.word = b.word"""
)
def word_reading(spark, d):
    """The best reading of each word, or the one that a rule names where the word has it; and whether it has several."""
    u = usable(entries(spark, d))
    rules = spark.createDataFrame([r[1:] for r in RULES if r[0] is None], "rule_word string, wanted string")  # a few rows
    u = u.join(F.broadcast(rules), (F.col("word") == F.col("rule_word")) & (F.lower("reading") == F.lower("wanted")), "left")
    ruled = F.min_by("reading", F.when(F.col("wanted").isNotNull(), _first()))
    return u.groupBy("word").agg(F.coalesce(ruled, F.min_by("reading", _first())).alias("best"), (F.count_distinct(F.lower("reading")) > 1).alias("ambiguous"))


@query(f"SELECT word, reading, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, (dense_rank() OVER (PARTITION BY word ORDER BY reading) - 1)::BIGINT AS place FROM {_SPELLED} GROUP BY word, reading")
def reading_groups(spark, d):
    """Entries of a word by reading, in the order of readings."""
    g = both_scripts(entries(spark, d)).groupBy("word", "reading").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    return g.withColumn("place", (F.row_number().over(Window.partitionBy("word").orderBy("reading")) - 1).cast("long"))


_CHARS = f"""(SELECT character, numeric, (row_number() OVER (PARTITION BY character ORDER BY upper_first, NOT has_definition, -senses, numeric) - 1)::BIGINT AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY character, numeric ORDER BY NOT has_definition, -senses, id) AS best FROM (
SELECT DISTINCT id, substring(word, 1, 1) AS character, regexp_extract(reading, '^[\\p{{L}}:]+[1-5]') AS numeric, regexp_matches(reading, '^\\p{{Lu}}') AS upper_first, p_type <> 'PROMO' AS has_definition, senses FROM {_SPELLED} WHERE regexp_matches(reading, '^[\\p{{L}}:]+[1-5]') AND reading <> 'xx5')) WHERE best = 1)"""


def character_readings_of(e):
    """character, numeric, rank: the best entry of each reading of a character, ranked by small letters, definitions, senses, reading."""
    first = F.regexp_extract("reading", r"^[\p{L}:]+[1-5]", 0)
    c = both_scripts(e).where(F.col("reading").rlike(r"^[\p{L}:]+[1-5]") & (F.col("reading") != "xx5"))
    c = c.select(F.substring("word", 1, 1).alias("character"), first.alias("numeric"), F.col("reading").rlike(r"^\p{Lu}").alias("upper_first"), (F.col("p_type") == "PROMO").alias("no_definition"), "senses", "id")
    best = c.groupBy("character", "numeric").agg(F.min(F.struct("no_definition", (-F.col("senses")).alias("fewer"), "id", "upper_first")).alias("x"))
    w = Window.partitionBy("character").orderBy("x.upper_first", "x.no_definition", "x.fewer", "numeric")
    return best.select("character", "numeric", (F.row_number().over(w) - 1).cast("long").alias("rank"))


@query(f"SELECT * FROM {_CHARS}")
def character_readings(spark, d):
    return character_readings_of(entries(spark, d))


_ASKED = "(SELECT DISTINCT lower(substring(p_type, 1, 3)) AS word FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part)"
_COMPOSED = f"(SELECT word, CASE WHEN count(numeric) = max(length(word)) THEN string_agg(numeric, ' ' ORDER BY i) END AS composed FROM (SELECT word, i, substring(word, i::INT, 1) AS c FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM {_ASKED})) LEFT JOIN {_CHARS} ON character = c AND rank = 0 GROUP BY word)"


def _composed(spark, d, asked):
    best = character_readings_of(entries(spark, d)).where("rank = 0").select(F.col("character").alias("c"), "numeric")
    chars = asked.select("word", F.posexplode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("i", "character"))
    r = chars.join(best, F.col("character") == F.col("c"), "left").groupBy("word").agg(F.count("numeric").alias("known"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("i", "numeric"))).alias("x"))
    return r.select("word", F.when(F.col("known") == F.col("n"), F.array_join(F.transform("x", lambda y: y.numeric), " ")).alias("composed"))


def _asked(spark, d):
    p = _t(spark, d, "part")
    return p.select(F.lower(F.substring("p_type", 1, 3)).alias("word")).union(p.select(F.explode(F.split("p_name", " ")))).distinct()


@query(f"SELECT * FROM {_COMPOSED}")
def composed_reading(spark, d):
    """A word's reading by its characters; none if one of them has none."""
    return _composed(spark, d, _asked(spark, d))


@query(f"SELECT c.word, coalesce(b.best, composed) AS reading, CASE WHEN b.best IS NOT NULL THEN CASE WHEN ambiguous THEN 'ambiguous' ELSE 'dictionary' END WHEN composed IS NOT NULL THEN 'composed' END AS source FROM {_COMPOSED} c LEFT JOIN (SELECT word, arg_min(reading, {{'a': capital, 'b': NOT neutral, 'c': -senses, 'd': reading}}) AS best, count(DISTINCT lower(reading)) > 1 AS ambiguous FROM {_USABLE} GROUP BY word) b ON b.word = c.word")
def reading_resolution(spark, d):
    """The dictionary's reading, else the composed one, and which it is."""
    exact = usable(entries(spark, d)).groupBy(F.col("word").alias("w")).agg(F.min_by("reading", _first()).alias("best"), (F.count_distinct(F.lower("reading")) > 1).alias("ambiguous"))
    x = _composed(spark, d, _asked(spark, d)).join(exact, F.col("word") == F.col("w"), "left")
    source = F.when(F.col("best").isNotNull(), F.when(F.col("ambiguous"), "ambiguous").otherwise("dictionary")).when(F.col("composed").isNotNull(), "composed")
    return x.select("word", F.coalesce("best", "composed").alias("reading"), source.alias("source"))


_CONTEXT = "(VALUES (0, '很'), (1, '不'), (2, '越来越'), (3, '他'), (4, NULL)) c(k, before)"
_CLS = "CASE WHEN before IN (" + ", ".join(f"'{w}'" for w in DEGREE) + ") THEN 'degreeAdverb' WHEN before IN (" + ", ".join(f"'{w}'" for w in NEGATORS) + ") THEN 'negator' END"


@query(f"SELECT DISTINCT word, {_CLS} AS cls, coalesce(wanted, best) AS reading FROM (SELECT {_W1} AS word, before FROM part JOIN {_CONTEXT} ON k = p_partkey % 5) LEFT JOIN (SELECT word AS w, arg_min(reading, {{'a': capital, 'b': NOT neutral, 'c': -senses, 'd': reading}}) AS best FROM {_USABLE} GROUP BY word) ON w = word LEFT JOIN {_RULES} ON rule_word = word AND cls = {_CLS} AND EXISTS (SELECT 1 FROM {_USABLE} u WHERE u.word = rule_word AND lower(u.reading) = lower(wanted))")
def batched_lookup(spark, d):
    """Distinct requests of a word and the class of the word before it, each with its reading."""
    before = spark.createDataFrame([(0, "很"), (1, "不"), (2, "越来越"), (3, "他"), (4, None)], "k int, before string")  # five rows
    asked = entries(spark, d).select("simplified", (F.col("id") % 5).alias("at")).join(F.broadcast(before), F.col("k") == F.col("at")).select(F.col("simplified").alias("word"), word_class(F.col("before")).alias("cls")).distinct()
    u = usable(entries(spark, d))
    best = u.groupBy(F.col("word").alias("w")).agg(F.min_by("reading", _first()).alias("best"), F.collect_set(F.lower("reading")).alias("has"))
    rules = spark.createDataFrame([r for r in RULES if r[0]], "rule_class string, rule_word string, wanted string")  # a few rows
    x = asked.join(best, F.col("word") == F.col("w"), "left").join(F.broadcast(rules), (F.col("word") == F.col("rule_word")) & (F.col("cls") == F.col("rule_class")) & F.array_contains("has", F.lower("wanted")), "left")
    return x.select("word", "cls", F.coalesce("wanted", "best").alias("reading"))


@query(f"SELECT c, coalesce(string_agg(numeric, ' ' ORDER BY rank), '') AS readings FROM (SELECT DISTINCT substring(p_type, 1 + (p_partkey % 3)::INT, 1) AS c0, lower(substring(p_type, 1 + (p_partkey % 3)::INT, 1)) AS c FROM part) LEFT JOIN {_CHARS} ON character = c GROUP BY c")
def batched_characters(spark, d):
    """Distinct characters with their ranked readings; those without are there too."""
    asked = _t(spark, d, "part").select(F.lower(F.expr("substring(p_type, 1 + cast(p_partkey % 3 as int), 1)")).alias("c")).distinct()
    r = character_readings_of(entries(spark, d))
    x = asked.join(r, F.col("c") == F.col("character"), "left").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("rank", "numeric"))).alias("x"))
    return x.select("c", F.array_join(F.transform("x", lambda y: y.numeric), " ").alias("readings"))


@query(f"SELECT a.word AS a, b.word AS b, a.has && b.has AS homophone, a.bare && b.bare AS same_base FROM (SELECT word, list(DISTINCT lower(reading)) AS has, list(DISTINCT lower(regexp_extract(reading, '^[\\p{{L}}:]+'))) AS bare FROM {_SPELLED} GROUP BY word) a JOIN (SELECT word, list(DISTINCT lower(reading)) AS has, list(DISTINCT lower(regexp_extract(reading, '^[\\p{{L}}:]+'))) AS bare FROM {_SPELLED} GROUP BY word) b ON substring(a.word, 1, 1) = substring(b.word, 1, 1) AND a.word < b.word")
def reading_overlap(spark, d):
    """Words of one initial whose readings, or bases of readings, overlap."""
    g = both_scripts(entries(spark, d)).groupBy("word").agg(F.collect_set(F.lower("reading")).alias("has"), F.collect_set(F.lower(F.regexp_extract("reading", r"^[\p{L}:]+", 0))).alias("bare"))
    a, b = g.select(F.col("word").alias("a"), F.col("has").alias("ha"), F.col("bare").alias("ba")), g.select(F.col("word").alias("b"), F.col("has").alias("hb"), F.col("bare").alias("bb"))
    x = a.join(b, (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.col("a") < F.col("b")))
    return x.select("a", "b", F.arrays_overlap("ha", "hb").alias("homophone"), F.arrays_overlap("ba", "bb").alias("same_base"))


@query("SELECT p_partkey, coalesce(list_filter(l, lambda x: x.kind = 'definition' AND x.gloss <> '')[1], list_filter(l, lambda x: x.gloss <> '')[1], list_filter(l, lambda x: x.kind = 'definition')[1], l[1]).gloss AS summary FROM (SELECT p_partkey, [{'kind': CASE WHEN p_size % 3 = 0 THEN 'reference' ELSE 'definition' END, 'gloss': CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END}, {'kind': CASE WHEN p_size % 5 = 0 THEN 'definition' ELSE 'label' END, 'gloss': CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END}] AS l FROM part)")
def summary_sense(spark, d):
    """The first definition with text, else any with text, else a definition, else the first."""
    one = F.struct(F.when(F.col("p_size") % 3 == 0, "reference").otherwise("definition").alias("kind"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")).alias("gloss"))
    two = F.struct(F.when(F.col("p_size") % 5 == 0, "definition").otherwise("label").alias("kind"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name")).alias("gloss"))
    x = _t(spark, d, "part").select("p_partkey", F.array(one, two).alias("l"))
    first = lambda f: F.try_element_at(F.filter("l", f), F.lit(1))
    return x.select("p_partkey", F.coalesce(first(lambda s: (s.kind == "definition") & (s.gloss != "")), first(lambda s: s.gloss != ""), first(lambda s: s.kind == "definition"), F.col("l")[0]).gloss.alias("summary"))


_MINED = f"""WITH w AS (SELECT character, numeric AS winner FROM {_CHARS} WHERE rank = 0),
o AS (SELECT substring(w, 1, 1) AS c, regexp_extract(reading, '^[\\p{{L}}:]+[1-5]') AS r, count(*) AS n FROM (SELECT simplified AS w, reading FROM ({_ENTRY}) WHERE p_type <> 'PROMO' AND senses > 2 AND reading <> 'xx5') GROUP BY ALL)
SELECT character, winner, r AS rival, n FROM w JOIN o ON c = character WHERE r <> winner AND n >= 2 AND NOT EXISTS (SELECT 1 FROM o x WHERE x.c = character AND x.r = winner)"""


@query(_MINED)
def heteronym_mining(spark, d):
    """Characters whose best reading is in no compound while another is in some; grammar words do not count."""
    e = entries(spark, d)
    w = character_readings_of(e).where("rank = 0").select("character", F.col("numeric").alias("winner"))
    o = e.where("p_type <> 'PROMO' AND senses > 2 AND reading <> 'xx5'").groupBy(F.substring("simplified", 1, 1).alias("c"), F.regexp_extract("reading", r"^[\p{L}:]+[1-5]", 0).alias("r")).agg(F.count("*").alias("n"))
    has = o.select(F.col("c").alias("c2"), F.col("r").alias("r2"))
    return w.join(has, (F.col("character") == F.col("c2")) & (F.col("winner") == F.col("r2")), "left_anti").join(o, F.col("character") == F.col("c")).where("r <> winner AND n >= 2").select("character", "winner", F.col("r").alias("rival"), "n")


@query()
def syllabify(spark, d):
    """Marked readings without their gaps, split again into known bases."""
    known = _t(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("b")).distinct()
    if (n := known.count()) > 100_000:
        raise ValueError(f"{n} bases are no syllables; the bound is 100,000")
    bases = frozenset(r.b for r in known.collect())
    shown = P.display(P.parse(F.col("reading")), "diacritic")
    return entries(spark, d).select("id", P.syllabified(shown, bases).alias("numeric"))


@query(f"SELECT id, lower(regexp_replace(t, '[0-9]$', '')) AS base FROM {_TOKENS} WHERE lower(regexp_replace(t, '[0-9]$', '')) <> ''")
def stripped_bases(spark, d):
    x = entries(spark, d).select("id", F.explode(P.parse(F.col("reading"))).alias("x"))
    return x.select("id", P.stripped(F.col("x.text")).alias("base")).where("base IS NOT NULL")


@query(f"SELECT word, length(word)::BIGINT AS char_length, round(max(1.0 / length(word) + least(senses, 8) / 8.0), 9)::DOUBLE AS weight FROM {_SPELLED} WHERE length(word) BETWEEN 1 AND CASE WHEN p_type = 'SMALL' THEN 4 ELSE 6 END AND senses > 0 AND regexp_full_match(word, '[a-z]+') GROUP BY word")
def lexicon_admission(spark, d):
    """Words of both scripts with a definition, of one script only, and short enough (shorter for an encyclopaedia)."""
    e = both_scripts(entries(spark, d)).where(F.length("word").between(1, F.when(F.col("p_type") == "SMALL", 4).otherwise(6)) & (F.col("senses") > 0) & F.col("word").rlike("^[a-z]+$"))
    return e.groupBy("word").agg(F.round(F.max(1 / F.length("word") + F.least("senses", F.lit(8)) / 8), 9).alias("weight")).select("word", F.length("word").cast("long").alias("char_length"), "weight")
