"""Phrases and their times over driver tables: an order's lines stand for a text's phrases, events for what was heard.

Folds run over one order's array inside its row (aggregate), after a grouping by order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphflow.functions import text as X
from glyphflow.operators import layout as Y
from glyphflow.operators import listening as L
from glyphflow.operators.segment import merged
from glyphflow.plans.lexicon import _words, build
from glyphflow.plans.texts import _OWN_SQL, _docs, _sql, _texts

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


#: Lines of one order with equal numbers are told apart by all that the passes read of them.
_TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
_ORDER = "PARTITION BY l_orderkey ORDER BY " + ", ".join(_TIES)
_N = "CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity END"


def _lines(spark, d, **columns):
    """Each order's lines as an ordered array of structs."""
    its = F.struct(*_TIES, *(F.expr(v).alias(k) for k, v in columns.items()))
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(its)).alias("x"))


def _glue(joins):
    """Fold: sizes of packs, where joins(last, n) adds n to the last one."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & joins(F.try_element_at(acc, F.lit(-1)), x.n), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.try_element_at(acc, F.lit(-1)) + x.n))).otherwise(F.concat(acc, F.array(x.n)))

    return F.aggregate("x", F.array().cast("array<double>"), step)


def _glue_sql(n: str, joins: str) -> str:
    return f"""WITH RECURSIVE x AS (SELECT l_orderkey, row_number() OVER ({_ORDER}) AS k, {n} AS n FROM lineitem),
f AS (SELECT l_orderkey, k, n AS last, 1 AS packs, n AS largest FROM x WHERE k = 1 UNION ALL
SELECT x.l_orderkey, x.k, CASE WHEN {joins} THEN last + x.n ELSE x.n END, packs + CASE WHEN {joins} THEN 0 ELSE 1 END, greatest(largest, CASE WHEN {joins} THEN last + x.n ELSE x.n END) FROM f JOIN x ON x.l_orderkey = f.l_orderkey AND x.k = f.k + 1)
SELECT l_orderkey, arg_max(packs, k)::BIGINT AS packs, arg_max(largest, k)::DOUBLE AS largest FROM f GROUP BY l_orderkey"""


def _packs(df, fold):
    return df.select("l_orderkey", fold.alias("p")).select("l_orderkey", F.size("p").cast("long").alias("packs"), F.array_max("p").alias("largest"))


@query(_glue_sql(_N, "x.n = 0 OR last + x.n <= 60"))
def clause_packing(spark, d):
    """A clause extends the last pack while it fits, and always where it has punctuation only."""
    return _packs(_lines(spark, d, n=f"cast({_N} as double)"), _glue(lambda last, n: (n == 0) | (last + n <= 60)))


@query(_glue_sql("l_quantity", "x.n < 15 AND last + x.n <= 60"))
def short_phrase_merge(spark, d):
    return _packs(_lines(spark, d, n="l_quantity"), _glue(lambda last, n: (n < 15) & (last + n <= 60)))


@query(_glue_sql("l_quantity", "last + x.n <= 75"))
def audio_repack(spark, d):
    """Pieces of a recording, merged while their time is at most 75."""
    return _packs(_lines(spark, d, n="l_quantity"), _glue(lambda last, n: last + n <= 75))


_TIDY = """WITH RECURSIVE x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER w AS k, l_quantity AS a, l_quantity + l_discount * 20 - 0.5 AS b, lead(l_quantity) OVER w AS nx FROM lineitem WINDOW w AS ({o})),
s AS (SELECT *, greatest(0.0, 0.0) AS floor0 FROM x),
f AS (SELECT l_orderkey, 0::BIGINT AS k, 0.0::DOUBLE AS s, 0.0::DOUBLE AS e FROM x WHERE k = 1 UNION ALL
SELECT l_orderkey, k, CASE WHEN e2 - s1 < 0.25 THEN greatest(floor_, greatest(0.0, e2 - 0.25)) ELSE s1 END, CASE WHEN e2 - s1 < 0.25 THEN greatest(e2, greatest(floor_, greatest(0.0, e2 - 0.25))) ELSE e2 END FROM (
SELECT *, CASE WHEN e1 - s1 < 0.25 THEN least(s1 + 0.25, 50.0) ELSE e1 END AS e2 FROM (
SELECT *, CASE WHEN e0 <= s1 THEN least(greatest(coalesce(nx, 50.0), s1 + 0.25), 50.0) ELSE e0 END AS e1 FROM (
SELECT *, least(greatest(b, s1), 50.0) AS e0 FROM (
SELECT x.l_orderkey, x.k, x.b, x.nx, f.e AS floor_, least(greatest(x.a, f.e), 50.0) AS s1 FROM f JOIN x ON x.l_orderkey = f.l_orderkey AND x.k = f.k + 1)))))
SELECT l_orderkey, k, round(s, 6)::DOUBLE AS start_time, round(e, 6)::DOUBLE AS end_time FROM f WHERE k > 0""".replace("{o}", _ORDER).replace("s AS (SELECT *, greatest(0.0, 0.0) AS floor0 FROM x),\n", "")


@query(_TIDY)
def timeline_tidy(spark, d):
    """Times made monotone, inside the recording of 50, and a quarter long where there is room."""
    x = _lines(spark, d, a="l_quantity", b="l_quantity + l_discount * 20 - 0.5")
    limit, least = F.lit(50.0), F.lit(L.MINIMUM)
    x = x.withColumn("x", F.zip_with("x", F.slice(F.transform("x", lambda y: y.a), 2, 1 << 30), lambda y, nx: F.struct(y.a.alias("a"), y.b.alias("b"), nx.alias("nx"))))

    def step(acc, y):
        floor = F.coalesce(F.try_element_at(acc, F.lit(-1)).e, F.lit(0.0))
        s1 = F.least(F.greatest(y.a, floor), limit)
        e0 = F.least(F.greatest(y.b, s1), limit)
        e1 = F.when(e0 <= s1, F.least(F.greatest(F.coalesce(y.nx, limit), s1 + least), limit)).otherwise(e0)
        e2 = F.when(e1 - s1 < least, F.least(s1 + least, limit)).otherwise(e1)
        back = F.greatest(floor, F.greatest(F.lit(0.0), e2 - least))
        short = e2 - s1 < least
        return F.concat(acc, F.array(F.struct(F.when(short, back).otherwise(s1).alias("s"), F.when(short, F.greatest(e2, back)).otherwise(e2).alias("e"))))

    out = x.select("l_orderkey", F.posexplode(F.aggregate("x", F.array().cast("array<struct<s:double,e:double>>"), step)).alias("k", "y"))
    return out.select("l_orderkey", (F.col("k") + 1).cast("long").alias("k"), F.round("y.s", 6).alias("start_time"), F.round("y.e", 6).alias("end_time"))


_PHRASES = f"(SELECT l_orderkey, k, start_time, start_time + l_quantity AS end_time, manual FROM (SELECT l_orderkey, l_quantity, l_returnflag = 'R' AS manual, row_number() OVER w AS k, sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - l_quantity + CASE WHEN l_linestatus = 'O' THEN 0.5 ELSE 0 END * row_number() OVER w AS start_time FROM lineitem WINDOW w AS ({_ORDER})))"


def _phrases(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(*_TIES)
    k = F.row_number().over(w)
    start = F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("l_quantity") + F.when(F.col("l_linestatus") == "O", 0.5).otherwise(0) * k
    x = _t(spark, d, "lineitem").select("l_orderkey", k.cast("long").alias("k"), start.alias("start_time"), "l_quantity", (F.col("l_returnflag") == "R").alias("manual"))
    return x.select("l_orderkey", "k", "start_time", (F.col("start_time") + F.col("l_quantity")).alias("end_time"), "manual")


_BY = "WINDOW w AS (PARTITION BY l_orderkey ORDER BY k)"
_MOVE = f"""WITH p AS {_PHRASES}, q AS (SELECT *, lag(start_time) OVER w AS ps, lag(end_time) OVER w AS pe FROM p {_BY}),
r AS (SELECT *, pe IS NOT NULL AND abs(pe - start_time) < 0.001 AS abuts, CASE WHEN pe IS NULL THEN 0 WHEN abs(pe - start_time) < 0.001 THEN ps + 0.25 ELSE pe END AS lo, end_time - 0.25 AS hi FROM q WHERE k = 3),
m AS (SELECT *, greatest(lo, least(hi, start_time - 4.0)) AS new FROM r WHERE lo <= hi)
SELECT l_orderkey, 3::BIGINT AS k, round(new, 6)::DOUBLE AS start_time, round(end_time, 6)::DOUBLE AS end_time FROM m WHERE new <> start_time UNION ALL SELECT l_orderkey, 2, round(ps, 6), round(new, 6) FROM m WHERE new <> start_time AND abuts"""


@query(_MOVE)
def boundary_move(spark, d):
    """The start of each third phrase moved back by four, within bounds; a neighbour that abuts moves too. Changed rows only."""
    w = Window.partitionBy("l_orderkey").orderBy("k")
    q = _phrases(spark, d).withColumn("ps", F.lag("start_time").over(w)).withColumn("pe", F.lag("end_time").over(w)).where("k = 3")
    abuts = F.coalesce(F.abs(F.col("pe") - F.col("start_time")) < 0.001, F.lit(False))
    lo = F.when(F.col("pe").isNull(), 0.0).when(abuts, F.col("ps") + L.MINIMUM).otherwise(F.col("pe"))
    m = q.withColumn("abuts", abuts).withColumn("lo", lo).withColumn("hi", F.col("end_time") - L.MINIMUM).where("lo <= hi")
    m = m.withColumn("new", F.greatest("lo", F.least("hi", F.col("start_time") - 4.0))).where("new <> start_time")
    own = F.struct(F.lit(3).cast("long").alias("k"), F.col("new").alias("s"), F.col("end_time").alias("e"))
    before = F.struct(F.lit(2).cast("long").alias("k"), F.col("ps").alias("s"), F.col("new").alias("e"))
    return m.select("l_orderkey", F.explode(F.when(F.col("abuts"), F.array(own, before)).otherwise(F.array(own))).alias("y")).select("l_orderkey", "y.k", F.round("y.s", 6).alias("start_time"), F.round("y.e", 6).alias("end_time"))


_PLACE = f"""WITH p AS {_PHRASES}, c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, max(CASE WHEN k = 1 THEN start_time END) OVER (PARTITION BY l_orderkey) AS first_start FROM p),
t AS (SELECT *, greatest(first_start + 0.25, least(400 - 0.25 * (n - 1), 20.0)) AS b, n - 1 AS tail, coalesce(min(CASE WHEN manual AND k >= 2 THEN k END) OVER (PARTITION BY l_orderkey), n + 1) AS stop FROM c WHERE n > 1),
u AS (SELECT *, greatest(1, stop - 2) AS free, greatest(0.25, (400 - b) / greatest(1, stop - 2)) AS slice FROM t WHERE first_start + 0.25 <= 400 - 0.25 * tail)
SELECT l_orderkey, k, round(CASE WHEN k = 1 THEN start_time ELSE b + (k - 2) * slice END, 6)::DOUBLE AS start_time, round(CASE WHEN k = 1 THEN b ELSE b + (k - 1) * slice END, 6)::DOUBLE AS end_time FROM u WHERE k = 1 OR k - 2 < free"""


@query(_PLACE)
def boundary_place(spark, d):
    """The bound before each second phrase set to twenty; the time that remains of 400 is spread over the phrases up to the first manual one."""
    w = Window.partitionBy("l_orderkey")
    c = _phrases(spark, d).withColumn("n", F.count("*").over(w)).withColumn("first_start", F.max(F.when(F.col("k") == 1, F.col("start_time"))).over(w)).where("n > 1")
    stop = F.coalesce(F.min(F.when(F.col("manual") & (F.col("k") >= 2), F.col("k"))).over(w), F.col("n") + 1)
    t = c.withColumn("stop", stop).withColumn("b", F.greatest(F.col("first_start") + 0.25, F.least(400 - 0.25 * (F.col("n") - 1), F.lit(20.0)))).where(F.col("first_start") + 0.25 <= 400 - 0.25 * (F.col("n") - 1))
    u = t.withColumn("free", F.greatest(F.lit(1), F.col("stop") - 2)).withColumn("slice", F.greatest(F.lit(0.25), (400 - F.col("b")) / F.col("free"))).where("k = 1 OR k - 2 < free")
    first = F.col("k") == 1
    return u.select("l_orderkey", "k", F.round(F.when(first, F.col("start_time")).otherwise(F.col("b") + (F.col("k") - 2) * F.col("slice")), 6).alias("start_time"), F.round(F.when(first, F.col("b")).otherwise(F.col("b") + (F.col("k") - 1) * F.col("slice")), 6).alias("end_time"))


@query(f"SELECT l_orderkey, k, round(CASE WHEN width <= 0 THEN 0 ELSE s END, 6)::DOUBLE AS low, round(CASE WHEN width <= 0 THEN 60 ELSE s + width END, 6)::DOUBLE AS high FROM (SELECT *, CASE WHEN greatest(0, start_time - 1.5) + width > 60 THEN greatest(0, 60 - width) ELSE greatest(0, start_time - 1.5) END AS s FROM (SELECT *, least(60, end_time - start_time + 3) AS width FROM {_PHRASES}))")
def editor_window(spark, d):
    """What is shown around a phrase: one and a half on both sides, slid to stay within 60."""
    p = _phrases(spark, d).withColumn("width", F.least(F.lit(60.0), F.col("end_time") - F.col("start_time") + 3))
    at = F.greatest(F.lit(0.0), F.col("start_time") - 1.5)
    s = F.when(at + F.col("width") > 60, F.greatest(F.lit(0.0), 60 - F.col("width"))).otherwise(at)
    return p.select("l_orderkey", "k", F.round(s, 6).alias("low"), F.round(s + F.col("width"), 6).alias("high"))


_HEARD = "len(regexp_extract_all(text, {}))".format(_sql(rf"[{X.HAN}{X.LATIN}\p{{N}}]"))


@query(f"SELECT conv_id, turn, n, round(turn * 10.0, 6)::DOUBLE AS first_start, round(turn * 10.0 + (n - 1) * (8.0 / n), 6)::DOUBLE AS last_start, round(n * turn * 10.0 + (8.0 / n) * n * (n - 1) / 2, 4)::DOUBLE AS start_sum FROM (SELECT conv_id, turn, {_HEARD}::BIGINT AS n FROM conversations) WHERE n > 0")
def recognised_timeline(spark, d):
    """A segment's time dealt evenly to the characters that count; a row for each, summed up by segment."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", F.size(X.scorable(F.col("text"))).alias("n")).where("n > 0")
    each = c.select("conv_id", "turn", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).withColumn("s", F.col("turn") * 10.0 + F.col("i") * (8.0 / F.col("n")))
    return each.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.round(F.min("s"), 6).alias("first_start"), F.round(F.max("s"), 6).alias("last_start"), F.round(F.sum("s"), 4).alias("start_sum"))


_PLACED = """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, CASE WHEN event_type = 'click' THEN event_id END AS anchor FROM events),
g AS (SELECT *, i // 5 AS phrase, max(anchor) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, min(anchor) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM e),
p AS (SELECT user_id, phrase, count(*) AS n, count(anchor) AS hit, min(anchor) AS a, max(anchor) AS b, arg_min(anchor, i) AS fa, max(i) AS hi, min(i) AS lo, min(CASE WHEN anchor IS NOT NULL THEN i END) AS fi, max(CASE WHEN anchor IS NOT NULL THEN i END) AS li FROM g GROUP BY ALL),
q AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY phrase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb, min(a) OVER (PARTITION BY user_id ORDER BY phrase ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS na FROM p)
SELECT user_id, phrase::BIGINT AS phrase, round(hit / n::DOUBLE, 6) AS confidence, CASE WHEN fi > lo THEN least(a, coalesce(pb, a)) ELSE a END AS start_at, CASE WHEN li < hi THEN greatest(b, coalesce(na, b)) ELSE b END AS end_at FROM q"""


@query(_PLACED)
def phrase_placement(spark, d):
    """Phrases of five places each: from their first to their last anchor, reaching to the neighbours' anchors where their own ends have none; the share of places with an anchor is their confidence."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _t(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).alias("i"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("anchor"))
    has = F.when(F.col("anchor").isNotNull(), F.col("i"))
    p = e.groupBy("user_id", F.floor(F.col("i") / 5).alias("phrase")).agg(F.count("*").alias("n"), F.count("anchor").alias("hit"), F.min("anchor").alias("a"), F.max("anchor").alias("b"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.min(has).alias("fi"), F.max(has).alias("li"))
    v = Window.partitionBy("user_id").orderBy("phrase")
    q = p.withColumn("pb", F.max("b").over(v.rowsBetween(Window.unboundedPreceding, -1))).withColumn("na", F.min("a").over(v.rowsBetween(1, Window.unboundedFollowing)))
    start = F.when(F.col("fi") > F.col("lo"), F.least("a", F.coalesce("pb", "a"))).otherwise(F.col("a"))
    end = F.when(F.col("li") < F.col("hi"), F.greatest("b", F.coalesce("na", "b"))).otherwise(F.col("b"))
    return q.select("user_id", "phrase", F.round(F.col("hit") / F.col("n"), 6).alias("confidence"), start.alias("start_at"), end.alias("end_at"))


@query("SELECT doc_id, greatest(1, floor(7 * rate + 0.5))::BIGINT AS longest, least(floor(rate + 0.5), greatest(1, floor(7 * rate + 0.5)))::BIGINT AS shortest FROM (SELECT doc_id, n_chars / (10.0 + doc_id % 90) AS rate FROM documents WHERE n_chars > 0)")
def rate_limits(spark, d):
    """Longest and shortest phrase by the rate of speech: seven seconds and one, halves rounded up."""
    rate = F.col("n_chars") / (10.0 + F.col("doc_id") % 90)
    longest = F.greatest(F.lit(1), F.round(7 * rate)).cast("long")
    return _docs(spark, d).where("n_chars > 0").select("doc_id", longest.alias("longest"), F.least(F.round(rate).cast("long"), longest).alias("shortest"))


#: The second part takes a rest without any mark in one step; else each of its places would be tried.
_CUT = rf"(?s)[^{X.SEPARATORS}{X.TERMINATORS}]*[{X.SEPARATORS}{X.TERMINATORS}][{X.CLOSERS}]*|[^{X.SEPARATORS}{X.TERMINATORS}]+"


@query(f"SELECT doc_id, count(*) FILTER (WHERE p < n) AS n_cuts, coalesce(sum(p) FILTER (WHERE p < n), 0)::BIGINT AS cut_sum FROM (SELECT doc_id, n, sum(length(l[i])) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT doc_id, n, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, length(text) AS n, regexp_extract_all(text, {_sql(_CUT)}) AS l FROM {_OWN_SQL}))) GROUP BY doc_id")
def cut_points(spark, d):
    """Places inside a text after a separator or terminator and its closers."""
    t = _texts(spark, d).select("doc_id", F.length("text").cast("long").alias("n"), F.transform(F.regexp_extract_all("text", F.lit(_CUT), F.lit(0)), lambda x: F.length(x).cast("long")).alias("l")).where(F.size("l") > 0)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    step = lambda a, x: F.struct((a.at + x).alias("at"), (a.n + (a.at + x < F.col("n")).cast("long")).alias("n"), (a.s + F.when(a.at + x < F.col("n"), a.at + x).otherwise(0)).alias("s"))
    return t.select("doc_id", F.aggregate("l", zero, step).alias("r")).select("doc_id", F.col("r.n").alias("n_cuts"), F.col("r.s").alias("cut_sum"))


@query()
def phrase_split(spark, d):
    """Phrases of every text by the standard lengths; a fold, which SQL's windows cannot express."""
    p = _texts(spark, d).select("doc_id", L.phrase_spans(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_phrases"), F.array_max(F.transform("p", lambda x: x.n)).alias("longest"), F.expr("aggregate(p, 0L, (a, x) -> a + x.n)").alias("n_scorable"))


@query()
def dictation_marks(spark, d):
    """Marks of each turn against the one after it; letters that differ by an accent read alike."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = _t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b")).where("b IS NOT NULL")
    pairs = [("e", "e1"), ("é", "e2"), ("è", "e4"), ("a", "a1"), ("A", "A1")]
    readings = F.create_map(*[x for c, r in pairs for x in (F.lit(c), F.array(F.lit(r)))])
    m = p.select("conv_id", "turn", L.dictation_marks(F.col("a"), F.col("b"), readings).alias("m")).select("conv_id", "turn", "m.*")
    total = sum((F.col(x) for x in L._MARKS), F.lit(0))
    return m.withColumn("accuracy", F.round(F.coalesce(F.try_divide(F.col("correct"), total), F.lit(1.0)), 9)).withColumn("listening", F.round(F.coalesce(F.try_divide(F.col("correct") + F.col("homophone"), total), F.lit(1.0)), 9))


@query()
def forced_alignment(spark, d):
    """Phrases of each turn placed on the time of the turn after it, as if that were what was heard."""
    @F.pandas_udf("array<struct<start:int,end:int,from_time:double,to_time:double,confidence:double>>")
    def place(text: pd.Series, heard: pd.Series) -> pd.Series:
        return pd.Series([L.force_align(x or "", L.phrases(x or ""), [(y or "", 0.0, 60.0)], 60.0) for x, y in zip(text, heard)])

    w = Window.partitionBy("conv_id").orderBy("turn")
    p = _t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b")).where("b IS NOT NULL")
    x = p.select("conv_id", "turn", F.posexplode(place("a", "b")).alias("phrase", "x"))
    return x.select("conv_id", "turn", "phrase", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.round("x.from_time", 6).alias("from_time"), F.round("x.to_time", 6).alias("to_time"), F.round("x.confidence", 6).alias("confidence"))


@query()
def repair_merge(spark, d):
    """Part names cut in pairs of letters, merged again where the lexicon has the joined word."""
    lex = build(_words(spark, d))
    names = _t(spark, d, "part").select("p_partkey", F.regexp_extract_all(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(".{1,2}"), F.lit(0)).alias("tokens"))
    return merged(names, "tokens", lex).select("p_partkey", F.array_join("merged", "|").alias("merged"))


@query()
def line_layout(spark, d):
    """Tokens of every text set in lines of forty widths, by the rules for what may begin and end a line."""
    t = _texts(spark, d).select("doc_id", Y.lines(X.runs(F.col("text")), 40.0).alias("l"))
    return t.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.round(F.array_max(F.transform("l", lambda x: x.width)), 6).alias("widest"))
