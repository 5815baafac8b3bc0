"""Text queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphflow.functions import text as X
from glyphflow.operators.align import alignment_counts
from glyphflow.operators.tokens import token_rows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


#: Texts in other scripts beside the documents, which have Latin ones only.
_OWN = ["中文abc，混排。123 第二", "かな漢字 カナ", "Привет, мир!", "Ｆｕｌｌ width × ÷ ١٢", "one\r\ntwo\r\n\r\nthree\n", "𠀀𠮷野家😀x", "é́a", "", " ", "　全角　空白 x", "「好。」！他说", "a_b-c $5 ½ ²"]
_OWN_SQL = "(SELECT doc_id, text FROM documents UNION ALL VALUES " + ", ".join("({}, {})".format(-k, " || ".join(f"chr({ord(c)})" for c in t) or "''") for k, t in enumerate(_OWN, 1)) + ") own"


def _texts(spark, d):
    own = spark.createDataFrame([(-k, t) for k, t in enumerate(_OWN, 1)], "doc_id long, text string")
    return _docs(spark, d).select("doc_id", "text").unionByName(own)


def _sql(pattern: str) -> str:
    """A pattern as a literal of the oracle."""
    return "'" + pattern.replace("'", "''") + "'"


_RUNS = f"regexp_extract_all(text, {_sql(X.RUN)})"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(t, {_sql(p)}) THEN '{k}'" for k, p in X.KINDS.items()) + " ELSE 'other' END"
_ROWS = f"(SELECT doc_id, i, t, {_KIND} AS kind, length(t) + len(regexp_extract_all(t, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS width FROM (SELECT doc_id, r[i] AS t, i FROM (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT doc_id, {_RUNS} AS r FROM {_OWN_SQL}))))"


@query("SELECT lang, sum(length(text))::BIGINT AS n_chars, " + ", ".join(f"sum(len(regexp_extract_all(text, {_sql(p)})))::BIGINT AS n_{k}" for k, p in X.CLASSES.items()) + f" FROM (SELECT coalesce(lang, 'own') AS lang, own.text AS text FROM {_OWN_SQL} LEFT JOIN documents USING (doc_id)) GROUP BY lang")
def script_class_profile(spark, d):
    t = F.col("text")
    every = _docs(spark, d).select("lang", "text").unionByName(_texts(spark, d).where("doc_id < 0").select(F.lit("own").alias("lang"), "text"))
    return every.groupBy("lang").agg(F.sum(F.length(t)).alias("n_chars"), *(F.sum(X.count_matching(t, p)).alias(f"n_{k}") for k, p in X.CLASSES.items()))


@query(f"SELECT doc_id, (i - 1)::BIGINT AS block, length(l[i])::BIGINT AS n_chars, NOT regexp_matches(l[i], {_sql(f'[^{X.SPACE}]')}) AS blank FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {_sql(X.BLOCK)}) AS l FROM {_OWN_SQL}))")
def paragraph_blocks(spark, d):
    b = _texts(spark, d).select("doc_id", F.posexplode(X.blocks(F.col("text"))).alias("block", "line"))
    return b.select("doc_id", F.col("block").cast("long").alias("block"), F.length("line").cast("long").alias("n_chars"), (~F.col("line").rlike(f"[^{X.SPACE}]")).alias("blank"))


@query(f"SELECT doc_id, kind, count(*) AS n_runs, sum(length(t))::BIGINT AS n_chars FROM {_ROWS} GROUP BY ALL")
def script_runs(spark, d):
    r = _texts(spark, d).select("doc_id", F.explode(X.runs(F.col("text"))).alias("t"))
    return r.groupBy("doc_id", X.kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n_runs"), F.sum(F.length("t")).alias("n_chars"))


@query(
    f"""SELECT doc_id, count(*) AS n_tokens, sum(s * i)::BIGINT AS offset_sum, max(s + width)::BIGINT AS end_offset,
sum(CASE WHEN coalesce(nx = 'whitespace', false) THEN 1 ELSE 0 END)::BIGINT AS n_trailing_space, bool_and(s = coalesce(pe, 0)) AS well_formed
FROM (SELECT *, lag(s + width) OVER w AS pe, lead(kind) OVER w AS nx FROM (SELECT *, sum(width) OVER (PARTITION BY doc_id ORDER BY i) - width AS s
FROM {_ROWS}) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id"""
)
def token_offsets(spark, d):
    """Figures of each text's tokens with their offsets; tokens never leave their row's task."""
    t = token_rows(_texts(spark, d))
    return t.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"),
        F.sum(F.col("start") * (F.col("idx") + 1)).alias("offset_sum"),
        F.max("end").alias("end_offset"),
        F.sum(F.col("trailing_space").cast("long")).alias("n_trailing_space"),
        F.bool_and(F.col("end") - F.col("start") == X.utf16_width(F.col("text"))).alias("well_formed"),
    )


@query(f"SELECT doc_id, array_to_string({_RUNS}, '') = text AS same, length(text)::BIGINT AS n_chars FROM {_OWN_SQL}")
def reassemble(spark, d):
    return _texts(spark, d).select("doc_id", (F.array_join(X.runs(F.col("text")), "") == F.col("text")).alias("same"), F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT kind, count(DISTINCT t) AS n_words, count(*) AS n_tokens FROM {_ROWS} WHERE kind IN ('han', 'latin') GROUP BY kind")
def lookup_candidates(spark, d):
    """Tokens that a dictionary is asked for."""
    t = _texts(spark, d).select(F.explode(X.runs(F.col("text"))).alias("t")).withColumn("kind", X.kind(F.col("t"))).where("kind IN ('han', 'latin')")
    each = t.groupBy("kind", "t").count()
    return each.groupBy("kind").agg(F.count("*").alias("n_words"), F.sum("count").alias("n_tokens"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, {_sql(rf'[{X.HAN}{X.LATIN}\p{{N}}]')}))::BIGINT AS n_scorable, len(regexp_extract_all(substring(text, 1, length(text) // 2), {_sql(rf'[{X.HAN}{X.LATIN}\p{{N}}]')}))::BIGINT AS in_first_half FROM {_OWN_SQL}")
def scorable_counts(spark, d):
    """Characters that count in a dictation, in the whole and in a range, by differences of one running count."""
    n = lambda t: F.size(X.scorable(t)).cast("long")
    half = F.floor(F.length("text") / 2).cast("int")
    rest = F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")
    return _texts(spark, d).select("doc_id", n(F.col("text")).alias("n_scorable"), (n(F.col("text")) - n(rest)).alias("in_first_half"))


@query(f"SELECT doc_id, sum(CASE WHEN wordlike AND before THEN 1 ELSE 0 END)::BIGINT AS n_gaps FROM (SELECT doc_id, kind IN ('han', 'latin', 'number') AS wordlike, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY i) IN ('han', 'latin', 'number'), false) AS before FROM {_ROWS}) GROUP BY doc_id")
def token_spacing(spark, d):
    """Gaps stand between two word-like tokens only."""
    kinds = F.transform(X.runs(F.col("text")), lambda t: X.kind(t).isin("han", "latin", "number").cast("int"))
    t = _texts(spark, d).select("doc_id", kinds.alias("w")).where(F.size("w") > 0)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", 2, 1 << 30), lambda a, b: a * F.coalesce(b, F.lit(0)))
    return t.select("doc_id", F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("n_gaps"))


@query(f"SELECT doc_id, count(*) FILTER (WHERE block BETWEEN least(2, n - 1) - 2 AND least(2, n - 1) + 4) AS n_shown, sum(length(t)) FILTER (WHERE block BETWEEN least(2, n - 1) - 2 AND least(2, n - 1) + 4)::BIGINT AS n_chars FROM (SELECT doc_id, l[i] AS t, i - 1 AS block, len(l) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {_sql(X.BLOCK)}) AS l FROM {_OWN_SQL}))) GROUP BY doc_id")
def viewport_slice(spark, d):
    """Blocks from two before the third one to four after it, where there are such."""
    b = _texts(spark, d).select("doc_id", X.blocks(F.col("text")).alias("l")).where(F.size("l") > 0)
    top = F.least(F.lit(2), F.size("l") - 1)
    shown = F.filter("l", lambda x, i: (i >= top - 2) & (i <= top + 4))
    return b.select("doc_id", F.size(shown).cast("long").alias("n_shown"), F.aggregate(shown, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))


@query("SELECT doc_id, substring(trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g')), 1, 120) AS preview FROM documents")
def preview(spark, d):
    return _docs(spark, d).select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 1.0 ELSE round((length(text) - l)::DOUBLE / (length(text) + 7 * l), 9) END AS plausibility FROM (SELECT doc_id, text, length(text) - length(replace(text, '�', '')) AS l FROM documents)")
def plausibility(spark, d):
    return _docs(spark, d).select("doc_id", F.round(X.plausibility(F.col("text")), 9).alias("plausibility"))


@query(f"SELECT doc_id, count(*) AS n_sentences, max(length(s))::BIGINT AS longest FROM (SELECT doc_id, regexp_replace(s, {_sql(f'[{X.SPACE}]+$')}, '') AS s FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_sql(X.SENTENCE)})) AS s FROM {_OWN_SQL})) GROUP BY doc_id")
def sentence_split(spark, d):
    s = X.sentences(F.col("text"))
    return _texts(spark, d).select("doc_id", s.alias("s")).where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


@query("SELECT doc_id, CASE WHEN trim(l) = '' THEN 'Untitled' ELSE substring(trim(l), 1, 60) END AS title FROM (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM documents)")
def title(spark, d):
    t = F.trim(F.split("text", "\n")[0])
    return _docs(spark, d).select("doc_id", F.when(t == "", "Untitled").otherwise(F.substring(t, 1, 60)).alias("title"))


@query("SELECT doc_id, round(12 * 4.5)::BIGINT AS longest, CASE WHEN n_chars <= 0 THEN 0.0 ELSE round(least(1.0, greatest(0.0, (doc_id % 3000) / n_chars::DOUBLE)), 9) END AS progress FROM documents")
def progress_fraction(spark, d):
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("doc_id") % 3000 / F.col("n_chars")))
    return _docs(spark, d).select("doc_id", F.round(F.lit(12 * 4.5)).cast("long").alias("longest"), F.when(F.col("n_chars") <= 0, 0.0).otherwise(F.round(at, 9)).alias("progress"))


@query(
    """SELECT conv_id, turn, coalesce(last_value(CASE WHEN length(text) >= 40 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'none') AS context FROM conversations"""
)
def previous_context(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.coalesce(F.last(F.when(F.length("text") >= 40, F.col("role")), True).over(w), F.lit("none")).alias("context"))


@query()
def edit_distance(spark, d):
    """The distance in code points of all neighbouring turns; SQL's counts bytes."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b"))
    return p.where("a IS NOT NULL AND b IS NOT NULL").select("conv_id", "turn", X.edit_distance(F.col("a"), F.col("b")).cast("long").alias("distance"))


@query()
def alignment_marks(spark, d):
    """Counts of an alignment with traceback between neighbouring turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b")).where("b IS NOT NULL")
    m = p.select("conv_id", "turn", alignment_counts("a", "b").alias("m")).select("conv_id", "turn", "m.*")
    return m.withColumn("accuracy", F.round(F.coalesce(F.try_divide(F.col("matched"), F.col("matched") + F.col("substituted") + F.col("missing") + F.col("extra")), F.lit(1.0)), 9))
