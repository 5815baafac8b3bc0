"""Changes to a library as append-only logs and the state that follows from them, and reads of that state.

The events table is the log: views open a text, clicks reveal or move, errors take back or
delete, purchases save and signups clear. A state is the last change of its key, found by a
partial aggregate (max_by), so that a hot key never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

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


def _when(kind: str, value):
    return F.when(F.col("event_type") == kind, value)


def _last(value, *kinds: str):
    """The value of a key's last change of some kinds."""
    of = F.col("event_type").isin(*kinds)
    return F.max_by(F.when(of, value), F.when(of, F.col("event_id")))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _k():
    return F.get_json_object("props", "$.k").cast("long")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) WHERE last = 'error')")
def delete_text(spark, d):
    """Rows of texts that are left when the texts whose last change is a deletion go, with all that hangs on them."""
    e = _t(spark, d, "events")
    gone = e.groupBy(F.col("user_id").alias("gone")).agg(F.max_by("event_type", "event_id").alias("last")).where("last = 'error'")
    return e.join(gone, F.col("user_id") == F.col("gone"), "left_anti").select("event_id", "user_id")


@query("SELECT user_id, arg_max(CASE WHEN event_type = 'purchase' THEN {'t': round(value, 6)} ELSE {'t': NULL::DOUBLE} END, event_id) FILTER (WHERE event_type IN ('purchase', 'error'))['t'] AS audio_time FROM events GROUP BY user_id")
def audio_time(spark, d):
    """A time that is saved or cleared: the last of both counts."""
    return _t(spark, d, "events").groupBy("user_id").agg(_last(F.struct(_when("purchase", F.round("value", 6)).alias("t")), "purchase", "error").alias("x")).select("user_id", F.col("x.t").alias("audio_time"))


@query("SELECT user_id, max(epoch_us(ts)) FILTER (WHERE event_type = 'view') AS opened_at, count(*) FILTER (WHERE event_type = 'view') AS times FROM events GROUP BY user_id")
def mark_opened(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.max(_when("view", F.unix_micros(F.col("ts").cast("timestamp")))).alias("opened_at"), F.count(_when("view", F.lit(1))).alias("times"))


@query("SELECT arg_max(user_id, {'t': ts, 'u': user_id}) AS user_id FROM events WHERE event_type = 'view'")
def most_recently_opened(spark, d):
    return _t(spark, d, "events").where("event_type = 'view'").agg(F.max_by("user_id", F.struct("ts", "user_id")).alias("user_id"))


@query(f"WITH e AS (SELECT *, {_K} AS k, max(event_id) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id) AS cleared FROM events) SELECT user_id, k, max(event_id) AS since FROM e WHERE event_type IN ('click', 'error') AND event_id > coalesce(cleared, -1) GROUP BY user_id, k HAVING arg_max(event_type, event_id) = 'click'")
def reveal_state(spark, d):
    """Words that are revealed now: shown after the last clearing, and not hidden since."""
    e = _t(spark, d, "events").withColumn("k", _k())
    cleared = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("u")).agg(F.max("event_id").alias("cleared"))
    after = e.where("event_type IN ('click', 'error')").join(cleared, F.col("user_id") == F.col("u"), "left").where("event_id > coalesce(cleared, -1)")
    return after.groupBy("user_id", "k").agg(F.max("event_id").alias("since"), F.max_by("event_type", "event_id").alias("last")).where("last = 'click'").drop("last")


@query("SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word IN (SELECT unnest(string_split(p_name, ' ')) FROM part WHERE p_size = 1 AND p_partkey % 10 = 0) OR p_partkey % 97 = 0")
def revealed_tokens(spark, d):
    """Tokens that are revealed by their word, wherever it stands, or by their own id."""
    w = _t(spark, d, "part").select("p_partkey", "p_size", F.explode(F.split("p_name", " ")).alias("word"))
    words = w.where("p_size = 1 AND p_partkey % 10 = 0").select(F.col("word").alias("shown")).distinct()
    return w.join(words, F.col("word") == F.col("shown"), "left").where("shown IS NOT NULL OR p_partkey % 97 = 0").select("p_partkey", "word")


_PATH = "CASE c_custkey % 4 WHEN 0 THEN '/abs/' WHEN 1 THEN 'a/../' WHEN 2 THEN 'audio/' ELSE '' END || c_name"


@query(f"SELECT c_nationkey, arg_max(path, c_custkey) AS path FROM (SELECT *, {_PATH} AS path FROM customer) WHERE path NOT LIKE '/%' AND NOT list_contains(string_split(path, '/'), '..') GROUP BY c_nationkey")
def attach_audio(spark, d):
    """The last track of each text; a path that is not relative to the folder is refused."""
    c = _t(spark, d, "customer").withColumn("path", F.expr(_PATH))
    return c.where(~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), "..")).groupBy("c_nationkey").agg(F.max_by("path", "c_custkey").alias("path"))


@query("SELECT user_id, arg_max(round(value, 6), event_id) FILTER (WHERE event_type IN ('click', 'purchase')) AS first_flag, arg_max(CASE event_type WHEN 'view' THEN round(value, 6) ELSE round(value * 2, 6) END, event_id) FILTER (WHERE event_type IN ('view', 'purchase')) AS second_flag FROM events GROUP BY user_id")
def preference_upserts(spark, d):
    """Changes of one column beside changes of the whole row: each column has its own last one."""
    second = F.coalesce(_when("view", F.round("value", 6)), F.round(F.col("value") * 2, 6))
    return _t(spark, d, "events").groupBy("user_id").agg(_last(F.round("value", 6), "click", "purchase").alias("first_flag"), _last(second, "view", "purchase").alias("second_flag"))


@query(f"SELECT user_id, k, arg_max(round(value, 6), event_id) FILTER (WHERE event_type = 'click') AS start_time, arg_max(round(value, 6), event_id) FILTER (WHERE event_type = 'view') AS grade FROM (SELECT *, {_K} AS k FROM events) GROUP BY user_id, k HAVING arg_max(event_type, event_id) <> 'error'")
def phrase_changes(spark, d):
    """Phrases after they were moved, graded and forgotten."""
    g = _t(spark, d, "events").groupBy("user_id", _k().alias("k"))
    s = g.agg(_last(F.round("value", 6), "click").alias("start_time"), _last(F.round("value", 6), "view").alias("grade"), F.max_by("event_type", "event_id").alias("last"))
    return s.where("last <> 'error'").drop("last")


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE user_id = 7")
def point_read(spark, d):
    """Rows of one key; the filter reaches the scan."""
    return _t(spark, d, "events").where("user_id = 7").select("event_id", "event_type", F.round("value", 6).alias("value"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def forget_dictionary(spark, d):
    gone = _t(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("gone"))
    return _t(spark, d, "nation").join(gone, F.col("n_nationkey") == F.col("gone"), "left_anti").select("n_nationkey", "n_name")


@query("WITH o AS (SELECT unnest(l) AS k, unnest(range(len(l))) AS pos FROM (SELECT list(n_nationkey ORDER BY n_name) AS l FROM nation WHERE n_regionkey = 2)) SELECT n_nationkey, coalesce(pos, 100 + n_nationkey)::BIGINT AS sort_order FROM nation LEFT JOIN o ON k = n_nationkey")
def user_order(spark, d):
    """Places given by a list; dictionaries that are not in it keep theirs."""
    n = _t(spark, d, "nation")
    names = n.where("n_regionkey = 2").agg(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("l"))
    order = names.select(F.posexplode("l").alias("pos", "x")).select("pos", F.col("x.n_nationkey").alias("k"))
    return n.join(order, F.col("n_nationkey") == F.col("k"), "left").select("n_nationkey", F.coalesce("pos", F.col("n_nationkey") + 100).cast("long").alias("sort_order"))


@query("SELECT c_custkey, round(coalesce(s_acctbal, c_acctbal), 2) AS start_time, s_suppkey IS NOT NULL AS moved FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def row_patch(spark, d):
    """Rows replaced by moved ones of the same index."""
    s = _t(spark, d, "supplier")
    return _t(spark, d, "customer").join(s, F.col("c_custkey") == F.col("s_suppkey"), "left").select("c_custkey", F.round(F.coalesce("s_acctbal", "c_acctbal"), 2).alias("start_time"), F.col("s_suppkey").isNotNull().alias("moved"))


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS turn FROM events")
def serial_queue(spark, d):
    """The place of each write in its key's queue; one key is one ordered group."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("turn"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN (SELECT o_orderkey, o_custkey % 7 AS cursor_at, o_orderstatus = 'F' AS same FROM orders) ON o_orderkey = l_orderkey WHERE same AND l_linenumber < cursor_at")
def resume_rollback(spark, d):
    """Rows of an import that stay when it goes on: those before the cursor where source and parser are the same, else none."""
    jobs = _t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_custkey") % 7).alias("cursor"))
    return _t(spark, d, "lineitem").join(jobs, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linenumber") < F.col("cursor"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT DISTINCT lower(word) AS base FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING min(p_size) = 1)")
def union_of_bases(spark, d):
    """Distinct bases of the dictionaries whose readings are on."""
    p = _t(spark, d, "part")
    on = p.groupBy(F.col("p_brand").alias("on")).agg(F.min("p_size").alias("least")).where("least = 1")
    return p.join(on, F.col("p_brand") == F.col("on"), "left_semi").select(F.explode(F.split(F.lower("p_name"), " ")).alias("base")).distinct()


@query("SELECT p_name AS word, p_partkey, (row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1)::BIGINT AS place FROM part")
def ordered_reads(spark, d):
    """Homographs in the order of their ids."""
    return _t(spark, d, "part").select(F.col("p_name").alias("word"), "p_partkey", (F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")) - 1).cast("long").alias("place"))


@query("SELECT o_custkey AS old_id, md5(c_name) AS new_id, max(o_orderkey) AS progress, CASE WHEN max(c_acctbal) > 0 THEN max(epoch_us(o_orderdate)) END AS opened_at FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def legacy_migration(spark, d):
    """Old ids under new ones, with their progress; opened times go to newcomers only."""
    ids = _t(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("new_id"), "c_acctbal")
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("progress"), F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"))
    return o.join(ids, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("old_id"), "new_id", "progress", F.when(F.col("c_acctbal") > 0, F.col("t")).alias("opened_at"))


@query("SELECT p_brand, p_partkey % 2 = 0 AS glosses, p_partkey % 3 = 0 AS readings, count(*) AS n FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 GROUP BY ALL")
def permission_filters(spark, d):
    """Dictionaries by three independent flags; one with no flag is not asked."""
    p, flag = _t(spark, d, "part"), lambda n: F.col("p_partkey") % n == 0
    return p.where(flag(2) | flag(3) | flag(5)).groupBy("p_brand", flag(2).alias("glosses"), flag(3).alias("readings")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY (lower(p_name) LIKE 'red%') DESC, p_partkey) - 1)::BIGINT AS place FROM part")
def displayed_first(spark, d):
    """Groups of the reading on display before the others, each in their order."""
    w = Window.partitionBy("p_brand").orderBy(F.lower("p_name").startswith("red").desc(), "p_partkey")
    return _t(spark, d, "part").select("p_partkey", "p_brand", (F.row_number().over(w) - 1).cast("long").alias("place"))


_WORDS = r"\S+"


@query(f"SELECT doc_id, existing_id, doc_id = existing_id AS is_new, CASE WHEN doc_id = existing_id THEN preview END AS preview, CASE WHEN doc_id = existing_id THEN n END AS n_words FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS existing_id, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 120) AS preview, len(regexp_extract_all(text, '{_WORDS}'))::BIGINT AS n FROM documents)")
def import_text(spark, d):
    """A text that is there already gives its id; a new one gets its preview and count."""
    t = _t(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("hash"))
    first = t.groupBy(F.col("hash").alias("of")).agg(F.min("doc_id").alias("existing_id"))
    new = F.col("doc_id") == F.col("existing_id")
    preview = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 120)
    return t.join(first, F.col("hash") == F.col("of")).select("doc_id", "existing_id", new.alias("is_new"), F.when(new, preview).alias("preview"), F.when(new, F.regexp_count("text", F.lit(_WORDS)).cast("long")).alias("n_words"))


@query("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'passing' WHEN p_size >= 20 THEN 'hard' ELSE 'open' END AS state, p_retailprice >= 1000 AS passing FROM part")
def passing(spark, d):
    s = F.col("p_size")
    return _t(spark, d, "part").select("p_partkey", F.when(s >= 40, "passing").when(s >= 20, "hard").otherwise("open").alias("state"), (F.col("p_retailprice") >= 1000).alias("passing"))


@query(
    """WITH h AS (SELECT (epoch_us(ts) // 3600000000)::BIGINT AS hour, max(abs(value)) AS peak FROM events GROUP BY ALL), r AS (SELECT min(hour) AS lo, max(hour) - min(hour) + 1 AS n FROM h),
b AS (SELECT unnest(range(50)) AS bucket) SELECT bucket::BIGINT AS bucket, round(coalesce(max(peak), 0), 6) AS peak FROM b CROSS JOIN r LEFT JOIN h ON hour - lo >= floor(bucket * n / 50.0) AND hour - lo < greatest(ceil((bucket + 1) * n / 50.0), floor(bucket * n / 50.0) + 1) GROUP BY bucket"""
)
def peak_resample(spark, d):
    """Peaks of fifty wider buckets; each hour goes to the buckets that overlap it, found by arithmetic."""
    h = _t(spark, d, "events").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour")).agg(F.max(F.abs("value")).alias("peak"))
    r = h.agg(F.min("hour").alias("lo"), (F.max("hour") - F.min("hour") + 1).alias("n"))  # one row
    k, n = F.col("hour") - F.col("lo"), F.col("n")
    low, high = F.floor(k * 50 / n) - 1, F.floor((k + 1) * 50 / n) + 1
    own = h.crossJoin(F.broadcast(r)).select("peak", "n", k.alias("k"), F.explode(F.sequence(low, high)).alias("bucket")).where("bucket BETWEEN 0 AND 49")
    first = F.floor(F.col("bucket") * F.col("n") / 50.0)
    hit = own.where((F.col("k") >= first) & (F.col("k") < F.greatest(F.ceil((F.col("bucket") + 1) * F.col("n") / 50.0), first + 1)))
    every = spark.range(50).select(F.col("id").alias("b"))
    best = hit.groupBy("bucket").agg(F.max("peak").alias("peak"))
    return every.join(best, F.col("b") == F.col("bucket"), "left").select(F.col("b").alias("bucket"), F.round(F.coalesce("peak", F.lit(0.0)), 6).alias("peak"))


@query("SELECT c_custkey, c_nationkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_nationkey, 'unreadable' FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey % 3 = 0")
def catalogue_rows(spark, d):
    """Containers of a folder with their metadata; one that cannot be read is a row that says so."""
    n = _t(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey")
    c = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return c.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, "unreadable").otherwise(F.col("c_name")).alias("c_name"))


@query("SELECT p_brand, string_agg(p_name, ',' ORDER BY p_partkey) AS first_three, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 3 GROUP BY p_brand")
def first_diagnostics(spark, d):
    """The first three of each group, which is all that a report shows."""
    s = F.slice(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), 1, 3)
    p = _t(spark, d, "part").withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("r <= 3")
    return p.groupBy("p_brand").agg(F.array_join(F.transform(s, lambda x: x.p_name), ",").alias("first_three"), F.count("*").alias("n"))
