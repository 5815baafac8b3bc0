"""Library queries: lists, change logs, joins by range, ordered passes, over driver tables."""

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


@query("SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS existing_id FROM documents")
def content_dedup(spark, d):
    h = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    first = h.groupBy("content_hash").agg(F.min("doc_id").alias("existing_id"))
    return h.join(first, "content_hash")


@query("SELECT d.doc_id, l.quality IS NOT NULL AS has_label, coalesce(e.n, 0) AS n_events, coalesce(e.last, 0) AS last FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT user_id, count(*) AS n, max(epoch_us(ts)) AS last FROM events GROUP BY user_id) e ON e.user_id = d.doc_id")
def library_list(spark, d):
    """Every text with its sort keys, last and doc_id, both descending; rows carry no place, which one task would have to number."""
    return _library(spark, d)


def _library(spark, d):
    e = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last"))
    l = _t(spark, d, "labels").select(F.col("doc_id").alias("lid"), "quality")
    x = _t(spark, d, "documents").select("doc_id").join(l, F.col("doc_id") == F.col("lid"), "left").join(e, F.col("doc_id") == F.col("user_id"), "left")
    return x.select("doc_id", F.col("quality").isNotNull().alias("has_label"), F.coalesce("n", F.lit(0)).alias("n_events"), F.coalesce("last", F.lit(0)).alias("last"))


@query("SELECT user_id, event_type, count(*) AS attempts, arg_max(round(value, 6), event_id) AS last_value, max(event_id) AS last_event FROM events GROUP BY ALL")
def attempt_upsert(spark, d):
    return _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("attempts"), F.max_by(F.round("value", 6), "event_id").alias("last_value"), F.max("event_id").alias("last_event"))


@query("SELECT user_id, arg_max(event_type, event_id) AS state, arg_max(round(value, 6), event_id) FILTER (WHERE event_type = 'purchase') AS kept_value FROM events GROUP BY user_id")
def position_log(spark, d):
    """Latest state; a value that only some changes carry keeps its last."""
    return _t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.max_by(F.when(F.col("event_type") == "purchase", F.round("value", 6)), F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("kept_value"))


@query("SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY ALL")
def reveal_set(spark, d):
    return _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_attempts(spark, d):
    o = _t(spark, d, "orders")
    return _t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def kept_attempts(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus = 'F'")
    return _t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS grade FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.quality < 1 OR l.toxic = 1")
def needs_work(spark, d):
    l = _t(spark, d, "labels").withColumnRenamed("doc_id", "lid")
    return _t(spark, d, "documents").join(l, F.col("doc_id") == F.col("lid"), "left").where("lid IS NULL OR quality < 1 OR toxic = 1").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("grade"))


@query("SELECT coalesce(min(doc_id) FILTER (WHERE quality < 1), 0) AS first_unfinished, count(*) AS n, count(*) FILTER (WHERE toxic = 1) > 0 AS any_toxic FROM labels")
def first_unfinished(spark, d):
    return _t(spark, d, "labels").agg(F.coalesce(F.min(F.when(F.col("quality") < 1, F.col("doc_id"))), F.lit(0)).alias("first_unfinished"), F.count("*").alias("n"), (F.count_if(F.col("toxic") == 1) > 0).alias("any_toxic"))


@query("SELECT e.event_id, a.event_id AS purchase_id FROM events e ASOF LEFT JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'purchase') a ON a.user_id = e.user_id AND a.event_id <= e.event_id")
def offset_lookup(spark, d):
    """As-of lookup in one ordered pass by user."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w).alias("purchase_id"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before, first_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM events")
def nearest_anchor(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    a = F.when(F.col("event_type") == "click", F.col("event_id"))
    return _t(spark, d, "events").select("event_id", F.last(a, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("before"), F.first(a, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("after"))


@query("SELECT user_id, round(coalesce(list_sort(list(value) FILTER (WHERE value > 0))[(count(*) FILTER (WHERE value > 0)) // 2 + 1], 0), 6) AS upper_median FROM events GROUP BY user_id")
def upper_median(spark, d):
    """The upper middle of the positive values, by counts of equal values, so that partial sums go to a key's group."""
    each = _t(spark, d, "events").groupBy("user_id", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id")
    own = F.when(F.col("value") > 0, F.col("n")).otherwise(0)
    upto = each.withColumn("upto", F.sum(own).over(w.orderBy("value"))).withColumn("n", F.sum(own).over(w))
    # the first value that more than half of the count reaches
    return upto.groupBy("user_id").agg(F.round(F.coalesce(F.min(F.when((F.col("value") > 0) & (F.col("upto") > F.floor(F.col("n") / 2)), F.col("value"))), F.lit(0.0)), 6).alias("upper_median"))


@query("SELECT bucket, round(peak, 6) AS peak, round(peak / max(peak) OVER (), 6) AS level FROM (SELECT (epoch_us(ts) // 3600000000)::BIGINT AS bucket, max(abs(value)) AS peak FROM events GROUP BY ALL)")
def bucket_peaks(spark, d):
    b = _t(spark, d, "events").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("bucket")).agg(F.max(F.abs("value")).alias("peak"))
    top = b.agg(F.max("peak").alias("top"))  # one row
    return b.crossJoin(F.broadcast(top)).select("bucket", F.round("peak", 6).alias("peak"), F.round(F.col("peak") / F.col("top"), 6).alias("level"))


@query("SELECT l_orderkey, l_linenumber, round((row_number() OVER w - 1) * 60.0 / count(*) OVER (PARTITION BY l_orderkey), 6)::DOUBLE AS start_time FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
def even_spread(spark, d):
    w = Window.partitionBy("l_orderkey")
    k = F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(k * 60.0 / F.count("*").over(w), 6).alias("start_time"))


@query("SELECT user_id, count(*) AS sessions, max(n)::BIGINT AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM (SELECT user_id, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) > 1800000000 THEN 1 ELSE 0 END AS g FROM events)) GROUP BY ALL) GROUP BY user_id")
def debounce_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    g = _t(spark, d, "events").select("user_id", "event_id", F.when(t - F.lag(t).over(w) > 1_800_000_000, 1).otherwise(0).alias("g"))
    s = g.select("user_id", F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")).groupBy("user_id", "s").count()
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("count").alias("longest"))


@query("SELECT key, name, rank FROM (SELECT *, min(rank) OVER (PARTITION BY key) AS best FROM (SELECT c_nationkey AS key, min(c_name) AS name, 0 AS rank FROM customer WHERE c_acctbal > 9000 GROUP BY ALL UNION ALL SELECT s_nationkey, min(s_name), 1 FROM supplier GROUP BY ALL)) WHERE rank = best")
def priority_coalesce(spark, d):
    a = _t(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("key")).agg(F.min("c_name").alias("name")).withColumn("rank", F.lit(0))
    b = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.min("s_name").alias("name")).withColumn("rank", F.lit(1))
    return a.unionByName(b).groupBy("key").agg(F.min_by("name", "rank").alias("name"), F.min("rank").alias("rank"))


@query("SELECT p_brand, min(p_partkey) AS first_seen, count(*) AS n, string_agg(p_name, ',' ORDER BY p_partkey) AS names FROM part GROUP BY p_brand")
def group_by_key_first_seen(spark, d):
    s = F.sort_array(F.collect_list(F.struct("p_partkey", "p_name")))
    return _t(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first_seen"), F.count("*").alias("n"), F.array_join(F.transform(s, lambda x: x.p_name), ",").alias("names"))


@query("SELECT o_orderkey, coalesce(l.q, round(o_totalprice, 2)) AS amount, l.q IS NOT NULL AS carried FROM orders LEFT JOIN (SELECT l_orderkey, round(max(l_extendedprice), 2) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) l ON l_orderkey = o_orderkey")
def manual_carry_over(spark, d):
    l = _t(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.round(F.max("l_extendedprice"), 2).alias("q"))
    return _t(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("q", F.round("o_totalprice", 2)).alias("amount"), F.col("q").isNotNull().alias("carried"))


@query("SELECT n_nationkey, coalesce(k.flag, n_regionkey = 1) AS enabled FROM nation LEFT JOIN (SELECT s_nationkey, max(s_acctbal) > 5000 AS flag FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey) k ON s_nationkey = n_nationkey")
def preference_defaults(spark, d):
    k = _t(spark, d, "supplier").where("s_acctbal > 0").groupBy("s_nationkey").agg((F.max("s_acctbal") > 5000).alias("flag"))
    return _t(spark, d, "nation").join(k, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", F.coalesce("flag", F.col("n_regionkey") == 1).alias("enabled"))


@query("SELECT DISTINCT user_id AS id FROM events EXCEPT SELECT doc_id FROM labels")
def missing_requests(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").alias("id")).distinct().join(_t(spark, d, "labels"), F.col("id") == F.col("doc_id"), "left_anti")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT c_nationkey AS k, min(c_name) AS v FROM customer WHERE c_acctbal > 9500 GROUP BY ALL) a FULL JOIN (SELECT s_nationkey AS k, min(s_name) AS v FROM supplier GROUP BY ALL) b ON a.k = b.k")
def merge_keep_current(spark, d):
    a = _t(spark, d, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("ka")).agg(F.min("c_name").alias("va"))
    b = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("kb")).agg(F.min("s_name").alias("vb"))
    return a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias("k"), F.coalesce("va", "vb").alias("v"))


@query("SELECT lang, doc_id, coalesce(list_position(['fr','de'], lang), 3) AS rank FROM documents")
def language_order(spark, d):
    """Every document with its sort keys, rank and doc_id."""
    r = F.array_position(F.array(F.lit("fr"), F.lit("de")), F.col("lang"))
    return _t(spark, d, "documents").select("lang", "doc_id", F.when(r == 0, 3).otherwise(r).cast("int").alias("rank"))


@query("SELECT md5(string_agg(source || ':' || n || ':' || c, '|' ORDER BY source)) AS fingerprint FROM (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS c FROM documents GROUP BY source)")
def source_fingerprint(spark, d):
    s = _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return s.agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "n", "c"))), lambda x: F.concat_ws(":", x.source, x.n, x.c)), "|")).alias("fingerprint"))


@query("SELECT user_id, max(event_id) AS generation, arg_max(event_type, event_id) AS kept FROM events GROUP BY user_id")
def latest_generation(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("generation"), F.max_by("event_type", "event_id").alias("kept"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN m = 0 THEN t0 + (k - 1) * 2.5 ELSE l_quantity END, 6)::DOUBLE AS start_time FROM (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER w AS k, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m, first_value(l_quantity) OVER w AS t0 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))")
def tail_reflow(spark, d):
    """Times spread evenly until the first manual row of each order, which keep theirs."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.row_number().over(w).alias("k"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"), F.first("l_quantity").over(w).alias("t0"))
    return x.select("l_orderkey", "l_linenumber", F.round(F.when(F.col("m") == 0, F.col("t0") + (F.col("k") - 1) * 2.5).otherwise(F.col("l_quantity")), 6).alias("start_time"))
