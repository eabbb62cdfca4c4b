"""Streaming queries over events, run to their end; and relational extensions over the TPC-H tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators.timeline import latest
from tidewater.plans.retrieval import table
from tidewater.streaming import fold as K
from tidewater.streaming import windows as W


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def stream_tumbling(spark, sf):
    out = W.run_to_end(W.tumbling(W.events_stream(spark, f"{sf}/events.parquet"), "1 day", "2 days", ["event_type"]), "update", ["window", "event_type"])
    return out.select(stamp("window.start").alias("begin"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark, sf):
    out = W.run_to_end(W.sliding(W.events_stream(spark, f"{sf}/events.parquet"), "12 hours", "6 hours", "2 days", ["event_type"]), "update", ["window", "event_type"])
    return out.select(stamp("window.start").alias("begin"), "event_type", "n")


def stream_session(spark, sf):
    """Spark has no update mode for session windows, and append would leave the last ones open: complete, so state isn't evicted."""
    out = W.run_to_end(W.sessions(W.events_stream(spark, f"{sf}/events.parquet"), "12 hours", "2 days", ["user_id"]), "complete")
    return out.select(stamp("session_window.start").alias("begin"), "user_id", "n")


def stream_dedup(spark, sf):
    s = W.events_stream(spark, f"{sf}/events.parquet")
    out = W.run_to_end(W.first_of(s, ["user_id", "event_type", "value"], "3650 days"))
    return out.select("user_id", "event_type", F.round("value", 6).alias("value"))


def spans(df):
    t = F.unix_micros("ts") / 1e6
    words = F.concat_ws(" ", "event_type", F.col("props"))
    return df.select(F.col("user_id").alias("session"), words.alias("text"), t.alias("start"), (t + 2.0).alias("end"), (t + 2.5).alias("window_end"))


def stream_stateful_fold(spark, sf):
    log = W.run_to_end(K.fold_stream(spans(W.events_stream(spark, f"{sf}/events.parquet"))), "update")
    return latest(log, ["session", "idx"], ["revisions", "end"]).select("session", "idx", "text", "revisions")


def batch_fold(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return K.fold_batch(spans(e)).select("session", "idx", "text", "revisions")


def x_rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def x_cube(spark, sf):
    o = table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("gid"))
    return o


def x_grouping_sets(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupingSets([[F.col("c_mktsegment")], [F.col("n_name")], []], "c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"))


def x_setops(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return b.exceptAll(a).withColumn("side", F.lit("only customers")).union(a.intersect(b).withColumn("side", F.lit("both")))


def x_window_frames(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"), F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).cast("bigint").alias("rank"), F.lag("o_orderkey").over(w).alias("prev"))


def x_pricing(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def x_region_revenue(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_session, stream_dedup, stream_stateful_fold, batch_fold, x_rollup, x_cube, x_grouping_sets, x_setops, x_window_frames, x_pricing, x_region_revenue)}

SQL = {
    "stream_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS \"begin\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": """WITH w AS (SELECT event_type, unnest([epoch_us(ts) // 21600000000, epoch_us(ts) // 21600000000 - 1]) * 21600000000 AS b FROM events)
SELECT strftime(make_timestamp(b), '%Y-%m-%d %H:%M:%S') AS "begin", event_type, count(*) AS n FROM w GROUP BY b, event_type""",
    "stream_session": """WITH n AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM n) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "begin", user_id, count(*) AS n FROM g GROUP BY user_id, g""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type, round(value, 6) AS value FROM (SELECT DISTINCT user_id, event_type, value FROM events)",
    "x_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "x_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "x_grouping_sets": "SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((c_mktsegment), (n_name), ())",
    "x_setops": "SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'both' ELSE 'only customers' END AS side FROM customer",
    "x_window_frames": """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3,
CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rank, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders""",
    "x_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "x_region_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}
