"""Relational and event-time queries on the star schema, beyond the retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .catalog import query, table


@query("SELECT n.n_regionkey AS region, c.c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey GROUP BY ROLLUP (n.n_regionkey, c.c_mktsegment)")
def rollup_totals(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    return j.rollup(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), X.rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS large FROM customer")
def semi_anti_joins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(large, "c_custkey", "left_semi").withColumn("large", F.lit(True)).unionByName(c.join(large, "c_custkey", "left_anti").withColumn("large", F.lit(False)))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def ranking_windows(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", X.rounded(F.col("l_extendedprice"), 2).alias("price"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
def set_ops(spark, sf_dir):
    c, s, n = (table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return c.intersect(s).unionAll(n.subtract(s))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), X.rounded(F.sum("value"), 4).alias("total"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) AS start, count(*) AS n FROM events, (VALUES (0), (1)) AS t(k) GROUP BY ALL")
def sliding_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM h GROUP BY user_id, session""")
def session_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT e.event_id, max(o_orderkey) FILTER (WHERE o_orderdate = latest) AS o_orderkey FROM (SELECT e.event_id, o.o_orderkey, o.o_orderdate, max(o.o_orderdate) OVER (PARTITION BY e.event_id) AS latest FROM (SELECT event_id, user_id, TIMESTAMP '1998-01-01' AS at FROM events WHERE event_type = 'purchase') e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.at) e GROUP BY e.event_id")
def as_of_join(spark, sf_dir):
    """The latest order of an event's user up to a moment: aggregated before the join, so one row per user."""
    o = table(spark, sf_dir, "orders").where("o_orderdate <= timestamp '1998-01-01'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").join(o, "user_id").select("event_id", "o_orderkey")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), X.rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), X.rounded(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )
