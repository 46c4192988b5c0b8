"""Extras: relational queries that the document operators do not need; not part of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.plans.catalog import query
from quire.sources.bridge import table


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def extra_pricing(spark, d):
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


@query("SELECT n_name, r_name, count(*) AS orders, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def extra_rollup(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.sum("l_quantity").alias("quantity"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def extra_top_orders(spark, d):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("k", k).where("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k")
def extra_sessions(spark, d):
    t = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return t.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n")).select("user_id", "started", "n")
