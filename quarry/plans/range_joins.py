"""Registered joins on ranges: values in intervals, bands, overlapping intervals, and lists that may hold nulls."""

from pyspark.sql import functions as F

from quarry.operators import joins
from quarry.plans.registry import Tables, query, rounded


@query("interval_join", """
    SELECT s_suppkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN supplier
      ON o_totalprice BETWEEN s_acctbal * 20 AND s_acctbal * 20 + 3000 + s_nationkey * 200 GROUP BY s_suppkey""")
def _(t: Tables):
    bands = t.supplier.selectExpr("s_suppkey", "s_acctbal * 20 AS low", "s_acctbal * 20 + 3000 + s_nationkey * 200 AS high")
    met = joins.interval_join(t.orders.select("o_totalprice"), bands, "o_totalprice", "low", "high")
    return rounded(met.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("interval_join_left", """
    SELECT o_orderkey, o_orderdate, event_id FROM orders LEFT JOIN (SELECT event_id, ts - INTERVAL 9000 DAY AS since, ts - INTERVAL 8990 DAY AS till, value FROM events WHERE value > 160) e
      ON o_orderdate > since AND o_orderdate <= till""")
def _(t: Tables):
    spans = t.events.filter("value > 160").selectExpr("event_id", "ts - INTERVAL 9000 DAYS AS since", "ts - INTERVAL 8990 DAYS AS till")
    met = joins.interval_join(t.orders.select("o_orderkey", "o_orderdate"), spans, "o_orderdate", "since", "till", "left", closed="right")
    return met.select("o_orderkey", "o_orderdate", "event_id")


_SPANS = "(SELECT s_nationkey AS nation, s_acctbal - 20 AS low, s_acctbal + 20 AS high FROM supplier WHERE s_suppkey % 9 <> 0)"


def _spans(t: Tables):
    return t.supplier.filter("s_suppkey % 9 <> 0").selectExpr("s_nationkey AS nation", "s_acctbal - 20 AS low", "s_acctbal + 20 AS high")


@query("interval_join_semi", f"""
    SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM {_SPANS} s WHERE c.c_nationkey = s.nation AND c_acctbal BETWEEN low AND high)""")
def _(t: Tables):
    people = t.customer.withColumn("nation", F.col("c_nationkey"))
    return joins.interval_join(people, _spans(t), "c_acctbal", "low", "high", "semi", on="nation").select("c_custkey")


@query("interval_join_anti", f"""
    SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM {_SPANS} s WHERE c_acctbal >= low)""")
def _(t: Tables):
    return joins.interval_join(t.customer, _spans(t), "c_acctbal", "low", None, "anti").select("c_custkey")


@query("band_join", """
    SELECT a.o_orderkey, count(*) AS n, min(b.o_orderkey) AS least FROM orders a JOIN orders b
      ON b.o_totalprice BETWEEN a.o_totalprice - 12.5 AND a.o_totalprice + 25 GROUP BY a.o_orderkey""")
def _(t: Tables):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    met = joins.band_join(orders, orders, "o_totalprice", "o_totalprice", 12.5, 25.0)
    return met.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("o_orderkey_right").alias("least"))


@query("overlap_join", """
    WITH stays AS (SELECT user_id, event_type, event_id, ts AS since, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS till FROM events)
    SELECT a.event_id, count(*) AS n, CAST(sum(b.event_id) AS BIGINT) AS total FROM stays a JOIN stays b
      ON a.event_type = b.event_type AND a.user_id = b.user_id AND a.since <= b.till AND b.since <= a.till GROUP BY a.event_id""")
def _(t: Tables):
    stays = t.events.selectExpr("user_id", "event_type", "event_id", "ts AS since", "ts + make_dt_interval(0, 0, 0, CAST(value * 60 AS DECIMAL(18, 6))) AS till")
    met = joins.overlap_join(stays, stays, "since", "till", on="event_type,user_id")
    return met.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("event_id_right").alias("total"))


_GAPPY = "(SELECT CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS k FROM orders WHERE o_orderstatus = 'P')"


@query("not_in_with_nulls", f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN {_GAPPY}")
def _(t: Tables):
    listed = t.orders.filter("o_orderstatus = 'P'").selectExpr("CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS k")
    return joins.not_in(t.customer.select("c_custkey"), "c_custkey", listed, "k")
