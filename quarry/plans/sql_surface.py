"""Conformance queries for raw SQL: the same text, or its Spark spelling, against the SQL oracle."""

from pyspark.sql import functions as F

from quarry.operators import joins, rows
from quarry.plans.registry import Tables, query

_ALL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def conform(key: str, text: str, oracle: str | None = None, params: dict | list | None = None) -> None:
    """Register SQL text that runs on both sides, with another spelling for the oracle where dialects differ."""
    @query(key, oracle or text)
    def _(t: Tables):
        return rows.sql(t.views(*_ALL), text, params)


conform("sql_join_inner", """
    SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
conform("sql_join_left", """
    SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY c_custkey""")
conform("sql_join_right", """
    SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'""")
conform("sql_join_full", """
    SELECT s.s_suppkey, n.n_nationkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s
    FULL JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s.s_nationkey = n.n_nationkey""")
conform("sql_join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")


@query("sql_join_theta", """
    SELECT s.s_suppkey, count(*) AS n FROM supplier s JOIN nation c ON s.s_acctbal BETWEEN c.n_nationkey * 300 AND c.n_nationkey * 400 + 500
    GROUP BY s.s_suppkey""")
def _(t: Tables):
    bands = t.nation.selectExpr("n_nationkey * 300 AS low", "n_nationkey * 400 + 500 AS high")
    return joins.interval_join(t.supplier.select("s_suppkey", "s_acctbal"), bands, "s_acctbal", "low", "high").groupBy("s_suppkey").agg(F.count("*").alias("n"))


conform("sql_semi", """
    SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""")
conform("sql_anti", """
    SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")


@query("sql_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def _(t: Tables):
    return joins.not_in(t.part.select("p_partkey"), "p_partkey", t.lineitem.filter("l_quantity > 48"), "l_partkey")


conform("sql_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)")
conform("sql_correlated", """
    SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
conform("sql_cte", """
    WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
         big AS (SELECT * FROM spent WHERE total > 2000000)
    SELECT c_name, round(total, 2) AS total FROM big JOIN customer ON c_custkey = o_custkey""")
conform("sql_cte_recursive", """
    WITH RECURSIVE steps(n, bound) AS (
      SELECT CAST(0 AS BIGINT), CAST((SELECT max(p_size) FROM part) AS BIGINT) UNION ALL SELECT n + 10, bound FROM steps WHERE n + 10 <= bound)
    SELECT n, count(p_partkey) AS parts FROM steps LEFT JOIN part ON p_size >= n AND p_size < n + 10 GROUP BY n""")
conform("sql_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
conform("sql_union_all", "SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
conform("sql_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT l_suppkey FROM lineitem")
conform("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
conform("sql_group_having", """
    SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600""")
conform("sql_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
conform("sql_filter_agg", """
    SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(avg(o_totalprice) FILTER (WHERE o_custkey < 500), 6) AS a
    FROM orders GROUP BY o_orderpriority""")
conform("sql_window_rank", """
    SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS n
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
conform("sql_window_lag_lead", """
    SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
        """SELECT event_id, lag(value) OVER w AS "before", lead(value, 2, -1.0) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
conform("sql_window_frame_rows", """
    SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS s FROM events""")
conform("sql_window_frame_range", """
    SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part""")
conform("sql_window_ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INT) AS q FROM customer",
        "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INTEGER) AS q FROM customer")
conform("sql_window_first_last", """
    SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
conform("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
conform("sql_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 100")
conform("sql_case_coalesce", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS level,
           coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer""")
conform("sql_like", "SELECT p_partkey FROM part WHERE p_name ILIKE 'RED%' OR p_type RLIKE '^S.*D$'",
        "SELECT p_partkey FROM part WHERE p_name ILIKE 'RED%' OR regexp_matches(p_type, '^S.*D$')")
conform("sql_between_in", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#12')")
conform("sql_strings", """
    SELECT c_custkey, substr(c_name, 1, 4) AS a, instr(c_name, '#') AS b, replace(c_name, 'Customer', 'C') AS c, upper(c_mktsegment) AS d,
           trim(concat(' ', c_name, ' ')) AS e, length(c_name) AS f, c_name || '-' || c_mktsegment AS g FROM customer""", """
    SELECT c_custkey, substr(c_name, 1, 4) AS a, CAST(instr(c_name, '#') AS INTEGER) AS b, replace(c_name, 'Customer', 'C') AS c, upper(c_mktsegment) AS d,
           trim(concat(' ', c_name, ' ')) AS e, CAST(length(c_name) AS INTEGER) AS f, c_name || '-' || c_mktsegment AS g FROM customer""")
conform("sql_group_concat", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
conform("sql_dates", """
    SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS month, CAST(date_add(to_date(o_orderdate), 30) AS STRING) AS due,
           CAST(unix_timestamp(o_orderdate) / 86400.0 + 2440587.5 AS DOUBLE) AS julian, year(o_orderdate) AS y FROM orders""", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS due,
           CAST(epoch(o_orderdate) / 86400.0 + 2440587.5 AS DOUBLE) AS julian, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders""")
conform("sql_math", """
    SELECT p_partkey, round(p_retailprice, 1) AS r, abs(p_size - 25) AS a, greatest(p_size, 20) AS g, least(p_size, 20) AS l, p_partkey div 7 AS d, p_partkey % 7 AS m FROM part""", """
    SELECT p_partkey, round(p_retailprice, 1) AS r, abs(p_size - 25) AS a, greatest(p_size, 20) AS g, least(p_size, 20) AS l, p_partkey // 7 AS d, p_partkey % 7 AS m FROM part""")
conform("sql_json", """
    SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type""", """
    SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type""")
conform("sql_json_each", """
    SELECT event_id, key, item FROM events LATERAL VIEW explode(from_json(props, 'map<string, bigint>')) kv AS key, item""",
        "SELECT event_id, key, CAST(e.value AS BIGINT) AS item FROM events, json_each(props) AS e")
conform("sql_params_named", "SELECT o_orderkey FROM orders WHERE o_totalprice > :floor AND o_orderstatus = :status",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000.0 AND o_orderstatus = 'F'", {"floor": 300000.0, "status": "F"})
conform("sql_params_positional", "SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000.0 AND o_orderstatus = 'F'", [300000.0, "F"])
