"""Queries over aggregates, statistics and windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import stats, windows
from quarry.plans.registry import Tables, query, rounded


@query("groupby", """
    SELECT l_returnflag, l_linestatus, count(l_quantity) AS l_quantity_count, round(sum(l_quantity), 2) AS l_quantity_sum,
           round(avg(l_discount), 6) AS l_discount_mean, min(l_tax) AS l_tax_min, max(l_tax) AS l_tax_max,
           round(stddev_samp(l_quantity), 6) AS l_quantity_std, round(var_samp(l_quantity), 6) AS l_quantity_var,
           round(median(l_extendedprice), 6) AS l_extendedprice_median
    FROM lineitem GROUP BY 1, 2""")
def _(t: Tables):
    return rounded(stats.groupby(
        t.lineitem, "l_returnflag,l_linestatus",
        "l_quantity:count,l_quantity:sum,l_discount:mean,l_tax:min,l_tax:max,l_quantity:std,l_quantity:var,l_extendedprice:median"))


@query("groupby_size", "SELECT p_brand, p_type, count(*) AS counts FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1, 2")
def _(t: Tables):
    return stats.groupby(t.part.withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#3"))), "p_brand,p_type")


@query("groupby_pivot", """
    SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS "F_l_quantity_mean",
           round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS "O_l_quantity_mean",
           max(l_tax) FILTER (l_linestatus = 'F') AS "F_l_tax_max", max(l_tax) FILTER (l_linestatus = 'O') AS "O_l_tax_max"
    FROM lineitem GROUP BY 1""")
def _(t: Tables):
    return rounded(stats.groupby_pivot(t.lineitem, "l_returnflag,l_linestatus", "l_quantity:mean,l_tax:max"))


def _pivot_sql(func: str) -> str:
    heads = ", ".join(f"""{func}(p_retailprice) FILTER (p_type = '{h}') AS "{h}" """ for h in
                      ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])
    return f"SELECT p_brand, {heads} FROM part GROUP BY 1"


@query("pivot", "WITH w AS (" + _pivot_sql("avg") + ") SELECT p_brand, " + ", ".join(
    f'round("{h}", 6) AS "{h}"' for h in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]) + " FROM w")
def _(t: Tables):
    return rounded(stats.pivot(t.part, "p_brand", "p_type", "p_retailprice", "mean"))


@query("pivot_count", _pivot_sql("count"))
def _(t: Tables):
    return stats.pivot(t.part, "p_brand", "p_type", "p_retailprice", "count", fill_value=0)


@query("pivot_min", _pivot_sql("min"))
def _(t: Tables):
    return stats.pivot(t.part, "p_brand", "p_type", "p_retailprice", "min")


_CUBE = """
    WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1, 2),
    f AS (SELECT r, c, coalesce(n, 0) AS n FROM (SELECT DISTINCT r FROM c) CROSS JOIN (SELECT DISTINCT c FROM c) LEFT JOIN c USING (r, c)),
    k AS (SELECT coalesce(r, 'All') AS "row", coalesce(c, 'All') AS col, sum(n) AS n FROM f GROUP BY CUBE (r, c))
    """


@query("crosstab", _CUBE + """SELECT "row", col, CAST(n AS DOUBLE) AS value FROM k WHERE "row" <> 'All' AND col <> 'All'""")
def _(t: Tables):
    return stats.crosstab(t.orders, "o_orderstatus", "o_orderpriority")


@query("crosstab_margins", _CUBE + """SELECT "row", col, CAST(n AS DOUBLE) AS value FROM k""")
def _(t: Tables):
    return stats.crosstab(t.orders, "o_orderstatus", "o_orderpriority", margins=True)


@query("crosstab_index", _CUBE + """
    SELECT "row", col, round(n / max(n) OVER (PARTITION BY "row"), 9) AS value FROM k QUALIFY col <> 'All'""")
def _(t: Tables):
    return rounded(stats.crosstab(t.orders, "o_orderstatus", "o_orderpriority", "index", margins=True), 9)


@query("crosstab_columns", _CUBE + """
    SELECT "row", col, round(n / max(n) OVER (PARTITION BY col), 9) AS value FROM k QUALIFY "row" <> 'All' AND col <> 'All'""")
def _(t: Tables):
    return rounded(stats.crosstab(t.orders, "o_orderstatus", "o_orderpriority", "columns"), 9)


@query("crosstab_all", _CUBE + """SELECT "row", col, round(n / max(n) OVER (), 9) AS value FROM k""")
def _(t: Tables):
    return rounded(stats.crosstab(t.orders, "o_orderstatus", "o_orderpriority", "all", margins=True), 9)


@query("crosstab_wide", """
    SELECT o_orderstatus AS "row", CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS "1-URGENT",
           CAST(count(*) FILTER (o_orderpriority = '5-LOW') AS DOUBLE) AS "5-LOW" FROM orders GROUP BY 1""")
def _(t: Tables):
    return stats.crosstab_wide(t.orders, "o_orderstatus", "o_orderpriority").select("row", "1-URGENT", "5-LOW")


def describe_sql(table: str, numbers: list[str], texts: list[str], percents: list[float]) -> str:
    parts = []
    for c in numbers:
        for metric, f in {"count": f"count({c})", "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})",
                          **{f"{p * 100:g}%": f"quantile_cont({c}, {p})" for p in percents}}.items():
            parts.append(f"""SELECT '{c}' AS "column", '{metric}' AS metric, round(CAST({f} AS DOUBLE), 6) AS value, CAST(NULL AS VARCHAR) AS text FROM {table}""")
    for c in texts:
        best = f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
        freq = f"(SELECT count(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1)"
        for metric, f, text in [("count", f"count({c})", "NULL"), ("unique", f"count(DISTINCT {c})", "NULL"), ("top", "NULL", best), ("freq", freq, "NULL")]:
            source = f" FROM {table}" if "count(" in f and not f.startswith("(") else ""
            parts.append(f"""SELECT '{c}' AS "column", '{metric}' AS metric, CAST({f} AS DOUBLE) AS value, CAST({text} AS VARCHAR) AS text{source}""")
    return " UNION ALL ".join(parts)


@query("describe", describe_sql("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"], [0.25, 0.5, 0.75]))
def _(t: Tables):
    return rounded(stats.describe(t.part))


@query("describe_percentiles", describe_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], [], [0.1, 0.5, 0.99]))
def _(t: Tables):
    return rounded(stats.describe(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount"), [0.1, 0.99], "number"))


@query("describe_object", describe_sql("customer", [], ["c_name", "c_mktsegment"], []))
def _(t: Tables):
    return stats.describe(t.customer, include="object")


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(table: str, cols: list[str], f: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round({f.format(a=a, b=b)}, 6) AS corr, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a in cols for b in cols)


_GAPS = "WITH g AS (SELECT nullif(l_quantity, 7) AS l_quantity, l_extendedprice, nullif(l_discount, 0.03) AS l_discount, l_tax FROM lineitem) "


def _gaps(t: Tables):
    return t.lineitem.select(F.nullif("l_quantity", F.lit(7.0)).alias("l_quantity"), "l_extendedprice",
                             F.nullif("l_discount", F.lit(0.03)).alias("l_discount"), "l_tax")


@query("corr_pearson", _GAPS + _corr_sql("g", _CORR_COLS, "corr({a}, {b})"))
def _(t: Tables):
    return rounded(stats.corr_pearson(_gaps(t)))


def _spearman_sql(cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"""
              SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS corr, count(*) AS n FROM (
                SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
                       rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
                FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    return " UNION ALL ".join(parts)


@query("corr_spearman", _GAPS + _spearman_sql(["l_quantity", "l_extendedprice", "l_discount"]))
def _(t: Tables):
    return rounded(stats.corr_spearman(_gaps(t).drop("l_tax")))


def _moment_sql(f: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", round({f}({c}), 6) AS {'skew' if f == 'skewness' else f} FROM lineitem"""
                              for c in ["l_partkey", "l_quantity", "l_extendedprice", "l_discount"])


@query("skew", _moment_sql("skewness"))
def _(t: Tables):
    return rounded(stats.skew(t.lineitem.select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"), numeric_only=True))


@query("kurtosis", _moment_sql("kurtosis"))
def _(t: Tables):
    return rounded(stats.kurtosis(t.lineitem.select("l_partkey", "l_quantity", "l_extendedprice", "l_discount"), numeric_only=False))


def profile_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"""
        SELECT "column", non_null_pct, unique_pct, CAST(rank AS INTEGER) AS rank, value, n FROM (
          SELECT '{c}' AS "column", round((SELECT count({c}) * 100.0 / count(*) FROM {table}), 6) AS non_null_pct,
                 round((SELECT count(DISTINCT {c}) * 100.0 / count(*) FROM {table}), 6) AS unique_pct,
                 row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank, CAST({c} AS VARCHAR) AS value, count(*) AS n
          FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5""" for c in cols)


@query("profile", profile_sql("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]))
def _(t: Tables):
    return rounded(stats.profile(t.part))


@query("profile_approx", profile_sql("orders", ["o_orderstatus", "o_orderpriority"]))
def _(t: Tables):
    return rounded(stats.profile(t.orders.select("o_orderstatus", "o_orderpriority"), approx=True))


def _near_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", true AS near_filled, true AS near_unique FROM region WHERE r_regionkey = 0"""


@query("profile_approx_bounds", " UNION ALL ".join(map(_near_sql, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                                                                    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])))
def _(t: Tables):
    exact = stats.profile(t.lineitem, top=1).select("column", F.col("non_null_pct").alias("filled"), F.col("unique_pct").alias("distinct"))
    near = stats.profile(t.lineitem, top=1, approx=True).select("column", "non_null_pct", "unique_pct")
    off = F.abs(F.col("unique_pct") - F.col("distinct")) <= 5 * stats.RELATIVE_ERROR * F.col("distinct")
    return near.join(exact, "column").select("column", (F.col("non_null_pct") == F.col("filled")).alias("near_filled"), off.alias("near_unique"))


def _bars_sql(table: str, c: str, bins: int) -> str:
    return f"""SELECT '{c}' AS "column", i AS bin, round(a, 6) AS low, round(z, 6) AS high, n FROM (
      SELECT CAST(r.i AS INTEGER) AS i, lo + r.i * ((hi - lo) / {bins}) AS a, lo + (r.i + 1) * ((hi - lo) / {bins}) AS z,
             (SELECT count(*) FROM {table} WHERE least({bins - 1}, floor((CAST({c} AS DOUBLE) - lo) / (hi - lo) * {bins})) = r.i) AS n
      FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {table}), range({bins}) AS r(i))"""


@query("profile_histogram", " UNION ALL ".join(_bars_sql("part", c, 20) for c in ["p_partkey", "p_size", "p_retailprice"]))
def _(t: Tables):
    found = stats.profile(t.part, top=1, histogram=True).filter("rank = 1 AND histogram IS NOT NULL")
    bars = found.select("column", F.posexplode("histogram").alias("bin", "bar")).select("column", "bin", F.col("bar.low").alias("low"), F.col("bar.high").alias("high"), F.col("bar.n").alias("n"))
    return rounded(bars)


@query("profile_sample", """SELECT count(*) AS "columns", CAST(round(0.25 * (SELECT count(*) FROM orders)) AS BIGINT) AS distinct_keys FROM (SELECT unnest([1, 2, 3, 4, 5, 6]))""")
def _(t: Tables):
    size = F.lit(0.25) * t.orders.agg(F.count("*")).scalar()
    found = stats.profile(t.orders, top=1, sample=0.25, key="o_orderkey", seed=3).filter("rank = 1")
    keys = F.max(F.when(F.col("column") == "o_orderkey", F.col("unique_pct")))
    return found.agg(F.count("*").alias("columns"), F.round(keys / 100 * F.round(size)).cast("long").alias("distinct_keys"))


@query("describe_approx", """
    SELECT "column", metric, value, text FROM (
      SELECT 'o_orderstatus' AS "column", o_orderstatus AS top, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS place FROM orders GROUP BY o_orderstatus) m,
      LATERAL (VALUES ('count', (SELECT CAST(count(o_orderstatus) AS DOUBLE) FROM orders), NULL), ('unique', (SELECT CAST(count(DISTINCT o_orderstatus) AS DOUBLE) FROM orders), NULL),
                      ('top', NULL, top), ('freq', CAST(n AS DOUBLE), NULL)) v(metric, value, text) WHERE place = 1""")
def _(t: Tables):
    return stats.describe(t.orders.select("o_orderstatus"), approx=True)


@query("groupby_median_approx", "SELECT l_returnflag, count(*) AS rows, true AS near FROM lineitem GROUP BY l_returnflag")
def _(t: Tables):
    found = stats.groupby(t.lineitem, "l_returnflag", "l_extendedprice:median,l_extendedprice:count", approx=True).withColumnRenamed("l_returnflag", "flag")
    rank = t.lineitem.join(F.broadcast(found), F.col("l_returnflag") == F.col("flag")).groupBy("l_returnflag").agg(  # a row per flag
        F.count("*").alias("rows"), F.count_if(F.col("l_extendedprice") <= F.col("l_extendedprice_median")).alias("upto"))
    return rank.select("l_returnflag", "rows", (F.abs(F.col("upto") / F.col("rows") - 0.5) <= 2 / stats.ACCURACY + 1 / F.col("rows")).alias("near"))


@query("crosstab_sparse", "SELECT CAST(l_partkey AS VARCHAR) AS row, CAST(l_suppkey AS VARCHAR) AS col, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY l_partkey, l_suppkey")
def _(t: Tables):
    return stats.crosstab(t.lineitem, "l_partkey", "l_suppkey", zeros=False)


@query("crosstab_many_labels", """
    WITH c AS (SELECT l_suppkey AS r, l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1, 2),
    full_ AS (SELECT s.r, p.k, coalesce(n, 0) AS n FROM (SELECT DISTINCT r FROM c) s CROSS JOIN (SELECT DISTINCT k FROM c) p LEFT JOIN c ON c.r = s.r AND c.k = p.k)
    SELECT CAST(r AS VARCHAR) AS row, count(*) AS cells, count(*) FILTER (n = 0) AS empty, round(sum(CAST(n AS DOUBLE) / (SELECT sum(n) FROM c c2 WHERE c2.r = full_.r)), 6) AS share FROM full_ GROUP BY r""")
def _(t: Tables):
    cells = stats.crosstab(t.lineitem, "l_suppkey", "l_partkey", normalize="index")
    return rounded(cells.groupBy("row").agg(F.count("*").alias("cells"), F.count_if(F.col("value") == 0).alias("empty"), F.sum("value").alias("share")))


@query("profile_json", """
    WITH d AS (""" + describe_sql("part", ["p_size"], ["p_brand"], [0.25, 0.5, 0.75]) + """)
    SELECT count(*) AS metrics, CAST(round(sum(value), 2) AS DOUBLE) AS total FROM d""")
def _(t: Tables):
    doc = stats.profile_json(t.part.select("p_size", "p_brand"))
    entries = doc.select(F.inline(F.from_json("profile", "array<struct<column: string, metric: string, value: double, text: string>>")))
    return entries.agg(F.count("*").alias("metrics"), F.round(F.sum("value"), 2).alias("total"))


@query("moving_avg", """
    SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(avg(value) OVER w, 6) END AS value_moving_avg
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(t: Tables):
    return rounded(windows.moving_avg(t.events.select("event_id", "ts", "value"), "value", 5, order_by="ts,event_id").select("event_id", "value_moving_avg"))


@query("moving_avg_center", """
    WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)
    SELECT event_id, CASE WHEN count(value) OVER w >= 2 THEN round(avg(value) OVER w, 6) END AS value_moving_avg
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def _(t: Tables):
    e = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return rounded(windows.moving_avg(e, "value", 4, center=True, min_periods=2, order_by="ts,event_id", partition_by="user_id")
                   .select("event_id", "value_moving_avg"))


def _rank_sql(expr: str, extra: str = "") -> str:
    return f"""
    WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_quantity, 7) AS l_quantity, l_extendedprice FROM lineitem),
    r AS (SELECT *, {expr} AS r FROM g WHERE l_quantity IS NOT NULL)
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(r AS DOUBLE) AS l_quantity_rank FROM r
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, NULL FROM g WHERE l_quantity IS NULL"""


def _ranked(t: Tables, method: str, pct: bool = False):
    g = t.lineitem.withColumn("l_quantity", F.nullif("l_quantity", F.lit(7.0)))
    out = windows.rank(g, "l_quantity", method, pct, "l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_quantity_rank")


@query("rank", _rank_sql("rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0"))
def _(t: Tables):
    return _ranked(t, "average")


@query("rank_min_pct", _rank_sql("round(rank() OVER (ORDER BY l_quantity) / count(*) OVER (), 9)"))
def _(t: Tables):
    return rounded(_ranked(t, "min", pct=True), 9, "l_quantity_rank")


@query("rank_max", _rank_sql("rank() OVER (ORDER BY l_quantity) + count(*) OVER (PARTITION BY l_quantity) - 1"))
def _(t: Tables):
    return _ranked(t, "max")


@query("rank_dense_pct", _rank_sql("round(dense_rank() OVER (ORDER BY l_quantity) / (SELECT count(DISTINCT l_quantity) FROM g), 9)"))
def _(t: Tables):
    return rounded(_ranked(t, "dense", pct=True), 9, "l_quantity_rank")


@query("rank_first", _rank_sql("row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"))
def _(t: Tables):
    return _ranked(t, "first")


BIN_SQL = """
    WITH e AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}),
    b AS (SELECT i, CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 ELSE i * ((hi - lo) / {n}) + lo END AS a,
                 CASE WHEN i = {n} - 1 THEN hi ELSE (i + 1) * ((hi - lo) / {n}) + lo END AS z FROM e, range({n}) AS r(i))"""


@query("bin", BIN_SQL.format(c="l_quantity", t="lineitem", n=4) + """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE i WHEN 0 THEN 'low' WHEN 1 THEN 'mid' WHEN 2 THEN 'high' ELSE 'top' END AS l_quantity_bin
    FROM lineitem JOIN b ON l_quantity > a AND l_quantity <= z""")
def _(t: Tables):
    return windows.bin(t.lineitem, "l_quantity", 4, "low,mid,high,top").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_quantity_bin")


@query("bin_intervals", BIN_SQL.format(c="l_extendedprice", t="lineitem", n=7) + """
    SELECT i AS bin, count(l_extendedprice) AS n FROM b LEFT JOIN lineitem ON l_extendedprice > a AND l_extendedprice <= z GROUP BY 1""")
def _(t: Tables):
    binned = windows.bin(t.lineitem, "l_extendedprice", 7)
    # intervals in order of their lower ends
    low = F.regexp_extract("l_extendedprice_bin", r"\(([^,]+),", 1).cast("double")
    counted = binned.groupBy(low.alias("low")).agg(F.count("*").alias("n"))
    return counted.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("low")) - 1).cast("long").alias("bin"), "n")
