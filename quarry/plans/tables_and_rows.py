"""Queries over sources, writes, column changes and row choices."""

from pyspark.sql import functions as F

from quarry.operators import columns_ops as cols
from quarry.operators import rows, stats
from quarry.plans.registry import Tables, coordinates, coordinates_sql, query, rounded
from quarry.sources import tables as io

FLAGSHIP_SQL = """
    SELECT l_returnflag, o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS qty_sum,
           round(avg(l_extendedprice), 4) AS price_mean
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 3
    GROUP BY ALL"""


@query("flagship", FLAGSHIP_SQL)
def flagship(t: Tables):
    items = rows.filter_rows(t.lineitem.filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")), "l_quantity > 3")
    joined = items.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    grouped = stats.groupby(joined, "l_returnflag,o_orderstatus", "l_orderkey:count,l_quantity:sum,l_extendedprice:mean")
    return rounded(grouped.toDF("l_returnflag", "o_orderstatus", "n", "qty_sum", "price_mean")
                   .withColumn("qty_sum", F.round("qty_sum", 2)), 4, "price_mean")


_ORDERS = "SELECT * FROM orders"


@query("read_table", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_orderpriority) AS p FROM orders")
def _(t: Tables):
    df = io.read_table(t.spark, f"{t.folder}/orders.parquet")
    return df.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"), F.max("o_orderpriority").alias("p"))


@query("read_table_csv", _ORDERS)
def _(t: Tables):
    path = t.scratch(".csv")
    io.write_table(t.orders, path, fmt="csv")
    read = io.read_table(t.spark, path)  # types are inferred: whole numbers come back as narrow as they fit
    return read.select(*[F.col(c).cast("long").alias(c) if kind == "int" else c for c, kind in read.dtypes])


@query("read_table_json", _ORDERS)
def _(t: Tables):
    path = t.scratch(".json")
    io.write_table(t.orders, path, fmt="json")
    read = io.read_table(t.spark, path)  # JSON has no type for times
    return read.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).select(*t.orders.columns)


@query("write_table", f"{_ORDERS} UNION ALL {_ORDERS}")
def _(t: Tables):
    path = t.scratch(".parquet")
    io.write_table(t.orders, path)
    io.write_table(t.orders, path, mode="append")
    return io.read_table(t.spark, path)


@query("merge_append", "SELECT s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT c_name, c_acctbal FROM customer")
def _(t: Tables):
    return io.merge_append(t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
                           t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))


@query("merge_replace", "SELECT c_custkey, c_name FROM customer")
def _(t: Tables):
    return io.merge_replace(t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")),
                            t.customer.select("c_custkey", "c_name"))


@query("merge_ignore", """
    SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL
    SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def _(t: Tables):
    return io.merge_ignore(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
                           t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), ["id"])


@query("merge_tables", """
    SELECT 'nation' AS tbl, 2 * count(*) AS n FROM nation UNION ALL
    SELECT 'orders', 2 * count(*) FROM orders""")
def _(t: Tables):
    both = {"nation": t.nation, "orders": t.orders}
    merged = io.merge_tables(both, {**both, "_log": t.region}, "append")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in merged.items()]
    return parts[0].unionByName(parts[1])


@query("export_geojson", f"""
    WITH p AS (SELECT c_custkey, c_nationkey, c_mktsegment, {coordinates_sql('c_custkey')} FROM customer)
    SELECT c_custkey AS id, 'Feature' AS type, 'Point' AS shape, lon, lat, c_mktsegment AS segment FROM p""")
def _(t: Tables):
    path = t.scratch()
    io.export_geojson(coordinates(t.customer, "c_custkey"), "lat", "lon", path, "c_custkey", ["c_mktsegment", "no_such"])
    back = t.spark.read.text(path).select(F.from_json(
        "value", "type string, geometry struct<type: string, coordinates: array<double>>, "
                 "properties struct<c_mktsegment: string>, id bigint").alias("f"))
    return back.select("f.id", "f.type", F.col("f.geometry.type").alias("shape"), F.col("f.geometry.coordinates")[0].alias("lon"),
                       F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.properties.c_mktsegment").alias("segment"))


@query("compact", _ORDERS)
def _(t: Tables):
    path = t.scratch()
    t.orders.repartition(16).write.parquet(path)
    return io.compact(t.spark, path, t.scratch(), 2)


@query("rename_col", "SELECT n_nationkey, n_name AS nation, n_regionkey FROM nation")
def _(t: Tables):
    return cols.rename_col(t.nation, "n_name", "nation")


@query("drop_col", "SELECT n_nationkey, n_name FROM nation")
def _(t: Tables):
    return cols.drop_col(t.nation, "n_regionkey")


@query("cast_col", """
    SELECT p_partkey, TRY_CAST(trunc(TRY_CAST(replace(p_brand, 'Brand#1', '1.') AS DOUBLE)) AS BIGINT) AS code,
           CAST(p_size AS VARCHAR) AS size_text FROM part""")
def _(t: Tables):
    df = t.part.select("p_partkey", F.replace("p_brand", F.lit("Brand#1"), F.lit("1.")).alias("code"), F.col("p_size").alias("size_text"))
    return cols.cast_col(cols.cast_col(df, "code", "integer", "nullify"), "size_text", "text")


@query("cast_col_ignore", "SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS p_size FROM part")
def _(t: Tables):
    df = t.part.select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("p_size"))
    return cols.cast_col(cols.cast_col(df, "p_brand", "real", "ignore"), "p_size", "real", "ignore")


@query("flatten_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def _(t: Tables):
    return cols.flatten_json(t.events.select("event_id", "props"), "props", drop_original=True)


@query("flatten_json_nested", """
    SELECT event_id, event_type AS doc_kind, CAST(json_extract(props, '$.k') AS BIGINT) AS doc_at_k, user_id AS doc_at_user FROM events""")
def _(t: Tables):
    nested = F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(
        F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("user_id").alias("user")).alias("at")))
    return cols.flatten_json(t.events.select("event_id", nested.alias("doc")), "doc", drop_original=True)


@query("detect_json", """
    WITH s AS (SELECT 'event_type' AS "column", avg(CASE WHEN json_valid(event_type) THEN 1.0 ELSE 0 END) AS valid_share FROM events
               UNION ALL SELECT 'props', avg(CASE WHEN json_valid(props) THEN 1.0 ELSE 0 END) FROM events)
    SELECT * FROM s WHERE valid_share >= 0.1""")
def _(t: Tables):
    return cols.detect_json(t.events)


@query("detect_json_depth", """
    SELECT 'props' AS "column", avg(CASE WHEN json_valid(props) THEN 1.0 ELSE 0 END) AS valid_share FROM events""")
def _(t: Tables):
    return cols.detect_json(t.events.select("event_id", "props"), depth=1)


@query("validate_schema", """
    WITH v AS (
      SELECT 'l_quantity' AS "column", 'max' AS "rule", count(*) FILTER (l_quantity > 45) AS violations FROM lineitem
      UNION ALL SELECT 'l_discount', 'min', count(*) FILTER (l_discount < 0.01) FROM lineitem
      UNION ALL SELECT 'l_returnflag', 'in', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem
      UNION ALL SELECT 'l_linestatus', 'regex', count(*) FILTER (NOT regexp_matches(l_linestatus, '^[FO]$')) FROM lineitem)
    SELECT "column", "rule", 'row check' AS detail, violations FROM v WHERE violations > 0
    UNION ALL SELECT 'l_tax', 'type', 'expected int, found double', NULL
    UNION ALL SELECT 'no_such', 'missing', 'missing column', NULL""")
def _(t: Tables):
    return cols.validate_schema(t.lineitem, {
        "l_quantity": {"type": "float", "max": 45}, "l_discount": {"min": 0.01, "not_null": True}, "l_orderkey": "int",
        "l_returnflag": {"type": "str", "in": ["A", "N"]}, "l_linestatus": {"regex": "^[FO]$"}, "l_tax": "int", "no_such": "str"})


@query("rule_flags", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
           concat_ws(',', CASE WHEN l_quantity < 3 THEN 'l_quantity:min' END, CASE WHEN l_quantity > 45 THEN 'l_quantity:max' END,
                     CASE WHEN l_tax > 0.07 THEN 'l_tax:max' END) AS broken
    FROM lineitem""")
def _(t: Tables):
    flagged = cols.rule_flags(t.lineitem, {"l_quantity": {"min": 3, "max": 45}, "l_tax": {"max": 0.07}})
    return flagged.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.array_join("broken_rules", ",").alias("broken"))


@query("head", "SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def _(t: Tables):
    return rows.head(t.customer, 10, "c_acctbal,c_custkey")


@query("tail", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 10")
def _(t: Tables):
    return rows.tail(t.customer, 10, "c_acctbal,c_custkey")


@query("sample", "SELECT CAST(round_even(0.1 * count(*), 0) AS BIGINT) AS n, CAST(round_even(0.1 * count(*), 0) AS BIGINT) AS keys, true AS subset FROM orders")
def _(t: Tables):
    picked = rows.sample(t.orders, frac=0.1, seed=3, key="o_orderkey")
    known = t.orders.select("o_orderkey").distinct()
    return picked.join(known.withColumn("known", F.lit(True)), "o_orderkey", "left").agg(
        F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.every("known").alias("subset"))


@query("filter_rows", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE (o_totalprice > 400000 AND o_orderstatus IN ('F', 'O')) OR (o_custkey < 50 AND NOT o_orderpriority = '1-URGENT')""")
def _(t: Tables):
    return rows.filter_rows(t.orders, "(o_totalprice > 400000 & o_orderstatus in ['F', 'O']) or (o_custkey < 50 and not `o_orderpriority` == '1-URGENT')"
                            ).select("o_orderkey", "o_totalprice")


@query("filter_rows_nulls", """
    WITH p AS (SELECT p_partkey, nullif(p_brand, 'Brand#7') AS brand, nullif(p_size, 5) AS size FROM part)
    SELECT * FROM p WHERE brand IS DISTINCT FROM 'Brand#3' AND NOT coalesce(size > 10, false)""")
def _(t: Tables):
    p = t.part.select("p_partkey", F.nullif("p_brand", F.lit("Brand#7")).alias("brand"), F.nullif("p_size", F.lit(5)).alias("size"))
    return rows.filter_rows(p, "brand != 'Brand#3' and not (size > 10)")


@query("sql", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(t: Tables):
    return rows.sql(t.views("customer"), "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")


@query("search", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(lang), 'license') OR contains(lower(source), 'license')")
def _(t: Tables):
    return rows.search(t.documents, "LICENSE").select("doc_id", "lang")


@query("search_case", "SELECT doc_id FROM documents WHERE contains(text, 'The ') OR contains(source, 'The ') OR contains(lang, 'The ')")
def _(t: Tables):
    return rows.search(t.documents, "The ", case_sensitive=True).select("doc_id")


@query("search_regex", "SELECT url FROM pages WHERE regexp_matches(url, '(?i)HTTPS?://m\\.[a-z]+')")
def _(t: Tables):
    return rows.search(t.pages, r"HTTPS?://m\.[a-z]+", cols="url", regex=True)


@query("sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST")
def _(t: Tables):
    return rows.sort(t.customer, "c_acctbal", "desc").select("c_custkey", "c_acctbal")


@query("distinct", "SELECT DISTINCT nullif(p_size, 5) AS size FROM part")
def _(t: Tables):
    return rows.distinct(t.part.select(F.nullif("p_size", F.lit(5)).alias("size")), "size")


@query("value_counts", "SELECT p_brand, count(*) AS count FROM part WHERE p_brand <> 'Brand#5' GROUP BY 1")
def _(t: Tables):
    return rows.value_counts(t.part.select(F.nullif("p_brand", F.lit("Brand#5")).alias("p_brand")), "p_brand")


_HOLES = """SELECT p_partkey, nullif(p_brand, 'Brand#7') AS brand, nullif(p_size, 5) AS size FROM part"""


def _holes(t: Tables):
    return t.part.select("p_partkey", F.nullif("p_brand", F.lit("Brand#7")).alias("brand"), F.nullif("p_size", F.lit(5)).alias("size"))


@query("find_nulls", f"WITH h AS ({_HOLES}) SELECT * FROM h WHERE p_partkey IS NULL OR brand IS NULL OR size IS NULL")
def _(t: Tables):
    return rows.find_nulls(_holes(t))


@query("find_nulls_all", f"WITH h AS ({_HOLES}) SELECT * FROM h WHERE brand IS NULL AND size IS NULL")
def _(t: Tables):
    return rows.find_nulls(_holes(t), "brand,size", "all")


@query("dups", """
    SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    WHERE rn > 1""")
def _(t: Tables):
    return rows.dups(t.orders, "o_custkey", "first", "o_orderdate,o_orderkey").select("o_orderkey", "o_custkey")


@query("dups_last", """
    SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
    WHERE rn > 1""")
def _(t: Tables):
    return rows.dups(t.orders, "o_custkey", "last", "o_orderdate,o_orderkey").select("o_orderkey", "o_custkey")


@query("dups_none", """
    SELECT c_custkey, c_acctbal FROM (SELECT *, count(*) OVER (PARTITION BY c_acctbal) AS n FROM customer) WHERE n > 1""")
def _(t: Tables):
    return rows.dups(t.customer, "c_acctbal", "none").select("c_custkey", "c_acctbal")


@query("dups_rows", """
    SELECT l_returnflag, l_linestatus, l_quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity) AS rn FROM lineitem) WHERE rn > 1""")
def _(t: Tables):
    return rows.dups(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"))
