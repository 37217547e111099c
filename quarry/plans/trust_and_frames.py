"""Queries over integrity, privacy, versioning, drift, and the frames behind charts and reports."""

from pyspark.sql import functions as F

from quarry.operators import frames, integrity, versions
from quarry.plans.registry import Tables, coordinates, coordinates_sql, query, rounded
from quarry.plans.statistics import profile_sql
from quarry.plans.steps import run_steps


def _fingerprint_sql(table: str, cols: list[str], salt: str) -> str:
    part = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in cols)
    return f"""
    WITH r AS (SELECT sha256('{len(salt)}:{salt}' || {part}) AS d FROM {table}),
    c AS (SELECT d, count(*) AS n FROM r GROUP BY 1),
    l AS (SELECT substr(d, 1, 6) AS p, sha256(string_agg(d || 'x' || n, ',' ORDER BY d || 'x' || n)) AS d FROM c GROUP BY 1),
    m AS (SELECT substr(p, 1, 3) AS q, sha256(string_agg(p || ':' || d, ',' ORDER BY p || ':' || d)) AS d FROM l GROUP BY 1)
    SELECT sha256('|' || string_agg(q || ':' || d, ',' ORDER BY q || ':' || d)) AS fingerprint FROM m"""


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query("fingerprint", _fingerprint_sql("orders", _ORDER_COLS, "pepper"))
def _(t: Tables):
    return integrity.fingerprint(t.orders, salt="pepper", exclude="o_totalprice,o_orderdate")


@query("fingerprint_repeated", _fingerprint_sql("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"], ""))
def _(t: Tables):
    return integrity.fingerprint(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("verify_fingerprint", "SELECT 'sha512' AS algo, true AS verified, false AS tampered FROM region LIMIT 1")
def _(t: Tables):
    cust = t.customer
    digest = integrity.fingerprint(cust, "sha512", "s", strict=True).first()[0]
    good = integrity.verify_fingerprint(cust.repartition(5), digest, "s", strict=True).select("algo", "verified")
    changed = integrity.verify_fingerprint(cust.withColumn("c_acctbal", F.col("c_acctbal") + 0.01), digest, "s", strict=True)
    return good.withColumn("tampered", F.lit(changed.first()["verified"]))


@query("snapshot", "SELECT 'before' AS name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer")
def _(t: Tables):
    root = t.scratch()
    versions.snapshot(t.customer, root, "customer", "before", "first copy")
    log = versions.snapshots(t.spark, root)
    saved = t.spark.read.parquet(log.first()["snapshot_path"])
    return saved.agg(F.lit("before").alias("name"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("rollback", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t: Tables):
    root = t.scratch()
    versions.audited_write(t.customer, root, "customer", "load")
    versions.snapshot(t.customer, root, "customer", "before")
    versions.audited_write(t.customer.filter("c_acctbal > 0").withColumn("c_name", F.lit("x")), root, "customer", "damage")
    return versions.rollback(t.spark, root, "customer", "before")


@query("rollback_dry_run", "SELECT count(*) FILTER (c_acctbal > 0) AS current_rows, count(*) AS snapshot_rows FROM customer")
def _(t: Tables):
    root = t.scratch()
    versions.snapshot(t.customer, root, "customer", "before")
    versions.audited_write(t.customer.filter("c_acctbal > 0"), root, "customer", "clean")
    return versions.rollback(t.spark, root, "customer", "before", dry_run=True)


@query("audited_write", """
    SELECT 'ana' AS user, 'clean.trim' AS action, 'table=orders' AS details, count(*) AS n FROM orders""")
def _(t: Tables):
    root = t.scratch()
    versions.audited_write(t.orders, root, "orders", "load", "bo")
    versions.audited_write(versions.read_current(t.spark, root, "orders"), root, "orders", "clean.trim", "ana")
    log = versions.read_audit_log(t.spark, root, user="ana", action="TRIM")
    return log.select("user", "action", "details").withColumn("n", F.lit(versions.read_current(t.spark, root, "orders").count()).cast("long"))


@query("audit_log", """
    SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user, event_type AS action FROM events
    WHERE event_type LIKE '%rr%' ORDER BY ts DESC, event_id LIMIT 50""")
def _(t: Tables):
    log = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("user"),
                          F.col("event_type").alias("action"))
    return versions.audit_log(log, action="RR").select("id", "user", "action")


@query("job_history", """
    SELECT event_id AS id, user_id AS task_id FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id LIMIT 20""")
def _(t: Tables):
    runs = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), F.lit("task").alias("task_name"),
                           F.col("ts").alias("start_time"), F.when(F.col("event_type") == "view", "success").otherwise("failed").alias("status"),
                           F.col("event_type").alias("error"))
    return versions.job_history(runs, errors_only=True).select("id", "task_id")


def _pii_sql(table: str, key: str) -> str:
    return " UNION ALL ".join(f"""
        SELECT {key}, '{c}' AS "column", '{e}' AS entity, CAST(i - 1 AS INTEGER) AS match_no, s AS snippet FROM (
          SELECT {key}, unnest(m) AS s, generate_subscripts(m, 1) AS i FROM (SELECT {key}, regexp_extract_all({c}, '{p}') AS m FROM {table}))"""
                              for c in ("text", "lang", "source") for e, p in integrity.PII_PATTERNS.items())


@query("scan_pii", _pii_sql("documents", "doc_id"))
def _(t: Tables):
    return integrity.scan_pii(t.documents, "doc_id")


@query("encrypt_col", "SELECT c_custkey, true AS hidden, c_name, c_name AS wrong_key_keeps FROM customer")
def _(t: Tables):
    key, other = "0123456789abcdef", "fedcba9876543210"
    sealed = integrity.encrypt_col(t.customer.select("c_custkey", "c_name"), "c_name", key).withColumn("sealed", F.col("c_name"))
    opened = integrity.decrypt_col(sealed, "c_name", key)
    plain = t.customer.select("c_custkey", F.col("c_name").alias("wrong_key_keeps"))
    kept = integrity.decrypt_col(plain, "wrong_key_keeps", other)
    return opened.select("c_custkey", (F.col("sealed") != F.col("c_name")).alias("hidden"), "c_name").join(kept, "c_custkey")


@query("decrypt_col", "SELECT s_suppkey, s_name FROM supplier")
def _(t: Tables):
    key = bytes(range(32))
    return integrity.decrypt_col(integrity.encrypt_col(t.supplier.select("s_suppkey", "s_name"), "s_name", key), "s_name", key)


@query("anonymize_mask", "SELECT c_custkey, repeat('*', least(9, length(c_name))) || substr(c_name, 10) AS c_name FROM customer")
def _(t: Tables):
    return integrity.anonymize(t.customer.select("c_custkey", "c_name"), "c_name", "mask", 9)


@query("anonymize_hash", "SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
def _(t: Tables):
    return integrity.anonymize(t.customer.select("c_custkey", "c_name"), "c_name", "hash")


@query("anonymize_redact", "SELECT c_custkey, '[REDACTED]' AS c_name FROM customer")
def _(t: Tables):
    return integrity.anonymize(t.customer.select("c_custkey", "c_name"), "c_name", "redact")


_DRIFT = ["l_quantity", "l_extendedprice", "l_discount"]


@query("drift_check", """
    WITH u AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} * (CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' AND '{c}' = 'l_extendedprice' THEN 1.2 ELSE 1 END) AS v,
        CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' THEN 1 ELSE 0 END AS now FROM lineitem""" for c in _DRIFT) + """),
    f AS (SELECT DISTINCT "column", v, sum(now) OVER w / (sum(now) OVER (PARTITION BY "column")) AS fa,
                 sum(1 - now) OVER w / (sum(1 - now) OVER (PARTITION BY "column")) AS fb
          FROM u WINDOW w AS (PARTITION BY "column" ORDER BY v))
    SELECT "column", round(max(abs(fa - fb)), 6) AS statistic FROM f GROUP BY 1""")
def _(t: Tables):
    late = F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp")
    now = t.lineitem.filter(late).withColumn("l_extendedprice", F.col("l_extendedprice") * 1.2).select(*_DRIFT)
    return rounded(integrity.drift_check(now, t.lineitem.filter(~late).select(*_DRIFT)).select("column", "statistic"))


def _tail_sql(distance: str, n: str, m: str) -> str:
    """The asymptotic probability of a larger two-sample distance."""
    lam = f"({distance} * sqrt(CAST({n} AS DOUBLE) * {m} / ({n} + {m})))"
    series = f"list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * {lam} * {lam})))"
    return f"CASE WHEN {lam} < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, {series})) END"


@query("drift_p_value", """
    WITH u AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS v, l_orderkey % 2 AS now FROM lineitem""" for c in _DRIFT) + f"""),
    f AS (SELECT DISTINCT "column", v, sum(now) OVER w / (sum(now) OVER (PARTITION BY "column")) AS fa,
                 sum(1 - now) OVER w / (sum(1 - now) OVER (PARTITION BY "column")) AS fb
          FROM u WINDOW w AS (PARTITION BY "column" ORDER BY v)),
    s AS (SELECT "column", max(abs(fa - fb)) AS d FROM f GROUP BY 1),
    c AS (SELECT "column", sum(now) AS n, sum(1 - now) AS m FROM u GROUP BY 1)
    SELECT "column", round({_tail_sql("d", "n", "m")}, 6) AS p_value FROM s JOIN c USING ("column")""")
def _(t: Tables):
    odd = F.col("l_orderkey") % 2 == 1  # two groups without a difference: p values inside 0 and 1
    now, then = t.lineitem.filter(odd).select(*_DRIFT), t.lineitem.filter(~odd).select(*_DRIFT)
    return rounded(integrity.drift_check(now, then).select("column", "p_value"))


@query("drift_verdict", """
    SELECT unnest(['l_quantity', 'l_extendedprice']) AS "column", unnest(['OK', 'DRIFT']) AS result""")
def _(t: Tables):
    both = t.lineitem.select("l_quantity", "l_extendedprice")
    return integrity.drift_check(both.withColumn("l_extendedprice", F.col("l_extendedprice") * 1.2), both).select("column", "result")


@query("bar_frame", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum FROM lineitem GROUP BY 1")
def _(t: Tables):
    return rounded(frames.bar_frame(t.lineitem, "l_returnflag", "l_extendedprice", "sum"), 2)


@query("bar_frame_stack", """
    SELECT p_brand, coalesce(median(p_retailprice) FILTER (p_type = 'PROMO' AND p_size > 40), 0) AS "PROMO",
           coalesce(median(p_retailprice) FILTER (p_type = 'LARGE' AND p_size > 40), 0) AS "LARGE" FROM part WHERE p_size > 40 GROUP BY 1""")
def _(t: Tables):
    return frames.bar_frame(t.part.filter("p_size > 40"), "p_brand", "p_retailprice", "median", "p_type").select("p_brand", "PROMO", "LARGE")


_HIST = """
    WITH e AS (SELECT min({c}) AS a, max({c}) AS b FROM {t}),
    n AS (SELECT least({n} - 1, CAST(floor(({c} - a) / (b - a) * {n}) AS BIGINT)) AS i, count(*) AS n FROM {t}, e GROUP BY 1)
    SELECT CAST(r.i AS INTEGER) AS bin, round(a + r.i * ((b - a) / {n}), 6) AS low, round(a + (r.i + 1) * ((b - a) / {n}), 6) AS high, coalesce(n.n, 0) AS n
    FROM range({n}) AS r(i) LEFT JOIN n ON n.i = r.i, e"""


@query("hist_frame", _HIST.format(c="o_totalprice", t="orders", n=12))
def _(t: Tables):
    return rounded(frames.hist_frame(t.orders, "o_totalprice", 12))


@query("scatter_frame", "SELECT p_size AS x, p_retailprice AS y FROM part")
def _(t: Tables):
    return frames.scatter_frame(t.part, "p_size", "p_retailprice")


@query("scatter_frame_sample", "SELECT least(500, count(*)) AS n, true AS known FROM orders")
def _(t: Tables):
    points = frames.scatter_frame(t.orders, "o_custkey", "o_totalprice", max_points=500, key="o_orderkey", seed=7)
    known = t.orders.select(F.col("o_custkey").alias("x"), F.col("o_totalprice").alias("y")).distinct().withColumn("known", F.lit(True))
    return points.join(known, ["x", "y"], "left").agg(F.count("*").alias("n"), F.every("known").alias("known"))


@query("line_frame", "SELECT event_id AS x, value AS y FROM events ORDER BY 1")
def _(t: Tables):
    return frames.line_frame(t.events, "event_id", "value")


@query("line_frame_buckets", """
    WITH e AS (SELECT CAST(epoch_us(min(ts)) AS DOUBLE) AS a, CAST(epoch_us(max(ts)) AS DOUBLE) AS b FROM events)
    SELECT CAST(least(23, floor((CAST(epoch_us(ts) AS DOUBLE) - a) / (b - a) * 24)) AS INTEGER) AS bucket,
           min(value) AS min_y, max(value) AS max_y, round(avg(value), 6) AS avg_y FROM events, e GROUP BY 1""")
def _(t: Tables):
    return rounded(frames.line_frame(t.events, "ts", "value", 24), 6, "avg_y")


@query("box_frame", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(median({c}), 6) AS median,
        round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS max FROM lineitem""" for c in ["l_quantity", "l_extendedprice", "l_tax"]))
def _(t: Tables):
    return rounded(frames.box_frame(t.lineitem, "l_quantity,l_extendedprice,l_tax"))


@query("heatmap_frame", """
    WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem),
    x AS (SELECT i, CASE WHEN i = 0 THEN a - (b - a) * 0.001 ELSE i * ((b - a) / 10) + a END AS lo,
                 CASE WHEN i = 9 THEN b ELSE (i + 1) * ((b - a) / 10) + a END AS hi FROM e, range(10) AS r(i)),
    y AS (SELECT i, CASE WHEN i = 0 THEN c - (d - c) * 0.001 ELSE i * ((d - c) / 10) + c END AS lo,
                 CASE WHEN i = 9 THEN d ELSE (i + 1) * ((d - c) / 10) + c END AS hi FROM e, range(10) AS r(i))
    SELECT CAST(y.i AS INTEGER) AS y_bin, CAST(x.i AS INTEGER) AS x_bin, count(*) AS n
    FROM lineitem JOIN x ON l_quantity > x.lo AND l_quantity <= x.hi JOIN y ON l_extendedprice > y.lo AND l_extendedprice <= y.hi GROUP BY 1, 2""")
def _(t: Tables):
    return frames.heatmap_frame(t.lineitem, "l_quantity", "l_extendedprice")


@query("pair_frame", """
    SELECT 'p_retailprice' AS "row", 'p_size' AS col, least(300, count(*)) AS cells, CAST(NULL AS BIGINT) AS n FROM part
    UNION ALL SELECT 'p_size', 'p_retailprice', least(300, count(*)), NULL FROM part
    UNION ALL SELECT 'p_size', 'p_size', 8, count(*) FROM part UNION ALL SELECT 'p_retailprice', 'p_retailprice', 8, count(*) FROM part""")
def _(t: Tables):
    pairs = frames.pair_frame(t.part, "p_size,p_retailprice", "p_partkey", max_points=300, bins=8)
    return pairs.groupBy("row", "col").agg(F.count("*").alias("cells"), F.sum("n").alias("n"))


def _ratio_sql(cat: str, num: str, table: str) -> str:
    return f"""
    SELECT '{num}' AS a, '{cat}' AS b, 'correlation_ratio' AS kind, round(sqrt(sum(n * (m - mm) * (m - mm)) / any_value(sst)), 5) AS value FROM (
      SELECT count(*) AS n, avg({num}) AS m FROM {table} GROUP BY {cat}),
      (SELECT avg({num}) AS mm, var_pop({num}) * count(*) AS sst FROM {table})"""


def _uncertainty_sql(a: str, b: str, table: str) -> str:
    return f"""
    SELECT '{a}' AS a, '{b}' AS b, 'uncertainty' AS kind, round((hx + hy - hxy) / hx, 5) AS value FROM
      (SELECT -sum(p * ln(p)) AS hx FROM (SELECT count(*) / (SELECT count(*) FROM {table}) AS p FROM {table} GROUP BY {a})),
      (SELECT -sum(p * ln(p)) AS hy FROM (SELECT count(*) / (SELECT count(*) FROM {table}) AS p FROM {table} GROUP BY {b})),
      (SELECT -sum(p * ln(p)) AS hxy FROM (SELECT count(*) / (SELECT count(*) FROM {table}) AS p FROM {table} GROUP BY {a}, {b}))"""


@query("eda_associations", " UNION ALL ".join([
    "SELECT 'p_size' AS a, 'p_retailprice' AS b, 'correlation' AS kind, round(corr(p_size, p_retailprice), 5) AS value FROM part",
    "SELECT 'p_retailprice', 'p_size', 'correlation', round(corr(p_size, p_retailprice), 5) FROM part",
    _ratio_sql("p_brand", "p_size", "part"), _ratio_sql("p_brand", "p_retailprice", "part"),
    _ratio_sql("p_type", "p_size", "part"), _ratio_sql("p_type", "p_retailprice", "part"),
    _uncertainty_sql("p_brand", "p_type", "part"), _uncertainty_sql("p_type", "p_brand", "part")]))
def _(t: Tables):
    return rounded(frames.eda(t.part.drop("p_partkey", "p_name"))["associations"], 5)


@query("eda_profile", profile_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def _(t: Tables):
    return rounded(frames.eda(t.customer)["profile"])


@query("compare_tables", """
    SELECT 'rows' AS section, '*' AS "column", 'count' AS metric, CAST(count(*) AS VARCHAR) AS "before", CAST(count(*) FILTER (p_size > 10) AS VARCHAR) AS "after" FROM part
    UNION ALL SELECT 'schema', 'p_size', 'modified', 'int', 'string' FROM region WHERE r_regionkey = 0
    UNION ALL SELECT 'schema', 'p_new', 'added', NULL, 'int' FROM region WHERE r_regionkey = 0
    UNION ALL SELECT 'schema', 'p_retailprice', 'removed', 'double', NULL FROM region WHERE r_regionkey = 0
    UNION ALL SELECT 'summary', 'p_brand', 'unique', CAST(CAST(count(DISTINCT p_brand) AS DOUBLE) AS VARCHAR),
                     CAST(CAST(count(DISTINCT p_brand) FILTER (p_size > 10) AS DOUBLE) AS VARCHAR) FROM part""")
def _(t: Tables):
    after = t.part.filter("p_size > 10").withColumn("p_size", F.col("p_size").cast("string")).withColumn("p_new", F.lit(1)).drop("p_retailprice")
    shown = frames.compare_tables(after, t.part)
    return shown.filter("section <> 'summary' OR (column = 'p_brand' AND metric = 'unique')")


@query("map_points", f"""
    WITH p AS (SELECT c_custkey, {coordinates_sql('c_custkey')} FROM customer),
    s AS (SELECT * FROM p WHERE lat <> 0 AND lon <> 0 ORDER BY c_custkey LIMIT 1000)
    SELECT *, min(lat) OVER () AS min_lat, max(lat) OVER () AS max_lat, min(lon) OVER () AS min_lon, max(lon) OVER () AS max_lon FROM s""")
def _(t: Tables):
    return frames.map_points(coordinates(t.customer, "c_custkey").select("c_custkey", "lat", "lon"), "lat", "lon", "c_custkey")


@query("view_materialize", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(t: Tables):
    return versions.view_materialize(
        t.views("orders"), "order_summary", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", t.scratch())


@query("run_steps", """
    SELECT p_brand, count(p_size) AS p_size_count, round(avg(p_retailprice), 6) AS p_retailprice_mean FROM part WHERE p_size > 5 GROUP BY 1""")
def _(t: Tables):
    result, status = run_steps(t.part, {"name": "weekly", "steps": [
        {"name": "pad", "op": "regex_replace", "args": {"col": "p_brand", "pattern": "$", "repl": "  "}},
        {"name": "trim", "op": "trim", "args": {"col": "p_brand"}},
        {"name": "bad", "op": "drop_col", "args": {"col": "no_such"}},
        {"name": "large", "op": "filter_rows", "args": {"where": "p_size > 5"}},
        {"name": "sum up", "op": "groupby", "args": {"keys": "p_brand", "agg": "p_size:count,p_retailprice:mean"}},
    ]}, continue_on_error=True)
    assert [s["status"] for s in status] == ["success", "success", "failed", "success", "success"]
    return rounded(result)


