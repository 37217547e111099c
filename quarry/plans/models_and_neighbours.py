"""Queries over models, similarity, neighbours, density clusters and rank correlation."""

from pyspark.sql import functions as F

from quarry.operators import density, fuzzy, isolation, kendall, ml, neighbours
from quarry.plans.cleaning_and_geo import haversine_sql
from quarry.plans.registry import Tables, coordinates, coordinates_sql, query, rounded
from quarry.session import write_out


def _flagged(t: Tables):
    return t.part.withColumn("large", (F.col("p_size") > 25).cast("int"))


@query("train_classifier")
def _(t: Tables):
    model, accuracy = ml.train_classifier(_flagged(t), "large", "p_size,p_retailprice,p_type", "p_partkey", n_estimators=20, max_depth=6)
    scored = ml.predict(_flagged(t), model, "guess")
    return scored.groupBy("large", "guess").agg(F.count("*").alias("n")).withColumn("accuracy", F.lit(accuracy))


@query("train_classifier_logistic")
def _(t: Tables):
    items = t.lineitem.withColumn("costly", (F.col("l_extendedprice") > 40000).cast("int"))
    model, accuracy = ml.train_classifier(items, "costly", "l_quantity,l_discount,l_returnflag", "l_orderkey,l_linenumber,l_partkey,l_suppkey", "logistic_regression")
    scored = ml.predict(items, model, "guess", threshold=0.5)
    return scored.groupBy("costly", "guess").agg(F.count("*").alias("n")).withColumn("accuracy", F.lit(accuracy))


_ITEM_KEY = "l_orderkey,l_linenumber,l_partkey,l_suppkey"


@query("train_regressor", "SELECT 'l_quantity' AS feature, round(abs(regr_slope(l_extendedprice, l_quantity)), 4) AS importance FROM lineitem")
def _(t: Tables):
    model, _ = ml.train_regressor(t.lineitem, "l_extendedprice", "l_quantity", _ITEM_KEY, test_size=0.0)
    return rounded(ml.feature_importance(t.spark, model), 4)


@query("train_regressor_ridge", """
    SELECT 'l_quantity' AS feature, round(abs(regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 5000.0)), 3) AS importance FROM lineitem""")
def _(t: Tables):
    model, _ = ml.train_regressor(t.lineitem, "l_extendedprice", "l_quantity", _ITEM_KEY, "ridge", alpha=5000.0, test_size=0.0)
    return rounded(ml.feature_importance(t.spark, model), 3)


@query("train_regressor_forest")
def _(t: Tables):
    model, r2 = ml.train_regressor(t.part, "p_retailprice", "p_partkey,p_size", "p_partkey", "random_forest", n_estimators=10, max_depth=8)
    return ml.feature_importance(t.spark, model).withColumn("r2", F.lit(r2))


@query("predict", """
    SELECT l_orderkey, l_linenumber, round(m.a + m.b * l_quantity, 2) AS price
    FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem) m""")
def _(t: Tables):
    model, _ = ml.train_regressor(t.lineitem, "l_extendedprice", "l_quantity", _ITEM_KEY, test_size=0.0)
    return rounded(ml.predict(t.lineitem, model, "price").select("l_orderkey", "l_linenumber", "price"), 2)


@query("score", """
    WITH c AS (SELECT quality AS y, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2),
    a AS (SELECT y, sum(n) AS support, coalesce(sum(n) FILTER (y = p), 0) AS hit FROM c GROUP BY 1),
    g AS (SELECT p AS y, sum(n) AS guessed FROM c GROUP BY 1),
    k AS (SELECT support, coalesce(hit / guessed, 0) AS pr, hit / support AS re FROM a LEFT JOIN g USING (y)),
    f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM k)
    SELECT 'accuracy' AS metric, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END), 6) AS value FROM labels
    UNION ALL SELECT 'precision', round(sum(pr * support) / sum(support), 6) FROM f
    UNION ALL SELECT 'recall', round(sum(re * support) / sum(support), 6) FROM f
    UNION ALL SELECT 'f1', round(sum(f1 * support) / sum(support), 6) FROM f
    UNION ALL SELECT 'lift', NULL""")
def _(t: Tables):
    return rounded(ml.score(t.labels, "quality", "toxic", "accuracy,precision,recall,f1,lift"))


@query("score_regression", """
    SELECT 'mae' AS metric, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 3) AS value FROM lineitem
    UNION ALL SELECT 'mse', round(avg(pow(l_extendedprice - 1500 * l_quantity, 2)) / 1000, 3) FROM lineitem
    UNION ALL SELECT 'r2', round(1 - avg(pow(l_extendedprice - 1500 * l_quantity, 2)) / var_pop(l_extendedprice), 3) FROM lineitem""")
def _(t: Tables):
    scored = ml.score(t.lineitem.withColumn("guess", F.col("l_quantity") * 1500), "l_extendedprice", "guess", "mae,mse,r2")
    return rounded(scored.withColumn("value", F.when(F.col("metric") == "mse", F.col("value") / 1000).otherwise(F.col("value"))), 3)


@query("feature_importance")
def _(t: Tables):
    model, _ = ml.train_classifier(_flagged(t), "large", "p_size,p_retailprice,p_brand", "p_partkey", n_estimators=10, max_depth=4)
    return ml.feature_importance(t.spark, model, 5)


@query("kmeans", """
    SELECT n_nationkey, CAST(n_regionkey AS INTEGER) AS cluster_id FROM nation""")
def _(t: Tables):
    spread = t.nation.withColumn("x", F.col("n_regionkey") * 1000.0 + F.col("n_nationkey") * 0.1)
    return ml.kmeans(spread, "x", k=5, n_init=4, seed=2).select("n_nationkey", "cluster_id")


@query("kmeans_embeddings")
def _(t: Tables):
    wide = t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    return ml.kmeans(wide, [f"e{i}" for i in range(64)], k=10, n_init=2, max_iter=50).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("isolation_forest")
def _(t: Tables):
    scored = isolation.isolation_forest(t.lineitem, "l_quantity,l_extendedprice,l_discount", _ITEM_KEY, n_estimators=40)
    return rounded(scored.select("l_orderkey", "l_linenumber", "anomaly_score"))


@query("isolation_forest_contamination", """
    SELECT CAST(count(*) AS BIGINT) AS n, true AS about_one_percent FROM customer""")
def _(t: Tables):
    scored = isolation.isolation_forest(t.customer, "c_acctbal,c_nationkey", "c_custkey", n_estimators=20, contamination=0.01)
    return scored.agg(F.count("*").alias("n"), (F.abs(F.avg((F.col("anomaly_score") < 0).cast("int")) - 0.01) < 0.005).alias("about_one_percent"))


# What holds for any seed of the random models above.


@query("train_classifier_invariants", "SELECT large, count(*) AS n, true AS better FROM (SELECT CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS large FROM part) GROUP BY 1")
def _(t: Tables):
    model, accuracy = ml.train_classifier(_flagged(t), "large", "p_size,p_retailprice,p_type", "p_partkey", n_estimators=20, max_depth=6)
    scored = ml.predict(_flagged(t), model, "guess")
    total = scored.agg(F.greatest(F.avg(F.col("large").cast("double")), 1 - F.avg(F.col("large").cast("double"))).alias("majority"))
    return scored.groupBy("large").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("large", "n", (F.lit(accuracy) > F.col("majority") + 0.2).alias("better"))


@query("train_classifier_logistic_invariants", """
    SELECT heavy, count(*) AS n, true AS better FROM (SELECT CASE WHEN l_quantity + 200 * l_discount > 36 THEN 1 ELSE 0 END AS heavy FROM lineitem) GROUP BY 1""")
def _(t: Tables):
    # the target follows from two of the features, so any seed learns it far better than the majority's guess
    items = t.lineitem.withColumn("heavy", (F.col("l_quantity") + 200 * F.col("l_discount") > 36).cast("int"))
    model, accuracy = ml.train_classifier(items, "heavy", "l_quantity,l_discount,l_returnflag", "l_orderkey,l_linenumber,l_partkey,l_suppkey", "logistic_regression")
    scored = ml.predict(items, model, "guess", threshold=0.5)
    share = F.avg(F.col("heavy").cast("double"))
    total = scored.agg(F.greatest(share, 1 - share).alias("majority"), F.avg((F.col("guess") == F.col("heavy")).cast("double")).alias("right"))
    better = (F.lit(accuracy) > F.col("majority") + 0.2) & (F.col("right") > F.col("majority") + 0.2)
    return scored.groupBy("heavy").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("heavy", "n", better.alias("better"))


@query("train_regressor_forest_invariants", "SELECT feature, CAST(1 AS DOUBLE) AS total FROM (VALUES ('p_partkey'), ('p_size')) f(feature)")
def _(t: Tables):
    model, _ = ml.train_regressor(t.part, "p_retailprice", "p_partkey,p_size", "p_partkey", "random_forest", n_estimators=10, max_depth=8)
    shares = ml.feature_importance(t.spark, model)
    total = shares.agg(F.round(F.sum("importance"), 6).alias("total"))
    return shares.select("feature").join(F.broadcast(total))


@query("kmeans_embeddings_invariants", "SELECT count(*) AS n, CAST(10 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS without FROM embeddings")
def _(t: Tables):
    wide = t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    found = ml.kmeans(wide, [f"e{i}" for i in range(64)], k=10, n_init=2, max_iter=20)
    return found.agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("clusters"), F.count_if(F.col("cluster_id").isNull()).alias("without"))


@query("isolation_forest_planted", "SELECT CAST(-i AS BIGINT) AS l_orderkey FROM range(1, 4) r(i)")
def _(t: Tables):
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    odd = t.spark.range(1, 4).select((-F.col("id")).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"),
                                     (F.col("id") * 5000.0).alias("l_quantity"), (F.col("id") * -9e6).alias("l_extendedprice"), (F.col("id") * 40.0).alias("l_discount"))
    # trees on a few hundred rows seldom see a planted one: these see all rows
    scored = isolation.isolation_forest(items.unionByName(odd), "l_quantity,l_extendedprice,l_discount", _ITEM_KEY, n_estimators=40, max_samples=1.0, max_depth=8)
    return scored.orderBy("anomaly_score", "l_orderkey").limit(3).select("l_orderkey")


@query("train_test_split", """
    SELECT CAST(floor(0.75 * count(*)) AS BIGINT) AS train, CAST(count(*) - floor(0.75 * count(*)) AS BIGINT) AS test, CAST(0 AS BIGINT) AS shared FROM orders""")
def _(t: Tables):
    train, test = ml.train_test_split(t.orders, "o_orderkey", 0.75, seed=4)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    per_key = both.groupBy("o_orderkey").agg(F.count_if(F.col("part") == "train").alias("a"), F.count_if(F.col("part") == "test").alias("b"))
    return per_key.agg(F.sum("a").alias("train"), F.sum("b").alias("test"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"))


@query("train_test_split_stratified", """
    WITH s AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
    q AS (SELECT *, CAST(floor(n * 0.7) AS BIGINT) AS base, row_number() OVER (ORDER BY -(n * 0.7 - floor(n * 0.7)), o_orderpriority) AS place FROM s),
    x AS (SELECT CAST(floor(0.7 * sum(n)) AS BIGINT) - sum(base) AS extra FROM q)
    SELECT o_orderpriority, base + CASE WHEN place <= extra THEN 1 ELSE 0 END AS train FROM q, x""")
def _(t: Tables):
    train, _ = ml.train_test_split(t.orders, "o_orderkey", 0.7, stratify="o_orderpriority")
    return train.groupBy("o_orderpriority").agg(F.count("*").alias("train"))


@query("save_load_model", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS changed FROM part")
def _(t: Tables):
    model, _ = ml.train_classifier(_flagged(t), "large", "p_size,p_type", "p_partkey", n_estimators=5, max_depth=4)
    path = t.scratch()
    ml.save_model(model, path)
    again = ml.predict(ml.predict(_flagged(t), model, "a"), ml.load_model(t.spark, path), "b")
    return again.agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


def _words_sql(order: str) -> str:
    """Greedy clusters of part names in SQL: bit-parallel common subsequences, then one step per name."""
    return f"""
    WITH RECURSIVE v AS (SELECT p_name AS w, row_number() OVER (ORDER BY {order}, p_name) - 1 AS id FROM part GROUP BY 1),
    m AS (SELECT a.id AS i, b.id AS j, length(a.w) AS la, length(b.w) AS lb, list_reduce(list_prepend((CAST(1 AS BIGINT) << length(a.w)) - 1,
            list_transform(string_split(b.w, ''), lambda c: CAST(list_sum(list_transform(range(length(a.w)), lambda k:
              CASE WHEN substr(a.w, k + 1, 1) = c THEN CAST(1 AS BIGINT) << k ELSE 0 END)) AS BIGINT))),
            lambda s, x: ((s + (s & x)) | (s - (s & x))) & ((CAST(1 AS BIGINT) << length(a.w)) - 1)) AS state
          FROM v a JOIN v b ON a.id <> b.id),
    e AS MATERIALIZED (SELECT i, j, 100 * (1 - (la + lb - 2 * (la - bit_count(state))) / (la + lb)) AS score FROM m WHERE 100 * (1 - (la + lb - 2 * (la - bit_count(state))) / (la + lb)) >= 75),
    n AS MATERIALIZED (SELECT v.id, coalesce(list(j) FILTER (j < v.id), []) AS smaller FROM v LEFT JOIN e ON e.i = v.id GROUP BY 1),
    g AS (SELECT CAST(-1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS heads UNION ALL
          SELECT pos + 1, CASE WHEN list_has_any(heads, smaller) THEN heads ELSE list_append(heads, n.id) END FROM g JOIN n ON n.id = pos + 1),
    h AS (SELECT heads FROM g ORDER BY pos DESC LIMIT 1),
    c AS (SELECT v.id, v.w, CASE WHEN list_contains(heads, v.id) THEN v.id ELSE (SELECT min(j) FROM e WHERE e.i = v.id AND list_contains(heads, j)) END AS head FROM v, h)
    """


@query("harmonize", _words_sql("count(*) DESC") + "SELECT p_partkey, v.w AS p_name FROM part JOIN c ON c.w = p_name JOIN v ON v.id = c.head")
def _(t: Tables):
    return fuzzy.harmonize(t.part.select("p_partkey", "p_name"), "p_name", 75)


@query("fuzzy_clusters", _words_sql("min(p_partkey)") + """
    SELECT v.w AS cluster, c.w AS value, CASE WHEN c.id = c.head THEN 100.0 ELSE round(score, 6) END AS score
    FROM c JOIN v ON v.id = c.head LEFT JOIN e ON e.i = c.id AND e.j = c.head
    WHERE c.head IN (SELECT head FROM c GROUP BY 1 HAVING count(*) > 1)""")
def _(t: Tables):
    return rounded(fuzzy.fuzzy_clusters(t.part, "p_name", 75, "p_partkey"))


@query("merge_clusters", """
    SELECT p_partkey, CASE p_name WHEN 'red bolt' THEN 'red rod' WHEN 'old bolt' THEN 'cold bolt' ELSE p_name END AS p_name FROM part""")
def _(t: Tables):
    return fuzzy.merge_clusters(t.part.select("p_partkey", "p_name"), "p_name", {"red bolt": "red rod", "old bolt": "cold bolt"})


@query("fuzzy_clusters_names", """
    WITH RECURSIVE v AS (SELECT c_name AS w, row_number() OVER (ORDER BY min(c_custkey), c_name) - 1 AS id FROM customer GROUP BY 1),
    less AS (SELECT DISTINCT id, substr(w, 1, CAST(k AS INTEGER)) || substr(w, CAST(k AS INTEGER) + 2) AS rest FROM v, range(18) r(k)),
    e AS MATERIALIZED (SELECT DISTINCT a.id AS i, b.id AS j FROM less a JOIN less b ON a.rest = b.rest AND a.id <> b.id),
    n AS MATERIALIZED (SELECT v.id, coalesce(list(j) FILTER (j < v.id), []) AS smaller FROM v LEFT JOIN e ON e.i = v.id GROUP BY 1),
    g AS (SELECT CAST(-1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS heads UNION ALL
          SELECT pos + 1, CASE WHEN list_has_any(heads, smaller) THEN heads ELSE list_append(heads, n.id) END FROM g JOIN n ON n.id = pos + 1),
    h AS (SELECT unnest(heads) AS head FROM (SELECT heads FROM g ORDER BY pos DESC LIMIT 1)),
    c AS (SELECT id, coalesce(h.head, (SELECT min(j) FROM e JOIN h ON h.head = j WHERE e.i = v.id)) AS head FROM v LEFT JOIN h ON h.head = v.id)
    SELECT v.w AS cluster, count(*) AS members FROM c JOIN v ON v.id = c.head GROUP BY 1 HAVING count(*) > 1""")
def _(t: Tables):
    found = fuzzy.fuzzy_clusters(t.customer, "c_name", 94, "c_custkey")
    return found.groupBy("cluster").agg(F.count("*").alias("members"))


_TAU = ["c_nationkey", "c_acctbal", "c_custkey"]


@query("corr_kendall", """
    WITH c AS (SELECT c_nationkey, nullif(trunc(c_acctbal / 100), 7) AS c_acctbal, c_custkey FROM customer)
    """ + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{a}' AS b, 1.0 AS corr, count({a}) AS n FROM c" if a == b else f"""
    SELECT '{a}' AS a, '{b}' AS b, round(sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) / sqrt(sum(abs(sign(p.{a} - q.{a})))) / sqrt(sum(abs(sign(p.{b} - q.{b})))), 9) AS corr,
           (SELECT count(*) FROM c WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n
    FROM c p, c q WHERE p.{a} IS NOT NULL AND p.{b} IS NOT NULL AND q.{a} IS NOT NULL AND q.{b} IS NOT NULL""" for a in _TAU for b in _TAU))
def _(t: Tables):
    whole = F.col("c_acctbal") / 100
    truncated = F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)).cast("double")
    c = t.customer.select("c_nationkey", F.nullif(truncated, F.lit(7.0)).alias("c_acctbal"), "c_custkey")
    return rounded(kendall.corr_kendall(c), 9)


def _density_sql(source: str, near: str, least: int) -> str:
    return f"""
    WITH RECURSIVE p AS ({source}),
    nb AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM p a, p b WHERE {near}),
    core AS (SELECT a AS k FROM nb GROUP BY 1 HAVING count(*) >= {least}),
    e AS MATERIALIZED (SELECT a, b FROM nb WHERE a IN (FROM core) AND b IN (FROM core)),
    r AS (SELECT k, k AS root FROM core UNION SELECT e.b, r.root FROM r JOIN e ON r.k = e.a WHERE r.root < e.b),
    top AS (SELECT k, min(root) AS root FROM r GROUP BY 1),
    lab AS (SELECT k, dense_rank() OVER (ORDER BY root) - 1 AS label FROM top),
    border AS (SELECT nb.a AS k, min(label) AS label FROM nb JOIN lab ON lab.k = nb.b WHERE nb.a NOT IN (FROM core) GROUP BY 1)
    SELECT p.k AS c_custkey, coalesce(lab.label, border.label, -1) AS cluster_id FROM p LEFT JOIN lab ON lab.k = p.k LEFT JOIN border ON border.k = p.k"""


@query("dbscan", _density_sql("SELECT c_custkey AS k, c_nationkey * 2.0 AS lat, c_acctbal / 100 AS lon FROM customer",
                              "sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) <= 0.80005", 4))
def _(t: Tables):
    at = t.customer.select("c_custkey", (F.col("c_nationkey") * 2.0).alias("lat"), (F.col("c_acctbal") / 100).alias("lon"))
    return density.dbscan(at, "lat", "lon", 0.80005, 4, key="c_custkey").select("c_custkey", "cluster_id")


@query("dbscan_haversine", _density_sql(f"SELECT c_custkey AS k, {coordinates_sql('c_custkey')} FROM customer",
                                        haversine_sql("a.lat", "a.lon", "b.lat", "b.lon") + " <= 400.0", 4))
def _(t: Tables):
    return density.dbscan(coordinates(t.customer, "c_custkey"), "lat", "lon", 400.0, 4, "haversine", "c_custkey").select("c_custkey", "cluster_id")


@query("dbscan_sizes", "SELECT cluster_id, count(*) AS count FROM (" + _density_sql(
    "SELECT c_custkey AS k, c_nationkey * 2.0 AS lat, c_acctbal / 100 AS lon FROM customer",
    "sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) <= 0.80005", 4) + ") GROUP BY 1")
def _(t: Tables):
    at = t.customer.select("c_custkey", (F.col("c_nationkey") * 2.0).alias("lat"), (F.col("c_acctbal") / 100).alias("lon"))
    return density.cluster_sizes(density.dbscan(at, "lat", "lon", 0.80005, 4, key="c_custkey"))


_NEAR = f"""
    WITH c AS (SELECT c_custkey, {coordinates_sql('c_custkey')} FROM customer), s AS (SELECT s_suppkey, {coordinates_sql('s_suppkey + 100000')} FROM supplier),
    d AS (SELECT c_custkey, s_suppkey, {haversine_sql('c.lat', 'c.lon', 's.lat', 's.lon')} AS km FROM c, s),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS rn FROM d)"""


def _places(t: Tables):
    moved = t.supplier.withColumn("k", F.col("s_suppkey") + 100000)
    return coordinates(t.customer, "c_custkey"), coordinates(moved, "k").select(F.col("s_suppkey").alias("id"), "lat", "lon")


@query("nearest", _NEAR + " SELECT c_custkey, s_suppkey AS nearest_poi_id, round(km, 4) AS nearest_poi_dist_km FROM r WHERE rn = 1")
def _(t: Tables):
    people, places = _places(t)
    return rounded(neighbours.nearest(people, "lat", "lon", places).select("c_custkey", "nearest_poi_id", "nearest_poi_dist_km"), 4)


@query("nearest_k", _NEAR + """
    SELECT c_custkey, string_agg(s_suppkey, ',' ORDER BY rn) AS ids, round(max(km), 4) AS farthest FROM r WHERE rn <= 3 GROUP BY 1""")
def _(t: Tables):
    people, places = _places(t)
    near = neighbours.nearest(people, "lat", "lon", places, k=3)
    return rounded(near.select("c_custkey", F.array_join("nearest_poi_id", ",").alias("ids"), F.array_max("nearest_poi_dist_km").alias("farthest")), 4)


@query("nearest_large", _NEAR + """
    SELECT c_custkey, string_agg(s_suppkey, ',' ORDER BY rn) AS ids, round(max(km), 4) AS farthest FROM r WHERE rn <= 2 GROUP BY 1""")
def _(t: Tables):
    people, places = _places(t)  # the way for places too many to broadcast
    near = neighbours.nearest(people, "lat", "lon", places, k=2, leaf_points=16)
    return rounded(near.select("c_custkey", F.array_join("nearest_poi_id", ",").alias("ids"), F.array_max("nearest_poi_dist_km").alias("farthest")), 4)


_IMPUTE = """
    WITH p AS (SELECT p_partkey AS k, CAST(CASE WHEN p_brand <> 'Brand#7' THEN p_size END AS DOUBLE) AS s, CAST(p_partkey AS DOUBLE) / 10 AS x,
                      CASE WHEN p_type <> 'PROMO' THEN p_retailprice END AS price FROM part),
    d AS (SELECT q.k, o.k AS donor, o.price, CASE WHEN q.s IS NOT NULL AND o.s IS NOT NULL
                 THEN sqrt(((q.s - o.s) * (q.s - o.s) + (q.x - o.x) * (q.x - o.x)) / 2 * 3) ELSE sqrt((q.x - o.x) * (q.x - o.x) / 1 * 3) END AS far
          FROM p q, p o WHERE q.price IS NULL AND o.price IS NOT NULL),
    n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY far, donor) <= 5)"""


def _gappy(t: Tables):
    return t.part.select(F.col("p_partkey").alias("k"), F.when(F.col("p_brand") != "Brand#7", F.col("p_size")).cast("double").alias("s"),
                         (F.col("p_partkey").cast("double") / 10).alias("x"), F.when(F.col("p_type") != "PROMO", F.col("p_retailprice")).alias("price"))


@query("knn_impute", _IMPUTE + " SELECT p.k, round(coalesce(p.price, g.price), 5) AS price FROM p LEFT JOIN (SELECT k, avg(price) AS price FROM n GROUP BY 1) g USING (k)")
def _(t: Tables):
    return rounded(neighbours.knn_impute(_gappy(t), "price", "k", features=["s", "x"]).select("k", "price"), 5)


@query("knn_impute_distance", _IMPUTE + """
    SELECT p.k, round(coalesce(p.price, g.price), 5) AS price FROM p LEFT JOIN (
      SELECT k, CASE WHEN min(far) = 0 THEN avg(price) FILTER (far = 0) ELSE sum(price / nullif(far, 0)) / sum(1 / nullif(far, 0)) END AS price FROM n GROUP BY 1) g USING (k)""")
def _(t: Tables):
    return rounded(neighbours.knn_impute(_gappy(t), "price", "k", weights="distance", features=["s", "x"]).select("k", "price"), 5)


_FEATURES = {"s": ("p_brand <> 'Brand#7'", "p_size"), "x": ("p_partkey % 5 <> 0", "p_partkey / 10.0"), "y": ("p_partkey % 3 <> 1", "p_partkey * 7919 % 1000"), "w": ("p_type <> 'ECONOMY'", "length(p_name) * 3")}
_KNOWN = ", ".join(f"CAST(CASE WHEN {test} THEN {value} END AS DOUBLE) AS {c}" for c, (test, value) in _FEATURES.items())
_PART = f"SELECT p_partkey AS k, {_KNOWN}, CASE WHEN p_type <> 'PROMO' THEN p_retailprice END AS price FROM part"
_SUM = " + ".join(f"coalesce((q.{c} - o.{c}) * (q.{c} - o.{c}), 0.0)" for c in _FEATURES)
_BOTH = " + ".join(f"CASE WHEN q.{c} IS NOT NULL AND o.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in _FEATURES)


@query("knn_impute_gaps", f"""
    WITH p AS ({_PART}),
    d AS (SELECT q.k, o.k AS donor, o.price, {_SUM} AS total, {_BOTH} AS shared FROM p q, p o WHERE q.price IS NULL AND o.price IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sqrt(total / shared * 5), donor) AS place FROM d WHERE shared > 0)
    SELECT p.k, round(coalesce(p.price, g.price, (SELECT avg(price) FROM p)), 5) AS price
    FROM p LEFT JOIN (SELECT k, avg(price) AS price FROM n WHERE place <= 5 GROUP BY 1) g USING (k)""")
def _(t: Tables):
    rows = t.views("part").sql(_PART)
    return rounded(neighbours.knn_impute(rows, "price", "k", features=list(_FEATURES), broadcast_cells=0, leaf_points=100).select("k", "price"), 5)


_NAMES = "SELECT DISTINCT p_type || ' ' || p_name AS w FROM part"
_TYPED = "SELECT p_partkey, upper(p_name) || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS w FROM part WHERE p_size < 9"
_LISTED = "SELECT DISTINCT upper(p_name) AS w FROM part WHERE p_size > 40"


def _scores_sql(pairs: str) -> str:
    """(value, other, score) of pairs (a.w, b.w) by bit-parallel common subsequences."""
    return f"""
    m AS (SELECT a.w AS value, b.w AS other, length(a.w) AS la, length(b.w) AS lb, list_reduce(list_prepend((CAST(1 AS BIGINT) << length(a.w)) - 1,
            list_transform(string_split(b.w, ''), lambda c: CAST(list_sum(list_transform(range(length(a.w)), lambda k:
              CASE WHEN substr(a.w, k + 1, 1) = c THEN CAST(1 AS BIGINT) << k ELSE 0 END)) AS BIGINT))),
            lambda s, x: ((s + (s & x)) | (s - (s & x))) & ((CAST(1 AS BIGINT) << length(a.w)) - 1)) AS state FROM {pairs}),
    e AS (SELECT value, other, 100 * (1 - (la + lb - 2 * (la - bit_count(state))) / (la + lb)) AS score FROM m)"""


@query("fuzzy_pairs", f"WITH v AS ({_NAMES}), {_scores_sql('v a JOIN v b ON a.w < b.w')} SELECT value, other, round(score, 6) AS score FROM e WHERE score >= 80")
def _(t: Tables):
    return rounded(fuzzy.fuzzy_pairs(t.views("part").sql(_NAMES), "w", 80))


@query("fuzzy_join", f"""
    WITH typed AS ({_TYPED}), listed AS ({_LISTED}), {_scores_sql('(SELECT DISTINCT w FROM typed) a, listed b')}
    SELECT p_partkey, other AS w_right, round(score, 6) AS score FROM typed JOIN e ON typed.w = value WHERE score >= 86""")
def _(t: Tables):
    spark = t.views("part")
    return rounded(fuzzy.fuzzy_join(spark.sql(_TYPED), spark.sql(_LISTED), "w", "w", 86).select("p_partkey", "w_right", "score"))
