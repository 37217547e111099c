"""Queries over cleaning and geospatial operators."""

from pyspark.sql import functions as F

from quarry.operators import clean, geo
from quarry.plans.registry import Tables, coordinates, coordinates_sql, query, rounded


@query("impute_mode", """
    WITH p AS (SELECT p_partkey, nullif(p_brand, 'Brand#7') AS brand FROM part)
    SELECT p_partkey, coalesce(brand, (SELECT brand FROM p WHERE brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS brand FROM p""")
def _(t: Tables):
    return clean.impute_mode(t.part.select("p_partkey", F.nullif("p_brand", F.lit("Brand#7")).alias("brand")), "brand")


@query("impute_group", """
    WITH p AS (SELECT p_partkey, p_brand, nullif(p_size, 5) AS size FROM part),
    m AS (SELECT p_brand, size AS best FROM p WHERE size IS NOT NULL GROUP BY 1, 2
          QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, size) = 1)
    SELECT p_partkey, p_brand, coalesce(size, best) AS size FROM p LEFT JOIN m USING (p_brand)""")
def _(t: Tables):
    p = t.part.select("p_partkey", "p_brand", F.nullif("p_size", F.lit(5)).alias("size"))
    return clean.impute_group(p, "size", "p_brand", std_max=1000.0)


@query("regex_replace", r"""
    SELECT c_custkey, regexp_replace(c_name, '^Customer#0*(\d+)(\d)$', 'no. \1-\2 ($)') AS c_name FROM customer""")
def _(t: Tables):
    return clean.regex_replace(t.customer.select("c_custkey", "c_name"), "c_name", r"^Customer#0*(\d+)(\d)$", r"no. \1-\2 ($)")


@query("drop_outliers", """
    WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
    SELECT event_id, CASE WHEN abs(value - m) / s <= 1.5 THEN value END AS value FROM events, s""")
def _(t: Tables):
    return clean.drop_outliers(t.events.select("event_id", "value"), "value", 1.5)


@query("drop_outliers_iqr", """
    WITH q AS (SELECT quantile_cont(o_totalprice / o_custkey, 0.25) AS a, quantile_cont(o_totalprice / o_custkey, 0.75) AS b
               FROM orders WHERE o_custkey > 0)
    SELECT o_orderkey, CASE WHEN x >= a - 1.5 * (b - a) AND x <= b + 1.5 * (b - a) THEN floor(x) END AS x
    FROM (SELECT o_orderkey, CASE WHEN o_custkey > 0 THEN o_totalprice / o_custkey END AS x FROM orders), q""")
def _(t: Tables):
    df = t.orders.select("o_orderkey", F.when(F.col("o_custkey") > 0, F.col("o_totalprice") / F.col("o_custkey")).alias("x"))
    return clean.drop_outliers(df, "x", method="iqr").withColumn("x", F.floor("x").cast("double"))


@query("map_values", """
    SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation
    FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""")
def _(t: Tables):
    path = t.scratch(".csv")
    names = t.nation.filter("n_regionkey <> 2").select("n_nationkey", "n_name").orderBy("n_nationkey").coalesce(1)
    names.write.csv(path)
    mapping = clean.read_mapping(t.spark, path)
    return clean.map_values(t.customer.select("c_custkey", F.col("c_nationkey").alias("nation")), "nation", mapping)


@query("trim", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(t: Tables):
    padded = t.customer.select("c_custkey", F.concat(F.lit(" \t "), "c_name", F.lit("  \n")).alias("c_name"),
                               F.concat(F.lit("  "), "c_mktsegment").alias("c_mktsegment"))
    return clean.trim(clean.trim(padded, "c_name"), "c_mktsegment", "left")


_AT = f"SELECT c_custkey, c_nationkey, {coordinates_sql('c_custkey')} FROM customer"
_OFF = (f"SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN lat + 200 ELSE lat END AS lat, "
        f"CASE WHEN c_nationkey = 5 THEN NULL ELSE lon END AS lon FROM ({_AT})")


def _off(t: Tables):
    at = coordinates(t.customer, "c_custkey")
    return at.select("c_custkey", F.when(F.col("c_nationkey") == 3, F.col("lat") + 200).otherwise(F.col("lat")).alias("lat"),
                     F.when(F.col("c_nationkey") != 5, F.col("lon")).alias("lon"))


@query("geo_validate", f"SELECT * FROM ({_OFF}) WHERE abs(lat) > 90 OR abs(lon) > 180")
def _(t: Tables):
    return geo.geo_validate(_off(t), "lat", "lon")


@query("geo_validate_drop", f"SELECT * FROM ({_OFF}) WHERE NOT coalesce(abs(lat) > 90, false) AND NOT coalesce(abs(lon) > 180, false)")
def _(t: Tables):
    return geo.geo_validate(_off(t), "lat", "lon", drop_invalid=True)


@query("geocode", f"""
    SELECT c_custkey, a.lat, a.lon FROM customer LEFT JOIN (
      SELECT 'NATION_' || n_nationkey AS address, {coordinates_sql('n_nationkey')} FROM nation WHERE n_regionkey <> 1) a
    ON address = 'NATION_' || c_nationkey""")
def _(t: Tables):
    lookup = coordinates(t.nation.filter("n_regionkey <> 1"), "n_nationkey").select(F.col("n_name").alias("address"), "lat", "lon")
    df = t.customer.select("c_custkey", F.concat(F.lit("NATION_"), "c_nationkey").alias("addr"))
    return geo.geocode(df, "addr", lookup).drop("addr")


@query("reverse_geocode", f"""
    WITH l AS (SELECT n_name, {coordinates_sql('n_nationkey')} FROM nation),
    c AS (SELECT c_custkey, {coordinates_sql('c_nationkey % 30')} FROM customer)
    SELECT c_custkey, n_name AS address FROM c LEFT JOIN l USING (lat, lon)""")
def _(t: Tables):
    lookup = coordinates(t.nation, "n_nationkey").select(F.col("n_name").alias("address"), "lat", "lon")
    df = coordinates(t.customer, "c_nationkey").select("c_custkey", "lat", "lon")
    return geo.reverse_geocode(df, "lat", "lon", lookup).select("c_custkey", "address")


HAVERSINE = ("2 * 6371.0 * atan2(sqrt({a}), sqrt(greatest(0.0, 1 - ({a}))))").format(
    a="pow(sin((radians({q}) - radians({p})) / 2), 2) + cos(radians({p})) * cos(radians({q})) * pow(sin((radians({s}) - radians({r})) / 2), 2)")


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return HAVERSINE.format(p=lat1, q=lat2, r=lon1, s=lon2)


@query("geo_distance", f"SELECT c_custkey, round({haversine_sql('lat', 'lon', '52.52', '13.405')}, 4) AS distance_km FROM ({_AT})")
def _(t: Tables):
    return rounded(geo.geo_distance(coordinates(t.customer, "c_custkey"), "lat", "lon", 52.52, 13.405), 4, "distance_km").select("c_custkey", "distance_km")


@query("centroid", f"SELECT round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM ({_AT})")
def _(t: Tables):
    return rounded(geo.centroid(coordinates(t.customer, "c_custkey"), "lat", "lon"))


@query("bounds", f"""SELECT round(min(lat) - 0.5, 6) AS min_lat, round(max(lat) + 0.5, 6) AS max_lat, round(min(lon) - 0.5, 6) AS min_lon,
                     round(max(lon) + 0.5, 6) AS max_lon FROM ({_AT})""")
def _(t: Tables):
    return rounded(geo.bounds(coordinates(t.customer, "c_custkey"), "lat", "lon", 0.5))


@query("geo_heatmap", f"""
    WITH p AS ({_AT}), e AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM p),
    y AS (SELECT i, CASE WHEN i = 0 THEN a - (b - a) * 0.001 ELSE i * ((b - a) / 20) + a END AS lo,
                 CASE WHEN i = 19 THEN b ELSE (i + 1) * ((b - a) / 20) + a END AS hi FROM e, range(20) AS r(i)),
    x AS (SELECT i, CASE WHEN i = 0 THEN c - (d - c) * 0.001 ELSE i * ((d - c) / 20) + c END AS lo,
                 CASE WHEN i = 19 THEN d ELSE (i + 1) * ((d - c) / 20) + c END AS hi FROM e, range(20) AS r(i))
    SELECT CAST(y.i AS INTEGER) AS lat_bin, CAST(x.i AS INTEGER) AS lon_bin, count(*) AS n
    FROM p JOIN y ON lat > y.lo AND lat <= y.hi JOIN x ON lon > x.lo AND lon <= x.hi GROUP BY 1, 2""")
def _(t: Tables):
    return geo.geo_heatmap(coordinates(t.customer, "c_custkey"), "lat", "lon")
