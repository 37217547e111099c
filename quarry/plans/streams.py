"""Queries that run operators on the events table as a stream of files."""

from pyspark.sql import functions as F

from quarry.operators import clean, columns_ops, integrity, rows, versions
from quarry.plans.registry import Tables, query, rounded
from quarry.streaming import streams


def _events(t: Tables):
    return streams.file_stream(t.spark, t.folder, t.events.schema, "events.parquet")


@query("stream_steps", """
    SELECT event_id, 'evt:' || event_type AS event_type, value, CASE WHEN value > 20 THEN 'value:max' ELSE '' END AS broken
    FROM events WHERE event_type <> 'view' AND value > 1""")
def _(t: Tables):
    path = t.scratch()

    def steps(df):
        df = rows.filter_rows(df, "event_type != 'view' and value > 1")
        df = clean.trim(clean.regex_replace(df, "event_type", "^(.*)$", r"  evt:\1 "), "event_type")
        flagged = columns_ops.rule_flags(df, {"value": {"max": 20}})
        return flagged.select("event_id", "event_type", "value", F.array_join("broken_rules", ",").alias("broken"))

    streams.write_stream(_events(t), path, t.scratch(), steps).awaitTermination()
    return t.spark.read.parquet(path)


@query("stream_groupby", """
    WITH w AS (SELECT date_trunc('hour', ts) AS h, event_type, value FROM events)
    SELECT strftime(h, '%Y-%m-%d %H') AS hour, event_type, round(sum(value), 4) AS value_sum, count(value) AS value_count
    FROM w WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def _(t: Tables):
    path = t.scratch()
    streams.write_stream(_events(t), path, t.scratch(), lambda df: streams.windowed_groupby(
        df, "ts", "1 hour", "event_type", "value:sum,value:count")).awaitTermination()
    done = t.spark.read.parquet(path)
    return rounded(done.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "value_sum", "value_count"), 4)


@query("stream_drift", """SELECT unnest(['event_id', 'user_id', 'value']) AS "column", 'OK' AS result""")
def _(t: Tables):
    path = t.scratch()
    streams.drift_per_batch(_events(t), t.events, path, t.scratch()).awaitTermination()
    return t.spark.read.parquet(path).select("column", "result")


@query("stream_operators", """
    SELECT event_id, substr('***' || substr(upper(event_type), 4), 1, length(event_type)) AS kind, CAST(value AS VARCHAR) AS value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
           value BETWEEN 0 AND 90 AS valid
    FROM events WHERE (event_type LIKE '%c%' OR event_type LIKE '%error%') AND event_type <> 'view'""")
def _(t: Tables):
    path = t.scratch()
    schema = columns_ops.json_schema(t.events, "props")

    def steps(df):
        df = columns_ops.flatten_json(df, "props", prefix="", schema=schema)
        df = rows.search(rows.filter_rows(df, "event_type != 'view'"), "c|error", regex=True)
        df = clean.map_values(df, "event_type", {x: x.upper() for x in ("click", "error", "purchase", "signup", "view", "scroll", "search")})
        df = columns_ops.rename_col(integrity.anonymize(df, "event_type", "mask", 3), "event_type", "kind")
        df = df.withColumn("valid", F.col("value").between(0, 90))
        return columns_ops.cast_col(df, "value", "text").select("event_id", "kind", "value", "k", "valid")

    streams.write_stream(_events(t), path, t.scratch(), steps).awaitTermination()
    return t.spark.read.parquet(path)


@query("stream_restart", "SELECT event_id, value FROM events WHERE value > 10")
def _(t: Tables):
    """A stream stopped after half of its files goes on from its checkpoint: every row once."""
    source, path, checkpoint = t.scratch(), t.scratch(), t.scratch()
    keep = lambda df: rows.filter_rows(df, "value > 10").select("event_id", "value")
    for part in range(2):
        t.events.filter(F.pmod("event_id", F.lit(2)) == part).repartition(2).write.mode("append").parquet(source)
        streams.write_stream(streams.file_stream(t.spark, source, t.events.schema), path, checkpoint, keep).awaitTermination()
    return t.spark.read.parquet(path)


@query("stream_lookup", """
    SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN '-first' ELSE '-second' END AS label FROM events""")
def _(t: Tables):
    """Events joined with a table that is replaced between two batches."""
    source, path, checkpoint, root = t.scratch(), t.scratch(), t.scratch(), t.scratch()
    kinds = t.events.select("event_type").distinct()
    for part, mark in enumerate(("first", "second")):
        versions.audited_write(kinds.withColumn("label", F.concat("event_type", F.lit(f"-{mark}"))), root, "labels", mark)
        t.events.filter(F.pmod("event_id", F.lit(2)) == part).coalesce(1).write.mode("append").parquet(source)
        streams.with_lookup(streams.file_stream(t.spark, source, t.events.schema), path, checkpoint, lambda: versions.read_current(t.spark, root, "labels"),
                            lambda batch, labels: batch.join(labels, "event_type").select("event_id", "label")).awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "label")


@query("stream_first_seen", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def _(t: Tables):
    path = t.scratch()
    streams.write_stream(_events(t), path, t.scratch(), lambda df: streams.first_seen(df, "user_id,event_type", "ts", "3650 days").select("user_id", "event_type")).awaitTermination()
    return t.spark.read.parquet(path).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_bursts", """
    WITH m AS (SELECT user_id, floor(epoch_us(ts) / 1000) AS ms FROM events),
    e AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) <= 3600000 THEN 0 ELSE 1 END AS opens FROM m),
    r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS run FROM e),
    b AS (SELECT user_id, min(ms) AS a, max(ms) AS z, count(*) AS n FROM r GROUP BY user_id, run),
    w AS (SELECT floor(epoch_us(max(ts)) / 1000) - 600000 AS mark FROM events)
    SELECT user_id, CAST(a AS BIGINT) AS started, CAST(z AS BIGINT) AS ended, n FROM b, w WHERE z + 3600000 < mark""")
def _(t: Tables):
    path = t.scratch()
    streams.write_stream(_events(t), path, t.scratch(), lambda df: streams.bursts(df, "user_id", "ts", 3600, "10 minutes")).awaitTermination()
    done = t.spark.read.parquet(path)
    return done.select(F.col("key").alias("user_id"), F.unix_millis("started").alias("started"), F.unix_millis("ended").alias("ended"), "n")
