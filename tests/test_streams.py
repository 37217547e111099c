"""Streams over several files give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import clean, columns_ops, geo, integrity, ml, rows, versions
from quarry.sources import tables
from quarry.streaming import streams

FOLDER = "/root/testdata/sf0.001"


def test_stateless_operators(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(4).write.parquet(source)

    def steps(df):
        df = rows.filter_rows(df, "value > 5 and event_type in ['click', 'error']")
        df = columns_ops.cast_col(clean.trim(df, "event_type"), "user_id", "text")
        df = geo.geo_distance(df.withColumn("lat", F.col("value")).withColumn("lon", F.col("value")), "lat", "lon", 1.0, 2.0)
        return integrity.anonymize(columns_ops.flatten_json(df, "props", schema=columns_ops.json_schema(events, "props")), "event_type", "mask", 2)

    out = str(tmp_path / "out")
    streams.write_stream(streams.file_stream(spark, source, events.schema), out, str(tmp_path / "cp"), steps).awaitTermination()
    got, want = spark.read.parquet(out), steps(events)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_drift_per_batch(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.withColumn("value", F.col("value") + 100).coalesce(1).write.parquet(source)
    streams.drift_per_batch(streams.file_stream(spark, source, events.schema), events, out, str(tmp_path / "cp")).awaitTermination()
    assert {r["column"]: r["result"] for r in spark.read.parquet(out).collect()}["value"] == "DRIFT"


def _folder_of(spark, tmp_path, parts=4):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events = (events.withColumn("lat", (F.col("event_id") % 181 - 90).cast("double")).withColumn("lon", (F.col("event_id") % 361 - 180).cast("double"))
              .withColumn("event_type", F.when(F.col("event_id") % 9 != 0, F.col("event_type"))).withColumn("mail", F.concat("event_id", F.lit("@mail.org"))))
    source = str(tmp_path / "in")
    events.repartition(parts).write.parquet(source)
    return source, spark.read.parquet(source)


def _same(got, want):
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


STATELESS = {
    "rename_col": lambda df, x: columns_ops.rename_col(df, "value", "amount"),
    "drop_col": lambda df, x: columns_ops.drop_col(df, "props"),
    "cast_col": lambda df, x: columns_ops.cast_col(df, "mail", "integer", "nullify"),
    "flatten_json": lambda df, x: columns_ops.flatten_json(df, "props", schema=x["schema"]),
    "search": lambda df, x: rows.search(df, "CLICK"),
    "find_nulls": lambda df, x: rows.find_nulls(df, "event_type"),
    "map_values": lambda df, x: clean.map_values(df, "event_type", {"click": "Click", "view": "View"}),
    "geo_validate": lambda df, x: geo.geo_validate(df.withColumn("lat", F.col("lat") * 2), "lat", "lon"),
    "geocode": lambda df, x: geo.geocode(df, "event_type", x["places"]),
    "reverse_geocode": lambda df, x: geo.reverse_geocode(df, "lat", "lon", x["points"]),
    "geo_distance": lambda df, x: geo.geo_distance(df, "lat", "lon", 10.0, 20.0),
    "predict": lambda df, x: ml.predict(df, x["model"], "guess", threshold=0.5).select("event_id", "guess"),
    "decrypt_col": lambda df, x: integrity.decrypt_col(integrity.encrypt_col(df, "mail", "0123456789abcdef"), "mail", "0123456789abcdef"),
    "anonymize": lambda df, x: integrity.anonymize(df, "mail", "hash"),
    "scan_pii": lambda df, x: integrity.scan_pii(df, "event_id"),
    "export_geojson": lambda df, x: tables.geojson_features(df, "lat", "lon", "event_id", ["event_type"]) if hasattr(tables, "geojson_features") else df,
}


@pytest.fixture(scope="module")
def help_tables(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    model, _ = ml.train_classifier(events.withColumn("large", (F.col("value") > 30).cast("int")), "large", "value,user_id", "event_id", "logistic_regression")
    return {"schema": columns_ops.json_schema(events, "props"), "model": model,
            "places": spark.createDataFrame([("click", 1.0, 2.0), ("view", 3.0, 4.0)], "address string, lat double, lon double"),
            "points": spark.createDataFrame([("here", -90.0, -180.0), ("there", -80.0, -170.0)], "address string, lat double, lon double")}


def test_every_stateless_operator_on_a_stream_equals_the_batch(spark, tmp_path, help_tables):
    """One stream over four files for each operator; they run side by side."""
    source, batch = _folder_of(spark, tmp_path)
    running = {name: streams.write_stream(streams.file_stream(spark, source, batch.schema), str(tmp_path / name), str(tmp_path / f"{name}-cp"), lambda df, f=f: f(df, help_tables))
               for name, f in STATELESS.items()}
    for name, query in running.items():
        query.awaitTermination()
        _same(spark.read.parquet(str(tmp_path / name)), STATELESS[name](batch, help_tables))


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in range(3):
        events.filter(F.pmod("event_id", F.lit(3)) == part).repartition(2).write.mode("append").parquet(source)
        streams.write_stream(streams.file_stream(spark, source, events.schema), out, cp, lambda df: rows.search(df, "i")).awaitTermination()
    streams.write_stream(streams.file_stream(spark, source, events.schema), out, cp, lambda df: rows.search(df, "i")).awaitTermination()  # nothing new
    _same(spark.read.parquet(out), rows.search(events, "i"))


def test_a_replaced_lookup_takes_effect_with_the_next_batch(spark, tmp_path):
    root, source, out, cp = (str(tmp_path / x) for x in ("root", "in", "out", "cp"))
    for turn, label in enumerate(("old", "new")):
        versions.audited_write(spark.createDataFrame([(1, label)], "k int, label string"), root, "labels", "load")
        spark.createDataFrame([(1, turn)], "k int, turn int").write.mode("append").parquet(source)
        streams.with_lookup(streams.file_stream(spark, source, spark.read.parquet(source).schema), out, cp, lambda: versions.read_current(spark, root, "labels"),
                            lambda batch, labels: batch.join(labels, "k", "left")).awaitTermination()
    found = sorted((r["turn"], r["label"], r["batch_id"]) for r in spark.read.parquet(out).collect())
    assert [f[:2] for f in found] == [(0, "old"), (1, "new")] and found[0][2] < found[1][2]


def test_keyed_state_joins_runs_and_expires(spark, tmp_path):
    """Rows in any order over several files, a restart in between: every run once, and only when it is over."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    files = [[("a", 0), ("b", 3), ("a", 20)], [("a", 10), ("b", 200)], [("a", 300), (None, 301), ("c", 302)], [("z", 900)], [("z", 2000)]]
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    run = lambda: streams.write_stream(streams.file_stream(spark, source, spark.read.parquet(source).schema), out, cp,
                                       lambda df: streams.bursts(df, "k", "t", 600, "60 minutes")).awaitTermination()
    for i, rows_ in enumerate(files):
        spark.createDataFrame([(k, at(m)) for k, m in rows_], "k string, t timestamp").coalesce(1).write.mode("append").parquet(source)
        if i in (2, 4):
            run()
    minutes = lambda x: round((x - start).total_seconds() / 60)
    found = sorted((r["key"], minutes(r["started"]), minutes(r["ended"]), r["n"]) for r in spark.read.parquet(out).collect())
    assert found == [("a", 0, 20, 3), ("a", 300, 300, 1), ("b", 3, 3, 1), ("b", 200, 200, 1), ("c", 302, 302, 1), ("z", 900, 900, 1)]


def test_first_seen_forgets(spark, tmp_path):
    source, batch = _folder_of(spark, tmp_path, 3)
    out = str(tmp_path / "out")
    streams.write_stream(streams.file_stream(spark, source, batch.schema), out, str(tmp_path / "cp"), lambda df: streams.first_seen(df, "user_id", "ts", "3650 days").select("user_id")).awaitTermination()
    _same(spark.read.parquet(out), batch.select("user_id").distinct())
