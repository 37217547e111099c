"""Nulls, ties, empty and one-row inputs, errors, and independence from partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions.columns import as_number
from quarry.operators import clean, columns_ops, frames, geo, integrity, ml, ordered, rows, stats, versions, windows
from quarry.plans.steps import run_steps
from quarry.sources import tables


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(
        [(1, " Ann ", "US", 100.0), (2, "Bob", "USA", None), (3, "Cid", None, 9999999.0), (4, "Dee", "US", 120.0), (5, "Eve", "UK", 110.0), (6, None, "UK", None)],
        "id long, name string, country string, salary double")


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"id": np.arange(500), "g": rng.integers(0, 4, 500), "x": rng.integers(0, 40, 500).astype(float), "y": rng.normal(size=500)})
    frame.loc[::9, "x"] = np.nan
    return frame, spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "id long, g long, x double, y double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_unknown_columns_fail_early(dirty):
    for call in (lambda: rows.sort(dirty, "nope"), lambda: rows.dups(dirty, "nope"), lambda: clean.trim(dirty, "nope"),
                 lambda: windows.rank(dirty, "nope"), lambda: geo.bounds(dirty, "nope", "id"), lambda: stats.groupby(dirty, "nope"),
                 lambda: rows.filter_rows(dirty, "nope > 1"), lambda: stats.groupby(dirty, "country", "nope:sum")):
        with pytest.raises(ValueError):
            call()


def test_filter_follows_query_strings(dirty):
    assert ids(rows.filter_rows(dirty, "country != 'US'")) == [2, 3, 5, 6]
    assert ids(rows.filter_rows(dirty, "not (salary > 105)")) == [1, 2, 6]
    assert ids(rows.filter_rows(dirty, "country in ['US', 'UK'] & salary < 115")) == [1, 5]
    assert ids(rows.filter_rows(dirty, "country not in ['US']")) == [2, 3, 5, 6]
    assert ids(rows.filter_rows(dirty, "100 < salary <= 120 | name == \"Cid\"")) == [3, 4, 5]
    assert ids(rows.filter_rows(dirty, "salary * 2 - 10 == 190")) == [1]
    with pytest.raises(ValueError):
        rows.filter_rows(dirty, "salary >")


def test_search(dirty):
    assert ids(rows.search(dirty, "us")) == [1, 2, 4]
    assert ids(rows.search(dirty, "us", case_sensitive=True)) == []
    assert rows.search(dirty, "A.n", cols="name", regex=True).columns == ["name"]
    assert ids(rows.search(dirty, ".")) == []


def test_nulls_and_dups(spark, dirty):
    assert ids(rows.find_nulls(dirty)) == [2, 3, 6]
    assert ids(rows.find_nulls(dirty, "name,salary", "all")) == [6]
    t = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "a"), (6, "b")], "id long, k string")
    assert ids(rows.dups(t, "k", "first", "id")) == [2, 4, 5]
    assert ids(rows.dups(t, "k", "last", "id")) == [1, 3, 4]
    assert ids(rows.dups(t, "k", "none")) == [1, 2, 3, 4, 5]
    many = t.select("k").unionByName(spark.range(2500).select(F.lit("a").alias("k")))
    assert {r["k"]: r["n"] for r in rows.dups(many).groupBy("k").agg(F.count("*").alias("n")).collect()} == {None: 1, "a": 2502}
    assert rows.dups(many.unionByName(many), keep="none").count() == 2 * many.count()


def test_sample_is_exact_and_repeatable(spark):
    t = spark.range(5000).withColumnRenamed("id", "k")
    a = rows.sample(t, frac=0.0501, seed=1, key="k")
    b = rows.sample(t.repartition(7), frac=0.0501, seed=1, key="k")
    assert a.count() == round(0.0501 * 5000) and sorted(a.collect()) == sorted(b.collect())
    assert sorted(a.collect()) != sorted(rows.sample(t, frac=0.0501, seed=2, key="k").collect())
    assert rows.sample(t, n=3, key="k").count() == 3 and rows.sample(t, key="k").count() == 10
    assert rows.sample(t, frac=1.0, key="k").count() == 5000 and rows.sample(t, frac=0.0, key="k").count() == 0
    assert rows.sample(t, n=9999, key="k").count() == 5000
    for bad in ({"frac": 1.5}, {"n": 0}):
        with pytest.raises(ValueError):
            rows.sample(t, key="k", **bad)


@pytest.mark.parametrize("size", [1000, 40])
def test_ordered_primitives(numbers, size):
    frame, df = numbers
    got = ordered.quantiles(df, ["x", "y"], [0, 0.3, 0.5, 1], ["g"], rows_per_range=size).toPandas()
    want = frame.groupby("g")[["x", "y"]].quantile([0, 0.3, 0.5, 1])
    for r in got.itertuples():
        assert abs(want.loc[(r.g, r.p), r.column] - r[4]) < 1e-9
    assert len(got) == 4 * 2 * 4
    numbered = ordered.number_rows(df.repartition(5), ["y", "id"], ["g"], rows_per_range=size).toPandas().sort_values(["g", "y"])
    assert (numbered.groupby("g").cumcount() == numbered["row_no"]).all()


@pytest.mark.parametrize("method", ["average", "min", "max", "dense", "first"])
@pytest.mark.parametrize("pct", [False, True])
def test_rank(numbers, method, pct):
    frame, df = numbers
    got = windows.rank(df, "x", method, pct, "id", rows_per_range=60).orderBy("id").toPandas()["x_rank"].astype(float)
    want = frame["x"].rank(method=method, pct=pct)
    assert np.allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("window,center,least", [(3, False, None), (4, True, None), (5, True, 2), (1, False, None), (30, False, 1)])
def test_moving_average(numbers, window, center, least):
    frame, df = numbers
    want = frame["x"].rolling(window, center=center, min_periods=least).mean()
    got = windows.moving_avg(df.repartition(6), "x", window, center, least, "id", chunk_rows=37).orderBy("id").toPandas()["x_moving_avg"].astype(float)
    assert np.allclose(got, want, equal_nan=True)
    want = frame.groupby("g")["x"].rolling(window, center=center, min_periods=least).mean().reset_index(0, drop=True).sort_index()
    for plain in (10, 10_000):  # split partitions, and plain windows
        got = windows.moving_avg(df, "x", window, center, least, "id", "g", 37, plain).orderBy("id").toPandas()["x_moving_avg"].astype(float)
        assert np.allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("bins", [1, 4, 100])
def test_bins(spark, numbers, bins):
    frame, df = numbers
    got = windows.bin(df, "x", bins).orderBy("id").toPandas()["x_bin"]
    want = pd.cut(frame["x"], bins).astype(object).map(lambda v: str(v) if isinstance(v, pd.Interval) else None)
    assert [a or None for a in got] == [b if isinstance(b, str) else None for b in want]
    same = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert {r["x_bin"] for r in windows.bin(same, "x", 2).collect()} == set(pd.cut(pd.Series([5.0, 5.0]), 2).astype(str))
    empty = spark.createDataFrame([], "x double")
    assert windows.bin(empty, "x", 3).count() == 0
    with pytest.raises(ValueError):
        windows.bin(df, "x", 3, "a,b")


def test_moments_and_correlation(numbers, spark):
    frame, df = numbers
    cols = df.select("x", "y")
    assert {r["column"]: round(r["skew"], 9) for r in stats.skew(cols).collect()} == {c: round(frame[c].skew(), 9) for c in "xy"}
    assert {r["column"]: round(r["kurtosis"], 9) for r in stats.kurtosis(cols).collect()} == {c: round(frame[c].kurtosis(), 9) for c in "xy"}
    tiny = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0)], "a double, c double")
    assert {r["column"]: r["skew"] for r in stats.skew(tiny).collect()}["c"] == 0.0
    assert {r["column"]: r["kurtosis"] for r in stats.kurtosis(tiny).collect()} == {"a": None, "c": None}
    with pytest.raises(ValueError):
        stats.skew(df.withColumn("t", F.lit("a")))
    for got, method in ((stats.corr_pearson(cols), "pearson"), (stats.corr_spearman(cols, rows_per_range=50), "spearman")):
        want = frame[["x", "y"]].corr(method="pearson") if method == "pearson" else frame[["x", "y"]].dropna().rank().corr()
        for r in got.collect():
            assert abs(want.loc[r["a"], r["b"]] - r["corr"]) < 1e-9
    few = {(r["a"], r["b"]): r["corr"] for r in stats.corr_pearson(tiny, min_periods=4).collect()}
    assert set(few.values()) == {None}
    assert {(r["a"], r["b"]): r["corr"] for r in stats.corr_spearman(tiny).collect()}[("a", "c")] is None


def test_groupby_drops_missing_keys(dirty):
    got = {r["country"]: r["counts"] for r in stats.groupby(dirty, "country").collect()}
    assert got == {"US": 2, "USA": 1, "UK": 2}
    medians = {r["country"]: r["salary_median"] for r in stats.groupby(dirty, "country", "salary:median").collect()}
    assert medians == {"US": 110.0, "USA": None, "UK": 110.0}
    odd = dirty.select(F.col("country").alias("value"), F.col("id").alias("column"), F.col("salary").alias("n"))
    assert {r["value"]: r["n_median"] for r in stats.groupby(odd, "value", "n:median").collect()} == medians
    assert stats.groupby(odd, "value,column", "n:median,n:sum").count() == 5
    with pytest.raises(ValueError):
        stats.groupby_pivot(dirty, "country")


def test_pivot_matches_pandas(spark):
    frame = pd.DataFrame({"k": list("aabbcc"), "c": list("xyxyxx"), "v": [1.0, None, None, None, 4.0, 6.0]})
    df = spark.createDataFrame(with_nulls(frame), "k string, c string, v double")
    for func in ("sum", "count", "mean", "max", "min"):
        want = frame.pivot_table(index="k", columns="c", values="v", aggfunc=func)
        got = stats.pivot(df, "k", "c", "v", func).toPandas().set_index("k").sort_index()
        for c in want.columns:
            assert np.allclose(got.loc[want.index, c].astype(float), want[c].astype(float), equal_nan=True), (func, c)
    assert stats.pivot(df, "k", "c", "v", "mean", fill_value="0").filter("k = 'c'").first()["x"] == 5.0


def with_nulls(frame):
    return frame.astype(object).where(frame.notna(), None)


def test_compact_and_keys(spark, dirty, tmp_path):
    dirty.repartition(5).write.parquet(str(tmp_path / "many"))
    packed = tables.compact(spark, str(tmp_path / "many"), str(tmp_path / "few"), 2)
    assert packed.count() == 6 and len(packed.inputFiles()) <= 2
    known = tables.compact(spark, str(tmp_path / "many"), str(tmp_path / "known"), 1, analyze_as="known_table")
    assert known.count() == 6 and "6 rows" in str(spark.sql("DESCRIBE EXTENDED known_table").filter("col_name = 'Statistics'").collect())
    spark.sql("DROP TABLE known_table")
    key = integrity.key_from_file(str(tmp_path / "key"))
    assert integrity.key_from_file(str(tmp_path / "key")) == key and len(key) == 32


def test_describe_empty_and_ties(spark, dirty):
    got = {(r["column"], r["metric"]): (r["value"], r["text"]) for r in stats.describe(dirty).collect()}
    assert got[("country", "top")] == (None, "UK") and got[("country", "freq")] == (2.0, None)
    assert got[("salary", "count")][0] == 4.0 and got[("salary", "50%")][0] == 115.0
    empty = {(r["column"], r["metric"]): r["value"] for r in stats.describe(dirty.limit(0)).collect()}
    assert empty[("salary", "count")] == 0.0


def test_imputation(dirty, spark):
    filled = {r["id"]: r["salary"] for r in clean.impute_mode(dirty, "salary").collect()}
    assert filled[2] == 100.0 and filled[6] == 100.0
    by_group = {r["id"]: r["salary"] for r in clean.impute_group(dirty, "salary", "country").collect()}
    assert by_group[6] == 110.0 and by_group[2] is None and by_group[3] == 9999999.0
    wide = spark.createDataFrame([("a", 1.0), ("a", 99.0), ("b", 1.0)], "g string, v double")
    with pytest.raises(ValueError):
        clean.impute_group(wide, "v", "g", std_max=5)
    assert clean.impute_mode(spark.createDataFrame([(None,)], "v double"), "v").collect()[0]["v"] is None


def test_cleaning(dirty, spark, tmp_path):
    assert clean.trim(dirty, "name").filter("id = 1").first()["name"] == "Ann"
    odd = spark.createDataFrame([(" x \n",)], "t string")
    assert clean.trim(odd, "t").first()["t"] == "x"
    assert clean.trim(odd, "t", "left").first()["t"] == "x \n"
    outliers = spark.createDataFrame([(float(i),) for i in range(20)] + [(10000.0,), (None,)], "v double")
    assert clean.drop_outliers(outliers, "v", 3).filter("v > 100").count() == 0
    assert clean.drop_outliers(outliers, "v", method="iqr").filter("v IS NULL").count() == 2
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert clean.drop_outliers(same, "v").filter("v = 5").count() == 2
    (tmp_path / "map.csv").write_text("US,United\nUSA,first\nUSA,last\n")
    mapping = clean.read_mapping(spark, str(tmp_path / "map.csv"))
    got = {r["id"]: r["country"] for r in clean.map_values(dirty, "country", mapping).collect()}
    assert got == {1: "United", 2: "last", 3: None, 4: "United", 5: "UK", 6: "UK"}
    money = spark.createDataFrame([("a-1",)], "t string")
    assert clean.regex_replace(money, "t", r"(?P<l>\w)-(\d)", r"$\2\g<l>\\").first()["t"] == "$1a\\"


def test_cast(spark):
    t = spark.createDataFrame([("1.9",), ("x",), (None,), ("9007199254740993",)], "v string")
    assert [r["v"] for r in columns_ops.cast_col(t, "v", "integer", "nullify").collect()] == [1, None, None, 9007199254740993]
    assert columns_ops.cast_col(t, "v", "real", "ignore").dtypes == [("v", "string")]
    assert columns_ops.cast_col(t, "v", "blob").dtypes == [("v", "binary")]
    with pytest.raises(Exception):
        columns_ops.cast_col(t, "v", "real", "fail").collect()


def test_json(spark):
    t = spark.createDataFrame([(1, '{"u":{"n":"A","i":1},"l":[1,2]}'), (2, None), (3, '{"u":{"n":"B"}}'), (4, "oops")], "id long, p string")
    flat = columns_ops.flatten_json(t, "p")
    assert set(flat.columns) == {"id", "p", "p_u_n", "p_u_i", "p_l"}
    got = {r["id"]: (r["p_u_n"], r["p_u_i"]) for r in flat.collect()}
    assert got == {1: ("A", 1), 2: (None, None), 3: ("B", None), 4: (None, None)}
    assert set(columns_ops.flatten_json(t, "p", prefix="x.", sep=".", drop_original=True).columns) == {"id", "x.u.n", "x.u.i", "x.l"}
    assert columns_ops.detect_json(t).collect()[0]["valid_share"] == pytest.approx(2 / 3)
    assert columns_ops.detect_json(t, depth=1).count() == 0
    assert columns_ops.detect_json(t, depth=2).collect()[0]["valid_share"] == pytest.approx(2 / 3)


def test_crosstab_matches_pandas(spark):
    frame = pd.DataFrame({"a": list("xxyyyz"), "b": list("pqppqp")})
    df = spark.createDataFrame(frame)
    for how in (None, "index", "columns", "all"):
        for margins in (False, True):
            want = pd.crosstab(frame.a, frame.b, normalize=how or False, margins=margins)
            got = {(r["row"], r["col"]): r["value"] for r in stats.crosstab(df, "a", "b", how, margins).collect()}
            assert got == pytest.approx({(i, c): want.loc[i, c] for i in want.index for c in want.columns})


def test_geo(spark):
    t = spark.createDataFrame([("a", 10.0, 20.0), ("bad", 100.0, 200.0), ("null", None, 5.0)], "name string, lat double, lon double")
    assert [r["name"] for r in geo.geo_validate(t, "lat", "lon").collect()] == ["bad"]
    assert sorted(r["name"] for r in geo.geo_validate(t, "lat", "lon", True).collect()) == ["a", "null"]
    lookup = spark.createDataFrame([("a", 1.0, 2.0)], "address string, lat double, lon double")
    got = {r["name"]: r["lat"] for r in geo.geocode(t.select("name"), "name", lookup).collect()}
    assert got == {"a": 1.0, "bad": None, "null": None}


def test_fingerprint(spark, dirty):
    one = integrity.fingerprint(dirty).first()[0]
    for n in (1, 4, 17):
        assert integrity.fingerprint(dirty.repartition(n)).first()[0] == one
    assert integrity.fingerprint(dirty.unionByName(dirty)).first()[0] != one
    assert integrity.fingerprint(dirty, salt="s").first()[0] != one
    shifted = spark.createDataFrame([("ab", "c")], "a string, b string"), spark.createDataFrame([("a", "bc")], "a string, b string")
    assert integrity.fingerprint(shifted[0]).first()[0] != integrity.fingerprint(shifted[1]).first()[0]
    assert len(integrity.fingerprint(dirty, "sha512").first()[0]) == 128
    assert integrity.verify_fingerprint(dirty, one).first()["verified"]
    with pytest.raises(ValueError):
        integrity.verify_fingerprint(dirty, "abc")


def test_privacy(spark):
    t = spark.createDataFrame([(1, "mail ann@x.org or bob@y.co.uk, call +1 (555) 123-4567", "ab"), (2, None, None), (3, "4111 1111 1111 1111", "abcdef")], "id long, note string, s string")
    found = {(r["id"], r["entity"], r["match_no"]): r["snippet"] for r in integrity.scan_pii(t, "id").collect()}
    assert found[(1, "EMAIL_ADDRESS", 1)] == "bob@y.co.uk" and (1, "PHONE_NUMBER", 0) in found and (3, "CREDIT_CARD", 0) in found
    assert integrity.scan_pii(t, "id", "EMAIL_ADDRESS").count() == 2 and integrity.scan_pii(t, "id", confidence=0.9).count() == 0
    masked = [r["s"] for r in integrity.anonymize(t, "s", "mask", 4).orderBy("id").collect()]
    assert masked == ["**", None, "****ef"]
    assert [r["s"] for r in integrity.anonymize(t, "s", "redact").collect()] == ["[REDACTED]"] * 3
    sealed = integrity.encrypt_col(t, "s", "k" * 16)
    assert [r["s"] for r in integrity.decrypt_col(sealed, "s", "k" * 16).orderBy("id").collect()] == ["ab", None, "abcdef"]
    kept = integrity.decrypt_col(sealed, "s", "z" * 16)
    assert kept.join(sealed.select("id"), "id").filter("s IS NOT NULL").count() == 2
    assert [r["s"] for r in integrity.decrypt_col(t, "s", "k" * 16).orderBy("id").collect()] == ["ab", None, "abcdef"]


def test_drift(spark, numbers):
    _, df = numbers
    same = {r["column"]: (r["statistic"], r["result"]) for r in integrity.drift_check(df, df).collect()}
    assert set(same.values()) == {(0.0, "OK")}
    moved = {r["column"]: r["result"] for r in integrity.drift_check(df.withColumn("y", F.col("y") + 1), df, rows_per_range=30).collect()}
    assert moved == {"id": "OK", "g": "OK", "x": "OK", "y": "DRIFT"}
    empty = {r["column"]: r["result"] for r in integrity.drift_check(df.limit(0), df).collect()}
    assert set(empty.values()) == {"insufficient"}


def test_versions(spark, dirty, tmp_path):
    root = str(tmp_path)
    versions.audited_write(dirty, root, "raw", "load", "ann")
    versions.snapshot(dirty, root, "raw", "v1")
    with pytest.raises(ValueError):
        versions.snapshot(dirty, root, "raw", "v1")
    versions.audited_write(versions.read_current(spark, root, "raw").filter("id > 3"), root, "raw", "clean", "bob")
    assert versions.rollback(spark, root, "raw", "v1", dry_run=True).first() == (3, 6)
    assert versions.rollback(spark, root, "raw", "v1").count() == 6
    with pytest.raises(ValueError):
        versions.rollback(spark, root, "raw", "nope")
    log = versions.read_audit_log(spark, root)
    assert [r["action"] for r in log.collect()] == ["rollback", "clean", "snapshot", "load"]
    assert [r["user"] for r in versions.read_audit_log(spark, root, user="bob").collect()] == ["bob"]


def test_splits(spark):
    t = spark.range(1000).select("id", F.when(F.col("id") < 10, "rare").otherwise("often").alias("s"))
    train, test = ml.train_test_split(t, "id", 0.755, seed=1)
    assert (train.count(), test.count(), train.join(test, "id").count()) == (755, 245, 0)
    train, test = ml.train_test_split(t, "id", 0.75, stratify="s")
    assert {r["s"]: r["n"] for r in train.groupBy("s").agg(F.count("*").alias("n")).collect()} == {"rare": 7, "often": 743}
    again, _ = ml.train_test_split(t.repartition(9), "id", 0.75, stratify="s")
    assert sorted(train.collect()) == sorted(again.collect())


def test_models(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"id": np.arange(400), "a": np.r_[rng.normal(2, 0.5, 200), rng.normal(6, 0.5, 200)], "b": np.r_[rng.normal(2, 0.5, 200), rng.normal(6, 0.5, 200)],
                          "c": rng.choice(["u", "v", "w"], 400), "label": np.r_[np.zeros(200, int), np.ones(200, int)]})
    df = spark.createDataFrame(frame)
    for kind, extra in (("random_forest", {"n_estimators": 10}), ("logistic_regression", {})):
        model, accuracy = ml.train_classifier(df, "label", "a,b,c", "id", kind, **extra)
        assert accuracy > 0.97
        unseen = ml.predict(df.withColumn("c", F.lit("new")), model, "p")
        assert unseen.count() == 400 and unseen.columns == [*df.columns, "p"] and dict(unseen.dtypes)["p"] == "bigint"
        assert {r["p"] for r in ml.predict(df, model, "p", threshold=0.5).collect()} == {0, 1}
        assert {r["feature"] for r in ml.feature_importance(spark, model).collect()} == {"a", "b", "c_v", "c_w"}
    found = ml.kmeans(df, "a,b", 2, n_init=2)
    assert found.groupBy("label", "cluster_id").count().count() == 2


def test_frames(spark, numbers):
    frame, df = numbers
    got = [r["n"] for r in frames.hist_frame(df, "x", 7).orderBy("bin").collect()]
    assert got == list(np.histogram(frame["x"].dropna(), 7)[0])
    assert frames.hist_frame(df.limit(0), "x").count() == 0
    assert [r["n"] for r in frames.hist_frame(spark.createDataFrame([(2.0,)], "x double"), "x", 2).orderBy("bin").collect()] == [0, 1]
    box = frames.box_frame(df, "y").first()
    assert box["median"] == pytest.approx(frame["y"].median())
    diff = frames.schema_diff(df, df.drop("g").withColumn("z", F.lit(1)).withColumn("x", F.col("x").cast("string")))
    assert sorted(d[:2] for d in diff) == [("g", "removed"), ("x", "modified"), ("z", "added")]


def test_steps(dirty):
    result, status = run_steps(dirty, '{"steps": [{"name": "t", "op": "trim", "args": {"col": "name"}}, {"op": "drop_col", "args": {"col": "id"}}]}')
    assert result.columns == ["name", "country", "salary"] and [s["name"] for s in status] == ["t", "Step 2"]
    with pytest.raises(ValueError):
        run_steps(dirty, {"steps": [{"op": "nope"}]})


def test_sources(spark, dirty, tmp_path):
    array = tmp_path / "a.json"
    array.write_text('[\n {"a": 1},\n {"a": 2}\n]')
    assert tables.read_table(spark, str(array)).count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.unknown")
    with pytest.raises(ValueError):
        tables.merge_tables({}, {"a": dirty}, tables=["b"])
    twice = tables.merge_ignore(dirty.filter("id < 3"), dirty.unionByName(dirty), ["id"])
    assert twice.count() == 2 + 8
    assert tables.merge_ignore(dirty, dirty, []).count() == 6
    for t, rows_ in (("s", dirty.filter("id < 3")), ("t", dirty.filter("id < 4"))):
        tables.write_table(rows_, str(tmp_path / t / "raw.parquet"))
    tables.merge_folders(spark, str(tmp_path / "t"), str(tmp_path / "s"), str(tmp_path / "o"), ["raw"], "ignore", {"raw": ["id"]})
    assert spark.read.parquet(str(tmp_path / "o" / "raw.parquet")).count() == 3


def test_times_as_numbers(spark):
    t = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'1969-12-31 23:59:59.5'), (TIMESTAMP_NTZ'2024-02-29 12:00:00.000001') AS t(ts)")
    assert [r[0] for r in t.select(as_number(t, "ts")).collect()] == [-500000.0, 1709208000000001.0]


def test_duplicates_with_ties_in_the_order(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 5, "b"), (2, 5, "a"), (None, 1, "x"), (None, 1, "x")], "k int, o int, v string")
    first = sorted(map(tuple, rows.dups(df, "k", "first", "o").collect()), key=str)
    assert first == [(1, 5, "a"), (1, 5, "b"), (None, 1, "x")]
    last = sorted(map(tuple, rows.dups(df, "k", "last", "o").collect()), key=str)
    assert last == [(1, 5, "a"), (1, 5, "a"), (None, 1, "x")]


def test_quoted_cells_and_array_files(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,text\n1,"say ""hi"", ok"\n2,"two\nlines"\n')
    assert [r["text"] for r in tables.read_table(spark, str(path), multiline=True).orderBy("id").collect()] == ['say "hi", ok', "two\nlines"]
    df = spark.createDataFrame([(1, 'a "quoted", cell')], "id int, text string")
    tables.write_table(df, str(tmp_path / "out.csv"), fmt="csv")
    assert tables.read_table(spark, str(tmp_path / "out.csv"), fmt="csv").first()["text"] == 'a "quoted", cell'
    array = tmp_path / "a.json"
    array.write_text('[\n{"a": 1},\n{"a": 2}\n]\n')
    assert [r["a"] for r in tables.read_table(spark, str(array), schema="a int").orderBy("a").collect()] == [1, 2]


def test_null_keys_merge_once(spark):
    target = spark.createDataFrame([(None, "x")], "id int, v string")
    assert tables.merge_ignore(target, target, ["id"]).count() == 1


def test_json_keys_that_look_like_types(spark):
    df = spark.createDataFrame([('{"VOIDED": 1, "a": null, "OBJECT<": {"VOID": "v"}}',)], "j string")
    flat = columns_ops.flatten_json(df, "j", prefix="").first().asDict()
    assert flat["VOIDED"] == 1 and flat["a"] is None and flat["OBJECT<_VOID"] == "v"


def test_patterns_know_unicode(spark):
    df = spark.createDataFrame([("café 1",)], "t string")
    assert clean.regex_replace(df, "t", r"\w+", "x").first()["t"] == "x x"
    assert rows.search(df, r"^\w{4}\b", regex=True).count() == 1


def test_a_label_called_all(spark):
    df = spark.createDataFrame([("a", "All"), ("b", "x")], "r string, c string")
    assert set(stats.crosstab_wide(df, "r", "c").columns) == {"row", "All", "x"}
    with pytest.raises(ValueError):
        stats.crosstab_wide(df, "r", "c", margins=True)


def test_division_in_filters(spark):
    df = spark.createDataFrame([(1, 7, 2), (2, 5, 0), (3, 0, 0), (4, -7, 2), (5, -1, 0)], "i int, x int, y int")
    ids = lambda where: sorted(r["i"] for r in rows.filter_rows(df, where).collect())
    assert ids("x // y == 3") == [1] and ids("x // y == -4") == [4]
    assert ids("x / y > 5") == [2] and ids("x / y < -5") == [5] and ids("x / y == x / y") == [1, 2, 4, 5]


def test_repeated_addresses_take_the_last_line(spark):
    lookup = spark.createDataFrame([("a", 9.0, 9.0, 1), ("a", 1.0, 1.0, 2)], "address string, lat double, lon double, line int")
    assert geo.geocode(spark.createDataFrame([("a",)], "at string"), "at", lookup).first()["lat"] == 1.0


def test_counts_beyond_long(spark):
    one = spark.range(1).select(F.lit(0.0005).alias("d"), F.lit(4_000_000_000).cast("long").alias("n"))
    assert one.select(integrity.kolmogorov_tail(F.col("d"), F.col("n"), F.col("n")).alias("p")).first()["p"] < 1e-9
    small = one.select(integrity.kolmogorov_tail(F.lit(0.2), F.lit(50), F.lit(60)).alias("p")).first()["p"]
    from math import exp, sqrt
    lam = 0.2 * sqrt(50 * 60 / 110)
    assert small == pytest.approx(2 * sum((-1) ** (k - 1) * exp(-2 * k * k * lam * lam) for k in range(1, 101)))


def test_spearman_beyond_two_million_rows(spark):
    df = spark.range(2_200_000).select((F.col("id") % 1000).cast("double").alias("a"), (F.col("id") % 1000 * -2).cast("double").alias("b"))
    found = stats.corr_spearman(df).filter("a = 'a' and b = 'b'").first()
    assert found["corr"] == pytest.approx(-1.0) and found["n"] == 2_200_000


def test_a_step_that_fails_while_running_is_told(spark):
    df = spark.createDataFrame([(1, "x")], "i int, t string")
    steps = {"steps": [{"op": "filter_rows", "args": {"where": "i > 0"}}, {"op": "regex_replace", "args": {"col": "t", "pattern": "(", "repl": ""}},
                       {"op": "fingerprint", "args": {}}]}
    out, status = run_steps(df, steps, continue_on_error=True)
    assert [s["status"] for s in status] == ["success", "failed", "success"] and out.count() == 1
    _, planned = run_steps(df, {"steps": [{"op": "trim", "args": {"col": "t"}}]}, settle=False)
    assert planned[0]["status"] == "planned"


def test_the_sample_does_not_depend_on_the_cells(spark, monkeypatch):
    df = spark.range(5000)
    one = ids(rows.sample(df, n=700, seed=3, key="id"))
    for bits, most in ((3, 10_000), (3, 5), (2, 1), (16, 1)):  # the boundary cell is cut until few rows are left to rank
        monkeypatch.setattr(rows, "HASH_BITS", bits)
        monkeypatch.setattr(rows, "RANKED_ROWS", most)
        assert ids(rows.sample(df, n=700, seed=3, key="id")) == one and len(one) == 700
    hot = spark.range(900).select((F.col("id") % 2).alias("id"))  # rows of one hash cannot be told apart
    assert rows.sample(hot, n=500, seed=3, key="id").count() == 500
