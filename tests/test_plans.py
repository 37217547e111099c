"""What the physical plans must and must not contain."""

import io
import os
import subprocess
import sys
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from quarry.operators import clean, geo, integrity, rows, stats
from quarry.session import shared_folder, write_out

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    items = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    text = plan(stats.groupby(items.filter("l_quantity > 30"), "l_returnflag", "l_tax:sum"))
    assert "GreaterThan(l_quantity,30.0)" in text
    assert "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string>" in text


def test_filter_strings_reach_the_scan(spark):
    items = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    text = plan(rows.filter_rows(items, "l_quantity > 30 and l_returnflag != 'A' and l_linestatus in ['F', 'X']"))
    assert "GreaterThan(l_quantity,30.0)" in text and "In(l_linestatus, [F,X])" in text and "Not(EqualNullSafe(l_returnflag,A))" in text


@pytest.mark.parametrize("key", ["groupby", "crosstab", "dups", "rank", "drift_check", "fingerprint", "scan_pii", "geo_distance", "harmonize", "map_values"])
def test_no_cartesian_product(spark, key):
    assert "CartesianProduct" not in plan(registry.queries()[key](spark, FOLDER))


def test_native_operators_stay_in_the_jvm(spark):
    people = spark.read.parquet(f"{FOLDER}/customer.parquet")
    for df in (clean.trim(people, "c_name"), integrity.scan_pii(people, "c_custkey"), integrity.fingerprint(people), rows.search(people, "a"),
               geo.geo_distance(people.withColumn("a", F.lit(1.0)), "a", "a", 0, 0), stats.describe(people), integrity.anonymize(people, "c_name")):
        text = plan(df)
        assert "Python" not in text and "InPandas" not in text


def test_row_operators_do_not_shuffle(spark):
    people = spark.read.parquet(f"{FOLDER}/customer.parquet")
    for df in (clean.trim(people, "c_name"), integrity.scan_pii(people, "c_custkey"), rows.filter_rows(people, "c_acctbal > 1"),
               clean.regex_replace(people, "c_name", "a", "b"), rows.find_nulls(people)):
        assert "Exchange" not in plan(df)


def test_top_rows_do_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(rows.head(spark.read.parquet(f"{FOLDER}/orders.parquet"), 10, "o_totalprice,o_orderkey"))


def test_intermediate_tables_go_to_the_named_folder(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder
    assert write_out(spark.range(3)).inputFiles()[0].replace("file://", "").startswith(folder)


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A query with Python on the workers, started where the package cannot be imported by accident."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from quarry.session import local_session\n"
            "import __spark_entry__ as e\n"
            "spark = local_session('2', 2, '2g')\n"
            f"print('rows', e.queries()['knn_impute'](spark, {FOLDER!r}).count(), e.queries()['nearest'](spark, {FOLDER!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_no_plan_shows_the_key(spark):
    df = spark.createDataFrame([("secret",)], "t string")
    sealed = integrity.encrypt_col(df, "t", "0123456789abcdef")
    text = sealed._jdf.queryExecution().toString() + plan(sealed)
    assert "0123456789abcdef" not in text and "30313233343536373839616263646566" not in text.lower()
    assert integrity.decrypt_col(sealed, "t", "0123456789abcdef").first()["t"] == "secret"


def test_crosstab_shares_need_no_window(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    for basis in ("all", "columns", "index"):
        assert "Window" not in plan(stats.crosstab(orders, "o_orderstatus", "o_orderpriority", basis))


def test_embedding_clusters_use_every_dimension(spark, monkeypatch):
    from quarry.operators import ml

    seen = []
    monkeypatch.setattr(ml, "kmeans", lambda df, features, **options: seen.extend(features) or df.withColumn("cluster_id", F.lit(0)))
    registry.queries()["kmeans_embeddings"](spark, FOLDER).collect()
    width = spark.read.parquet(f"{FOLDER}/embeddings.parquet").selectExpr("max(size(embedding))").first()[0]
    assert seen == [f"e{i}" for i in range(width)]
