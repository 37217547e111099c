"""What the third round's findings asked for, on rows of their own."""

import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as registry
from quarry.operators import fuzzy, isolation, ml, neighbours, ordered


def test_cut_points_do_not_grow_with_the_table(spark):
    df = spark.range(3000)
    assert ordered._cut_points(df, F.struct("id"), 2)[2] < ordered.MAX_RANGES <= 256
    numbered = ordered.number_rows(df.selectExpr("-id AS x"), ["x"], rows_per_range=2)
    assert numbered.filter("row_no <> x + 2999").count() == 0


def test_nearest_in_blocks_as_row_by_row(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", 100)
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 4, (37, 2)).astype(float), rng.integers(0, 4, (30, 2)).astype(float)
    far = neighbours.euclidean_block(a, b)
    want = [(i, j) for i in range(37) for j in np.argsort(far[i], kind="stable")[:3]]
    found = [(i, j) for who, which, _ in neighbours.closest_flat(a, b, 3, neighbours.euclidean_block) for i, j in zip(who, which)]
    assert found == want
    assert [(i, j) for i, (which, _) in enumerate(neighbours.closest(a, b, 3, neighbours.euclidean_block)) for j in which] == want
    near = [(i, j) for who, which, _ in neighbours.closest_flat(a, b, 3, neighbours.euclidean_block, 1e-9) for i, j in zip(who, which)]
    assert sorted(near) == [(i, j) for i in range(37) for j in range(30) if far[i, j] <= np.sort(far[i])[2] + 1e-9]


def test_short_texts_meet_without_grams(spark, monkeypatch):
    """Numbered names share all their grams: they are not compared for that."""
    def grams(*_):
        raise AssertionError("short texts need no grams")
    random.seed(8)
    names = sorted({"Name#" + "".join(random.choice("0012") for _ in range(random.choice([11, 12, 13, 14]))) for _ in range(150)})
    names += ["", "a", "ab", "Name#01é"]
    score = lambda x, y: 100.0 * 2 * fuzzy.common_length(x, y) / (len(x) + len(y))
    monkeypatch.setattr(fuzzy, "_signatures", grams)
    found = fuzzy.fuzzy_pairs(spark.createDataFrame([(n,) for n in names], "w string"), "w", 94)
    assert sorted((r["value"], r["other"]) for r in found.collect()) == sorted((x, y) for x in names for y in names if x < y and score(x, y) >= 94)
    monkeypatch.undo()
    long = names + [n + n[5:] for n in names[:40]] + [n + n[6:] for n in names[:40]]  # shorter and longer texts than the limit
    found = fuzzy.fuzzy_pairs(spark.createDataFrame([(n,) for n in long], "w string"), "w", 92)
    want = sorted((x, y) for x in set(long) for y in set(long) if x < y and score(x, y) >= 92)
    assert sorted((r["value"], r["other"]) for r in found.collect()) == want


@pytest.mark.parametrize("partitions", [1, 5])
def test_trees_on_all_rows_find_the_rare_ones(spark, partitions):
    """Three rows far out among many: trees on 256 rows do not see them, trees on all rows do."""
    rng = np.random.default_rng(5)
    rows = [(i, float(u), float(v)) for i, (u, v) in enumerate(rng.integers(0, 50, (4000, 2)))] + [(-i, i * 5000.0, i * -9e6) for i in (1, 2, 3)] + [(5000, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, u double, v double").repartition(partitions)
    scored = isolation.isolation_forest(df, "u,v", "id", n_estimators=10, max_samples=1.0, max_depth=8)
    found = scored.filter("anomaly_score is not null").orderBy("anomaly_score").limit(3).collect()
    assert sorted(r["id"] for r in found) == [-3, -2, -1] and scored.filter("anomaly_score is null").count() == 1
    same = isolation.isolation_forest(spark.createDataFrame([(i, 1.0, 2.0) for i in range(5)], "id long, u double, v double"), "u,v", "id", max_samples=1.0, max_depth=8)
    assert same.select("anomaly_score").distinct().count() == 1


def test_planted_rows_come_first_of_the_whole_table():
    sql = registry.oracle_sql()["isolation_forest_planted"]
    assert "tie" not in sql and "low" not in sql and "range(1, 4)" in sql


def test_knn_over_gaps_does_not_visit_ties(spark, monkeypatch):
    """Many donors know one coarse coordinate alone and tie on it: a pair of patterns holds few of them, and the answer is the plain search's."""
    rng = np.random.default_rng(11)
    rows = [(int(i), float(rng.integers(3)) if rng.random() < 0.8 else None, float(i) if rng.random() < 0.6 else None, float(rng.random()) if rng.random() < 0.7 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, z double")
    small = neighbours.knn_impute(df, "z", "id", 3, "distance", ["a", "b"])
    met, whole = [], neighbours._pattern_cells_join
    monkeypatch.setattr(neighbours, "_pattern_cells_join", lambda *x: met.append(whole(*x)) or met[-1])
    large = neighbours.knn_impute(df, "z", "id", 3, "distance", ["a", "b"], broadcast_cells=0, leaf_points=20)
    a, b = ({r["id"]: r["z"] for r in x.collect()} for x in (small, large))
    assert len(met) == 1 and a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)
    monkeypatch.setattr(neighbours, "MAX_PATTERNS", 1)  # more patterns: the one tree
    one = neighbours.knn_impute(df, "z", "id", 3, "distance", ["a", "b"], broadcast_cells=0, leaf_points=20)
    assert len(met) == 1 and all(r["z"] == pytest.approx(a[r["id"]], abs=1e-9) for r in one.collect())


@pytest.mark.parametrize("learner", ["random_forest", "logistic_regression"])
def test_models_predict_after_an_observation(spark, learner):
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    df = spark.createDataFrame([(i, float(i % 10), int(i % 10 > 4)) for i in range(200)], "id long, x double, y int")
    model, _ = ml.train_classifier(df, "y", "x", "id", learner)
    assert ml.predict(df, model, "guess").filter("guess is not null").count() == 200
