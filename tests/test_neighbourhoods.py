"""Pairwise operators against brute force, with blocks small enough to take every branch."""

import random
import string
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quarry.operators import components, density, fuzzy, isolation, kendall, neighbours, segments


def haversine_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kilometres between all rows of (lat, lon) degrees in ``a`` and ``b``."""
    p, q = np.radians(a), np.radians(b)
    h = (np.sin((q[None, :, 0] - p[:, None, 0]) / 2) ** 2
         + np.cos(p[:, None, 0]) * np.cos(q[None, :, 0]) * np.sin((q[None, :, 1] - p[:, None, 1]) / 2) ** 2)
    return 2 * 6371.0 * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))


def with_nulls(frame):
    return frame.astype(object).where(frame.notna(), None)


def tau(x, y):
    both = ~(np.isnan(x) | np.isnan(y))
    a, b = (np.sign(v[both][:, None] - v[both][None]) for v in (x, y))
    return (a * b).sum() / np.sqrt(np.abs(a).sum() * np.abs(b).sum())


@pytest.mark.parametrize("chunk", [200_000, 19])
def test_kendall(spark, chunk):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.integers(0, 12, 260).astype(float), "b": rng.normal(size=260).round(1)})
    frame["b"] += frame["a"] * 0.1
    frame.loc[::11, "a"] = np.nan
    frame.loc[rng.random(260) < 0.4, "b"] = 1.0
    got = {(r["a"], r["b"]): r["corr"] for r in kendall.corr_kendall(spark.createDataFrame(with_nulls(frame), "a double, b double"), chunk_rows=chunk).collect()}
    assert got[("a", "b")] == pytest.approx(tau(frame["a"].to_numpy(), frame["b"].to_numpy()), abs=1e-12) and got[("a", "a")] == 1.0


def test_inversions():
    rng = np.random.default_rng(5)
    v, w = rng.integers(0, 9, 60), rng.integers(1, 4, 60)
    assert kendall.weighted_inversions(v, w) == sum(w[i] * w[j] for i in range(60) for j in range(i + 1, 60) if v[i] > v[j])
    assert kendall.weighted_inversions(v[:1], w[:1]) == 0


def score(a, b):
    return 100 * (1 - (len(a) + len(b) - 2 * fuzzy.common_length(a, b)) / (len(a) + len(b)))


def test_common_length():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fuzzy.common_length(a, b) == table[-1][-1]


@pytest.mark.parametrize("threshold,letters", [(90, "abcdefgh"), (75, "abcde"), (96, string.ascii_lowercase), (80, string.ascii_lowercase), (60, "abcdefgh")])
def test_fuzzy_clusters(spark, threshold, letters):
    rng = random.Random(threshold)
    values = []
    for _ in range(35):
        base = "".join(rng.choices(letters, k=rng.randint(1, 26)))
        for _ in range(4):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                if rng.random() < 0.5 or len(text) < 2:
                    text.insert(rng.randrange(len(text) + 1), rng.choice(letters))
                else:
                    text.pop(rng.randrange(len(text)))
            values.append("".join(text))
    rng.shuffle(values)
    values = list(dict.fromkeys(values))
    head = {}
    for v in values:
        if v not in head:
            head.update({w: v for w in values if w not in head and score(v, w) >= threshold})
    sizes = Counter(head.values())
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    got = {r["value"]: r["cluster"] for r in fuzzy.fuzzy_clusters(df, "s", threshold, "i").collect()}
    assert got == {w: v for w, v in head.items() if sizes[v] > 1}


def _misspelt(n, letters=string.ascii_lowercase, seed=1):
    """(id, word) of invented names, each with a near copy."""
    rng, found = random.Random(seed), []
    while len(found) < n:
        name = "".join(rng.choices(letters, k=rng.randint(6, 22)))
        at = rng.randrange(len(name))
        found += [name, name[:at] + rng.choice(letters) + name[at + 1:]]
    return list(enumerate(dict.fromkeys(found)))


@pytest.mark.parametrize("threshold, letters, few", [(80, "abcd", 2048), (80, "ab", 20), (70, "abcdefgh", 10), (55, "abc", 30)])
def test_segments_lose_no_pair(spark, threshold, letters, few):
    words = _misspelt(120, letters, few) + [(1000, ""), (1001, "a"), (1002, "ab"), (1003, "b")]
    words = [(i, w) for w, i in {w: i for i, w in words}.items()]
    df = spark.createDataFrame(words, "id long, word string")
    df = df.join(fuzzy._letter_masks(df), "id", "left").fillna(0, ["mask"])
    found = {tuple(r) for r in segments.candidates(df, threshold, few).collect()}
    want = {tuple(sorted((i, j))) for i, a in words for j, b in words if i < j and (a or b) and score(a, b) >= threshold}
    assert want <= found and all(u < v for u, v in found)


def test_candidates_follow_the_texts_not_their_pairs(spark):
    """Ten times the texts make about ten times the candidates at a threshold of 80, not a hundred times."""
    made = []
    for n in (300, 3000):
        df = spark.createDataFrame(_misspelt(n), "id long, word string")
        made.append(segments.candidates(df.join(fuzzy._letter_masks(df), "id"), 80, few_pairs=16).count())
    assert made[0] >= 130 and made[1] <= 20 * made[0] and made[1] < 3000 * 10


def test_alike_texts_are_not_cut_for_nothing(spark):
    """Texts that are all similar are paired once, whatever segments they share."""
    words = [(i, f"Customer#{i:09d}") for i in range(300)]
    df = spark.createDataFrame(words, "id long, word string")
    found = segments.candidates(df.join(fuzzy._letter_masks(df), "id"), 80, few_pairs=100).count()
    assert found == sum(1 for i, a in words for j, b in words if i < j) or found > 300


def test_greedy_rounds(spark):
    rng = random.Random(7)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(i, i + 1) for i in range(100, 140)})
    nodes = sorted({v for e in edges for v in e})
    near = {v: {a + b - v for a, b in edges if v in (a, b)} for v in nodes}
    want = {}
    for v in nodes:
        if v not in want:
            want.update({w: v for w in near[v] | {v} if w not in want})
    df = spark.createDataFrame(edges, "u long, v long")
    for limits in ({}, {"one_task_edges": 5, "front": 4}):
        assert {r["id"]: r["head"] for r in fuzzy.greedy_heads(df, **limits).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 60), (70, 71), (99, 5)]
    df = spark.createDataFrame(edges, "u long, v long")
    for limits in ({}, {"one_task_edges": 0}):
        got = {r["node"]: r["root"] for r in components.components(df, **limits).collect()}
        assert {got[i] for i in [*range(31), 99]} == {0} and {got[i] for i in (40, 50, 60)} == {40} and got[71] == 70


def reference_clusters(points, eps, least, metric):
    gap = haversine_block(points, points) if metric == "haversine" else np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    near = gap <= eps
    core, label, number = near.sum(1) >= least, np.full(len(points), -1), 0
    for i in range(len(points)):
        if label[i] != -1 or not core[i]:
            continue
        stack, label[i] = [i], number
        while stack:
            p = stack.pop()
            for q in np.flatnonzero(near[p]) if core[p] else ():
                if label[q] == -1:
                    label[q] = number
                    stack.append(q)
        number += 1
    return label


@pytest.mark.parametrize("metric,eps,least,scale", [("euclidean", 0.5, 4, 3), ("haversine", 60, 4, 10)])
def test_dbscan(spark, metric, eps, least, scale):
    rng = np.random.default_rng(int(eps * 10))
    points = np.vstack([rng.normal(size=(200, 2)) * 0.4 + rng.uniform(-scale, scale, 2) for _ in range(2)] + [rng.uniform(-scale, scale, (120, 2))]).round(2)
    rng.shuffle(points)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(9999, None, 1.0)], "id long, la double, lo double")
    got = density.dbscan(df, "la", "lo", eps, least, metric, "id").orderBy("id").toPandas()["cluster_id"]
    assert pd.isna(got.iloc[-1]) and list(got[:-1].astype(int)) == list(reference_clusters(points, eps, least, metric))


def test_dbscan_crowded_cells(spark):
    """Two crowds just within and just out of reach: decided by halving boxes, not by comparing all points."""
    rng = np.random.default_rng(3)
    crowd = rng.uniform(0, 0.2, (300, 2))
    points = np.vstack([crowd, crowd + [0.0, 0.65], crowd + [3.0, 0.0], crowd + [3.0, 0.75]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, la double, lo double")
    got = density.dbscan(df, "la", "lo", 0.5, 5, "euclidean", "id").orderBy("id").toPandas()["cluster_id"]
    assert list(got) == list(reference_clusters(points, 0.5, 5, "euclidean"))


@pytest.mark.parametrize("limits", [{}, {"leaf_points": 12}])
def test_nearest(spark, limits):
    rng = np.random.default_rng(8)
    poi = pd.DataFrame({"id": np.arange(200), "lat": rng.uniform(-90, 90, 200), "lon": rng.uniform(-180, 180, 200)})
    asked = pd.DataFrame({"k": np.arange(80), "la": rng.uniform(-90, 90, 80), "lo": rng.uniform(-180, 180, 80)})
    asked.loc[3, "la"] = np.nan
    df = spark.createDataFrame(with_nulls(asked), "k long, la double, lo double")
    got = neighbours.nearest(df, "la", "lo", spark.createDataFrame(poi), 3, **limits).orderBy("k").toPandas()
    gap = haversine_block(asked[["la", "lo"]].fillna(0).to_numpy(), poi[["lat", "lon"]].to_numpy())
    for i in range(80):
        if i == 3:
            assert got["nearest_poi_id"][i] is None
        else:
            assert list(got["nearest_poi_id"][i]) == list(np.argsort(gap[i], kind="stable")[:3])
            assert np.allclose(got["nearest_poi_dist_km"][i], np.sort(gap[i])[:3], atol=1e-6)


@pytest.mark.parametrize("weights", ["uniform", "distance"])
@pytest.mark.parametrize("limits", [{}, {"broadcast_cells": 0, "leaf_points": 15}])
def test_knn_impute(spark, weights, limits):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"id": np.arange(160), "x": rng.normal(size=160).round(1), "y": rng.normal(size=160).round(1), "z": rng.normal(size=160)})
    for c, share in (("x", 0.2), ("y", 0.3), ("z", 0.2)):
        frame.loc[rng.random(160) < share, c] = np.nan
    df = spark.createDataFrame(with_nulls(frame), "id long, x double, y double, z double")
    got = neighbours.knn_impute(df, "z", "id", 4, weights, ["x", "y"], **limits).orderBy("id").toPandas()["z"]
    points, known = frame[["x", "y"]].to_numpy(), frame["z"].to_numpy()
    donors, want = np.flatnonzero(~np.isnan(known)), known.copy()
    for i in np.flatnonzero(np.isnan(known)):
        both = ~np.isnan(points[i]) & ~np.isnan(points[donors])
        gap = np.sqrt(np.where(both, (points[i] - points[donors]) ** 2, 0).sum(1) / np.maximum(both.sum(1), 1) * 3)
        usable = np.flatnonzero(both.any(1))
        chosen = usable[np.argsort(gap[usable], kind="stable")][:4]
        if not len(chosen):
            want[i] = np.nanmean(known)
        elif weights == "uniform":
            want[i] = known[donors[chosen]].mean()
        elif (gap[chosen] == 0).any():
            want[i] = known[donors[chosen]][gap[chosen] == 0].mean()
        else:
            want[i] = (known[donors[chosen]] / gap[chosen]).sum() / (1 / gap[chosen]).sum()
    assert np.allclose(got.astype(float), want)


def _gaps_frame(features, share, seed=8, n=300):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"id": np.arange(n)} | {c: rng.integers(-9, 9, n).astype(float) for c in features} | {"z": rng.normal(size=n)})
    for c in features:
        frame.loc[rng.random(n) < share, c] = np.nan
    frame.loc[rng.random(n) < 0.3, "z"] = np.nan
    return frame


@pytest.mark.parametrize("leaf_points", [4, 40, 1000])
def test_knn_impute_over_many_gap_patterns(spark, leaf_points):
    """Four features with gaps in any pattern: the tree gives what the broadcast search gives."""
    features = ["a", "b", "c", "e"]
    df = spark.createDataFrame(with_nulls(_gaps_frame(features, 0.4)), "id long, a double, b double, c double, e double, z double")
    small = neighbours.knn_impute(df, "z", "id", 3, "distance", features)
    large = neighbours.knn_impute(df, "z", "id", 3, "distance", features, broadcast_cells=0, leaf_points=leaf_points)
    a, b = ({r["id"]: r["z"] for r in x.collect()} for x in (small, large))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_knn_jobs_do_not_grow_with_the_patterns(spark):
    features, jobs = ["a", "b", "c", "e"], []
    for share in (0.0, 0.5):
        df = spark.createDataFrame(with_nulls(_gaps_frame(features, share)), "id long, a double, b double, c double, e double, z double")
        spark.sparkContext.setJobGroup(f"gaps {share}", "")
        neighbours.knn_impute(df, "z", "id", 3, "uniform", features, broadcast_cells=0, leaf_points=30).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"gaps {share}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[1] <= jobs[0] + 3


def test_isolation_forest(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"id": np.arange(400), "u": np.r_[rng.normal(size=396), [9, 9, -9, 8]], "v": np.r_[rng.normal(size=396), [9, -9, 8, 10]]})
    df = spark.createDataFrame(frame)
    got = isolation.isolation_forest(df, "u,v", "id", n_estimators=40, seed=1).orderBy("id").toPandas()["anomaly_score"]
    assert got[396:].max() < 0 < got[:396].median()
    again = isolation.isolation_forest(df.repartition(5), "u,v", "id", n_estimators=40, seed=1).orderBy("id").toPandas()["anomaly_score"]
    assert np.allclose(got, again)
    share = isolation.isolation_forest(df, "u,v", "id", n_estimators=40, contamination=0.05).filter("anomaly_score < 0").count()
    assert share == 20


@pytest.mark.parametrize("limits", [{}, {"leaf_points": 9}])
def test_nearest_on_a_grid_of_ties(spark, limits):
    """Equally near places, and several points at one place: the smaller ids, whatever the number of cells."""
    poi = [(i, float(lat), float(lon)) for i, (lat, lon) in enumerate((a, o) for a in range(-80, 81, 20) for o in range(-160, 161, 20))]
    poi += [(1000 + i, lat, lon) for i, lat, lon in poi[::3]]
    asked = [(float(a), float(o)) for a in range(-85, 86, 5) for o in range(-175, 176, 10)]
    df = spark.createDataFrame(asked, "la double, lo double")
    got = {(r["la"], r["lo"]): list(r["nearest_poi_id"]) for r in neighbours.nearest(df, "la", "lo", spark.createDataFrame(poi, "id int, lat double, lon double"), 3, **limits).collect()}
    gap = haversine_block(np.array(asked), np.array([p[1:] for p in poi])).round(6)
    for place, row in zip(asked, gap):
        assert got[place] == [poi[j][0] for j in sorted(range(len(poi)), key=lambda j: (row[j], poi[j][0]))[:3]]
