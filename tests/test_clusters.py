"""Bottom-up and density clusters, nearest rows and components against brute force."""

import random

import numpy as np
import pytest

from tessera.operators import clusters, graph


def brute_ward(points, weights, k):
    groups = [([i], np.array(p, float), float(w)) for i, (p, w) in enumerate(zip(points, weights))]
    heights = []
    while len(groups) > k:
        best = min((2 * a[2] * b[2] / (a[2] + b[2]) * ((a[1] - b[1]) ** 2).sum(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        a, b = groups[best[1]], groups[best[2]]
        heights.append(best[0] ** 0.5)
        groups = [g for n, g in enumerate(groups) if n not in best[1:]] + [(a[0] + b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2])]
    return {frozenset(g[0]) for g in groups}, heights


def blobs(n=90, seed=1, d=2):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(c, 0.7, (n // 3, d)) for c in (0, 5, 11)]).round(3)


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_hierarchical_is_ward(spark, k):
    points = blobs()
    points[40] = points[41]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, x double, y double").repartition(3)
    got = {}
    for r in clusters.hierarchical(df, ["x", "y"], k).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    z = (points - points.mean(axis=0)) / points.std(axis=0)
    want, heights = brute_ward(z, [1] * len(z), k)
    assert {frozenset(x) for x in got.values()} == want and sorted(got) == list(range(k))
    found = clusters.dendrogram(df, ["x", "y"]).orderBy("merge").collect()
    all_heights = [h for h in brute_ward(z, [1] * len(z), 1)[1] if h > 1e-9]
    assert np.allclose([r["height"] for r in found], all_heights) and found[-1]["size"] == 90
    kids = [x for r in found for x in (r["left"], r["right"])]
    assert sorted(kids) == list(range(len(kids))) and all(max(r["left"], r["right"]) < r["merge"] for r in found)


def test_hierarchical_over_micro_clusters(spark):
    points = blobs(600, 2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(600, None, 5.0)], "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in clusters.hierarchical(df, ["x", "y"], 3, micro=40).collect()}
    assert len(got) == 601 and len({got[i] for i in range(200)}) == 1 and len({got[i] for i in range(0, 600, 200)}) == 3
    assert [got[i] for i in range(600)].count(got[0]) == 200
    empty = spark.createDataFrame([], "id long, x double, y double")
    assert clusters.hierarchical(empty, ["x", "y"]).collect() == [] and clusters.dendrogram(empty, ["x", "y"]).collect() == []


def brute_dbscan(v, eps, least):
    near = ((v[:, None] - v[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label = [-1] * len(v)
    for i in range(len(v)):
        if core[i] and label[i] == -1:
            stack, label[i] = [i], i
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if label[j] == -1:
                        label[j] = i
                        stack.append(j)
    return [label[i] if core[i] else min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(v))]


@pytest.mark.parametrize("d, eps, part", [(1, 0.05, 4096), (2, 0.35, 4096), (3, 0.6, 5), (4, 1.0, 4096)])
def test_dbscan(spark, monkeypatch, d, eps, part):
    monkeypatch.setattr(clusters, "PART", part)
    v = blobs(240, 3, d)
    v[:30] = v[0]  # a dense cell of equal points
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)] + [(999, *[None] * d)], "id long, " + ", ".join(f"x{j} double" for j in range(d))).repartition(3)
    got = {r["id"]: r["cluster"] for r in clusters.dbscan(df, "id", [f"x{j}" for j in range(d)], eps, 5).collect()}
    assert got.pop(999) == -1 and [got[i] for i in range(len(v))] == brute_dbscan(v, eps, 5)
    assert len(set(got.values())) > 1


def test_dbscan_lists_no_pairs_in_a_dense_cell(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select("id", (F.col("id") % 141 / 1000).alias("x"), (F.col("id") / 200_000).alias("y")).union(spark.createDataFrame([(20_000, 5.0, 5.0), (20_001, 0.5, 0.1)], "id long, x double, y double"))
    got = clusters.dbscan(df, "id", ["x", "y"], 0.5, 5).groupBy("cluster").count().collect()
    assert sorted(map(tuple, got)) == [(-1, 1), (0, 20_001)]


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(200, 200), (300, 299), (300, 299)] + [(400, 401 + i) for i in range(30)]
    got = {x["id"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}

    def root(v):
        return v if parent[v] == v else root(parent[v])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {v: root(v) for v in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- nearest rows ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("method, weights", [("mean", "uniform"), ("mean", "distance"), ("vote", "uniform"), ("vote", "distance")])
def test_nearest_rows_by_cells(spark, method, weights):
    from tessera.operators import neighbours

    v = blobs(300, 6)
    v[7], label = v[8], [i % 4 for i in range(300)]
    d = spark.createDataFrame([(i, float(v[i][0]), float(v[i][1]), float(label[i])) for i in range(300)], "id int, x double, y double, label double").repartition(3)
    got = {r["id"]: r["prediction"] for r in neighbours.knn_predict(d, d.where("id % 3 = 1"), ["x", "y"], "label", "id", 5, (20, 15), method, weights, per_cell=25).collect()}
    for i in range(1, 300, 3):
        near = sorted((((v[j] - v[i]) ** 2).sum(), j) for j in range(300) if j != i)[:5]
        w = [1.0] * 5 if weights == "uniform" else [float(d == 0) for d, _ in near] if near[0][0] == 0 else [1 / d**0.5 for d, _ in near]
        votes = {x: sum(a for a, (_, j) in zip(w, near) if label[j] == x) for x in range(4)}
        want = max(sorted(votes), key=lambda x: votes[x]) if method == "vote" else sum(a * label[j] for a, (_, j) in zip(w, near)) / sum(w)
        assert got[i] == pytest.approx(want)


def test_far_cells_are_not_read(spark):
    from tessera.operators import neighbours

    v = blobs(600, 7)
    d = spark.createDataFrame([(i, v[i].tolist(), 0.0) for i in range(600)], "id int, v array<double>, label double")
    cells = neighbours.build_cells(d, ["v"], "label", "id", per_cell=30)
    queries = d.select("id", "v")
    found = neighbours.nearest_rows(cells, queries, 3)
    kth = found.groupBy("id").agg({"d": "max"}).toDF("id", "kth")
    read = neighbours.probes_of(cells, queries, 3, False).count() + neighbours.probes_of(cells, queries.join(kth, "id").select("id", "v", "kth"), 3, True).count()
    assert len(cells.centres) == 20 and found.count() == 1800 and read < 0.35 * 600 * 20
