"""Permutations of all rows, and what a model loses by them, against numpy."""

import numpy as np

from tessera.operators import modeling as M


def test_permutation_importance(spark):
    r = np.random.default_rng(3)
    n = 400
    x, z = r.normal(size=n), r.normal(size=n)
    rows = [(i, float(x[i]), float(z[i]) if i % 9 else None, float(2 * x[i] + 0.5 * r.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, x double, z double, label double").repartition(4)
    dealt = {d["k"]: d for d in M.dealt_again(df, "k", ["x", "z"], 5).collect()}
    assert sorted(dealt) == list(range(n))
    for rep in range(5):
        values = [dealt[i]["__dealt"][rep]["x"] for i in range(n)]
        assert sorted(values) == sorted(x) and sum(a == b for a, b in zip(values, x)) < 12
    model = M.fit(df, ["x", "z"], [], "linear", "regression")
    got = {a["column_name"]: a for a in M.permutation_importance(model, df, "k", ["x", "z"]).collect()}
    y, fill = np.array([a[3] for a in rows]), np.median([a[2] for a in rows if a[2] is not None])
    design = np.column_stack([np.ones(n), x, [fill if a[2] is None else a[2] for a in rows]])
    w = np.linalg.lstsq(design, y, rcond=None)[0]
    r2 = lambda m: 1 - ((m @ w - y) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    for j, c in ((1, "x"), (2, "z")):
        losses = []
        for rep in range(5):
            m = design.copy()
            m[:, j] = [fill if dealt[i]["__dealt"][rep][c] is None else dealt[i]["__dealt"][rep][c] for i in range(n)]
            losses.append(r2(design) - r2(m))
        assert abs(got[c]["importance"] - np.mean(losses)) < 1e-6 and abs(got[c]["deviation"] - np.std(losses)) < 1e-6 and got[c]["repeats"] == 5
    assert got["x"]["importance"] > 1 and abs(got["z"]["importance"]) < 0.05


def test_bisecting_finds_all_its_clusters(spark):
    df = spark.createDataFrame([(i, float(i % 3) * 10 + (i % 7) / 10, float(i % 3)) for i in range(150)], "id int, x double, y double")
    assert M.bisecting(df, ["x", "y"], 3).groupBy("cluster").count().count() == 3


def test_rows_of_equal_values_are_scored_once(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, float(r.integers(3)), None if i % 11 == 0 else float(r.integers(4)), "ab"[r.integers(2)]) for i in range(900)]
    rows = [(*a, a[1] * 2 + (a[2] or 0) + float(r.normal()), None if a[0] % 50 == 0 else float(a[1] > 1)) for a in rows]
    df = spark.createDataFrame(rows, "k int, x double, z double, w string, label double, cls double").repartition(4)

    class Seen:
        def __init__(self, model):
            self.model = model

        def transform(self, d):
            self.rows = d.count()
            return self.model.transform(d)

    for task, score, d in (("regression", "r2", df.drop("cls")), ("regression", "neg_rmse", df.drop("cls")), ("classification", "accuracy", df.drop("label").withColumnRenamed("cls", "label"))):
        model = Seen(M.fit(d.where("label is not null"), ["x", "z"], ["w"], "random_forest", task))
        by = lambda: {a["column_name"]: a for a in M.permutation_importance(model, d, "k", ["x", "z", "w"], score, 2).collect()}
        few = by()
        assert model.rows <= 7 * 3 * 5 * 2 * 3
        with monkeypatch.context() as m:
            m.setattr(M, "prod", lambda _: 1 << 40)
            each = by()
        assert model.rows == 7 * 900
        for c, a in each.items():
            assert abs(few[c]["importance"] - a["importance"]) < 1e-9 and abs(few[c]["deviation"] - a["deviation"]) < 1e-9 and few[c]["repeats"] == 2
