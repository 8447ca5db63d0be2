"""Exact quantiles by group, the density of violins and outliers of boxes against numpy."""

import numpy as np
import pytest

from tessera.operators import charts, clean, order


def rows_of(seed=1, n=4000):
    r = np.random.default_rng(seed)
    group = np.where(r.random(n) < 0.99, "hot", r.choice(["a", "b", "none"], n))
    x = np.where(group == "hot", r.integers(0, 3000, n) / 7, r.normal(0, 1e6, n))
    y = r.choice([1.0, 2.0, 2.0, 5.0], n)
    return [(None if g == "b" else str(g), float(a) if g != "none" and r.random() > 0.05 else None, float(b) if i % 17 else float("nan")) for i, (g, a, b) in enumerate(zip(group, x, y))]


@pytest.mark.parametrize("per_range", [4_000_000, 10])
def test_grouped_quantiles_with_a_group_of_nearly_all_rows(spark, monkeypatch, per_range):
    monkeypatch.setattr(order, "PER_RANGE", per_range)  # 10: some 400 ranges, cut by the bucketizer
    rows, qs = rows_of(), [0.0, 0.1, 0.5, 0.99, 1.0]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {r["g"]: r for r in order.grouped_quantiles(df, ["g"], ["x", "y"], qs).collect()}
    assert set(got) == {g for g, _, _ in rows}
    for g in got:
        for k, c in ((1, "x"), (2, "y")):
            have = [r[k] for r in rows if r[0] == g and r[k] is not None and r[k] == r[k]]
            assert (got[g][c] is None) == (not have) and (not have or np.allclose(got[g][c], np.quantile(have, qs)))
    whole = {r["column_name"]: r["q"] for r in order.exact_quantiles(df, ["x", "y"], qs).collect()}
    assert all(np.allclose(whole[c], np.quantile([r[k] for r in rows if r[k] is not None and r[k] == r[k]], qs)) for k, c in ((1, "x"), (2, "y")))
    assert order.grouped_quantiles(df.limit(0), ["g"], ["x"], [0.5]).collect() == []
    run = order.with_running(df.where("x is not null"), "x", {"k": __import__("pyspark").sql.functions.lit(1)}, tie=["y"]).collect()
    assert sorted(r["k"] for r in run) == list(range(1, len(run) + 1)) and [r["x"] for r in sorted(run, key=lambda r: r["k"])] == sorted(r["x"] for r in run)


def test_boxes_summaries_and_fills_by_group(spark):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    of = lambda g: [r[1] for r in rows if r[0] == g and r[1] is not None]
    for r in charts.box(df, "x", ["g"]).collect():
        have = of(r["g"])
        assert r["n"] == len(have) and (not have or np.allclose([r[k] for k in ("min", "q1", "median", "q3", "max")], np.quantile(have, [0, 0.25, 0.5, 0.75, 1])))
    fence = {g: (lambda a, b: (a - 1.5 * (b - a), b + 1.5 * (b - a)))(*np.quantile(of(g), [0.25, 0.75])) for g in {r[0] for r in rows} if of(g)}
    assert charts.box_outliers(df, "x", ["g"]).count() == sum(r[1] is not None and not fence[r[0]][0] <= r[1] <= fence[r[0]][1] for r in rows)
    assert {r["g"]: r["target_median"] for r in charts.group_target_summary(df, "x", ["g"]).collect()} == {g: float(np.median(of(g))) if of(g) else None for g in {r[0] for r in rows}}
    assert {r["g"]: r["y"] for r in charts.group_agg(df, ["g"], "x", "p90").collect()} == pytest.approx({g: np.quantile(of(g), 0.9) if of(g) else None for g in {r[0] for r in rows}})
    filled = clean.impute_missing(df, {"x": "median"}, by="g").collect()
    every = float(np.median([r[1] for r in rows if r[1] is not None]))
    want = sorted((r[0] or "", r[1] if r[1] is not None else float(np.median(of(r[0]))) if of(r[0]) else every) for r in rows)
    assert np.allclose([x for _, x in sorted((r["g"] or "", r["x"]) for r in filled)], [x for _, x in want])


def test_violin_is_a_kernel_density(spark):
    r = np.random.default_rng(5)
    data = {"a": r.normal(0, 1, 500), None: r.exponential(3, 300), "one": np.array([4.0] * 9)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None)], "g string, x double")
    got = {}
    for row in charts.violin(df, "x", ["g"], 64).orderBy("at").collect():
        got.setdefault(row["g"], []).append((row["at"], row["density"]))
    assert set(got) == {"a", None}
    for g, found in got.items():
        x = data[g]
        at, density = np.array(found).T
        q1, q3 = np.quantile(x, [0.25, 0.75])
        width = 0.9 * min(x.std(), (q3 - q1) / 1.34) * len(x) ** -0.2
        edges = np.linspace(x.min(), x.max(), 65)
        count = np.histogram(x, edges)[0]
        z = (at[:, None] - (edges[:-1] + edges[1:])[None] / 2) / width
        assert np.allclose(at, np.linspace(x.min(), x.max(), 64)) and np.allclose(density, (count * np.exp(-z * z / 2)).sum(axis=1) / (len(x) * width * np.sqrt(2 * np.pi)))
        exact = np.exp(-(((at[:, None] - x[None]) / width) ** 2) / 2).sum(axis=1) / (len(x) * width * np.sqrt(2 * np.pi))
        assert abs(density - exact).max() < 0.05 * exact.max()
