"""Reports of models and scans against brute force on small tables."""

import numpy as np
import pytest

from tessera.operators import modeling as M
from tessera.operators import reports as R


def test_class_report_and_auc(spark):
    r = np.random.default_rng(4)
    y, p = r.integers(0, 3, 200), r.integers(0, 4, 200)
    s = np.round(r.random((200, 3)), 1)
    df = spark.createDataFrame([(int(a), int(b), c.tolist()) for a, b, c in zip(y, p, s)], "label int, prediction int, probability array<double>")
    for x in R.class_report(df).collect():
        k = x["label"]
        tp, made, is_ = ((y == k) & (p == k)).sum(), (p == k).sum(), (y == k).sum()
        assert x["support"] == is_ and x["precision"] == pytest.approx(tp / made) and x["recall"] == pytest.approx(tp / is_ if is_ else 0) and x["f1"] == pytest.approx(2 * tp / (made + is_))
    for x in R.auc_one_vs_rest(df).collect():
        pos, neg = s[y == x["label"], x["label"]], s[y != x["label"], x["label"]]
        assert x["auc"] == pytest.approx(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)))
    assert R.class_report(df.limit(0)).collect() == [] and R.auc_one_vs_rest(df.limit(0)).collect() == []


def test_residual_bins_and_samples(spark):
    r = np.random.default_rng(5)
    e = r.normal(size=300).round(3)
    df = spark.createDataFrame([(i, 1.0, 1.0 + float(x)) for i, x in enumerate(e)] + [(300, None, 1.0)], "k int, label double, prediction double")
    count, edges = np.histogram(e, 8)
    got = R.residual_bins(df, 8).orderBy("bin").collect()
    assert [x["n"] for x in got] == list(count) and np.allclose([x["start"] for x in got], edges[:-1]) and np.allclose(got[-1]["end"], edges[-1])
    same = R.residual_bins(spark.createDataFrame([(1.0, 3.0)] * 4, "label double, prediction double")).collect()
    assert [(x["bin"], x["start"], x["end"], x["n"]) for x in same] == [(0, 2.0, 2.0, 4)] and R.residual_bins(df.limit(0)).collect() == []
    sample = R.prediction_sample(df, "k", 7).collect()
    assert len(sample) == 7 and all(x["residual"] is None or abs(x["prediction"] - x["actual"]) == x["absolute_error"] for x in sample)
    assert R.prediction_sample(df, "k", 7, numeric=False).columns == ["k", "actual", "prediction"]


def test_contributions_have_names_and_add_up(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), "ab"[i % 2], 2.0 * (i % 7) + 10 * (i % 2)) for i in range(84)], "k int, x double, z double, g string, label double")
    model = M.fit(df, ["x", "z"], ["g"], "linear", "regression")
    pred = model.transform(df)
    parts = R.named_contributions(model, pred, "k").collect()
    assert {p["feature"] for p in parts} >= {"x", "z"} and any(p["feature"].startswith("g=") for p in parts)
    total = {}
    for p in parts:
        total[p["k"]] = total.get(p["k"], 0) + p["contribution"]
    assert all(total[x["k"]] + model.stages[-1].intercept == pytest.approx(x["prediction"]) for x in pred.collect())
    first = R.named_contributions(model, pred, "k", top=1).collect()
    assert len(first) == 84


def test_sorted_charts_and_conversions(spark):
    df = spark.createDataFrame([("b", "9"), ("a", "10"), ("c", None), (None, "x")], "x string, y string")
    assert [r["x"] for r in R.sort_visual(df, "x_descending", "x", "y").collect()] == ["c", "b", "a", None]
    assert [r["y"] for r in R.sort_visual(df, "y_ascending", "x", "y").collect()][:2] == ["9", "10"]
    assert R.sort_visual(df, "auto", "x", "y") is df
    raw = spark.createDataFrame([(f"{i % 10}000", f"2024-01-{i % 28 + 1:02d}", "yes" if i % 2 else "no", "word") for i in range(40)], "price string, day string, flag string, same string")
    got = R.apply_suggested_conversions(raw)
    kinds = dict(got.dtypes)
    assert kinds["price"] == "double" and kinds["day"] == "timestamp" and kinds["flag"] == "int" and kinds["same"] == "string"
    assert {(r["price"], r["flag"]) for r in got.collect()} == {(i % 10 * 1000.0, i % 2) for i in range(40)}


def test_numeric_distribution(spark):
    x = np.concatenate([np.arange(1.0, 100.0), [10_000.0]])
    r = R.numeric_distribution(spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("inf"),), (float("nan"),)], "x double"), "x").first()
    assert r["non_null"] == 100 and r["skewed"] and r["outliers"] == 1 and r["median"] == 50.5 and r["top_1pct_share"] == pytest.approx(10_000 / x.sum())


def test_amounts_are_told_by_their_names(spark):
    from tessera.operators.rules import semantic_types

    df = spark.createDataFrame([(float(i % 50) * 1.5, float(i % 50) * 1.5) for i in range(200)], "total_price double, height double")
    got = {r["column_name"]: {h["type"]: h["confidence"] for h in r["hypotheses"]} for r in semantic_types(df).collect()}
    assert got["total_price"]["nonnegative_amount"] == 0.72 and got["total_price"]["amount"] == 0.88
    assert "nonnegative_amount" not in got["height"] and got["height"]["numeric"] == 0.72
