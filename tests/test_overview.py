"""Overviews of tables against pandas and brute force."""

from itertools import combinations

import numpy as np
import pytest

from tessera.operators import overview as O


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(i % 17) if i % 4 else None, float(i % 17) * 2 + r.random(), "ab"[i % 2], None if i % 4 == 0 else "x", f"2024-01-{1 + i // 3 % 28:02d}" if i % 10 else "soon") for i in range(120)]
    return rows, spark.createDataFrame(rows, "k int, x double, y double, kind string, gap string, day string")


def test_overview_and_facts(spark, table):
    rows, df = table
    one = O.table_overview(df, sampled=True).first()
    texts = sum(len(v) for r in rows for v in r[3:] if v is not None)
    assert (one["rows"], one["columns"], one["missing_cells"], one["sampled"]) == (120, 6, 60, True)
    assert one["value_bytes"] == 120 * 4 + 90 * 8 + 120 * 8 + texts and sum(one["semantic_counts"].values()) == 6
    facts = {(r["subject"], r["fact"]): r for r in O.all_facts(df, sampled=True).collect()}
    assert facts["x", "non_null"]["value"] == 90 and facts["*", "rows"]["value"] == 120 and facts["x", "median"]["value"] == np.median([r[1] for r in rows if r[1] is not None])
    assert {f["mode"] for f in facts.values()} == {"sampled"} and facts["day", "max_length"]["value"] == 10 and ("kind", "mean") not in facts
    empty = O.table_overview(df.limit(0)).first()
    assert (empty["rows"], empty["value_bytes"], empty["duplicate_rows"]) == (0, 0, 0)


def test_time_facts(spark, table):
    _, df = table
    (got,) = O.time_facts(df, ["day"], "k").collect()
    days = [np.datetime64(r[5]) for r in table[0] if r[5] != "soon"]
    gaps = np.diff(np.sort(days)).astype("timedelta64[s]").astype(float)
    assert (got["parsed"], got["parse_ratio"], got["duplicates"]) == (108, 0.9, 108 - len(set(days)))
    assert got["median_gap"] == np.median(gaps) and got["max_gap"] == gaps.max() and got["span_days"] == 27 and got["monotonic"] is False
    up = spark.createDataFrame([(1, "2024-01-01"), (2, None), (3, "2024-01-03"), (4, "2024-01-03")], "k int, d string")
    (got,) = O.time_facts(up, ["d"], "k").collect()
    assert got["monotonic"] is True and (got["duplicates"], got["median_gap"], got["duplicate_ratio"]) == (1, 86400.0, pytest.approx(1 / 3))
    none = O.time_facts(up.where("k = 2"), ["d"], "k").first()
    assert none["parse_ratio"] == 0 and none["min"] is None and none["median_gap"] is None and none["monotonic"] is None and none["duplicates"] == 0
    assert O.time_facts(up.limit(0), ["d"]).first()["parsed"] == 0


def test_ranked_associations(spark, table):
    rows, df = table
    got = O.ranked_associations(df, ["x", "y"], ["kind"]).collect()
    strength = {(r["a"], r["b"], r["method"]): r["strength"] for r in got}
    both = [(r[1], r[2]) for r in rows if r[1] is not None]
    assert strength["x", "y", "pearson"] == pytest.approx(abs(np.corrcoef(np.array(both).T)[0, 1])) and strength["x", "gap", "phi_of_nulls"] == pytest.approx(1)
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and all(a["strength"] >= b["strength"] for a, b in combinations(got, 2))
    assert len(O.ranked_associations(df, ["x", "y"], ["kind"], most=2).collect()) == 2
    chosen = O.ranked_associations(df).collect()
    assert {"x", "kind"} <= {c for r in chosen for c in (r["a"], r["b"])}
    assert O.ranked_associations(df.limit(0), ["x"], ["kind"]).collect() == []


def test_histogram_by(spark, table):
    rows, df = table
    x = np.array([r[1] for r in rows if r[1] is not None])
    kinds = np.array([r[3] for r in rows if r[1] is not None])
    for norm in ("count", "probability", "percent", "density"):
        got = {(r["kind"], r["bin"]): r for r in O.histogram_by(df, "x", "kind", 5, norm).collect()}
        for kind in "ab":
            n, edges = np.histogram(x[kinds == kind], 5, (x.min(), x.max()))
            y = {"count": n, "probability": n / n.sum(), "percent": 100 * n / n.sum(), "density": n / n.sum() / (edges[1] - edges[0])}[norm]
            for b in range(5):
                assert (got[kind, b]["n"], got[kind, b]["y"], got[kind, b]["lo"]) == (n[b], pytest.approx(y[b]), pytest.approx(edges[b])) if n[b] else (kind, b) not in got
    assert O.histogram_by(df.limit(0), "x").collect() == []
    same = O.histogram_by(df.selectExpr("1.5D AS v"), "v", norm="density").collect()
    assert [(r["bin"], r["n"], r["y"]) for r in same] == [(0, 120, None)]
    with pytest.raises(ValueError):
        O.histogram_by(df, "x", norm="shares")


def test_points_of_many_dimensions(spark, table):
    _, df = table
    assert O.points(df, "k", ["x", "y", "gap"], "kind").columns == ["k", "x", "y", "gap", "kind"] and O.points(df, "k", ["k", "x"], kind="parallel_coordinates").count() == 120
    with pytest.raises(ValueError):
        O.points(df, "k", [])


def test_outliers_and_targets(spark, table):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=95), [50, 60, -70, 80, 90]])
    df = spark.createDataFrame([(float(v), f"${v:,.3f}", 1.0, None) for v in x] + [(float("inf"), "n/a", 1.0, None), (float("nan"), None, 1.0, None)], "x double, t string, same double, none double")
    got = {v["column_name"]: v for v in O.outlier_table(df, ["x", "t", "same", "none"]).collect()}
    a, b = np.quantile(x, [0.25, 0.75])
    lo, hi = a - 1.5 * (b - a), b + 1.5 * (b - a)
    assert got["x"]["outliers"] == ((x < lo) | (x > hi)).sum() and got["x"]["lower"] == pytest.approx(lo) and got["x"]["p99"] == pytest.approx(np.quantile(x, 0.99)) and got["x"]["confidence"] == 0.78
    assert got["t"]["outliers"] == got["x"]["outliers"] and (got["same"]["outliers"], got["same"]["lower"], got["same"]["confidence"]) == (0, None, 0.66) and (got["none"]["outliers"], got["none"]["confidence"]) == (0, 0.0)
    assert O.outlier_table(df.select("t")).collect() == []
    named = spark.createDataFrame([(i, "yes" if i % 4 else "no") for i in range(40)] + [(40, None)], "k int, churn string")
    rows = O.target_summary(named, "churn").collect()
    assert [(v["value"], v["n"]) for v in rows] == [("yes", 30), ("no", 10), (None, 1)] and rows[0]["task"] == "binary_classification" and rows[1]["imbalance_ratio"] == pytest.approx(30 / 41)
    assert O.target_summary(named).collect() == [] and O.target_summary(named, sure=0.5).first()["source"] == "inferred"
    with pytest.raises(ValueError):
        O.target_summary(named, "gone")


def test_candidates_by_value(spark):
    from tessera.operators import rules as R

    df = spark.createDataFrame([(i, f"2024-02-{1 + i % 27:02d}", float(i * 7 % 31), i % 2) for i in range(60)], "order_id int, created_at string, amount double, churn int")
    scores = {r["column_name"]: r["score"] for r in R.target_candidates(df).collect()}
    assert scores["churn"] == 0.86 and "order_id" not in scores and "created_at" not in scores and max(scores, key=scores.get) == "churn"
    assert {r["column_name"]: r["score"] for r in R.time_candidates(df).collect()} == {"created_at": 0.88}
    assert {r["column_name"]: r["score"] for r in R.target_candidates(df, "amount").collect()}["amount"] == 0.99


def test_components_and_clusters_by_value(spark):
    from tessera.operators import modeling as M

    r = np.random.default_rng(3)
    x = r.normal(size=(80, 3)) @ np.diag([3.0, 1.0, 0.2]) + r.normal(size=(80, 1))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k int, a double, b double, c double")
    got = np.array([v["pc"] for v in M.pca_project(df, ["a", "b", "c"]).orderBy("k").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(z @ vt[:2].T), atol=1e-8) and M.pca_project(df, ["a", "b", "c"]).first()["explained"] == pytest.approx((s[:2] ** 2).sum() / (s**2).sum())
    far = spark.createDataFrame([(i, float(i % 3 * 100 + i % 5), float(i % 3 * -50)) for i in range(90)], "k int, a double, b double")
    made = M.kmeans(far, ["a", "b"], 3).select("k", "cluster").collect()
    assert len({(v["k"] % 3, v["cluster"]) for v in made}) == 3


def test_settled_stream_of_sessions(spark, tmp_path):
    from tessera.streaming import incremental as I

    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:10:00"), (2, None)], "user_id int, ts string").selectExpr("user_id", "timestamp(ts) AS ts").write.parquet(str(tmp_path / "in"))
    stream = I.read_stream(spark, str(tmp_path / "in"), "user_id int, ts timestamp")
    assert sorted((r["user_id"], str(r["start"])[11:16], r["n"]) for r in I.settled(I.sessions(stream)).collect()) == [(1, "00:00", 2), (1, "02:00", 1), (2, "00:10", 1)]
    assert I.settled(stream, "append").count() == 5
