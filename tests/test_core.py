"""Golden values on small frames, invariants, and independence of the partitioning."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import assess as A
from tessera.operators import charts as G
from tessera.operators import clean as K
from tessera.operators import order as O
from tessera.operators import modeling as M
from tessera.operators import profile as P
from tessera.operators import rules as R
from tessera.operators import stats as S
from tessera.operators import views as V
from tessera.sources import readers
from tessera.sources.states import StateStore


def col(df, c, by):
    return [r[c] for r in df.orderBy(by).collect()]


def test_names():
    assert C.clean_names(["Sale Price", "Owner Name", "123 Weird %", "Sale-Price"]) == ["sale_price", "owner_name", "col_123_weird", "sale_price_2"]


def test_rolling_and_cumulative(spark):
    d = spark.createDataFrame([(i, i) for i in range(1, 6)], "day int, amount int")
    assert col(G.rolling_stat(d, "day", "amount", 3), "rolling", "day") == [1, 1.5, 2, 3, 4]
    assert col(G.cumulative_sum(d, "day", "amount"), "cumulative", "day") == [1, 3, 6, 10, 15]


def test_weighted_mean_and_percentile(spark):
    d = spark.createDataFrame([("A", 10, 1), ("A", 20, 3), ("B", 100, 1), ("B", 200, 1)], "s string, price int, w int")
    assert col(G.weighted_mean(d, ["s"], "price", "w"), "y", "s") == [17.5, 150]
    assert col(G.group_agg(d, ["s"], "price", "p90"), "y", "s") == [19, 190]


def test_shares(spark):
    d = spark.createDataFrame([("A", 10), ("A", 30), ("B", 40), ("C", 20)], "s string, y int")
    t = G.value_transform(G.group_agg(d, ["s"], "y"), "y", "percent_total")
    assert sorted(r["transformed"] for r in t.collect()) == [20, 40, 40]


def test_flags_with_null_policy(spark):
    d = spark.createDataFrame([(1, "Y"), (2, "N"), (3, "Yes"), (4, None), (5, "missing")], "i int, f string")
    assert col(K.unify_binary_flags(d, ["f"], "int", "treat_as_false"), "f", "i") == [1, 0, 1, 0, 0]
    with pytest.raises(Exception, match="no flag"):
        K.unify_binary_flags(d, ["f"], "bool").collect()


def test_dates_in_mixed_formats(spark):
    d = spark.createDataFrame([("2025-01-01",), ("01/05/2025",), ("Feb 1 2025",), ("missing",), ("2025/03/01",)], "t string")
    assert [str(r["t"])[:10] for r in K.parse_datetime(d, "t").collect()] == ["2025-01-01", "2025-01-05", "2025-02-01", "None", "2025-03-01"]


def test_outliers_and_imputation(spark):
    d = spark.createDataFrame([(10, 1.0), (11, None), (12, 3.0), (13, float("nan")), (10000, 5.0)], "x int, y double")
    assert col(K.clean_numeric_outliers(d, {"x": ("iqr", "flag")}), "x_is_outlier", "x") == [0, 0, 0, 0, 1]
    assert K.clean_numeric_outliers(d, {"x": ("iqr", "drop")}).count() == 4
    assert col(K.impute_missing(d, {"y": "median"}), "y", "x") == [1, 3, 3, 3, 5]
    assert col(K.add_missing_indicators(d, ["y"]), "y_was_missing", "x") == [0, 1, 0, 1, 0]


def test_geo_swap(spark):
    d = spark.createDataFrame([(0, 120.0, 30.0), (1, 25.7, -80.2)], "i int, lat double, lon double")
    assert [tuple(r)[1:] for r in K.geo_fix(d, "lat", "lon", "swap_likely").orderBy("i").collect()] == [(30.0, 120.0), (25.7, -80.2)]


def test_dedupe(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert K.dedupe(d, ["k"], "first", "v").count() == 2 and K.dedupe(d, ["k"], "none").count() == 1
    with pytest.raises(ValueError):
        K.dedupe(d, ["k"])


@pytest.mark.parametrize("parts", [1, 7])
def test_global_order(spark, parts):
    import random

    values = [random.Random(1).randint(0, 50) for _ in range(1)] + [random.Random(i).randint(0, 50) for i in range(400)]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(parts)
    run = {r["i"]: r["s"] for r in O.with_running(d, "v", {"s": F.lit(1)}, ["i"]).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert [run[i] for i in order] == list(range(1, len(values) + 1))
    lag = {r["i"]: r["previous"] for r in O.with_lag(d, "v", "v", tie=["i"]).collect()}
    assert [lag[i] for i in order] == [None] + [values[i] for i in order[:-1]]


def test_constant_and_empty_columns(spark):
    d = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    m = {r["column_name"]: r for r in P.numeric_metrics(d).collect()}
    assert m["a"]["skew"] == 0 and m["b"]["mean"] is None
    assert S.pearson_matrix(d, ["a", "b"]).first()["r"] is None
    assert {r["issue"] for r in R.issues(d).collect()} >= {"constant", "mostly_missing", "duplicate_rows"}


def test_lorenz_is_monotone(spark):
    d = spark.createDataFrame([(float(i * i),) for i in range(60)], "v double")
    rows = [tuple(r) for r in S.lorenz_curve(d, "v").orderBy("row_share").collect()]
    assert rows == sorted(rows) and abs(rows[-1][1] - 1) < 1e-9 and all(a <= r + 1e-9 for r, a in rows)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;a\n2;b\n")
    assert readers.read_table(spark, str(tmp_path / "a.csv")).columns == ["x", "y"]
    (tmp_path / "b.txt").write_text("x y\n1  a\n2 b\n")
    assert readers.read_table(spark, str(tmp_path / "b.txt")).count() == 2
    (tmp_path / "c.json").write_text('{"results": [{"a": {"b": 1}}, {"a": {"b": 2}}]}')
    assert readers.read_table(spark, str(tmp_path / "c.json")).columns == ["a.b"]
    (tmp_path / "d.geojson").write_text('{"features": [{"properties": {"n": "p"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}]}')
    assert readers.read_table(spark, str(tmp_path / "d.geojson")).first()["latitude"] == 2.5
    import zipfile

    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("m.csv", "h\n1\n")
    assert readers.read_zip(spark, str(tmp_path / "e.zip")).count() == 2 and readers.list_zip(spark, str(tmp_path / "e.zip")).count() == 1


def test_states_replay_and_delete(spark, tmp_path):
    d = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "city string, price int")
    store = StateStore(spark, f"file://{tmp_path}/store")
    root = store.save(d, "root")
    view = {"filters": [{"column": "price", "op": "greater", "value": 1}]}
    leaf = store.save(V.apply_view(d, view), "leaf", root, "view", view)
    assert store.replay(leaf, d).exceptAll(store.load(leaf)).count() == 0 and store.path(leaf).count() == 2 and store.tree(root).count() == 2
    store.register("cheap", "SELECT * FROM {df} WHERE price < 3")
    assert store.run_flow(d, [("cheap", {})]).count() == 2
    assert set(store.delete(root)) == {root, leaf}


def test_assessment_and_presets(spark, tmp_path):
    m = spark.createDataFrame([(0.8,), (0.5,), (-0.1,), (None,)], "r2 double")
    assert [r["rating"] for r in A.model_assessment(m, "regression").collect()] == ["strong", "promising", "poor", "needs_review"]
    d = spark.createDataFrame([(1, "Y", 1.0), (2, "N", 2.0), (3, "Y", 4.0)], "i int, f string, x double")
    plan = K.cleaning_plan(d)
    assert {r["action"] for r in A.cleaning_preset(plan, "safe_defaults").collect()} == {"binary_mapping"} and A.cleaning_preset(plan, "audit_all").count() == plan.count()
    with pytest.raises(ValueError):
        A.cleaning_preset(plan, "other")
    assert A.task_inference(d, "f").first()["task"] == "binary_classification"
    assert A.write_predictions(d.select("i", F.col("x").alias("label"), F.lit(1.0).alias("prediction")), f"file://{tmp_path}/p", ["i"]).count() == 3


def test_grid_search_and_separation(spark):
    d = spark.createDataFrame([(i, float(i), 2.0 * i + 1) for i in range(60)], "i int, x double, label double")
    found = A.grid_search(d, "i", ["x"], [], "linear", "regression", {"regParam": [0.0, 50.0]}).orderBy("rank").collect()
    assert found[0]["params"] == "regParam=0.0" and found[0]["mean"] > 0.99 and found[0]["folds"] == 3
    c = spark.createDataFrame([(0, 0.0), (0, 2.0), (1, 10.0), (1, 12.0)], "cluster int, v double")
    r = A.cluster_separation(c, ["v"]).first()
    assert (r["clusters"], r["calinski_harabasz"], r["davies_bouldin"]) == (2, 50.0, 0.2)


def test_no_group_holds_all_values(spark):
    d = spark.createDataFrame([(i, "yes" if i % 3 else "no", "x" if i % 2 else None, f"bad{i:03}") for i in range(200)], "id int, flag string, one string, text string")
    got = {r["column_name"]: tuple(r)[1:] for r in R.binary_profile(d).collect()}
    assert got == {"flag": ("clean_binary", 0.98, False, "no", "yes"), "one": ("single_observed_binary_state", 0.55, True, "x", None)}
    assert "collect" not in R.binary_profile(d)._jdf.queryExecution().toString()
    assert tuple(K.invalid_count(d, "text").first()) == (200, [f"bad{i:03}" for i in range(8)])
    assert tuple(K.invalid_count(d, "flag", "numeric").first()) == (200, ["no", "yes"])
    assert tuple(K.invalid_count(d.select(F.col("id").cast("string").alias("id")), "id").first()) == (0, [])
    assert "collect_set" not in K.invalid_count(d, "text")._jdf.queryExecution().toString()


def test_stratified_split_sorts_no_whole_class(spark):
    from pyspark.sql import Window

    d = spark.createDataFrame([(i, "a" if i % 10 else None if i % 20 else "b") for i in range(2000)] + [(5000, "single")], "id int, label string")
    got = M.stratified_split(d, "id", "label")
    rank = F.percent_rank().over(Window.partitionBy("label").orderBy(C.hash_order(["id"]), "id"))
    want = d.withColumn("is_test", rank < 0.25)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x and "__hash" in x]
    assert windows and all("__range" in x for x in windows)


def test_one_hot_encode_loses_no_level(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST_LEVELS", 3)
    d = spark.createDataFrame([(i, f"v{i % 4}") for i in range(8)], "id int, c string")
    with pytest.raises(ValueError, match="over 3 levels"):
        K.one_hot_encode(d, "c")
    assert K.one_hot_encode(d.where("c <> 'v3'"), "c").columns == ["id", "c_v0", "c_v1", "c_v2"]
    assert K.one_hot_encode(d, "c", 2).columns == ["id", "c_v0", "c_v1", "c_Other"]
    monkeypatch.undo()
    with pytest.raises(ValueError, match="over 1000 levels"):
        K.one_hot_encode(spark.range(1001).selectExpr("id", "concat('v', id) AS c"), "c")


def test_positive_value_sees_all_values(spark):
    d = spark.range(2500).selectExpr("CASE WHEN id % 2 = 0 THEN 'Yes' ELSE concat('v', id) END AS c")
    assert G.positive_value(d, "c") == "Yes"
    assert G.positive_value(d.selectExpr("replace(c, 'Yes', 'often') AS c"), "c") == "often"
    assert G.positive_value(d.selectExpr("if(c = 'Yes', 'b', if(c < 'v2', 'a', 'b')) AS c"), "c") == "a"


def test_duplicate_documents_reads_the_text(spark, tmp_path):
    from tessera.plans import catalogue

    rows = [(1, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (3, "a c", "en", "s", 3), (4, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.queries()["duplicate_documents"](spark, str(tmp_path)).first()[0] == 1


def test_exact_quantiles_equal_numpy(spark):
    import numpy as np

    r = np.random.default_rng(3)
    cols = {"a": r.normal(size=997), "b": r.integers(0, 5, 997).astype(float), "c": np.full(997, 7.0), "d": r.exponential(size=997)}
    rows = [(*(float(v[i]) for v in cols.values()), None) for i in range(997)]
    d = spark.createDataFrame(rows + [(float("nan"), None, None, None, None)], "a double, b double, c double, d double, e double").repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]
    got = {x["column_name"]: x["q"] for x in O.exact_quantiles(d, [*cols, "e"], qs).collect()}
    assert got.pop("e") is None and all(np.allclose(got[c], np.quantile(v, qs)) for c, v in cols.items())
    assert O.quantiles_of(d.limit(0), "a", [0.5]) == [None]


def test_positive_value(spark):
    values = lambda xs: G.positive_value(spark.createDataFrame([(x,) for x in xs], "v string"), "v")
    assert values(["yes "] * 5 + ["true"] * 3 + ["zz"] * 9) == "yes " and values(["a"] * 3 + ["b"]) == "b" and values(["a"] * 3 + ["b", "c"]) == "a"
    assert values([f"k{i}" for i in range(3000)] + ["zz"] * 50) == "zz"


@pytest.mark.parametrize("days, bucket", [(44, "none"), (45, "day"), (120, "week"), (730, "month")])
def test_auto_bucket(spark, days, bucket):
    d = spark.sql(f"SELECT timestamp'2020-01-01 10:00:00' AS t UNION ALL SELECT timestamp'2020-01-01 10:00:00' + INTERVAL {days} DAY")
    assert G.auto_bucket(d, "t") == bucket


def test_flags_of_up_to_five_values(spark):
    rows = [("Y", "1", "x", "1", "yes", "p", i) for i in range(4)] + [("no", None, "y", "missing", "n/a", "q", 9), ("N", None, "y", None, "0", None, 10), ("yes", None, "x", "1", "Yes", "q", 11)]
    d = spark.createDataFrame(rows, "a string, is_b string, c string, d string, e string, has_f string, n int")
    got = {r["column_name"]: (r["kind"], r["confidence"], r["ambiguous"]) for r in R.binary_profile(d).collect()}
    assert got == {"a": ("clean_binary", 0.98, False), "is_b": ("positive_only_nullable_flag", 0.78, True), "c": ("binary_categorical", 0.72, True), "d": ("positive_only_nullable_flag", 0.64, True), "e": ("nullable_binary", 0.94, False), "has_f": ("binary_flag", 0.82, False)}


def test_issue_rules_and_insights(spark):
    rows = [(i % 50, 1000.0 if i == 0 else 0.001 * (i % 7 + 1), f"2024-01-0{i % 3 + 1}", "a" if i else "b", f"v{i}", "12" if i % 2 else "unknown", "same") for i in range(100)]
    d = spark.createDataFrame(rows + rows[:3], "k int, amount double, day string, t string, word string, num string, one string").withColumn("day", F.to_timestamp("day"))
    got = {(r["issue"], r["column_name"]) for r in R.issues(d, "t").collect()}
    assert got >= {("top_1pct_dominates", "amount"), ("duplicate_timestamps", "day"), ("constant", "one"), ("imbalanced_target", "t"), ("two_categories", "t"), ("high_cardinality", "word"), ("missing_like_tokens", "num"), ("duplicate_rows", "*")}
    order = [{"error": 3, "warning": 2, "info": 1}[r["severity"]] for r in R.issues(d, "t").collect()]
    assert order == sorted(order, reverse=True)
    twice = d.select("k", "k")
    assert [(r["issue"], r["column_name"], r["severity"]) for r in R.issues(twice).collect()] == [("duplicate_names", "k", "error")]
    said = [(r["insight"], r["column_name"]) for r in R.insights(d, "t").collect()]
    assert len(said) == len(set(said)) and {("target.selected", "t"), ("time.candidate", "day"), ("binary", "t"), ("issue.constant", "one")} <= set(said)


def test_every_chart_kind_has_data(spark):
    d = spark.createDataFrame([(float(i % 7), float(i), "ab"[i % 2], "xyz"[i % 3], i) for i in range(60)], "x double, y double, c string, g string, i int").withColumn("t", F.expr("timestamp'2024-01-01' + make_dt_interval(i)"))
    base = {"x": "x", "y": "y", "path": ["c", "g"], "target": "c"}
    own = {"calendar_heatmap": {"x": "t", "y": "y"}, "heatmap": {"x": "c", "y": "g"}, "target_profile": {"x": "g", "y": "c"}, "missingness_matrix": {"x": "i"}, "autocorrelation": {"x": "i", "y": "y"}, "bump_chart": {"x": "c", "y": "y", "color": "g"}, "violin": {"x": "c", "y": "y"}, "box": {"x": "c", "y": "y"}}
    kinds = [*G.SERIES, *G.ROW_CAPS, *G.OTHER_KINDS]
    assert len(set(kinds)) >= 38
    for k in kinds:
        assert G.chart_data(d, {"kind": k} | base | own.get(k, {})).count() > 0, k
    with pytest.raises(ValueError):
        G.chart_data(d, {"kind": "none such", "x": "x"})


def test_cluster_profile_is_the_mean_distance_from_the_overall_mean(spark):
    d = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0), (2, 6.0)], "cluster int, v double")
    assert M.cluster_profile(d, ["v"]).first()["separation"] == pytest.approx((abs(2 - 5) + abs(10 - 5) + abs(6 - 5)) / 3)


def test_replay_fails_with_a_reason(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}")
    d = spark.range(5)
    root = store.save(d, "root")
    odd = store.save(d, "odd", root, "no_such_step", {})
    with pytest.raises(ValueError, match="no_such_step"):
        store.replay(odd, d)


def test_range_clip_without_bounds_keeps_nulls(spark):
    d = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert V.range_clip(d, "v").count() == 2 and V.range_clip(d, "v", 0, 5).count() == 1


def test_reviews_and_presets(spark):
    d = spark.createDataFrame([(float(i), "Red" if i % 5 else "red ") for i in range(30)] + [(900.0, "Red"), (900.0, "Red"), (None, None)], "`Unit Price` double, colour string")
    review = K.review_plan(d)
    review = spark.createDataFrame(review.collect(), review.schema)
    got = {(r["action"], r["column_name"]): r["affected"] for r in review.collect()}
    assert got == {("column_rename_review", "__columns__"): 1, ("duplicate_row_review", "__rows__"): 1, ("missing_value_review", "Unit Price"): 1, ("missing_value_review", "colour"): 1, ("category_value_review", "colour"): 6, ("numeric_outlier_review", "Unit Price"): 2}
    plan = spark.createDataFrame(K.cleaning_plan(d).collect(), review.schema).unionByName(review)
    assert A.cleaning_preset(plan, "audit_all").count() == plan.count()
    assert {r["action"] for r in A.cleaning_preset(plan, "analysis_ready").collect()} == {"column_rename_review", "trim_strings"}
    done = K.apply_cleaning(d, A.cleaning_preset(plan, "power_review"))
    assert done.columns[0] == "unit_price" and done.where("unit_price_is_outlier = 1").count() == 2 and done.where("colour = 'red'").count() == 6
    empty = K.review_plan(d.limit(0))
    assert {r["action"] for r in empty.collect()} == {"column_rename_review"}


def test_kendall_counts_no_pairs(spark):
    import itertools
    import random

    random.seed(5)
    rows = [(random.randint(0, 9), random.randint(0, 6)) for _ in range(80)] + [(None, 1), (2, None)]
    whole = [r for r in rows if None not in r]
    pairs = [((a > c) - (a < c), (b > d) - (b < d)) for (a, b), (c, d) in itertools.combinations(whole, 2)]
    want = sum(x * y for x, y in pairs) / (sum(x != 0 for x, _ in pairs) * sum(y != 0 for _, y in pairs)) ** 0.5
    d = spark.createDataFrame(rows, "a int, b int")
    assert abs(S.kendall(d, "a", "b").first()[0] - want) < 1e-12
    assert S.kendall(d.where("a = 1"), "a", "b").first()[0] is None and S.kendall(d.limit(0), "a", "b").first()[0] is None


@pytest.mark.parametrize("blocks", [(2_048, 32_768), (3, 7)])
def test_nearest_rows_over_blocks(spark, blocks):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(0, 4, (60, 3)).astype(float)
    d = spark.createDataFrame([(i, v[i].tolist(), float(i % 7)) for i in range(60)] + [(60, None, 1.0)], "id int, v array<double>, label double")
    got = {r["id"]: r["prediction"] for r in M.knn_predict(d, d.where("id % 10 = 0"), ["v"], "label", "id", 4, blocks).collect()}
    assert set(got) == set(range(0, 60, 10))
    for i, p in got.items():
        near = sorted((((v[j] - v[i]) ** 2).sum(), j) for j in range(60) if j != i)[:4]
        assert abs(p - np.mean([j % 7 for _, j in near])) < 1e-12
    assert M.knn_predict(d.limit(0), d, ["v"], "label", "id").count() == 0


def test_fill_over_all_rows(spark):
    rows = [(i, None if i % 9 else float(i)) for i in range(3, 400)]
    d = spark.createDataFrame(rows, "i int, v double").repartition(7)
    held, want = None, []
    for i, v in rows:
        held = held if v is None else v
        want.append((i, held))
    assert [tuple(r) for r in K.fill_forward(d, "v", "i").orderBy("i").collect()] == want
    back = {r["i"]: r["v"] for r in K.fill_forward(d, "v", "i", backward=True).collect()}
    assert back[3] == 9.0 and back[10] == 18.0 and back[399] is None
    assert K.fill_forward(d.limit(0), "v", "i").count() == 0


def test_splits_and_associations_of_a_numeric_target(spark):
    rows = [(float(i), "a" if i < 40 else "b" if i < 70 else "c", (10.0 if i < 40 else 0.0) + i % 2) for i in range(100)] + [(5.0, None, 3.0), (None, "a", None)]
    d = spark.createDataFrame(rows, "x double, g string, y double")
    got = {r["feature"]: r for r in S.target_best_splits(d, "y", ["x"], ["g"], regression=True).collect()}
    assert got["g"]["level"] == "a" and 32 < got["x"]["threshold"] < 45 and got["g"]["gain"] > 20
    bits = {r["feature"]: r for r in S.target_best_splits(d.withColumn("y", F.col("y") > 5), "y", ["x"], ["g"]).collect()}
    assert bits["g"]["level"] == "a" and bits["g"]["gain"] > 0.9
    tied = {(r["feature"], r["method"]): r["strength"] for r in S.target_associations(d, "y", ["x"], ["g"]).collect()}
    assert tied["g", "median_spread"] == 1.0 and 0.8 < tied["x", "pearson"] < 1
    assert S.target_best_splits(d.limit(0), "y", ["x"], ["g"], regression=True).count() == 0


def test_baseline_and_importance(spark):
    d = spark.createDataFrame([(i, float(i % 17), float(i % 5), float(i % 17) * 3) for i in range(400)], "i int, x double, z double, label double")
    m = {r["metric"]: (r["baseline"], r["model"]) for r in M.modeling_baseline(d, "i", ["x", "z"], [], "regression", "linear").collect()}
    assert m["r2"][0] < 0.1 and m["r2"][1] > 0.99 and m["mae"][1] < m["mae"][0]
    top = M.target_importance(d, "i", ["x", "z"], [], "regression").orderBy(F.desc("importance")).first()
    assert top["column_name"] == "x" and top["suspicion"] == "possible_leakage_or_proxy" and top["permutation"] > 0.5


def test_feature_select(spark):
    d = spark.createDataFrame([(i, "c", float(i % 7) * 1.5, "ab"[i % 2], float(i % 5), float(i % 5) + 1) for i in range(60)], "row_id int, same string, size double, kind string, sold double, sold_log double")
    got = {r["column_name"]: (r["role"], r["reason"]) for r in M.feature_select(d, "sold").collect()}
    assert got == {"row_id": ("drop", "identifier"), "same": ("drop", "constant"), "size": ("numeric", None), "kind": ("categorical", None), "sold": ("drop", "target"), "sold_log": ("drop", "target_derived")}
    chosen = {r["column_name"]: r["role"] for r in M.feature_select(d, "sold", ["row_id", "sold_log"], allow_derived=True).collect()}
    assert {c for c, role in chosen.items() if role == "numeric"} == {"row_id", "sold_log"} and chosen["size"] == "drop"
    assert M.derived_from("Price_per_foot", "list price") and not M.derived_from("size", "price")
