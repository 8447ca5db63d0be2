"""Plans of model tables and reviews against small tables worked out by hand."""

import pytest

from tessera.operators import clean as K
from tessera.operators import preparation as A
from tessera.operators import rules as R


@pytest.fixture(scope="module")
def listings(spark):
    rows = [(101, "A", 100000, 900, "2025-01-01", 1, 1), (102, "B", 125000, 1100, "2025-02-01", 1, 0), (103, "A", 130000, None, "2025/03/01", 1, 1), (104, "C", 150000, 1400, None, 1, 0), (105, "B", 175000, 1600, "Apr 1 2025", 1, 1), (106, None, 180000, 1800, "2025-05-01", 1, 0)]
    return spark.createDataFrame(rows, "listing_id int, city string, list_price int, sqft int, sold_date string, constant int, sold int")


def test_plan_and_its_defaults(spark, listings):
    plan = A.model_table_plan(listings, "sold").cache()
    by_id = {r["id"]: r for r in plan.collect()}
    assert {"review_target:sold", "drop_identifier:listing_id", "impute_missing:sqft", "impute_missing:city", "encode_one_hot:city", "add_date_features:sold_date", "drop_constant:constant", "scale_numeric:list_price", "add_ratio:list_price_per_sqft"} <= set(by_id)
    assert not any(r["by_default"] for i, r in by_id.items() if i.startswith(("scale", "add_ratio", "review"))) and not any(r["column_name"] == "sold" for r in by_id.values() if r["action"] != "review_target")
    got = A.apply_model_table(listings, plan)
    assert {"sold", "city_A", "city_B", "sqft_was_imputed", "sold_date_year", "sold_date"} <= set(got.columns) and not {"listing_id", "constant", "city"} & set(got.columns)
    assert [r[0] for r in got.orderBy("list_price").select("sqft").collect()] == [900, 1100, 1400, 1400, 1600, 1800]


def test_chosen_actions_and_settings(spark, listings):
    plan = A.model_table_plan(listings, "sold").cache()
    ratio = A.apply_model_table(listings, plan, ["add_ratio:list_price_per_sqft"])
    assert ratio.columns == [*listings.columns, "list_price_per_sqft"] and ratio.where("listing_id = 101").first()["list_price_per_sqft"] == 100000 / 900 and ratio.where("listing_id = 103").first()["list_price_per_sqft"] is None
    scaled = A.apply_model_table(listings, plan, ["scale_numeric:list_price"]).selectExpr("avg(list_price)", "stddev_pop(list_price)").first()
    assert scaled[0] == pytest.approx(0) and scaled[1] == pytest.approx(1)
    own = A.apply_model_table(listings, plan, controls={"impute_missing:city": {"strategy": "constant", "fill_value": "Unknown"}})
    assert [r[0] for r in own.orderBy("list_price").select("city_Unknown").collect()] == [0, 0, 0, 0, 0, 1]
    few = A.apply_model_table(listings, plan, controls={"encode_one_hot:city": {"max_categories": "1"}})
    assert {"city_A", "city_Other"} <= set(few.columns) and "city_B" not in few.columns
    with pytest.raises(ValueError, match="no action"):
        A.apply_model_table(listings, plan, ["scale_numeric:sold"])


def test_coordinates_by_name(spark):
    rows = [("25.76", -80.19, 1.0), ("26.1", -81.0, 200.0), ("120.0", 25.7, None), ("91.0", -181.0, float("nan")), (None, 190.0, 3.0), ("x", 2.0, 4.0)]
    df = spark.createDataFrame(rows, "home_latitude string, home_longitude double, lng double")
    assert A.coordinate_pairs(["shop_lat", "b_lon", "shop_lon", "lat", "x"]) == [("shop_lat", "shop_lon"), ("lat", "b_lon")]
    got = {r["column_name"]: r for r in A.coordinate_review(df).collect()}
    pair = got["home_latitude,home_longitude"]
    assert (pair["invalid"], pair["likely_swapped"], pair["affected"], pair["confidence"]) == (3, 1, 3, 0.72) and (pair["lat_min"], pair["lat_max"]) == (25.76, 120.0)
    assert (got["lng"]["invalid"], got["lng"]["affected"], got["lng"]["confidence"], got["lng"]["lat_min"]) == (1, 1, 0.68, None)
    assert A.coordinate_review(df.select("lng").where("lng < 5")).collect() == [] and A.coordinate_review(spark.range(3)).collect() == []
    gone = A.apply_reviews(df, {"geo_coordinate_review:home_latitude,home_longitude": {"treatment": "null_invalid"}, "geo_coordinate_review:lng": {"treatment": "null_invalid"}}).collect()
    assert [r["home_longitude"] for r in gone] == [-80.19, -81.0, None, None, None, 2.0] and gone[1]["lng"] is None and gone[0]["lng"] == 1.0
    n = df.selectExpr("try_cast(home_latitude AS double) AS lat", "home_longitude AS lon")
    swapped = A.apply_reviews(n, {"geo_coordinate_review:lat,lon": {"treatment": "swap_likely"}}).collect()
    assert tuple(swapped[2]) == (25.7, 120.0) and tuple(swapped[3]) == (91.0, -181.0)


def test_reviews_of_the_cleaning_plan(spark):
    df = spark.createDataFrame([("Y", 1, 25.0, -80.0), ("N", None, 26.0, -81.0), ("Yes", 1, 120.0, 25.0), (None, None, 91.0, -181.0)], "listed_flag string, pool_flag int, latitude double, longitude double")
    plan = {(r["action"], r["column_name"]): r for r in A.every_review(df).collect()}
    assert plan["geo_coordinate_review", "latitude,longitude"]["affected"] == 2
    assert plan["binary_mapping_review", "pool_flag"]["affected"] == 2 and ("binary_mapping_review", "listed_flag") not in plan
    assert K.apply_cleaning(df, A.every_review(df).where("action in ('geo_coordinate_review', 'binary_mapping_review')")).collect() == df.collect()
    got = A.apply_reviews(df, {"binary_mapping_review:pool_flag": {"mapping": {"1": 1}, "null": 0}, "category_value_review:listed_flag": {"mapping": {"yes": "Y"}}}).collect()
    assert [r["pool_flag"] for r in got] == [1, 0, 1, 0] and [r["listed_flag"] for r in got] == ["Y", "N", "Y", None]
    with pytest.raises(ValueError, match="no review"):
        A.apply_reviews(df, {"other:latitude": {}})


@pytest.mark.parametrize(
    "treatment, want",
    [("inspect", [2.0, None, 4.0, 4.0, None]), ("fill_mean", [2.0, 10 / 3, 4.0, 4.0, 10 / 3]), ("fill_median", [2.0, 4.0, 4.0, 4.0, 4.0]), ("fill_mode", [2.0, 4.0, 4.0, 4.0, 4.0]), ("fill_constant", [2.0, 9.0, 4.0, 4.0, 9.0]), ("forward_fill", [2.0, 2.0, 4.0, 4.0, 4.0]), ("back_fill", [2.0, 4.0, 4.0, 4.0, None]), ("drop_rows", [2.0, 4.0, 4.0])],
)
def test_treatments(spark, treatment, want):
    df = spark.createDataFrame(list(enumerate([2.0, None, 4.0, 4.0, None])), "k int, x double")
    got = A.treat_missing(df, "x", treatment, 9.0, "k", indicator=True).orderBy("k").collect()
    assert [r["x"] for r in got] == pytest.approx(want)
    assert treatment == "inspect" or [r["x_was_missing"] for r in got] == ([0, 0, 0] if treatment == "drop_rows" else [0, 1, 0, 0, 1])


def test_treatments_that_need_more(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert [r[0] for r in A.treat_missing(df, "x", "fill_missing_label").collect()] == ["a", "Missing"]
    assert A.treat_missing(df, "x", "add_indicator").columns == ["x", "x_was_missing"]
    for wrong in ("forward_fill", "guess"):
        with pytest.raises(ValueError):
            A.treat_missing(df, "x", wrong)


def test_shapes_and_flags(spark):
    shapes = lambda d, **kw: {r["shape"]: r["confidence"] for r in R.shape_hypotheses(d, **kw).collect()}
    sales = spark.createDataFrame([(i, f"2025-01-{1 + i % 28:02d}", 10.5 * i, f"{'words ' * 15}{i}", '{"a": %d}' % i, 40.0 + i / 10) for i in range(40)], "order_id int, sold_at string, price double, note string, extra string, latitude double")
    got = shapes(sales, target="price")
    assert got == {"dataframe": 1.0, "time_series": 0.72, "event_log": 0.82, "transaction_table": 0.72, "targeted_modeling_table": 0.85, "text_corpus": 0.65, "geospatial_points": 0.66, "nested_records": 0.7}
    wide = spark.range(3).selectExpr(*(f"rand({i}) * 100 + id * {i} AS x{i}" for i in range(12)))
    assert {"wide_sparse_matrix", "feature_matrix"} <= set(shapes(wide)) and "wide_sparse_matrix" not in shapes(sales)
    t = spark.createDataFrame([(1, "N/A", "v%d" % i, 1000.0 if i < 3 else float(i % 7)) for i in range(100)], "one int, gap string, name string, x double")
    flags = {r["column_name"]: r for r in R.column_flags(t).collect()}
    assert flags["one"]["constant"] and flags["gap"]["missing_like"] and not flags["name"]["missing_like"] and flags["x"]["iqr_outliers"] and flags["name"]["high_cardinality"] and not flags["x"]["high_cardinality"]
    assert not flags["name"]["iqr_outliers"] and not any(r["near_constant"] for r in flags.values())


def test_back_fill_treatment_takes_a_running_frame(spark):
    df = spark.createDataFrame([(i, None if i % 50 else float(i)) for i in range(1_000)], "i int, x double")
    got = A.treat_missing(df, "x", "back_fill", order_by="i", indicator=True)
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    last = {r["i"]: (r["x"], r["x_was_missing"]) for r in got.collect()}
    assert last[0] == (0.0, 0) and last[1] == (50.0, 1) and last[950] == (950.0, 0) and last[951] == (None, 1) and len(last) == 1_000


def test_modeling_plan_takes_all_medians_at_once(spark, monkeypatch):
    rows = [(i, None if i % 4 == 0 else float(i), None if i % 5 == 0 else i % 9 + 0.5, "xyz"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, a double, b double, w string")
    seen, found = [], K.exact_quantiles
    monkeypatch.setattr(K, "exact_quantiles", lambda d, cols, qs: seen.append(list(cols)) or found(d, cols, qs))
    plan = spark.createDataFrame([("impute_median", "b"), ("one_hot", "w"), ("drop_identifier", "k"), ("impute_median", "a")], "action string, column_name string")
    got = K.apply_modeling(df, plan)
    assert seen == [["a", "b"]]
    assert got.columns == ["a", "b", "a_was_imputed", "b_was_imputed", "w_x", "w_y", "w_z", "w_Other"]
    assert got.where("a_was_imputed = 1").select("a").distinct().collect()[0][0] == 30.0 and got.where("b is null").count() == 0
