"""Facts of columns: each counted once, over values of their own type."""

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.operators import reports
from tessera.operators import rules as R


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_count_values_of_their_type_and_are_held(spark, tmp_path):
    rows = [(1, 0.0, "1.5", None), (2, -0.0, " 2", None), (2, float("nan"), "N/A", None), (None, 3.0, None, None)]
    spark.createDataFrame(rows, "k bigint, x double, words string, gone string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    facts = R.column_facts(df)
    got = {r["column_name"]: r for r in facts.collect()}
    assert [(got[c]["rows"], got[c]["non_null"], got[c]["distinct_count"], got[c]["top"]) for c in df.columns] == [(4, 3, 2, 2), (4, 3, 2, 2), (4, 3, 3, 1), (4, 0, 0, 0)]
    assert (got["x"]["lo"], got["x"]["hi"], got["x"]["zero_ratio"], got["words"]["missing_like"]) == (0.0, 3.0, 2 / 3, 1)
    assert abs(got["words"]["num"] - 2 / 3) < 1e-12 and got["words"]["max_len"] == 3 and got["gone"]["num"] is None
    assert [tuple(r)[1:5] for r in P.column_counts(df).collect()] == [(3, 1, 0.25, 2), (3, 1, 0.25, 2), (3, 1, 0.25, 3), (0, 4, 1.0, 0)]
    # one expanded aggregate for each column's different values made these scan and shuffle the table again with every use
    for table in (R.semantic_types(df), P.column_counts(df)):
        assert "Expand" not in plan_of(table)
    assert "parquet" not in plan_of(R.semantic_types(df))


def test_conversions_of_a_wide_table(spark):
    df = spark.range(400).select("id", *(F.concat(F.lit(" "), (F.col("id") * i).cast("string")).alias(f"n{i}") for i in range(1, 6)), F.when(F.col("id") % 3 == 0, "Yes").otherwise("no").alias("flag"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("day"))
    got = reports.apply_suggested_conversions(df)
    assert [k for _, k in got.dtypes] == ["bigint", *["double"] * 5, "int", "timestamp"]
    row = got.where("id = 33").first()
    assert (row["n4"], row["flag"], str(row["day"])[:10]) == (132.0, 1, "2024-02-03")


def test_plan_of_a_model_table_reads_the_table_once_for_its_facts(spark, tmp_path):
    from tessera.operators import preparation as D

    spark.range(200).selectExpr("id AS row_key", "id % 40 AS unit_count", "CASE WHEN id % 5 > 0 THEN id * 1.5D END AS price", "CAST(id % 3 AS string) AS level", "timestamp'2024-01-01' AS at").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = D.model_table_plan(df, "level")
    assert "parquet" not in plan_of(plan)
    assert {r["id"]: r["distinct_count"] for r in plan.where("by_default").collect()} == {"drop_identifier:row_key": 200, "impute_missing:price": 160, "drop_constant:at": 1}
    ratio, flags = "add_ratio:price_per_unit_count", D.ambiguous_flags(df.selectExpr("CASE WHEN row_key % 2 = 0 THEN 'yes' END AS has_note", "level"))
    assert ratio in {r["id"] for r in plan.collect()}
    assert [(r["column_name"], r["affected"]) for r in flags.collect()] == [("has_note", 100)]


def test_sample_of_repeated_keys_is_the_same_in_any_order_of_rows(spark):
    from tessera.functions.columns import hash_sample

    rows = [(i % 3, i, {"i": i}) for i in range(60)]
    taken = [sorted(r["v"] for r in hash_sample(spark.createDataFrame(x, "k int, v int, m map<string,int>").repartition(p), 7, "k").collect()) for x, p in ((rows, 1), (rows[::-1], 1), (rows[30:] + rows[:30], 4))]
    assert taken[0] == taken[1] == taken[2] and len({v % 3 for v in taken[0]}) == 1 and taken[0] == sorted(taken[0])[:7] == [min(taken[0]) + 3 * i for i in range(7)]


def test_shares_of_all_numbers_at_once_agree_with_those_of_one(spark):
    import random

    from tessera.operators.stats import top_share

    r = random.Random(5)
    rows = [(r.choice([None, r.random() * 100]), r.gauss(0, 10), r.randint(0, 3), 7.0 if i else 9e5, None) for i in range(1201)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, e double")
    facts = {x["column_name"]: x["lo"] for x in R.column_facts(df).collect()}
    got = {x["column_name"]: x for x in R.measured_shares(df, df.columns, facts).collect()}
    outside = {x["column_name"]: x["outlier_ratio"] for x in P.iqr_outliers(df).collect()}
    for c in df.columns:
        want = top_share(df, c).first()[0]
        assert got[c]["outlier_ratio"] == outside[c] and (got[c]["top_share"] == want or abs(got[c]["top_share"] - want) < 1e-12), c
    few = {(x["issue"], x["column_name"]): x["value"] for x in R.issues(df.select("c", "d")).collect()}
    assert few["duplicate_rows", "*"] == 1196
    assert "duplicate_rows" not in {x["issue"] for x in R.issues(df.select("b", "c")).collect()}


def test_feature_select_reads_held_facts(spark, tmp_path):
    from tessera.operators import modeling as M

    spark.range(300).selectExpr("id AS order_key", "id % 7 * 1.5D AS amount", "substr('abc', CAST(id % 3 AS int) + 1, 1) AS level", "id * 2.5D AS amount_left").write.parquet(f"{tmp_path}/t")
    got = M.feature_select(spark.read.parquet(f"{tmp_path}/t"), "amount")
    assert "parquet" not in plan_of(got)
    assert [tuple(r) for r in got.collect()] == [("order_key", "drop", "identifier"), ("amount", "drop", "target"), ("level", "categorical", None), ("amount_left", "drop", "target_derived")]
