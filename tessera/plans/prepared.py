"""Registered queries of model features, plans of model tables, and reviews of coordinates, flags, nulls and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import featuring as A
from tessera.operators import overview as O
from tessera.operators import preparation as D
from tessera.operators import rules as R
from tessera.plans.catalogue import _QUERIES, _SQL, ORDER_TEXT, query
from tessera.plans.extended import _association_sql
from tessera.streaming import incremental

# --- features: each one's sum over all rows ---------------------------------------------------------------------
_rounded = lambda d: d.withColumn("total", F.round("total", 4))
_BASE = """t AS MATERIALIZED (SELECT coalesce(price_null::DOUBLE, (SELECT median(price_null::DOUBLE) FROM {dirty})) AS price_null, o_custkey::DOUBLE AS o_custkey, o_orderdate, o_orderstatus,
 coalesce(flag_text, (SELECT flag_text FROM {dirty} WHERE flag_text IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS flag_text, o_orderpriority FROM {dirty}),
c AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority DESC) AS r FROM t GROUP BY 1)"""
_sum = lambda name, x, where="true": f"SELECT {name} AS feature, count(*) FILTER ({x} <> 0)::BIGINT AS rows, round(sum({x}), 4) AS total FROM t WHERE {where}"
_FEATURES = [
    _sum("'price_null'", "price_null"),
    *(_sum(f"'o_orderdate_{p}'", f"{f}(o_orderdate)::DOUBLE") for p, f in (("year", "year"), ("month", "month"), ("day", "day"), ("weekday", "isodow"))[:3]),
    _sum("'o_orderdate_weekday'", "(isodow(o_orderdate) - 1)::DOUBLE"),
    "SELECT 'o_orderpriority_' || CASE WHEN r <= 2 THEN v ELSE 'infrequent' END AS feature, count(*)::BIGINT AS rows, count(*)::DOUBLE AS total FROM t JOIN c ON v = o_orderpriority GROUP BY 1",
    "SELECT 'flag_text_' || flag_text AS feature, count(*)::BIGINT AS rows, count(*)::DOUBLE AS total FROM t GROUP BY 1",
]
query("model_features", "dirty", f"WITH {_BASE}\n" + "\nUNION ALL ".join(_FEATURES))(lambda d: _rounded(A.feature_table(d, A.fit_features(d, ["price_null"], ["o_orderpriority", "flag_text"], ["o_orderdate"], max_levels=3))))
_CROSSES = [
    _sum("'price_null'", "price_null"),
    _sum("'o_custkey'", "o_custkey"),
    "SELECT 'o_orderstatus_' || o_orderstatus AS feature, count(*)::BIGINT AS rows, count(*)::DOUBLE AS total FROM t GROUP BY 1",
    _sum("'price_null o_custkey'", "price_null * o_custkey"),
    *(f"SELECT '{c} o_orderstatus_' || o_orderstatus AS feature, count(*) FILTER ({c} <> 0)::BIGINT AS rows, round(sum({c}), 4) AS total FROM t GROUP BY 1" for c in ("price_null", "o_custkey")),
]
# Sums of products are large: they are compared in thousands.
_THOUSANDS = "SELECT feature, rows, round(total / 1000, 1) AS total FROM ({})"
query("interaction_features", "dirty", f"WITH {_BASE}\n" + _THOUSANDS.format("\nUNION ALL ".join(_CROSSES)))(
    lambda d: A.feature_table(d, A.fit_features(d, ["price_null", "o_custkey"], ["o_orderstatus"], degree=2, interaction_only=True)).withColumn("total", F.round(F.round("total", 4) / 1000, 1))
)

# --- plans of model tables ---------------------------------------------------------------------------------------
_columns = lambda d: d.select("o_orderkey", F.col("o_custkey").alias("unit_count"), "price_null", "o_orderpriority", "o_orderdate", "o_orderstatus")
_LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
query(
    "modeling_plan_defaults",
    "dirty",
    "SELECT o_custkey AS unit_count, coalesce(price_null, median(price_null) OVER ()) AS price_null, o_orderdate, o_orderstatus, (price_null IS NULL)::TINYINT AS price_null_was_imputed, year(o_orderdate)::INT AS o_orderdate_year, quarter(o_orderdate)::INT AS o_orderdate_quarter, month(o_orderdate)::INT AS o_orderdate_month, (isodow(o_orderdate) - 1)::INT AS o_orderdate_weekday, (isodow(o_orderdate) >= 6)::INT AS o_orderdate_is_weekend, "
    + ", ".join(f"(o_orderpriority = '{v}')::TINYINT AS \"o_orderpriority_{v}\"" for v in _LEVELS)
    + " FROM {dirty}",
)(lambda d: D.apply_model_table(_columns(d), D.model_table_plan(_columns(d), "o_orderstatus")))
query(
    "modeling_plan_chosen",
    "dirty",
    "SELECT o_orderkey, o_custkey AS unit_count, round((price_null - avg(price_null) OVER ()) / stddev_pop(price_null) OVER (), 6) AS price_null, o_orderpriority, o_orderdate, o_orderstatus, price_null / nullif(o_custkey, 0) AS price_null_per_unit_count FROM {dirty}",
)(lambda d: D.apply_model_table(_columns(d), D.model_table_plan(_columns(d), "o_orderstatus"), ["scale_numeric:price_null", "add_ratio:price_null_per_unit_count"]).withColumn("price_null", F.round("price_null", 6)))

# --- reviews -----------------------------------------------------------------------------------------------------
_placed = lambda d: d.select("o_orderkey", (F.col("o_custkey") % 140 - 40.0).alias("home_lat"), (F.col("o_orderkey") % 400 - 200.0).alias("home_lon"), (F.col("o_custkey") % 250 - 50.0).alias("longitude"))
_PLACED = "(SELECT o_orderkey, o_custkey % 140 - 40.0::DOUBLE AS home_lat, o_orderkey % 400 - 200.0::DOUBLE AS home_lon, o_custkey % 250 - 50.0::DOUBLE AS longitude FROM orders)"
_BAD, _SWAPPED = "(abs(home_lat) > 90 OR abs(home_lon) > 180)", "(abs(home_lat) > 90 AND abs(home_lat) <= 180 AND abs(home_lon) <= 90)"
query(
    "coordinate_review",
    "orders",
    f"SELECT * FROM (SELECT 'home_lat,home_lon' AS column_name, count(*) FILTER {_BAD.join(('(', ')'))}::BIGINT AS invalid, count(*) FILTER ({_SWAPPED})::BIGINT AS likely_swapped, count(*) FILTER ({_BAD} OR {_SWAPPED})::BIGINT AS affected, min(home_lat)::DOUBLE AS lat_min, max(home_lat)::DOUBLE AS lat_max, min(home_lon)::DOUBLE AS lon_min, max(home_lon)::DOUBLE AS lon_max FROM {_PLACED}\n"
    f"UNION ALL SELECT 'longitude', count(*) FILTER (abs(longitude) > 180)::BIGINT, 0::BIGINT, count(*) FILTER (abs(longitude) > 180)::BIGINT, NULL, NULL, min(longitude)::DOUBLE, max(longitude)::DOUBLE FROM {_PLACED}) WHERE affected > 0",
)(lambda d: D.coordinate_review(_placed(d)).drop("confidence"))
query(
    "coordinate_treatment",
    "orders",
    f"SELECT o_orderkey, (CASE WHEN {_SWAPPED} THEN home_lon ELSE home_lat END)::DOUBLE AS home_lat, (CASE WHEN {_SWAPPED} THEN home_lat ELSE home_lon END)::DOUBLE AS home_lon, (CASE WHEN abs(longitude) <= 180 THEN longitude END)::DOUBLE AS longitude FROM {_PLACED}",
)(lambda d: D.apply_reviews(_placed(d), {"geo_coordinate_review:home_lat,home_lon": {"treatment": "swap_likely"}, "geo_coordinate_review:longitude": {"treatment": "null_invalid"}}))
_flagged = lambda d: d.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 1).alias("has_note"), F.when(F.col("o_custkey") % 2 == 0, "Y").otherwise("N").alias("is_sure"), F.col("o_orderstatus"))
query(
    "flag_review",
    "orders",
    "SELECT 'has_note' AS column_name, 'positive_only_nullable_flag' AS kind, 0.78 AS confidence, count(*) FILTER (o_orderkey % 3 = 0)::BIGINT AS affected FROM orders",
)(lambda d: D.ambiguous_flags(_flagged(d)).select("column_name", "kind", "confidence", "affected"))
query("flag_decision", "orders", "SELECT o_orderkey, (o_orderkey % 3 = 0)::INT AS has_note FROM orders")(lambda d: D.apply_reviews(_flagged(d), {"binary_mapping_review:has_note": {"mapping": {"1": 1}, "null": 0}}).select("o_orderkey", "has_note"))
_TREATED = {
    "add_indicator": "price_null, (price_null IS NULL)::TINYINT AS price_null_was_missing",
    "fill_mean": "round(coalesce(price_null, avg(price_null) OVER ()), 4) AS price_null",
    "fill_median": "coalesce(price_null, median(price_null) OVER ()) AS price_null",
    "forward_fill": "last_value(price_null IGNORE NULLS) OVER (ORDER BY o_orderkey) AS price_null",
    "back_fill": "first_value(price_null IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price_null",
}


def _treat(d, how):
    out = D.treat_missing(d.select("o_orderkey", "price_null"), "price_null", how, order_by="o_orderkey")
    return out.withColumn("price_null", F.round("price_null", 4)) if how == "fill_mean" else out


for _how, _sql in _TREATED.items():
    query(f"treat_missing_{_how}", "dirty", f"SELECT o_orderkey, {_sql} FROM {{dirty}}")(lambda d, how=_how: _treat(d, how))
query("treat_missing_drop_rows", "dirty", "SELECT o_orderkey, price_null FROM {dirty} WHERE price_null IS NOT NULL")(lambda d: _treat(d, "drop_rows"))
_FLAGS = """SELECT '{c}' AS column_name, count(DISTINCT {c}) <= 1 AS constant, count(DISTINCT {c}) > 1 AND (SELECT max(n) >= 0.98 * sum(n) FROM (SELECT count(*) AS n FROM {dirty} WHERE {c} IS NOT NULL GROUP BY {c})) AS near_constant,
 {likes} AS missing_like, {out} AS iqr_outliers, {many} AS high_cardinality FROM {dirty}"""
_OUTSIDE = "(SELECT count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) >= 0.01 * count({c}) FROM {dirty}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {dirty}))"
_LIKE = "count(*) FILTER (lower(trim({c})) IN ('', 'n/a')) > 0"
_rows = [("num_text", _LIKE, "false", "count(DISTINCT {c}) >= 50 AND count(DISTINCT {c}) >= 0.5 * count({c})"), ("flag_text", _LIKE, "false", "false"), ("price_spike", "false", _OUTSIDE, "false")]
query("column_flags", "dirty", "\nUNION ALL\n".join(_FLAGS.replace("{likes}", a).replace("{out}", b).replace("{many}", m).replace("{c}", c) for c, a, b, m in _rows))(lambda d: R.column_flags(d.select("num_text", "flag_text", "price_spike")))
query("review_plan_coordinates", "orders", f"SELECT 'geo_coordinate_review' AS action, 'home_lat,home_lon' AS column_name, count(*) FILTER ({_BAD} OR {_SWAPPED})::BIGINT AS affected, 0.72 AS confidence FROM {_PLACED} HAVING affected > 0")(
    lambda d: D.every_review(_placed(d).select("home_lat", "home_lon")).where("action = 'geo_coordinate_review'")
)

# --- overviews ---------------------------------------------------------------------------------------------------
_BYTES = " + ".join(f"coalesce({'8' if c.startswith('price') else f'octet_length(encode({c}))'} * ({c} IS NOT NULL)::INT, 0)" for c in ("num_text", "price_null", "flag_text", "price_spike"))
query(
    "table_overview",
    "dirty",
    f"SELECT count(*)::BIGINT AS rows, 4::BIGINT AS columns, sum((num_text IS NULL)::INT + (price_null IS NULL)::INT + (flag_text IS NULL)::INT)::BIGINT AS missing_cells, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT num_text, price_null, flag_text, price_spike FROM {{dirty}})))::BIGINT AS duplicate_rows, sum({_BYTES})::BIGINT AS value_bytes FROM {{dirty}}",
)(lambda d: O.table_overview(d.select("num_text", "price_null", "flag_text", "price_spike")).select("rows", "columns", "missing_cells", "duplicate_rows", "value_bytes"))
query(
    "time_facts",
    "events",
    """WITH g AS (SELECT ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1e6 AS gap FROM events WHERE ts IS NOT NULL),
o AS (SELECT count(*) FILTER (ts < p) AS back FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events WHERE ts IS NOT NULL))
SELECT 'ts' AS column_name, count(*)::BIGINT AS non_null, count(*)::BIGINT AS parsed, count(*) / (SELECT count(*) FROM events)::DOUBLE AS parse_ratio, min(ts)::TIMESTAMP AS "min", max(ts)::TIMESTAMP AS "max", (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000 AS span_days,
 (count(*) - count(DISTINCT ts))::BIGINT AS duplicates, (count(*) - count(DISTINCT ts)) / count(*)::DOUBLE AS duplicate_ratio, round(median(gap), 6) AS median_gap, max(gap) AS max_gap, (SELECT back = 0 FROM o) AS monotonic FROM g""",
)(lambda d: O.time_facts(d, ["ts"], "event_id").withColumn("median_gap", F.round("median_gap", 6)))
query(
    "all_facts",
    "dirty",
    "WITH f AS (SELECT count(num_text)::DOUBLE AS a, max(length(num_text))::DOUBLE AS b, count(DISTINCT price_null)::DOUBLE AS c, median(price_null)::DOUBLE AS d, quantile_cont(price_null, 0.75)::DOUBLE AS e, round(avg(price_null), 4)::DOUBLE AS f, count(*)::DOUBLE AS g FROM {dirty})\n"
    + "\nUNION ALL ".join(f"SELECT '{s}' AS subject, '{n}' AS fact, {x} AS value, 'exact' AS mode FROM f" for s, n, x in (("num_text", "non_null", "a"), ("num_text", "max_length", "b"), ("price_null", "distinct_count", "c"), ("price_null", "median", "d"), ("price_null", "p75", "e"), ("price_null", "mean", "f"), ("*", "rows", "g"))),
)(
    lambda d: O.all_facts(d.select("num_text", "price_null"))
    .where("(subject, fact) IN (('num_text', 'non_null'), ('num_text', 'max_length'), ('price_null', 'distinct_count'), ('price_null', 'median'), ('price_null', 'p75'), ('price_null', 'mean'), ('*', 'rows'))")
    .select("subject", "fact", F.when(F.col("fact") == "mean", F.round("value", 4)).otherwise(F.col("value")).alias("value"), "mode")
)
_NULLED = ("num_text", "price_null", "flag_text")
_STRENGTHS = [f"SELECT '{a}' AS a, '{b}' AS b, '{m}' AS method, {s} AS strength" for a, b, m, s in _association_sql("{dirty}", ("o_custkey", "price_spike"), ORDER_TEXT)]
_STRENGTHS += [f"SELECT '{a}', '{b}', 'phi_of_nulls', abs(corr(({a} IS NULL)::INT, ({b} IS NULL)::INT)) FROM {{dirty}}" for i, a in enumerate(_NULLED) for b in _NULLED[i + 1 :]]
query("ranked_associations", "dirty", "SELECT row_number() OVER (ORDER BY strength DESC, a, b, method)::INT AS rank, a, b, method, round(strength, 8) AS strength FROM (" + "\nUNION ALL ".join(_STRENGTHS) + ")")(
    lambda d: O.ranked_associations(d.select("o_custkey", "price_spike", *ORDER_TEXT, *_NULLED), ["o_custkey", "price_spike"], list(ORDER_TEXT)).withColumn("strength", F.round("strength", 8))
)
query(
    "histogram_by",
    "lineitem",
    "WITH b AS (SELECT min(l_quantity)::DOUBLE AS lo, (max(l_quantity) - min(l_quantity))::DOUBLE / 7 AS w FROM lineitem) SELECT l_returnflag, bin, lo + bin * w AS lo, lo + (bin + 1) * w AS hi, n, 100 * (n / sum(n) OVER (PARTITION BY l_returnflag)::DOUBLE) AS y FROM (SELECT l_returnflag, least(floor((l_quantity - lo) / w), 6)::INT AS bin, count(*)::BIGINT AS n FROM lineitem, b GROUP BY 1, 2), b",
)(lambda d: O.histogram_by(d, "l_quantity", "l_returnflag", 7, "percent"))
query("points_of_dimensions", "orders", "SELECT o_orderkey, o_totalprice, o_custkey, o_orderdate, o_orderstatus FROM orders ORDER BY md5(concat_ws('|', o_orderkey, '42')), o_orderkey LIMIT 3000")(lambda d: O.points(d, "o_orderkey", ["o_totalprice", "o_custkey", "o_orderdate"], "o_orderstatus"))
_FENCES = "SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b, quantile_cont({c}, 0.01) AS p01, quantile_cont({c}, 0.99) AS p99 FROM (SELECT {x} AS {c} FROM {dirty})"
_OUTLIERS = "SELECT '{c}' AS column_name, o::BIGINT AS outliers, o / n::DOUBLE AS outlier_ratio, a - 1.5 * (b - a) AS lower, b + 1.5 * (b - a) AS upper, b - a AS iqr, p01, p99, CASE WHEN o / n::DOUBLE >= 0.05 THEN 0.78 ELSE 0.66 END::DOUBLE AS confidence FROM (SELECT count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS o, count({c}) AS n, any_value(a) AS a, any_value(b) AS b, any_value(p01) AS p01, any_value(p99) AS p99 FROM (SELECT {x} AS {c} FROM {dirty}), (" + _FENCES + "))"
query("outlier_table", "dirty", "\nUNION ALL\n".join(_OUTLIERS.replace("{c}", c).replace("{x}", x) for c, x in (("price_spike", "price_spike"), ("num_text", "try_cast(num_text AS DOUBLE)"))))(lambda d: O.outlier_table(d, ["price_spike", "num_text"]))
query(
    "target_summary",
    "dirty",
    "SELECT flag_text AS value, count(*)::BIGINT AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS ratio, 'flag_text' AS target, CASE WHEN (SELECT count(DISTINCT flag_text) FROM {dirty}) = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END AS task, 'user' AS source, 0.99::DOUBLE AS confidence, max(count(*)) OVER () / sum(count(*)) OVER ()::DOUBLE AS imbalance_ratio FROM {dirty} GROUP BY 1",
)(lambda d: O.target_summary(d, "flag_text"))


def _sessions(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return incremental.settled(incremental.sessions(incremental.read_stream(spark, f"{sf_dir}/events.parquet*", schema)))


_QUERIES["stream_sessions"] = _sessions
_SQL["stream_sessions"] = """SELECT min(ts)::TIMESTAMP AS start, user_id, count(*)::BIGINT AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
 (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, s"""
