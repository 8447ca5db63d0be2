"""More registered queries: chart kinds by name, samples and splits by MD5, metrics of rule-made predictions, files and states."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions.shared import use_checkpoints
from tessera.operators import assess as A
from tessera.operators import charts as G
from tessera.operators import clean as K
from tessera.operators import modeling as M
from tessera.operators import stats as S
from tessera.operators import views as V
from tessera.plans.catalogue import ALL_ORDER, LINE, ORDER_TEXT, each, query
from tessera.sources import readers
from tessera.sources.states import StateStore


def _md5(*cols: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|', {', '.join(cols)}, '{seed}'))"


def _part(*cols: str, parts: int, seed: int = 42) -> str:
    return f"(CAST('0x' || substr({_md5(*cols, seed=seed)}, 1, 13) AS BIGINT) % {parts})"


def _folder(spark) -> str:
    return f"{use_checkpoints(spark)}/query-{uuid.uuid4().hex}"


# --- samples and splits ----------------------------------------------------------------------------------------
query("scan_sample", "lineitem", f"SELECT * FROM lineitem ORDER BY {_md5('l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber LIMIT 1000")(lambda d: C.hash_sample(d, 1000, ["l_orderkey", "l_linenumber"]))
query("sample_rows", "orders", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_md5('o_orderkey', seed=7)} LIMIT 500")(lambda d: C.hash_sample(d, 500, "o_orderkey", 7).select("o_orderkey", "o_totalprice"))
query("split_holdout", "orders", f"SELECT o_orderkey FROM orders WHERE {_part('o_orderkey', parts=10000)} < 2500")(lambda d: M.split(d, "o_orderkey")[1].select("o_orderkey"))
query("stratified_split", "orders", f"SELECT o_orderstatus, is_test, count(*)::BIGINT AS n FROM (SELECT o_orderstatus, percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY {_md5('o_orderkey')}) < 0.25 AS is_test FROM orders) GROUP BY 1, 2")(lambda d: M.stratified_split(d, "o_orderkey", "o_orderstatus").groupBy("o_orderstatus", "is_test").agg(F.count("*").alias("n")))
query("missingness_matrix", "dirty", f"SELECT row_id, column_name, missing FROM (SELECT o_orderkey AS row_id, (num_text IS NULL)::INT AS num_text, (price_null IS NULL)::INT AS price_null, (flag_text IS NULL)::INT AS flag_text FROM {{dirty}} ORDER BY {_md5('o_orderkey')} LIMIT 250) UNPIVOT (missing FOR column_name IN (num_text, price_null, flag_text))")(lambda d: S.missingness_matrix(d.select("o_orderkey", "num_text", "price_null", "flag_text"), "o_orderkey"))
query("source_fingerprint", "part", f"SELECT count(*)::BIGINT AS rows, bit_xor(CAST('0x' || substr({_md5('p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice')}, 1, 15) AS BIGINT)) AS content_hash FROM part")(lambda d: S.dataset_fingerprint(d.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")).select("rows", "content_hash"))
query("duplicate_rows", "documents", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY ALL)" .replace("GROUP BY ALL", "GROUP BY doc_id, text, lang, source, n_chars"))(lambda d: d.groupBy(*d.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows")))
query("select_order", "lineitem", "SELECT l_quantity, l_orderkey, l_linenumber FROM lineitem")(lambda d: V.select_order(d.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_tax"], ["l_quantity"]))
query("sort_multi", "orders", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")(lambda d: V.sort_multi(d.select("o_orderkey", "o_orderpriority", "o_totalprice"), [("o_orderpriority", "desc"), ("o_totalprice", "asc")]))
query("rename_columns", "orders", "SELECT o_orderkey AS order_key, o_totalprice AS total_price_usd FROM orders")(lambda d: K.rename_columns(d.select(F.col("o_orderkey").alias("Order Key"), F.col("o_totalprice").alias(" Total-Price (USD)"))))
query("read_parquet", "orders", "SELECT * FROM orders")(lambda d: d)
# --- rows of charts --------------------------------------------------------------------------------------------
_CAPPED = {"row_level_cap": ("scatter", "lineitem", "l_quantity", "l_extendedprice", 500), "scatter": ("scatter", "orders", "o_custkey", "o_totalprice", 300), "strip": ("strip", "orders", "o_orderpriority", "o_totalprice", 300), "geo_scatter": ("geo_scatter", "lineitem", "l_discount", "l_quantity", 200), "scatter_matrix": ("scatter_matrix", "lineitem", "l_tax", "l_extendedprice", 200), "parallel_coordinates": ("parallel_coordinates", "lineitem", "l_quantity", "l_discount", 200)}
for _n, (_kind, _table, _x, _y, _k) in _CAPPED.items():
    query(_n, _table, f"SELECT {_x}, {_y} FROM {_table} ORDER BY {_md5(_x, _y)}, {_x}, {_y} LIMIT {_k}")(lambda d, s=(_kind, _x, _y, _k): G.chart_data(d, dict(zip(("kind", "x", "y", "limit"), s))))
_MONTH = "date_trunc('month', o_orderdate)::TIMESTAMP"
_CHARTS = {
    "line": ({"x": "o_orderdate", "y": "o_totalprice", "bucket": "month"}, f"SELECT {_MONTH} AS o_orderdate, sum(o_totalprice) AS y FROM orders GROUP BY 1"),
    "area": ({"x": "o_orderdate", "y": "o_totalprice", "bucket": "month", "color": "o_orderstatus", "cumulative": True}, f"SELECT *, sum(y) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate ROWS UNBOUNDED PRECEDING) AS cumulative FROM (SELECT {_MONTH} AS o_orderdate, o_orderstatus, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2)"),
    "bar": ({"x": "o_orderpriority", "y": "o_totalprice", "aggregation": "mean"}, "SELECT o_orderpriority, avg(o_totalprice) AS y FROM orders GROUP BY 1"),
    "lollipop": ({"x": "o_orderpriority"}, "SELECT o_orderpriority, count(*)::BIGINT AS y FROM orders GROUP BY 1"),
    "slope": ({"x": "o_orderstatus", "y": "o_totalprice", "color": "o_orderpriority", "aggregation": "median"}, "SELECT o_orderstatus, o_orderpriority, median(o_totalprice) AS y FROM orders GROUP BY 1, 2"),
    "funnel": ({"x": "o_orderstatus", "y": "o_totalprice", "transform": "percent_total"}, "SELECT o_orderstatus, sum(o_totalprice) AS y, 100.0::DOUBLE * sum(o_totalprice) / sum(sum(o_totalprice)) OVER () AS transformed FROM orders GROUP BY 1"),
    "radar": ({"x": "o_orderpriority", "y": "o_totalprice", "aggregation": "max"}, "SELECT o_orderpriority, max(o_totalprice) AS y FROM orders GROUP BY 1"),
    "bump_chart": ({"x": "o_orderdate", "y": "o_totalprice", "color": "o_orderpriority", "bucket": "year"}, "SELECT *, dense_rank() OVER (PARTITION BY o_orderdate ORDER BY y DESC)::INT AS rank FROM (SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS o_orderdate, o_orderpriority, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2)"),
    "waterfall": ({"x": "o_orderpriority", "y": "o_totalprice"}, "SELECT o_orderpriority AS x, sum(o_totalprice) AS y FROM orders GROUP BY 1 UNION ALL SELECT 'Total', sum(o_totalprice) FROM orders"),
    "pie": ({"x": "o_orderstatus", "y": "o_totalprice"}, "SELECT o_orderstatus, sum(o_totalprice) AS y, sum(o_totalprice) / sum(sum(o_totalprice)) OVER () AS share FROM orders GROUP BY 1"),
    "treemap": ({"path": ["o_orderstatus", "o_orderpriority"], "y": "o_totalprice"}, "SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS y, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "sunburst": ({"path": ["o_orderpriority", "o_orderstatus"]}, "SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS y, grouping_id(o_orderpriority, o_orderstatus)::BIGINT AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)"),
    "choropleth": ({"x": "o_orderpriority"}, "SELECT o_orderpriority, count(*)::BIGINT AS y FROM orders GROUP BY 1"),
    "heatmap": ({"x": "o_orderstatus", "y": "o_orderpriority", "z": "o_totalprice", "aggregation": "mean"}, "SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2"),
    "concentration_chart": ({"kind": "concentration_curve", "x": "o_totalprice"}, "SELECT sum(k) OVER (ORDER BY v) / sum(k) OVER ()::DOUBLE AS row_share, sum(k * v) OVER (ORDER BY v) / sum(k * v) OVER () AS amount_share FROM (SELECT o_totalprice AS v, count(*) AS k FROM orders GROUP BY 1)"),
    "target_profile_chart": ({"kind": "target_profile", "x": "o_orderpriority", "y": "o_totalprice"}, "SELECT o_orderpriority, count(*)::BIGINT AS record_count, avg(o_totalprice) AS target_mean, median(o_totalprice) AS target_median, 0.0 AS missing_ratio FROM orders GROUP BY 1"),
    "target_rate_chart": ({"kind": "target_profile", "x": "o_orderpriority", "y": "o_orderstatus"}, "SELECT o_orderpriority, count(*)::BIGINT AS record_count, avg((o_orderstatus = (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))::INT) AS positive_rate, 0.0 AS missing_ratio FROM orders GROUP BY 1"),
    "missingness_chart": ({"kind": "missingness"}, each(ALL_ORDER, "SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL)::BIGINT AS missing, avg(({c} IS NULL)::INT) AS missing_ratio FROM orders")),
    "missingness_matrix_chart": ({"kind": "missingness_matrix", "x": "o_orderkey", "limit": 100}, f"SELECT row_id, column_name, missing FROM (SELECT o_orderkey AS row_id, 0::INT AS o_custkey, 0::INT AS o_orderstatus, 0::INT AS o_totalprice, 0::INT AS o_orderdate, 0::INT AS o_orderpriority FROM orders ORDER BY {_md5('o_orderkey')} LIMIT 100) UNPIVOT (missing FOR column_name IN (o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority))"),
    "calendar_heatmap": ({"x": "o_orderdate"}, "SELECT o_orderdate::DATE AS day, weekofyear(o_orderdate::DATE)::INT AS iso_week, (isodow(o_orderdate::DATE) - 1)::INT AS weekday, count(*)::BIGINT AS y FROM orders GROUP BY 1"),
    "correlation_heatmap": ({"columns": ["o_custkey", "o_totalprice"]}, "SELECT 'o_custkey' AS a, 'o_totalprice' AS b, corr(o_custkey, o_totalprice) AS r FROM orders UNION ALL SELECT 'o_totalprice', 'o_custkey', corr(o_custkey, o_totalprice) FROM orders"),
}
for _n, (_spec, _sql) in _CHARTS.items():
    query(_n, "orders", _sql)(lambda d, s={"kind": _n} | _spec: (lambda x: x.withColumn("day", F.col("day").cast("string")) if "day" in x.columns else x)(G.chart_data(d.select(*ALL_ORDER), s)))
_GRID = "WITH b AS (SELECT min(l_quantity) AS a, (max(l_quantity) - min(l_quantity)) / 20 AS w, min(l_extendedprice) AS c, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS h FROM lineitem) SELECT least(floor((l_quantity - a) / w), 19)::INT AS x_bin, least(floor((l_extendedprice - c) / h), 19)::INT AS y_bin, count(*)::BIGINT AS n FROM lineitem, b GROUP BY 1, 2"
for _n in ("density_heatmap", "density_contour"):
    query(_n, "lineitem", _GRID)(lambda d, k=_n: G.chart_data(d, {"kind": k, "x": "l_quantity", "y": "l_extendedprice"}))
query("autocorrelation_chart", "events", "WITH x AS (SELECT value, row_number() OVER (ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL) SELECT lag::INT AS lag, corr(a.value, b.value) AS r FROM range(1, 6) t(lag) JOIN x a ON true JOIN x b ON b.i = a.i + lag GROUP BY 1")(lambda d: G.chart_data(d, {"kind": "autocorrelation", "x": "event_id", "y": "value", "lags": 5}))
query("iso_calendar", "orders", "SELECT weekofyear(o_orderdate::DATE)::INT AS iso_week, count(DISTINCT o_orderdate::DATE)::BIGINT AS days, sum((isodow(o_orderdate::DATE) >= 6)::INT)::BIGINT AS weekend_orders FROM orders GROUP BY 1")(lambda d: G.calendar_table(d, "o_orderdate").groupBy("iso_week").agg(F.count("*").alias("days"), F.sum(F.when(F.col("weekday") >= 5, F.col("y")).otherwise(0)).alias("weekend_orders")))
# --- associations ----------------------------------------------------------------------------------------------
def _association_sql(table: str, numeric, words) -> list[tuple[str, str, str, str]]:
    eta = "(SELECT sum(n * (m - mu) * (m - mu)) / (sum(n * (m - mu) * (m - mu)) + sum(n * v)) FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS mu FROM (SELECT count(*) AS n, avg({a}) AS m, var_pop({a}) AS v FROM {t} GROUP BY {b})))"
    cramer = "(SELECT sqrt(greatest(0, (sum(o * o / (r * c)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1))) FROM (SELECT *, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c FROM (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM {t} GROUP BY 1, 2)))"
    out = [(a, b, "pearson", "(SELECT abs(corr({a}, {b})) FROM {t})") for a, b in combinations(numeric, 2)]
    out += [(a, b, "eta_squared", eta) for a in numeric for b in words] + [(a, b, "cramers_v", cramer) for a, b in combinations(words, 2)]
    return [(a, b, m, s.replace("{a}", a).replace("{b}", b).replace("{t}", table)) for a, b, m, s in out]


_PAIRS_OF = {"mixed_associations": ("lineitem", LINE, ("l_returnflag", "l_linestatus")), "association_matrix": ("orders", ("o_totalprice", "o_custkey"), ORDER_TEXT)}
for _n, (_table, _nums, _words) in _PAIRS_OF.items():
    query(_n, _table, "\nUNION ALL\n".join(f"SELECT '{a}' AS a, '{b}' AS b, '{m}' AS method, {s} AS strength" for a, b, m, s in _association_sql(_table, _nums, _words)))(lambda d, n=_nums, w=_words: S.mixed_associations(d, list(n), list(w)))
query("association_heatmap", "orders", "\nUNION ALL\n".join(f"SELECT '{x}' AS a, '{y}' AS b, {s} AS strength" for a, b, _, s in _association_sql("orders", ("o_custkey", "o_totalprice"), ORDER_TEXT) for x, y in ((a, b), (b, a))))(lambda d: G.chart_data(d, {"kind": "association_heatmap", "columns": ["o_custkey", "o_totalprice", *ORDER_TEXT]}))
_TARGET = each(LINE, "SELECT '{c}' AS feature, 'median_spread' AS method, (SELECT max(m) - min(m) FROM (SELECT median({c}) AS m FROM lineitem GROUP BY l_returnflag)) / (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS strength FROM lineitem") + "\nUNION ALL\nSELECT 'l_linestatus', 'share_spread', max(t) - min(t) FROM (SELECT max(n) / sum(n)::DOUBLE AS t FROM (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY l_linestatus)"
query("target_associations", "lineitem", _TARGET)(lambda d: S.target_associations(d, "l_returnflag", list(LINE), ["l_linestatus"]))
query("target_association_chart", "lineitem", _TARGET)(lambda d: G.chart_data(d, {"kind": "target_association", "target": "l_returnflag", "columns": [*LINE, "l_linestatus"]}))
query("numeric_target_associations", "lineitem", "\nUNION ALL\n".join(
    ["SELECT '{c}' AS feature, 'pearson' AS method, abs(corr({c}, l_extendedprice)) AS strength FROM lineitem".replace("{c}", c) for c in ("l_quantity", "l_discount", "l_tax")]
    + ["SELECT '{c}', 'median_spread', (max(m) - min(m)) / (SELECT quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) FROM lineitem) FROM (SELECT median(l_extendedprice) AS m FROM lineitem GROUP BY {c})".replace("{c}", c) for c in ("l_returnflag", "l_linestatus")]
))(lambda d: S.target_associations(d, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]))
# each candidate's two sides are measured on the rows themselves
_CUTS = "[" + ", ".join(str(0.05 + 0.9 * i / 15) for i in range(16)) + "]"
_BITS = "(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_returnflag))"
_BITS_OF = "SELECT t, k, side, sum(n) AS m, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT t, k, {f} AS side, l_returnflag, count(*)::DOUBLE AS n FROM lineitem, {o} GROUP BY ALL) GROUP BY 1, 2, 3"
_VARIANCE_OF = "SELECT t, k, {f} AS side, count(*)::DOUBLE AS m, var_pop(l_extendedprice) AS h FROM lineitem, {o} GROUP BY 1, 2, 3"


def _splits_sql(numeric, words, sides: str, parent: str, digits: int) -> str:
    best = "FROM (SELECT t, k, greatest(0, {p} - sum(m * h) / sum(m)) AS gain FROM ({s}) GROUP BY 1, 2 HAVING count(*) = 2 AND min(m) >= 5)".replace("{p}", parent)
    cut = "(SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT unnest(quantile_cont({c}, {q})) AS t FROM lineitem))".replace("{q}", _CUTS)
    level = "(SELECT t, row_number() OVER (ORDER BY n DESC, t) AS k FROM (SELECT {c} AS t, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY k LIMIT 20)"
    order = f"(-round(gain / {parent}, 12), k)"
    out = [f"SELECT '{{c}}' AS feature, 'numeric_threshold' AS kind, arg_min(t, {order}) AS threshold, NULL::VARCHAR AS level, max(gain) AS gain {best}".replace("{s}", sides).replace("{f}", "{c} <= t").replace("{o}", cut).replace("{c}", c) for c in numeric]
    out += [f"SELECT '{{c}}', 'category_one_vs_rest', NULL::DOUBLE, arg_min(t, {order}), max(gain) {best}".replace("{s}", sides).replace("{f}", "{c} = t").replace("{o}", level).replace("{c}", c) for c in words]
    return f"SELECT feature, kind, threshold, level, round(gain, {digits}) AS gain FROM ({' UNION ALL '.join(out)})"


query("target_best_splits", "lineitem", _splits_sql(("l_quantity", "l_tax"), ("l_linestatus",), _BITS_OF, _BITS, 10))(lambda d: S.target_best_splits(d, "l_returnflag", ["l_quantity", "l_tax"], ["l_linestatus"]).withColumn("gain", F.round("gain", 10)))
query("numeric_target_splits", "lineitem", _splits_sql(("l_quantity", "l_discount"), ("l_returnflag", "l_linestatus"), _VARIANCE_OF, "(SELECT var_pop(l_extendedprice) FROM lineitem)", 2))(lambda d: S.target_best_splits(d, "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"], regression=True).withColumn("gain", F.round("gain", 2)))
for _n, _f, _back in (("fill_forward_global", "last_value(price_null IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)", False), ("fill_backward_global", "first_value(price_null IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", True)):
    query(_n, "dirty", f"SELECT o_orderkey, {_f} AS price_null FROM {{dirty}}")(lambda d, back=_back: K.fill_forward(d, "price_null", "o_orderkey", backward=back).select("o_orderkey", "price_null"))
query("knn_predict", "embeddings", "SELECT id, avg(label)::DOUBLE AS prediction FROM (SELECT q.vec_id AS id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), t.vec_id) AS r FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id WHERE q.vec_id % 50 = 0) WHERE r <= 5 GROUP BY 1")(lambda d: M.knn_predict(d, d.where("vec_id % 50 = 0"), ["embedding"], "label", "vec_id"))
_model_rows = lambda d: d.select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_linestatus", F.col("l_extendedprice").alias("label"))
query("feature_select", "orders")(lambda d: M.feature_select(d, "o_totalprice"))
query("modeling_baseline", "lineitem")(lambda d: M.modeling_baseline(_model_rows(d), "l_orderkey", ["l_quantity", "l_discount", "l_tax"], ["l_linestatus"], "regression"))
query("target_importance", "lineitem")(lambda d: M.target_importance(_model_rows(d), "l_orderkey", ["l_quantity", "l_discount", "l_tax"], ["l_linestatus"], "regression"))


def _horner(xs, x: str) -> str:
    out = repr(xs[0])
    for k in xs[1:]:
        out = f"({out} * {x} + {k!r})"
    return out + "::DOUBLE"


_A, _B, _C, _D = S.PROBIT
_tail = lambda p: f"({_horner(_C, f'sqrt(-2 * ln({p}))')} / {_horner(_D, f'sqrt(-2 * ln({p}))')})"
_QQ = f"SELECT value, CASE WHEN p < 0.02425 THEN {_tail('p')} WHEN p > 0.97575 THEN -{_tail('(1 - p)')} ELSE {_horner(_A, '((p - 0.5) * (p - 0.5))')} * (p - 0.5) / {_horner(_B, '((p - 0.5) * (p - 0.5))')} END AS normal FROM (SELECT v AS value, (sum(n) OVER (ORDER BY v) - n / 2.0::DOUBLE) / sum(n) OVER () AS p FROM (SELECT {{c}} AS v, count(*)::DOUBLE AS n FROM {{t}} GROUP BY 1))"
query("qq_points", "lineitem", _QQ.replace("{c}", "l_extendedprice").replace("{t}", "lineitem"))(lambda d: S.qq_points(d, "l_extendedprice"))
query("qq_plot", "orders", _QQ.replace("{c}", "o_totalprice").replace("{t}", "orders"))(lambda d: G.chart_data(d, {"kind": "qq_plot", "x": "o_totalprice"}))
_GAP = "(SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1e6 AS gap FROM events)"
query("time_cadence", "events", f"SELECT round(min(gap), 3) AS min_gap, round(median(gap), 3) AS median_gap, round(max(gap), 3) AS max_gap, round(avg(gap), 3) AS mean_gap, round(quantile_cont(gap, 0.95), 3) AS p95_gap, count(*) FILTER (gap = 0)::BIGINT AS duplicates, round(sum(gap), 3) AS span FROM {_GAP} WHERE gap IS NOT NULL")(lambda d: S.time_cadence(d, "ts").drop("large_gaps").select("duplicates", *(F.round(c, 3).alias(c) for c in ("min_gap", "median_gap", "max_gap", "mean_gap", "p95_gap", "span"))))
# --- cleaning --------------------------------------------------------------------------------------------------
_BAD = "FROM {dirty} WHERE flag_text IS NOT NULL AND try_cast(flag_text AS DOUBLE) IS NULL AND trim(flag_text) <> ''"
query("invalid_numeric", "dirty", f"SELECT count(*)::BIGINT AS invalid, array_to_string(list_sort(list(DISTINCT flag_text)), '|') AS examples {_BAD}")(lambda d: K.invalid_count(d, "flag_text").withColumn("examples", F.array_join("examples", "|")))
query("invalid_datetime", "dirty", "SELECT (SELECT count(*)::BIGINT FROM {dirty} WHERE trim(num_text) NOT IN ('', 'N/A')) AS invalid, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT num_text AS v FROM {dirty} WHERE trim(num_text) NOT IN ('', 'N/A') ORDER BY v LIMIT 8)) AS examples")(lambda d: K.invalid_count(d, "num_text", "datetime").withColumn("examples", F.array_join("examples", "|")))
_PLAN = "WITH s AS (SELECT c, count(*) FILTER (v IS NOT NULL AND NOT gone)::DOUBLE AS useful, count(*) FILTER (v <> trim(v)) AS trims, count(*) FILTER (gone) AS missing, count(*) FILTER (try_cast(v AS DOUBLE) IS NOT NULL) AS nums, count(*) FILTER (lower(trim(v)) IN ('y', 'yes', 'no', '0', '1')) AS flags FROM (SELECT *, lower(trim(v)) IN ('', 'n/a') AS gone FROM (SELECT 'num_text' AS c, num_text AS v FROM {dirty} UNION ALL SELECT 'flag_text', flag_text FROM {dirty})) GROUP BY 1) SELECT action, c AS column_name, affected::BIGINT AS affected, confidence::DOUBLE AS confidence FROM (SELECT 'trim_strings' AS action, c, trims AS affected, 0.95 AS confidence, trims > 0 AS fits FROM s UNION ALL SELECT 'standardize_missing', c, missing, 0.9, missing > 0 FROM s UNION ALL SELECT 'parse_numeric', c, nums, 0.85, nums >= 0.9 * greatest(useful, 1) FROM s UNION ALL SELECT 'binary_mapping', c, flags, 0.9, flags >= 0.9 * greatest(useful, 1) FROM s) WHERE fits"
query("cleaning_plan", "dirty", _PLAN)(lambda d: K.cleaning_plan(d.select("num_text", "flag_text")))
query("cleaning_presets", "dirty", f"SELECT * FROM ({_PLAN}) WHERE confidence >= 0.9")(lambda d: A.cleaning_preset(K.cleaning_plan(d.select("num_text", "flag_text")), "safe_defaults"))
_REVIEW = """SELECT 'missing_value_review' AS action, 'price_null' AS column_name, count(*) FILTER (price_null IS NULL)::BIGINT AS affected, 0.8::DOUBLE AS confidence FROM {dirty}
UNION ALL SELECT 'missing_value_review', 'flag_text', count(*) FILTER (flag_text IS NULL), 0.8 FROM {dirty}
UNION ALL SELECT 'duplicate_row_review', '__rows__', (SELECT count(*) FROM {dirty}) - (SELECT count(*) FROM (SELECT DISTINCT price_null, flag_text, price_spike FROM {dirty})), 0.94
UNION ALL SELECT 'numeric_outlier_review', c, count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)), CASE WHEN count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) >= 0.05 * count(v) THEN 0.78 ELSE 0.66 END FROM (SELECT *, quantile_cont(v, 0.25) OVER (PARTITION BY c) AS a, quantile_cont(v, 0.75) OVER (PARTITION BY c) AS b FROM (SELECT 'price_null' AS c, price_null AS v FROM {dirty} UNION ALL SELECT 'price_spike', price_spike FROM {dirty})) GROUP BY c
UNION ALL SELECT 'category_value_review', 'flag_text', sum(n - m), 0.72 FROM (SELECT sum(n) AS n, max(n) AS m FROM (SELECT flag_text AS v, count(*) AS n FROM {dirty} WHERE flag_text IS NOT NULL GROUP BY 1) GROUP BY lower(trim(v)))"""
query("review_plan", "dirty", f"SELECT * FROM ({_REVIEW}) WHERE affected > 0")(lambda d: K.review_plan(d.select("price_null", "flag_text", "price_spike")))
# --- metrics and linear models ---------------------------------------------------------------------------------
_flagged = lambda d: d.select((F.col("l_returnflag") == "R").cast("double").alias("label"), (F.col("l_quantity") > 25).cast("double").alias("prediction"))
_CELLS = "(SELECT (l_returnflag = 'R')::INT AS y, (l_quantity > 25)::INT AS p, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2)"
query("classification_metrics", "lineitem", f"WITH c AS {_CELLS}, j AS (SELECT y, support, tp / predicted AS pr, tp / support AS re, tp FROM (SELECT y, sum(n) AS support, sum(n) FILTER (y = p) AS tp FROM c GROUP BY 1) JOIN (SELECT p, sum(n) AS predicted FROM c GROUP BY 1) ON y = p) SELECT sum(tp) / sum(support) AS accuracy, avg(re) AS balanced_accuracy, sum(pr * support) / sum(support) AS precision, sum(re * support) / sum(support) AS recall, sum(2 * pr * re / (pr + re) * support) / sum(support) AS f1 FROM j")(lambda d: M.classification_metrics(_flagged(d)))
query("confusion_matrix", "lineitem", f"SELECT y::DOUBLE AS label, p::DOUBLE AS prediction, n::BIGINT AS n FROM {_CELLS}")(lambda d: M.confusion(_flagged(d)))
_guess = lambda d: d.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
_GUESS = "(SELECT l_extendedprice AS y, l_quantity * 1500 - l_extendedprice AS e, abs(l_quantity * 1500 - l_extendedprice) AS a FROM lineitem)"
query("regression_metrics", "lineitem", f"SELECT avg(a) AS mae, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, median(a) AS median_ae, avg(e) AS bias, quantile_cont(a, 0.9) AS p90_ae, max(a) AS max_ae, avg(a / abs(y)) AS mape, avg((e > 0)::INT) AS over_ratio, avg((a <= 0.1 * abs(y))::INT) AS within_10, avg((a <= 0.2 * abs(y))::INT) AS within_20 FROM {_GUESS}")(lambda d: M.regression_metrics(_guess(d)))
query("prediction_audit", "lineitem", f"SELECT round(a, 4) AS abs_error FROM {_GUESS} ORDER BY a DESC LIMIT 15")(lambda d: M.prediction_audit(_guess(d)).select(F.round("abs_error", 4).alias("abs_error")))
query("write_predictions", "lineitem", f"SELECT count(*)::BIGINT AS n, round(sum(e), 2) AS error FROM {_GUESS}")(lambda d: A.write_predictions(_guess(d), _folder(d.sparkSession), ["l_orderkey"]).agg(F.count("*").alias("n"), F.round(F.sum(F.col("prediction") - F.col("label")), 2).alias("error")))
_RUN = "SELECT threshold, sum(neg) OVER w / sum(neg) OVER () AS fpr, sum(pos) OVER w / sum(pos) OVER () AS tpr, sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w) AS precision FROM (SELECT l_quantity AS threshold, sum((l_returnflag = 'R')::INT)::DOUBLE AS pos, sum((l_returnflag <> 'R')::INT)::DOUBLE AS neg FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY threshold DESC)"
query("roc_pr_curves", "lineitem", _RUN)(lambda d: M.roc_points(d.select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))))
query("union_curves", "lineitem", "SELECT 'quantity' AS curve, max(tpr - fpr) AS best_gap FROM ({r}) UNION ALL SELECT 'tax', max(tpr - fpr) FROM ({t})".replace("{r}", _RUN).replace("{t}", _RUN.replace("l_quantity", "l_tax")))(lambda d: (lambda curve: curve("quantity", "l_quantity").unionByName(curve("tax", "l_tax")).groupBy("curve").agg(F.max(F.col("tpr") - F.col("fpr")).alias("best_gap")))(lambda n, c: M.roc_points(d.select(F.col(c).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))).withColumn("curve", F.lit(n))))
_one = lambda d: d.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"), "l_quantity", F.col("l_extendedprice").alias("label"))
_LINEAR = "(SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM lineitem)"
query("fit_linear", "lineitem", f"SELECT concat_ws('-', l_orderkey, l_linenumber) AS row_key, round(s * l_quantity + i, 3) AS prediction FROM lineitem, {_LINEAR}")(lambda d: M.fit(_one(d), ["l_quantity"], [], "linear", "regression").transform(_one(d)).select("row_key", F.round("prediction", 3).alias("prediction")))
query("linear_contributions", "lineitem", f"SELECT concat_ws('-', l_orderkey, l_linenumber) AS row_key, 0::INT AS position, round(s * (l_quantity - m), 3) AS contribution FROM lineitem, {_LINEAR}")(lambda d: (lambda m, x: M.linear_contributions(m, m.transform(x), "row_key").withColumn("contribution", F.round("contribution", 3)))(M.fit(_one(d), ["l_quantity"], [], "linear", "regression"), _one(d)))
query("native_importance", "lineitem", f"SELECT 'l_quantity' AS column_name, round(abs(s) * sd, 3) AS importance FROM {_LINEAR}")(lambda d: (lambda m, x: M.native_importance(m, m.transform(x)).withColumn("importance", F.round("importance", 3)))(M.fit(_one(d), ["l_quantity"], [], "linear", "regression"), _one(d)))
_FOLDS = f"(SELECT l_quantity AS q, l_extendedprice AS y, {_part('l_orderkey || {dash} || l_linenumber', parts=3, seed=7)} AS f FROM lineitem)".replace("{dash}", "'-'")
query("cross_validate", "lineitem", f"WITH d AS {_FOLDS} SELECT k::INT AS fold, round(1 - sum((y - s * q - i) * (y - s * q - i)) / (var_pop(y) * count(*)), 6) AS score FROM d JOIN (SELECT k, regr_slope(y, q) AS s, regr_intercept(y, q) AS i FROM d JOIN range(3) t(k) ON f <> k GROUP BY k) ON f = k GROUP BY k")(lambda d: M.cross_validate(_one(d), "row_key", ["l_quantity"], [], "linear", "regression").withColumn("score", F.round("score", 6)))
query("cluster_profile", "lineitem", each(("l_quantity", "l_discount"), "SELECT '{c}' AS feature, avg(abs(m - mu)) AS separation FROM (SELECT avg({c}) AS m, (SELECT avg({c}) FROM lineitem) AS mu FROM lineitem GROUP BY l_returnflag)"))(lambda d: M.cluster_profile(d.withColumn("cluster", F.col("l_returnflag")), ["l_quantity", "l_discount"]))
# --- files and states ------------------------------------------------------------------------------------------
_THREE = ("o_orderkey", "o_orderstatus", "o_totalprice")
_same = lambda x: x.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


def _read_back(kind: str, sep: str, header: bool):
    def run(d):
        path = _folder(d.sparkSession)
        d.select(*_THREE).write.csv(path, sep=sep, header=header)
        back = readers.read_table(d.sparkSession, path, kind, **({} if kind == "tsv" else {"sep": sep}))
        return _same(back if header else back.toDF(*_THREE))

    return run


for _n, _args in {"read_csv": ("csv", ";", True), "read_tsv": ("tsv", "\t", True), "read_uci": ("data", ",", False)}.items():
    query(_n, "orders", f"SELECT {', '.join(_THREE)} FROM orders")(_read_back(*_args))


def _documents(d, item, whole):
    """Writes one text file for each of 8 parts of d, holding the part's items; returns the folder."""
    path = _folder(d.sparkSession)
    d.select(F.pmod("o_orderkey", F.lit(8)).alias("part"), item.alias("item")).groupBy("part").agg(F.to_json(whole(F.collect_list("item"))).alias("value")).write.partitionBy("part").text(path)
    return f"{path}/part=*"


query("read_json", "orders", f"SELECT {', '.join(_THREE)} FROM orders")(lambda d: _same(readers.read_json(d.sparkSession, _documents(d, F.struct(*_THREE), lambda x: x))))
query("read_geojson", "orders", "SELECT o_orderkey, 'Point' AS geometry_type, o_custkey / 10.0::DOUBLE AS longitude, o_custkey / 20.0::DOUBLE AS latitude FROM orders")(lambda d: readers.read_geojson(d.sparkSession, _documents(d, F.struct(F.lit("Feature").alias("type"), F.struct("o_orderkey").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("o_custkey") / 10.0, F.col("o_custkey") / 20.0).alias("coordinates")).alias("geometry")), lambda x: F.struct(F.lit("FeatureCollection").alias("type"), x.alias("features")))).select("o_orderkey", "geometry_type", "longitude", "latitude"))
query("write_snapshot", "orders", "SELECT count(*)::BIGINT AS rows, 6::BIGINT AS columns FROM orders")(lambda d: readers.write_snapshot(d.select(*ALL_ORDER), _folder(d.sparkSession)).select("rows", F.col("columns").cast("bigint").alias("columns")))


def _snapshot(d):
    path = _folder(d.sparkSession)
    readers.write_snapshot(d, path)
    return readers.load_snapshot(d.sparkSession, path)


query("load_snapshot", "orders", "SELECT * FROM orders")(_snapshot)
query("preview_source", "orders", "SELECT least(100, count(*))::BIGINT AS n FROM orders")(lambda d: readers.preview_source(d, 100).agg(F.count("*").alias("n")))
query("query_fingerprint", "orders", "SELECT o_orderstatus, count(*)::BIGINT AS n, 64::INT AS fingerprint_length, 'least' AS params FROM orders WHERE o_totalprice > 1000 GROUP BY 1")(lambda d: (lambda q: readers.query_source(d.sparkSession, q, {"least": 1000}, {"f_orders": d}).withColumn("x", F.lit(1)).join(readers.query_fingerprint(d.sparkSession, "f_orders", q, {"least": 1000}).select(F.lit(1).alias("x"), F.length("fingerprint").alias("fingerprint_length"), F.array_join("param_names", ",").alias("params")), "x").drop("x"))("SELECT o_orderstatus, count(*) AS n FROM f_orders WHERE o_totalprice > :least GROUP BY 1"))


def _states(d):
    """A store with a root and, below it, one state by two steps and one beside it."""
    store = StateStore(d.sparkSession, _folder(d.sparkSession))
    store.register("dear", "SELECT * FROM {df} WHERE o_totalprice > :least")
    root = store.save(d.select(*ALL_ORDER), "root")
    dear = store.save(store.steps["dear"](d, least=100000), "dear", root, "dear", {"least": 100000})
    view = {"hidden": ["o_custkey"]}
    seen = store.save(store.run_flow(d, [("dear", {"least": 100000}), ("view", view)]), "seen", dear, "view", view)
    beside = store.save(d.where("o_orderstatus = 'F'"), "beside", root)
    return store, {"root": root, "dear": dear, "seen": seen, "beside": beside}


_DEAR = "SELECT * EXCLUDE (o_custkey) FROM orders WHERE o_totalprice > 100000"
_SAVED = "SELECT 'root' AS title, count(*)::BIGINT AS rows FROM orders UNION ALL SELECT 'dear', count(*) FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 'seen', count(*) FROM orders WHERE o_totalprice > 100000"
query("save_state", "orders", _SAVED + " UNION ALL SELECT 'beside', count(*) FROM orders WHERE o_orderstatus = 'F'")(lambda d: _states(d)[0].states.select("title", "rows"))
query("checkout", "orders", _DEAR)(lambda d: (lambda s, k: s.load(k["seen"]))(*_states(d)))
query("state_path", "orders", "SELECT * EXCLUDE (i), i::INT AS depth FROM (SELECT *, CASE title WHEN 'seen' THEN 0 WHEN 'dear' THEN 1 ELSE 2 END AS i FROM (" + _SAVED + "))")(lambda d: (lambda s, k: s.path(k["seen"]).select("title", "rows", "depth"))(*_states(d)))
query("state_tree", "orders", "SELECT count(*)::BIGINT AS states, 2::INT AS deepest FROM (SELECT 1 FROM orders LIMIT 4)")(lambda d: (lambda s, k: s.tree(k["root"]).agg(F.count("*").alias("states"), F.max("depth").alias("deepest")))(*_states(d)))
query("replay_state", "orders", _DEAR)(lambda d: (lambda s, k: s.replay(k["seen"], d))(*_states(d)))
query("run_flow", "orders", _DEAR)(lambda d: _states(d)[0].run_flow(d, [("dear", {"least": 100000}), ("view", {"hidden": ["o_custkey"]})]))
query("register_transform", "orders", "SELECT * FROM orders WHERE o_totalprice > 300000")(lambda d: _states(d)[0].steps["dear"](d, least=300000))
query("delete_states", "orders", "SELECT 'root' AS title, count(*)::BIGINT AS rows FROM orders UNION ALL SELECT 'beside', count(*) FROM orders WHERE o_orderstatus = 'F'")(lambda d: (lambda s, k: (s.delete(k["dear"]), s.states.select("title", "rows"))[1])(*_states(d)))
