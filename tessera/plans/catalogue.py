"""The registered queries, one per operator, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import assess as A
from tessera.operators import charts as G
from tessera.operators import clean as K
from tessera.operators import modeling as M
from tessera.operators import profile as P
from tessera.operators import rules as R
from tessera.operators import stats as S
from tessera.operators import views as V
from tessera.sources import readers
from tessera.streaming import incremental

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    """Registers f(df) over a table; `dirty` is orders with nulls, missing words, flags and spikes."""
    if name in _QUERIES:
        raise ValueError(f"two queries are named {name}")

    def add(f):
        def run(spark, sf_dir, f=f):
            return f(dirty(spark, sf_dir) if table == "dirty" else spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql.replace("{dirty}", f"({DIRTY_SQL})")
        return f

    return add


DIRTY = """*, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'N/A' WHEN o_orderkey % 13 = 0 THEN ' ' ELSE CAST(o_orderkey AS STRING) END AS num_text,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price_null,
 CASE o_orderkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'No' WHEN 2 THEN ' yes ' ELSE NULL END AS flag_text,
 CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS price_spike"""
DIRTY_SQL = f"SELECT {DIRTY.replace('AS STRING', 'AS VARCHAR')} FROM orders"


def dirty(spark, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*DIRTY.replace("*, ", "*,\n").split(",\n"))


def each(cols, f: str) -> str:
    """UNION ALL of a SELECT over columns; {c} is the column."""
    return "\nUNION ALL\n".join(f.replace("{c}", c) for c in cols)


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
ORDER_TEXT = ("o_orderstatus", "o_orderpriority")
ALL_ORDER = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")

# --- profile ---------------------------------------------------------------------------------------------------
query("dataset_summary", "orders", "SELECT count(*)::BIGINT AS rows, 6::BIGINT AS columns, 0::BIGINT AS missing_cells, 0.0 AS missing_ratio, (count(*) - count(DISTINCT (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)))::BIGINT AS duplicate_rows FROM orders")(P.dataset_summary)
query("duplicate_documents", "documents", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)")(lambda d: P.duplicate_rows(d.drop("doc_id")))
query("column_counts", "dirty", each(("num_text", "price_null", "flag_text"), "SELECT '{c}' AS column_name, count({c})::BIGINT AS non_null, (count(*) - count({c}))::BIGINT AS missing, (count(*) - count({c})) / count(*)::DOUBLE AS missing_ratio, count(DISTINCT {c})::BIGINT AS distinct_count, count(DISTINCT {c}) / count({c})::DOUBLE AS distinct_ratio FROM {dirty}"))(lambda d: P.column_counts(d.select("num_text", "price_null", "flag_text")))
_FREQ = "(SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1)"
query("top_values", "orders", each(ORDER_TEXT, "SELECT '{c}' AS column_name, rank::INT AS rank, value, n::BIGINT AS n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank FROM " + _FREQ + ") WHERE rank <= 10"))(lambda d: P.top_values(d, list(ORDER_TEXT)))
query("dominant_value", "orders", each(ORDER_TEXT, "SELECT '{c}' AS column_name, arg_min(value, (-n, value)) AS dominant_value, max(n) / sum(n)::DOUBLE AS dominant_share FROM " + _FREQ))(lambda d: P.frequency_facts(d, list(ORDER_TEXT)).select("column_name", "dominant_value", "dominant_share"))
query("rare_values", "orders", each(("o_custkey", "o_orderstatus"), "SELECT '{c}' AS column_name, count(*) FILTER (n <= 5)::BIGINT AS rare_values, coalesce(sum(n) FILTER (n <= 5), 0) / sum(n)::DOUBLE AS rare_share FROM " + _FREQ))(lambda d: P.frequency_facts(d, ["o_custkey", "o_orderstatus"]).select("column_name", "rare_values", "rare_share"))
query("entropy", "orders", each(("o_custkey", *ORDER_TEXT), "SELECT '{c}' AS column_name, entropy({c}) AS entropy, entropy({c}) / log2(count(DISTINCT {c})) AS entropy_ratio FROM orders"))(lambda d: P.frequency_facts(d, ["o_custkey", *ORDER_TEXT]).select("column_name", "entropy", "entropy_ratio"))
_TOKENS = ", ".join(f"'{t}'" for t in C.MISSING_TOKENS)
query("missing_like_tokens", "dirty", f"SELECT 'num_text' AS column_name, lower(trim(num_text)) AS token, count(*)::BIGINT AS n FROM {{dirty}} WHERE lower(trim(num_text)) IN ({_TOKENS}) GROUP BY 2")(lambda d: P.missing_like_tokens(d, ["num_text"]))
_NUM = "SELECT '{c}' AS column_name, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg({c}) AS mean, median({c}) AS median, stddev_samp({c}) AS std, skewness({c}) AS skew, kurtosis({c}) AS kurtosis, avg(({c} = 0)::INT) AS zero_ratio, avg(({c} < 0)::INT) AS negative_ratio, avg(({c} > 0)::INT) AS positive_ratio, avg(({c} = floor({c}))::INT) AS integer_ratio, 0::BIGINT AS infinite_count FROM lineitem"
query("numeric_metrics", "lineitem", each(LINE, _NUM))(lambda d: P.numeric_metrics(d, list(LINE)))
_Q = "SELECT '{c}' AS column_name, " + ", ".join(f"quantile_cont({{c}}, {q}) AS {n}" for q, n in zip(P.QUANTILES, P.QUANTILE_NAMES)) + " FROM lineitem"
query("quantiles11", "lineitem", each(LINE, _Q))(lambda d: P.quantiles11(d, list(LINE)))
_IQR = "SELECT '{c}' AS column_name, b - a AS iqr, o::BIGINT AS outliers, o / n::DOUBLE AS outlier_ratio FROM (SELECT any_value(a) AS a, any_value(b) AS b, count(*) AS n, count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS o FROM (SELECT {c} AS v, quantile_cont({c}, 0.25) OVER () AS a, quantile_cont({c}, 0.75) OVER () AS b FROM {dirty}))"
query("iqr_outliers", "dirty", each(("o_totalprice", "price_spike"), _IQR))(lambda d: P.iqr_outliers(d, ["o_totalprice", "price_spike"]))
query("top_1pct_share", "lineitem", "SELECT sum(v) FILTER (r <= k) / sum(v) AS share FROM (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice DESC) AS r, ceil(0.01 * count(*) OVER ()) AS k FROM lineitem)")(lambda d: S.top_share(d, "l_extendedprice", 0.01))
query("string_metrics", "documents", "SELECT 'text' AS column_name, min(length(text))::INT AS min_length, max(length(text))::INT AS max_length, avg(length(text)) AS mean_length, median(length(text)) AS median_length, count(*) FILTER (trim(text) = '')::BIGINT AS empty_count, avg(len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'))) AS mean_words, max(len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')))::INT AS max_words FROM documents")(lambda d: P.string_metrics(d, ["text"]))
query("parse_ratios", "dirty", "SELECT 'num_text' AS column_name, avg((try_cast(nullif(trim(num_text), '') AS DOUBLE) IS NOT NULL)::INT) FILTER (num_text IS NOT NULL) AS numeric_ratio, avg((try_cast(nullif(trim(num_text), 'N/A') AS DOUBLE) IS NOT NULL)::INT) FILTER (num_text NOT IN ('N/A', ' ')) AS numeric_parse_ratio FROM {dirty}")(lambda d: P.parse_ratios(d, ["num_text"]).select("column_name", "numeric_ratio", "numeric_parse_ratio"))
query("numeric_parse_ratio", "dirty", "SELECT 'flag_text' AS column_name, 0.0 AS numeric_parse_ratio")(lambda d: P.parse_ratios(d, ["flag_text"]).select("column_name", "numeric_parse_ratio"))
query("boolean_metrics", "dirty", "SELECT 'flag_text' AS column_name, count(*) FILTER (lower(trim(flag_text)) IN ('y', 'yes'))::BIGINT AS true_count, count(*) FILTER (flag_text = 'No')::BIGINT AS false_count, avg((flag_text <> 'No')::INT) AS true_ratio, 0.0 AS unmapped_ratio FROM {dirty}")(lambda d: P.boolean_metrics(d, ["flag_text"]))
query("datetime_range", "events", "SELECT 'ts' AS column_name, min(ts) AS min, max(ts) AS max, count(ts)::BIGINT AS non_null FROM events")(lambda d: P.datetime_range(d, ["ts"]))
query("numeric_histogram16", "lineitem", "WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 16 AS w FROM lineitem) SELECT bin, lo + bin * w AS lo, lo + (bin + 1) * w AS hi, n FROM (SELECT least(floor((l_extendedprice - lo) / w), 15)::INT AS bin, count(*)::BIGINT AS n FROM lineitem, b GROUP BY 1), b")(lambda d: P.numeric_histogram(d, "l_extendedprice", 16))
query("examples", "orders", each(ORDER_TEXT, "SELECT '{c}' AS column_name, r::INT AS rank, value FROM (SELECT DISTINCT {c} AS value, dense_rank() OVER (ORDER BY {c}) AS r FROM orders) WHERE r <= 5"))(lambda d: P.examples(d, list(ORDER_TEXT)))
query("fact_table", "dirty", each(("num_text",), "SELECT 'num_text' AS subject, fact, value::DOUBLE AS value, 'exact' AS mode, 1.0 AS confidence FROM (SELECT count(num_text)::DOUBLE AS non_null, (count(*) - count(num_text))::DOUBLE AS missing, (count(*) - count(num_text)) / count(*)::DOUBLE AS missing_ratio, count(DISTINCT num_text)::DOUBLE AS distinct_count, count(DISTINCT num_text) / count(num_text)::DOUBLE AS distinct_ratio FROM {dirty}) UNPIVOT (value FOR fact IN (non_null, missing, missing_ratio, distinct_count, distinct_ratio))"))(lambda d: P.fact_table(d.select("num_text")))
query("profile_numeric", "lineitem", each(LINE, _NUM.replace(" FROM lineitem", ", " + ", ".join(f"quantile_cont({{c}}, {q}) AS {n}" for q, n in zip(P.QUANTILES, P.QUANTILE_NAMES)) + " FROM lineitem")))(lambda d: P.numeric_metrics(d, list(LINE), True))
query("column_profile", "lineitem")(P.column_profile)
query("datetime_metrics", "events", "SELECT min(gap) AS min_gap, median(gap) AS median_gap, max(gap) AS max_gap, count(*) FILTER (gap = 0)::BIGINT AS duplicates FROM (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1e6 AS gap FROM events) WHERE gap IS NOT NULL")(lambda d: S.gaps(d, "ts").withColumn("gap", F.round("gap", 6)).agg(F.min("gap").alias("min_gap"), F.median("gap").alias("median_gap"), F.max("gap").alias("max_gap"), F.count_if(F.col("gap") == 0).alias("duplicates")))
# --- rules -----------------------------------------------------------------------------------------------------
query("semantic_hypotheses", "orders")(R.semantic_types)
query("numeric_rules", "lineitem")(lambda d: R.semantic_types(d.select(*LINE)).select("column_name", "semantic_type", "confidence"))
query("string_rules", "documents")(lambda d: R.semantic_types(d.select("text", "lang", "source")).select("column_name", "semantic_type", "confidence"))
query("column_role", "orders", "SELECT * FROM (VALUES ('o_orderkey', 'id'), ('o_custkey', 'feature'), ('o_orderstatus', 'feature'), ('o_totalprice', 'feature'), ('o_orderdate', 'timestamp'), ('o_orderpriority', 'feature')) t(column_name, role)")(lambda d: R.semantic_types(d).select("column_name", "role"))
query("binary_profile", "labels", "SELECT c AS column_name, 'clean_binary' AS kind, 0.98 AS confidence, false AS ambiguous, '0' AS zero_value, '1' AS one_value FROM (VALUES ('quality'), ('toxic')) t(c)")(lambda d: R.binary_profile(d, ["quality", "toxic"]))
query("quality_flags", "orders", each(("o_orderkey", "o_orderstatus"), "SELECT '{c}' AS column_name, count(DISTINCT {c}) <= 1 AS constant, (SELECT max(n) >= 0.98 * sum(n) FROM " + _FREQ + ") AS near_constant, count(DISTINCT {c}) >= 50 AND count(DISTINCT {c}) >= 0.5 * count({c}) AS high_cardinality FROM orders"))(lambda d: R.quality_flags(d.select("o_orderkey", "o_orderstatus")))
query("issues", "dirty")(R.issues)
query("insights", "documents")(R.insights)
query("target_candidates", "labels")(R.target_candidates)
query("time_candidates", "events")(R.time_candidates)
query("target_profile", "labels", "SELECT CAST(quality AS VARCHAR) AS value, count(*)::BIGINT AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS ratio FROM labels GROUP BY 1")(lambda d: R.target_profile(d, "quality"))
query("grain_keys", "orders", "SELECT 'o_orderkey' AS column_name, 0.95 AS confidence FROM orders HAVING count(DISTINCT o_orderkey) = count(*)")(lambda d: R.grain_keys(d.select("o_orderkey", "o_orderstatus")))
query("shape_hypotheses", "events")(R.shape_hypotheses)
# --- views -----------------------------------------------------------------------------------------------------
query("global_search", "part", "SELECT * FROM part WHERE lower(concat_ws('|', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)) LIKE '%brand#1%'")(lambda d: V.global_search(d, "Brand#1"))
query("filter_empty", "dirty", "SELECT o_orderkey, num_text FROM {dirty} WHERE num_text IS NULL OR trim(num_text) = ''")(lambda d: V.filter_empty(d, "num_text").select("o_orderkey", "num_text"))
query("filter_not_empty", "dirty", "SELECT o_orderkey, num_text FROM {dirty} WHERE trim(num_text) <> ''")(lambda d: V.filter_not_empty(d, "num_text").select("o_orderkey", "num_text"))
query("filter_numeric", "dirty", "SELECT o_orderkey, num_text FROM {dirty} WHERE try_cast(num_text AS DOUBLE) BETWEEN 100 AND 5000")(lambda d: V.filter_numeric(d, "num_text", 100, 5000).select("o_orderkey", "num_text"))
query("filter_datetime", "orders", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")(lambda d: V.filter_datetime(d, "o_orderdate", "1995-01-01", "1996-12-31").select("o_orderkey"))
query("filter_text", "orders", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) LIKE '1-%'")(lambda d: V.filter_text(d, "o_orderpriority", "1-", "starts").select("o_orderkey"))
query("filter_ops", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O') AND NOT contains(lower(o_orderpriority), 'low')")(lambda d: V.filter_op(V.filter_op(V.filter_op(d, "o_totalprice", "greater", 100000), "o_orderstatus", "in", "F, O"), "o_orderpriority", "not_contains", "low").select("o_orderkey"))
query("range_clip", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")(lambda d: V.range_clip(d, "l_quantity", 10, 20).select("l_orderkey", "l_linenumber"))
_VIEW = {"search": "urgent", "filters": [{"column": "o_totalprice", "op": "less", "value": 200000}], "hidden": ["o_custkey"]}
query("apply_view", "orders", "SELECT * EXCLUDE (o_custkey) FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_totalprice < 200000")(lambda d: V.apply_view(d, _VIEW))
query("view_summary", "orders", "SELECT count(*)::BIGINT AS rows_before, 6::BIGINT AS columns_before, count(*) FILTER (contains(lower(o_orderpriority), 'urgent') AND o_totalprice < 200000)::BIGINT AS rows_after, 5::BIGINT AS columns_after, count(*) FILTER (contains(lower(o_orderpriority), 'urgent') AND o_totalprice < 200000) / count(*)::DOUBLE AS row_ratio FROM orders")(lambda d: V.view_summary(d, _VIEW))
query("missing_category", "dirty", "SELECT flag_text, count(*)::BIGINT AS n FROM (SELECT CASE WHEN flag_text IS NULL OR trim(flag_text) = '' THEN 'Missing' ELSE flag_text END AS flag_text FROM {dirty}) GROUP BY 1")(lambda d: G.missing_category(d, "flag_text").groupBy("flag_text").agg(F.count("*").alias("n")))
query("axis_transform", "lineitem", "SELECT sum(CASE WHEN l_discount > 0 THEN ln(l_discount) END) AS a, sum(ln(1 + l_tax)) AS b, sum(sqrt(l_quantity)) AS c FROM lineitem")(lambda d: d.agg(F.sum(G.axis_transform(F.col("l_discount"), "log")).alias("a"), F.sum(G.axis_transform(F.col("l_tax"), "log1p")).alias("b"), F.sum(G.axis_transform(F.col("l_quantity"), "sqrt")).alias("c")))
# --- groups, windows, charts -----------------------------------------------------------------------------------
_AGGS = ("count", "sum", "mean", "median", "min", "max", "std", "var", "nunique", "p25", "p90")
query("group_agg", "lineitem", "SELECT l_returnflag, count(l_quantity)::BIGINT AS y_count, sum(l_quantity) AS y_sum, avg(l_quantity) AS y_mean, median(l_quantity) AS y_median, min(l_quantity) AS y_min, max(l_quantity) AS y_max, stddev_samp(l_quantity) AS y_std, var_samp(l_quantity) AS y_var, count(DISTINCT l_quantity)::BIGINT AS y_nunique, quantile_cont(l_quantity, 0.25) AS y_p25, quantile_cont(l_quantity, 0.9) AS y_p90 FROM lineitem GROUP BY 1")(lambda d: d.groupBy("l_returnflag").agg(*(G.aggregate(a, F.col("l_quantity")).alias(f"y_{a}") for a in _AGGS)))
query("agg_aliases", "orders", "SELECT o_orderstatus, avg(o_totalprice) AS y FROM orders GROUP BY 1")(lambda d: G.group_agg(d, ["o_orderstatus"], "o_totalprice", "average"))
query("grouped_quantile", "lineitem", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.95) AS y FROM lineitem GROUP BY 1")(lambda d: G.group_agg(d, ["l_returnflag"], "l_extendedprice", "p95"))
query("weighted_mean", "lineitem", "SELECT l_returnflag, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS y FROM lineitem WHERE l_quantity <> 0 GROUP BY 1")(lambda d: G.weighted_mean(d, ["l_returnflag"], "l_extendedprice", "l_quantity"))
query("pivot_agg", "lineitem", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS y FROM lineitem GROUP BY 1, 2")(lambda d: G.group_agg(d, ["l_returnflag", "l_linestatus"], None, "count"))
query("hierarchy_agg", "lineitem", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS y, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda d: G.hierarchy_agg(d, ["l_returnflag", "l_linestatus"], "l_quantity"))
query("location_agg", "customer", "SELECT c_nationkey, sum(c_acctbal) AS y FROM customer GROUP BY 1")(lambda d: G.group_agg(d, ["c_nationkey"], "c_acctbal"))
query("share_agg", "customer", "SELECT c_mktsegment, sum(c_acctbal) AS y, sum(c_acctbal) / sum(sum(c_acctbal)) OVER () AS share FROM customer GROUP BY 1")(lambda d: G.share_agg(d, "c_mktsegment", "c_acctbal"))
query("crosstab", "orders", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus)::DOUBLE AS share FROM orders GROUP BY 1, 2")(lambda d: G.crosstab(d, "o_orderstatus", "o_orderpriority", True))
query("value_counts", "documents", "SELECT source AS value, count(*)::BIGINT AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS ratio FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 25")(lambda d: G.value_counts(d, "source"))
query("distinct_count", "documents", "SELECT count(DISTINCT source)::BIGINT AS n FROM documents")(lambda d: d.agg(F.count_distinct("source").alias("n")))
query("group_target_summary", "dirty", "SELECT o_orderstatus, count(*)::BIGINT AS record_count, avg(price_null) AS target_mean, median(price_null) AS target_median, avg((price_null IS NULL)::INT) AS missing_ratio FROM {dirty} GROUP BY 1")(lambda d: G.group_target_summary(d, "price_null", ["o_orderstatus"]))
query("left_join_group_stats", "dirty", "SELECT flag_text, count(*)::BIGINT AS record_count, avg(price_null) AS target_mean, median(price_null) AS target_median, avg((price_null IS NULL)::INT) AS missing_ratio FROM {dirty} GROUP BY 1")(lambda d: G.group_target_summary(d, "price_null", ["flag_text"]))
query("target_profile_table", "labels", "SELECT toxic, count(*)::BIGINT AS record_count, avg((quality = 1)::INT) AS positive_rate, 0.0 AS missing_ratio FROM labels GROUP BY 1")(lambda d: G.group_target_summary(d, "quality", ["toxic"], G.positive_value(d, "quality")))
query("positive_value", "labels", "SELECT '1' AS value FROM labels LIMIT 1")(lambda d: d.select(F.lit(G.positive_value(d, "toxic")).alias("value")).limit(1))
_MONTH = "(SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, sum(o_totalprice) AS y FROM orders GROUP BY 1)"
_month = lambda d: d.groupBy(G.date_bucket(F.col("o_orderdate"), "month").alias("m")).agg(F.sum("o_totalprice").alias("y"))
query("rolling_stat", "orders", f"SELECT m, y, avg(y) OVER (ORDER BY m ROWS 2 PRECEDING) AS rolling FROM {_MONTH}")(lambda d: G.rolling_stat(_month(d), "m", "y", 3))
query("cumulative_sum", "orders", f"SELECT m, y, sum(y) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING) AS cumulative FROM {_MONTH}")(lambda d: G.cumulative_sum(_month(d), "m", "y"))
query("date_bucket", "orders", f"SELECT m, y FROM {_MONTH}")(_month)
query("records_over_time", "orders", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, count(*)::BIGINT AS n FROM orders GROUP BY 1")(lambda d: G.records_over_time(d, "o_orderdate"))
query("auto_bucket", "orders", "SELECT 'month' AS bucket FROM orders LIMIT 1")(lambda d: d.select(F.lit(G.auto_bucket(d, "o_orderdate")).alias("bucket")).limit(1))
_PRIO = "(SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS y FROM orders GROUP BY 1, 2)"
_prio = lambda d: G.group_agg(d, ["o_orderstatus", "o_orderpriority"], None, "count")
query("percent_total", "orders", f"SELECT *, y * 100.0::DOUBLE / sum(y) OVER () AS transformed FROM {_PRIO}")(lambda d: G.value_transform(_prio(d), "y", "percent_total"))
query("percent_group", "orders", f"SELECT *, y * 100.0::DOUBLE / sum(y) OVER (PARTITION BY o_orderstatus) AS transformed FROM {_PRIO}")(lambda d: G.value_transform(_prio(d), "y", "percent_group", ["o_orderstatus"]))
query("rank_desc", "orders", f"SELECT *, dense_rank() OVER (ORDER BY y DESC)::INT AS transformed FROM {_PRIO}")(lambda d: G.value_transform(_prio(d), "y", "rank_desc"))
query("rank_asc", "orders", f"SELECT *, dense_rank() OVER (ORDER BY y)::INT AS transformed FROM {_PRIO}")(lambda d: G.value_transform(_prio(d), "y", "rank_asc"))
query("bump_rank", "orders", f"SELECT *, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY y DESC)::INT AS rank FROM {_PRIO}")(lambda d: G.bump_rank(_prio(d), "o_orderstatus", "y"))
query("pareto", "orders", "SELECT o_orderpriority, y, 100.0::DOUBLE * sum(y) OVER (ORDER BY y DESC, o_orderpriority ROWS UNBOUNDED PRECEDING) / sum(y) OVER () AS cumulative_percent FROM (SELECT o_orderpriority, sum(o_totalprice) AS y FROM orders GROUP BY 1)")(lambda d: G.pareto(d, "o_orderpriority", "o_totalprice"))
query("waterfall_total", "orders", "SELECT o_orderstatus AS x, sum(o_totalprice) AS y FROM orders GROUP BY 1 UNION ALL SELECT 'Total', sum(o_totalprice) FROM orders")(lambda d: G.waterfall(d, "o_orderstatus", "o_totalprice"))
query("gaps", "events", "SELECT user_id, count(*)::BIGINT AS n, max(gap) AS max_gap FROM (SELECT user_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6, 6) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY 1")(lambda d: S.gaps(d, "ts", "user_id").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.round("gap", 6)).alias("max_gap")))
query("fill_forward", "dirty", "SELECT o_orderkey, last_value(price_null IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS price_null FROM {dirty}")(lambda d: K.fill_forward(d, "price_null", "o_orderkey", ["o_custkey"]).select("o_orderkey", "price_null"))
query("fill_backward", "dirty", "SELECT o_orderkey, first_value(price_null IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price_null FROM {dirty}")(lambda d: K.fill_forward(d, "price_null", "o_orderkey", ["o_custkey"], True).select("o_orderkey", "price_null"))
query("autocorrelation", "events", "WITH x AS (SELECT value, row_number() OVER (ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL) SELECT lag::INT AS lag, corr(a.value, b.value) AS r FROM range(1, 11) t(lag) JOIN x a ON true JOIN x b ON b.i = a.i + lag GROUP BY 1")(lambda d: S.autocorrelation(d, "event_id", "value", 10))
query("top_n_filter", "documents", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 3)")(lambda d: G.top_n_filter(d, "source", 3).select("doc_id"))
query("semi_top_levels", "orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 2)")(lambda d: G.top_n_filter(d, "o_orderpriority", 2, "o_totalprice").select("o_orderkey"))
query("top_n_other", "documents", "SELECT CASE WHEN source IN (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 3) THEN source ELSE 'Other' END AS source, count(*)::BIGINT AS n FROM documents GROUP BY 1")(lambda d: G.top_n_other(d, "source", 3).groupBy("source").agg(F.count("*").alias("n")))
query("dedupe", "orders", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(lambda d: K.dedupe(d, ["o_custkey"], "first", "o_orderkey").select("o_custkey", "o_orderkey"))
query("duplicate_groups", "orders", "SELECT sum(n) FILTER (n > 1)::BIGINT AS rows_in_groups, count(*) FILTER (n > 1)::BIGINT AS groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")(lambda d: K.duplicate_groups(d, ["o_custkey"]))
query("melt_matrix", "lineitem", "SELECT l_returnflag, name, value FROM (SELECT l_returnflag, avg(l_quantity) AS q, avg(l_tax) AS t FROM lineitem GROUP BY 1) UNPIVOT (value FOR name IN (q, t))")(lambda d: d.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("t")).unpivot("l_returnflag", ["q", "t"], "name", "value"))
query("bin_width", "lineitem", "SELECT greatest(ceil((l_quantity - 0) / 5.0) - 1, 0)::BIGINT AS bin, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")(lambda d: d.groupBy(G.bin_width(F.col("l_quantity"), 0, 5.0).cast("bigint").alias("bin")).agg(F.count("*").alias("n")))
query("bin_quantile", "lineitem", "SELECT ((v > a)::INT + (v > b)::INT + (v > c)::INT)::INT AS bin, count(*)::BIGINT AS n FROM (SELECT l_extendedprice AS v, quantile_cont(l_extendedprice, 0.25) OVER () AS a, quantile_cont(l_extendedprice, 0.5) OVER () AS b, quantile_cont(l_extendedprice, 0.75) OVER () AS c FROM lineitem) GROUP BY 1")(lambda d: G.bin_quantile(d, "l_extendedprice", 4).groupBy("bin").agg(F.count("*").alias("n")))
query("histogram", "lineitem", "WITH b AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 7 AS w FROM lineitem) SELECT bin, lo + bin * w AS lo, lo + (bin + 1) * w AS hi, n, n / sum(n) OVER ()::DOUBLE AS probability FROM (SELECT least(floor((l_quantity - lo) / w), 6)::INT AS bin, count(*)::BIGINT AS n FROM lineitem, b GROUP BY 1), b")(lambda d: G.histogram(d, "l_quantity", 7))
query("box", "lineitem", "SELECT l_returnflag, count(*)::BIGINT AS n, min(l_tax) AS min, quantile_cont(l_tax, 0.25) AS q1, median(l_tax) AS median, quantile_cont(l_tax, 0.75) AS q3, max(l_tax) AS max FROM lineitem GROUP BY 1")(lambda d: G.box(d, "l_tax", ["l_returnflag"]))
query("ecdf", "lineitem", "SELECT value, sum(n) OVER (ORDER BY value)::BIGINT AS cumulative, sum(n) OVER (ORDER BY value) / sum(n) OVER ()::DOUBLE AS share FROM (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1)")(lambda d: G.ecdf(d, "l_quantity"))
query("scatter_trend", "lineitem", "SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem")(lambda d: G.trend(d, "l_quantity", "l_extendedprice"))
query("calendar_table", "orders", "SELECT CAST(o_orderdate::DATE AS VARCHAR) AS day, weekofyear(o_orderdate::DATE)::INT AS iso_week, (isodow(o_orderdate::DATE) - 1)::INT AS weekday, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2, 3")(lambda d: G.calendar_table(d, "o_orderdate", "o_totalprice").withColumn("day", F.col("day").cast("string")))
query("series_statistic", "lineitem", "SELECT quantile_cont(l_extendedprice, 0.9) AS value FROM lineitem")(lambda d: G.series_statistic(d, "l_extendedprice", "p90"))
query("histogram_outlier_options", "dirty", "SELECT m >= 5 * c OR c >= 20 * a OR b >= 10 * a AS clip, c AS clip_at FROM (SELECT quantile_cont(price_spike, 0.5) AS a, quantile_cont(price_spike, 0.95) AS b, quantile_cont(price_spike, 0.99) AS c, max(price_spike) AS m FROM {dirty})")(lambda d: G.histogram_outlier_options(d, "price_spike"))
query("parallel_categories", "lineitem", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2, 3")(lambda d: G.parallel_categories(d, ["l_returnflag", "l_linestatus", "l_linenumber"]))
query("chart_data", "orders", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, o_orderstatus, sum(o_totalprice) AS y, dense_rank() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY sum(o_totalprice) DESC)::INT AS rank FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2, date_trunc('month', o_orderdate)")(lambda d: G.chart_data(d, {"kind": "bump_chart", "x": "o_orderdate", "y": "o_totalprice", "color": "o_orderstatus", "bucket": "month", "filters": [{"column": "o_totalprice", "op": "greater", "value": 1000}]}))
# --- cleaning --------------------------------------------------------------------------------------------------
query("column_rename_preview", "nation", "SELECT * FROM (VALUES ('n_nationkey', 'n_nationkey'), ('n_name', 'n_name'), ('n_regionkey', 'n_regionkey')) t(column_name, proposed)")(K.rename_preview)
query("trim_strings", "dirty", "SELECT o_orderkey, trim(flag_text) AS flag_text FROM {dirty}")(lambda d: K.trim_strings(d, ["flag_text"]).select("o_orderkey", "flag_text"))
query("whitespace_mask", "dirty", "SELECT count(*) FILTER (flag_text <> trim(flag_text))::BIGINT AS n FROM {dirty}")(lambda d: K.whitespace_count(d, "flag_text"))
query("missing_like_to_null", "dirty", "SELECT o_orderkey, CASE WHEN num_text IN ('N/A', ' ') THEN NULL ELSE num_text END AS num_text FROM {dirty}")(lambda d: K.missing_like_to_null(d, ["num_text"]).select("o_orderkey", "num_text"))
query("parse_numeric", "dirty", "SELECT o_orderkey, try_cast(num_text AS DOUBLE) AS num_text FROM {dirty}")(lambda d: K.parse_numeric(d, "num_text").select("o_orderkey", "num_text"))
query("parse_datetime", "orders", "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders")(lambda d: K.parse_datetime(d.withColumn("d", F.date_format("o_orderdate", "MM/dd/yyyy")), "d").select("o_orderkey", F.col("d").cast("timestamp_ntz").alias("d")))
query("datetime_format_clusters", "orders", "SELECT '9-9-9' AS pattern, count(*)::BIGINT AS n FROM orders")(lambda d: K.format_clusters(d.withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd")), "d"))
query("map_values", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")(lambda d: K.map_values(d, "o_orderstatus", {"F": "done", "O": "open"}).select("o_orderkey", "o_orderstatus"))
query("category_variants", "dirty", "SELECT label, forms, n FROM (SELECT lower(trim(v)) AS label, count(*)::BIGINT AS forms, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN ' ' || lower(o_orderpriority) ELSE o_orderpriority END AS v, count(*) AS n FROM {dirty} GROUP BY 1) GROUP BY 1) WHERE forms > 1")(lambda d: K.category_variants(d.withColumn("v", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.lower("o_orderpriority"))).otherwise(F.col("o_orderpriority"))), "v"))
query("add_date_features", "orders", "SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, quarter(o_orderdate)::INT AS o_orderdate_quarter, month(o_orderdate)::INT AS o_orderdate_month, day(o_orderdate)::INT AS o_orderdate_day, (isodow(o_orderdate) - 1)::INT AS o_orderdate_weekday, (isodow(o_orderdate) >= 6)::INT AS o_orderdate_is_weekend FROM orders")(lambda d: K.add_date_features(d, "o_orderdate", ("year", "quarter", "month", "day", "weekday", "is_weekend")).drop(*ALL_ORDER[1:]))
query("datetime_model_features", "orders", "SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month FROM orders")(lambda d: K.add_date_features(d, "o_orderdate", ("year", "month")).drop(*ALL_ORDER[1:]))
query("json_prefix_ratio", "events", "SELECT avg(regexp_matches(props, '^\\s*[\\[{]')::INT) AS ratio FROM events WHERE props IS NOT NULL")(lambda d: P.parse_ratios(d, ["props"]).select(F.col("json_ratio").alias("ratio")))
query("ratio", "lineitem", "SELECT l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) AS r FROM lineitem")(lambda d: K.add_ratio(d, "l_tax", "l_discount", "r").select("l_orderkey", "l_linenumber", "r"))
query("unify_binary_flags", "dirty", "SELECT o_orderkey, CASE WHEN lower(trim(flag_text)) IN ('y', 'yes') THEN 1 ELSE 0 END::INT AS flag_text FROM {dirty}")(lambda d: K.unify_binary_flags(d, ["flag_text"], "int", "treat_as_false").select("o_orderkey", "flag_text"))
query("add_missing_indicators", "dirty", "SELECT o_orderkey, (price_null IS NULL)::TINYINT AS price_null_was_missing FROM {dirty}")(lambda d: K.add_missing_indicators(d, ["price_null"]).select("o_orderkey", "price_null_was_missing"))
query("impute_missing", "dirty", "SELECT o_orderkey, coalesce(price_null, median(price_null) OVER ()) AS price_null FROM {dirty}")(lambda d: K.impute_missing(d, {"price_null": "median"}).select("o_orderkey", "price_null"))
query("group_broadcast_fill", "dirty", "SELECT o_orderkey, coalesce(price_null, avg(price_null) OVER (PARTITION BY o_orderstatus)) AS price_null FROM {dirty}")(lambda d: K.impute_missing(d, {"price_null": "mean"}, by="o_orderstatus").select("o_orderkey", "price_null"))
query("one_hot_encode", "orders", "SELECT o_orderkey, (o_orderstatus = 'F')::TINYINT AS o_orderstatus_F, (o_orderstatus = 'O')::TINYINT AS o_orderstatus_O, (o_orderstatus = 'P')::TINYINT AS o_orderstatus_P FROM orders")(lambda d: K.one_hot_encode(d.select("o_orderkey", "o_orderstatus"), "o_orderstatus"))
for _m, _e in (("standard", "(v - avg(v) OVER ()) / stddev_pop(v) OVER ()"), ("minmax", "(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())"), ("robust", "(v - median(v) OVER ()) / (quantile_cont(v, 0.75) OVER () - quantile_cont(v, 0.25) OVER ())"), ("maxabs", "v / max(abs(v)) OVER ()")):
    query(f"scale_numeric_{_m}", "orders", f"SELECT o_orderkey, {_e} AS o_totalprice FROM (SELECT o_orderkey, o_totalprice AS v FROM orders)")(lambda d, m=_m: K.scale_numeric(d.select("o_orderkey", "o_totalprice"), ["o_totalprice"], m))
query("outlier_bounds", "dirty", "SELECT avg(v) - 3 * stddev_pop(v) AS z_lo, avg(v) + 3 * stddev_pop(v) AS z_hi, median(v) - 3.5 * mad(v) / 0.6745 AS m_lo, median(v) + 3.5 * mad(v) / 0.6745 AS m_hi, quantile_cont(v, 0.01) AS p_lo, quantile_cont(v, 0.99) AS p_hi FROM (SELECT price_spike AS v FROM {dirty})")(lambda d: d.sparkSession.createDataFrame([K.outlier_bounds(d, "price_spike", "zscore") + K.outlier_bounds(d, "price_spike", "modified_zscore") + tuple(K.outlier_bounds(d, "price_spike", "percentile"))], "z_lo double, z_hi double, m_lo double, m_hi double, p_lo double, p_hi double"))
query("clean_numeric_outliers", "dirty", "SELECT o_orderkey, (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a))::TINYINT AS price_spike_is_outlier FROM (SELECT o_orderkey, price_spike AS v, quantile_cont(price_spike, 0.25) OVER () AS a, quantile_cont(price_spike, 0.75) OVER () AS b FROM {dirty})")(lambda d: K.clean_numeric_outliers(d, {"price_spike": ("iqr", "flag")}).select("o_orderkey", "price_spike_is_outlier"))
query("outlier_preview", "dirty", each(("price_spike",), _IQR))(lambda d: P.iqr_outliers(d, ["price_spike"]))
_GEO = "(SELECT c_custkey, c_acctbal / 60 AS lat, c_acctbal / 50 AS lon FROM customer)"
_geo = lambda d: d.select("c_custkey", (F.col("c_acctbal") / 60).alias("lat"), (F.col("c_acctbal") / 50).alias("lon"))
query("geo_review", "customer", f"SELECT count(*) FILTER (abs(lat) > 90 OR abs(lon) > 180)::BIGINT AS invalid, count(*) FILTER (abs(lat) > 90 AND abs(lat) <= 180 AND abs(lon) <= 90)::BIGINT AS likely_swapped FROM {_GEO}")(lambda d: K.geo_review(_geo(d), "lat", "lon"))
query("geo_fix", "customer", f"SELECT c_custkey, CASE WHEN abs(lat) > 90 OR abs(lon) > 180 THEN NULL ELSE lat END AS lat, CASE WHEN abs(lat) > 90 OR abs(lon) > 180 THEN NULL ELSE lon END AS lon FROM {_GEO}")(lambda d: K.geo_fix(_geo(d), "lat", "lon"))
query("missing_treatment", "dirty", "SELECT o_orderkey, coalesce(flag_text, 'Missing') AS flag_text FROM {dirty}")(lambda d: K.impute_missing(d, {"flag_text": "missing"}).select("o_orderkey", "flag_text"))
query("cleaning_plan_apply", "dirty", "SELECT o_orderkey, try_cast(num_text AS DOUBLE) AS num_text, CASE WHEN lower(trim(flag_text)) IN ('y', 'yes') THEN 1 WHEN flag_text = 'No' THEN 0 END::DOUBLE AS flag_text FROM {dirty}")(lambda d: (lambda x: K.apply_cleaning(x, K.cleaning_plan(x)).withColumn("flag_text", F.col("flag_text").cast("double")))(d.select("o_orderkey", "num_text", "flag_text")))
query("modeling_plan", "orders")(lambda d: K.modeling_plan(d, "o_orderstatus"))
query("modeling_plan_apply", "orders")(lambda d: K.apply_modeling(d, K.modeling_plan(d, "o_orderstatus")))
query("type_downcast_plan", "lineitem", "SELECT * FROM (VALUES ('l_orderkey', 'bigint', CASE WHEN (SELECT max(l_orderkey) FROM lineitem) < 32768 THEN 'smallint' ELSE 'int' END), ('l_linenumber', 'int', 'tinyint')) t(column_name, from_type, to_type)")(lambda d: K.downcast_plan(d.select("l_orderkey", "l_linenumber")))
query("apply_downcast", "lineitem", "SELECT l_orderkey, l_linenumber::TINYINT AS l_linenumber FROM lineitem")(lambda d: (lambda x: K.apply_downcast(x, K.downcast_plan(x)).withColumn("l_orderkey", F.col("l_orderkey").cast("bigint")))(d.select("l_orderkey", "l_linenumber")))
query("low_cardinality_plan", "orders", each(ORDER_TEXT, "SELECT '{c}' AS column_name, count(DISTINCT {c})::BIGINT AS distinct_count, count(DISTINCT {c}) / count({c})::DOUBLE AS distinct_ratio FROM orders"))(K.low_cardinality_plan)
# --- lenses ----------------------------------------------------------------------------------------------------
query("missingness", "dirty", each(("num_text", "price_null", "flag_text"), "SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL)::BIGINT AS missing, avg(({c} IS NULL)::INT) AS missing_ratio FROM {dirty}"))(lambda d: S.missingness(d.select("num_text", "price_null", "flag_text")))
query("row_missingness", "dirty", "SELECT min(k)::INT AS min_missing, max(k)::INT AS max_missing, avg(k) AS mean_missing FROM (SELECT (num_text IS NULL)::INT + (price_null IS NULL)::INT + (flag_text IS NULL)::INT AS k FROM {dirty})")(lambda d: S.row_missingness(d.select("num_text", "price_null", "flag_text")))
query("missingness_phi", "dirty", "SELECT 'num_text' AS a, 'price_null' AS b, corr((num_text IS NULL)::INT, (price_null IS NULL)::INT) AS phi FROM {dirty}")(lambda d: S.missingness_phi(d, ["num_text", "price_null"]))
query("binary_rates", "dirty", "SELECT 'flag_text' AS column_name, avg((flag_text <> 'No')::INT) AS true_ratio FROM {dirty}")(lambda d: P.boolean_metrics(d, ["flag_text"]).select("column_name", "true_ratio"))
query("lorenz", "lineitem", "SELECT 2 * sum(i * v) / (any_value(n) * sum(v)) - (any_value(n) + 1) / any_value(n)::DOUBLE AS gini, sum(v) FILTER (n - i < ceil(0.01 * n)) / sum(v) AS top1_share, sum(v) FILTER (n - i < ceil(0.05 * n)) / sum(v) AS top5_share, sum(v) FILTER (n - i < ceil(0.1 * n)) / sum(v) AS top10_share FROM (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem)")(lambda d: S.lorenz(d, "l_extendedprice"))
query("concentration_curve", "orders", "SELECT sum(k) OVER (ORDER BY v) / sum(k) OVER ()::DOUBLE AS row_share, sum(k * v) OVER (ORDER BY v) / sum(k * v) OVER () AS amount_share FROM (SELECT o_totalprice AS v, count(*) AS k FROM orders GROUP BY 1)")(lambda d: S.lorenz_curve(d, "o_totalprice"))
query("top_share", "orders", "SELECT sum(v) FILTER (r <= k) / sum(v) AS share FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice DESC) AS r, ceil(0.1 * count(*) OVER ()) AS k FROM orders)")(lambda d: S.top_share(d, "o_totalprice", 0.1))
_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]
query("pearson_matrix", "lineitem", "\nUNION ALL\n".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS))(lambda d: S.pearson_matrix(d, ["l_quantity", "l_extendedprice", "l_discount"]))
_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
query("spearman", "lineitem", f"SELECT corr(a, b) AS rho FROM (SELECT {_RANK.replace('{c}', 'l_quantity')} AS a, {_RANK.replace('{c}', 'l_extendedprice')} AS b FROM lineitem)")(lambda d: S.spearman(d, "l_quantity", "l_extendedprice"))
query("kendall", "lineitem", "WITH g AS (SELECT l_discount AS x, l_tax AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM g a JOIN g b ON b.x > a.x), t AS (SELECT sum(n) AS n FROM g), tx AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT sum(n) AS k FROM g GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT sum(n) AS k FROM g GROUP BY y)) SELECT s / sqrt((t.n * (t.n - 1) / 2 - tx.v) * (t.n * (t.n - 1) / 2 - ty.v)) AS tau FROM s, t, tx, ty")(lambda d: S.kendall(d, "l_discount", "l_tax"))
_ETA = "SELECT sum(n * (m - mu) * (m - mu)) / (sum(n * (m - mu) * (m - mu)) + sum(n * v)) AS eta_squared FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS mu FROM (SELECT count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY o_orderpriority))"
query("eta_squared", "orders", _ETA)(lambda d: S.eta_squared(d, "o_totalprice", "o_orderpriority"))
query("correlation_ratio", "orders", f"SELECT sqrt(eta_squared) AS eta FROM ({_ETA})")(lambda d: S.correlation_ratio(d, "o_totalprice", "o_orderpriority"))
_CRAMER = "SELECT sqrt((sum(o * o / (r * c)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)) AS v FROM (SELECT *, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c FROM (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS o FROM lineitem GROUP BY 1, 2))"
query("cramers_v", "lineitem", _CRAMER)(lambda d: S.cramers_v(d, "l_returnflag", "l_linestatus"))
query("pairwise_align", "dirty", "SELECT count(*)::BIGINT AS n, corr(price_null, price_spike) AS r FROM {dirty} WHERE price_null IS NOT NULL AND price_spike IS NOT NULL")(lambda d: d.where("price_null is not null and price_spike is not null").agg(F.count("*").alias("n"), S._pearson(F.col("price_null"), F.col("price_spike")).alias("r")))
query("target_balance", "orders", "SELECT o_orderstatus AS value, count(*)::BIGINT AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS ratio FROM orders GROUP BY 1")(lambda d: S.target_balance(d, "o_orderstatus"))
query("text_lengths", "benchmark", "SELECT 'text' AS column_name, min(length(text))::INT AS min_length, max(length(text))::INT AS max_length, avg(length(text)) AS mean_length FROM benchmark")(lambda d: S.text_lengths(d, "text").select("column_name", "min_length", "max_length", "mean_length"))
query("type_coercion", "dirty")(lambda d: R.issues(K.missing_like_to_null(d.select("num_text", "flag_text"), ["num_text"])).where(F.col("issue").endswith("_like_text")))
# --- models ----------------------------------------------------------------------------------------------------
def _labelled(d):
    return d.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("double").alias("label"))


def _priced(d):
    return d.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"))


query("fit_baseline", "orders", "SELECT avg(o_totalprice) AS prediction FROM orders")(lambda d: M.baseline(d, "o_totalprice"))
query("preflight", "orders", "SELECT sum(n)::BIGINT AS rows, count(*)::BIGINT AS classes, min(n)::BIGINT AS smallest_class, max(n) / sum(n)::DOUBLE AS imbalance, max(n) / sum(n) >= 0.9 AS imbalanced FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)")(lambda d: M.preflight(d, "o_orderstatus"))
query("roc_auc", "lineitem", "SELECT (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM (SELECT " + _RANK.replace("{c}", "l_quantity") + " AS r, (l_returnflag = 'R')::INT AS y FROM lineitem)")(lambda d: M.roc_auc(d.select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))))
query("model_comparison", "lineitem")(lambda d: M.model_comparison(_priced(d), "row_key", ["l_quantity", "l_discount", "l_tax"], [], "regression"))
query("kmeans", "lineitem")(lambda d: M.cluster_metrics(M.kmeans(d, ["l_quantity", "l_discount"])))
query("pca_project", "lineitem")(lambda d: M.pca_project(d, list(LINE)).select("l_orderkey", "l_linenumber", "pc", "explained"))
query("task_inference", "orders", "SELECT 'multiclass_classification' AS task, 0.95::DOUBLE AS confidence, 'o_orderstatus' AS target FROM orders HAVING count(DISTINCT o_orderstatus) BETWEEN 3 AND 20")(lambda d: A.task_inference(d, "o_orderstatus"))
query("suggested_config", "labels")(A.suggested_config)
query("grid_search", "lineitem")(lambda d: A.grid_search(_priced(d), "row_key", ["l_quantity", "l_tax"], [], "linear", "regression", {"regParam": [0.1, 1.0, 10.0]}))
query("model_assessment", "lineitem", "SELECT 'r2' AS metric, round(regr_r2(l_extendedprice, l_quantity), 6) AS value, CASE WHEN regr_r2(l_extendedprice, l_quantity) >= 0.75 THEN 'strong' WHEN regr_r2(l_extendedprice, l_quantity) >= 0.4 THEN 'promising' ELSE 'weak' END AS rating FROM lineitem")(lambda d: A.model_assessment(d.agg(F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2")), "regression"))
_CLUSTERS = "(SELECT l_returnflag AS k, count(*)::DOUBLE AS n, avg(l_quantity) AS a, avg(l_tax) AS b, var_pop(l_quantity) + var_pop(l_tax) AS v FROM lineitem GROUP BY 1)"
query("cluster_separation", "lineitem", f"WITH g AS {_CLUSTERS}, c AS (SELECT sum(n * a) / sum(n) AS a, sum(n * b) / sum(n) AS b FROM g) SELECT (SELECT count(*)::BIGINT FROM g) AS clusters, (SELECT sum(n * ((g.a - c.a) * (g.a - c.a) + (g.b - c.b) * (g.b - c.b))) * (sum(n) - count(*)) / (sum(n * v) * (count(*) - 1)) FROM g, c) AS calinski_harabasz, (SELECT avg(r) FROM (SELECT x.k, max((sqrt(x.v) + sqrt(y.v)) / sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))) AS r FROM g x JOIN g y ON x.k <> y.k GROUP BY 1)) AS davies_bouldin")(lambda d: A.cluster_separation(d, ["l_quantity", "l_tax"], "l_returnflag"))
# --- sources, streams ------------------------------------------------------------------------------------------
query("query_source", "orders", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1")(lambda d: readers.query_source(d.sparkSession, "SELECT o_orderstatus, count(*) AS n FROM q_orders WHERE o_totalprice > :least GROUP BY 1", {"least": 50000}, {"q_orders": d}))


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = incremental.windowed_profile(incremental.read_stream(spark, f"{sf_dir}/events.parquet*", schema))
    import uuid

    name = "windowed_" + uuid.uuid4().hex
    q = s.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


_QUERIES["stream_windowed_profile"] = _stream
_SQL["stream_windowed_profile"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*)::BIGINT AS n, count(*) FILTER (value IS NULL)::BIGINT AS missing, sum(value) AS total FROM events GROUP BY 1, 2"


def queries() -> dict:
    from tessera.plans import deep, extended, prepared  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tessera.plans import deep, extended, prepared  # noqa: F401

    return dict(_SQL)
