"""Registered queries of clusters, nearest rows, permutations, densities, flows, sources and model reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.shared import use_checkpoints
from tessera.operators import charts as G
from tessera.operators import clean as K
from tessera.operators import modeling as M
from tessera.operators import reports as R
from tessera.plans.catalogue import query
from tessera.sources.registry import SourceRegistry
from tessera.sources.states import StateStore

# --- clusters: flags of lines are far apart, so that any right clustering finds them ----------------------------
_apart = lambda d: d.select((F.ascii("l_returnflag") * 1000 + F.col("l_quantity")).alias("x"), (F.ascii("l_returnflag") * -1000 + 100 * F.col("l_tax")).alias("y"))
_FLAGS = "SELECT count(*)::BIGINT AS n FROM lineitem GROUP BY l_returnflag"
query("hierarchical", "lineitem", _FLAGS)(lambda d: M.hierarchical(_apart(d), ["x", "y"], 3).groupBy("cluster").agg(F.count("*").alias("n")).select("n"))
query("bisecting_kmeans", "lineitem", _FLAGS)(lambda d: M.bisecting(_apart(d), ["x", "y"], 3).groupBy("cluster").agg(F.count("*").alias("n")).select("n"))
query("kmeans_sizes", "lineitem", _FLAGS)(lambda d: M.kmeans(_apart(d), ["x", "y"], 3).groupBy("cluster").agg(F.count("*").alias("n")).select("n"))
query("dendrogram", "lineitem", "SELECT (count(*) - 1)::BIGINT AS merges, (SELECT count(*)::BIGINT FROM lineitem) AS rows FROM (SELECT DISTINCT l_discount, l_tax FROM lineitem)")(lambda d: M.dendrogram(d, ["l_discount", "l_tax"]).agg(F.count("*").alias("merges"), F.max("size").alias("rows")))
_placed = lambda d: d.select("c_custkey", (F.col("c_acctbal").cast("double") / 100).alias("x"), (F.col("c_nationkey") * 10.0).alias("y"), (F.length("c_mktsegment") * 10.0).alias("z"))
query(
    "dbscan",
    "customer",
    """WITH RECURSIVE p AS (SELECT c_custkey AS id, c_acctbal::DOUBLE / 100 AS x, c_nationkey * 10.0 AS y, length(c_mktsegment) * 10.0 AS z FROM customer),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.y = b.y AND a.z = b.z AND abs(a.x - b.x) <= 3),
core AS MATERIALIZED (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 3),
r(id, root) AS (SELECT id, id FROM core UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id JOIN core c ON c.id = e.b),
l AS MATERIALIZED (SELECT id, min(root) AS cluster FROM r GROUP BY id),
o AS (SELECT e.a AS id, min(l.cluster) AS cluster FROM e JOIN l ON e.b = l.id GROUP BY e.a)
SELECT p.id, coalesce(l.cluster, o.cluster, -1) AS cluster FROM p LEFT JOIN l ON l.id = p.id LEFT JOIN o ON o.id = p.id""",
)(lambda d: M.dbscan(_placed(d), "c_custkey", ["x", "y", "z"], 3.0, 3))

# --- nearest rows ----------------------------------------------------------------------------------------------
_NEAR = "(SELECT q.vec_id AS id, t.label, list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), t.vec_id) AS r FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id WHERE q.vec_id % 50 = 0)"
_WEIGHED = f"(SELECT id, label, CASE WHEN min(d) OVER (PARTITION BY id) = 0 THEN (d = 0)::INT::DOUBLE ELSE 1 / nullif(d, 0) END AS w FROM {_NEAR} WHERE r <= 5)"
_knn = lambda d, **kw: M.knn_predict(d, d.where("vec_id % 50 = 0"), ["embedding"], "label", "vec_id", **kw)
query("knn_vote", "embeddings", f"SELECT id, label::DOUBLE AS prediction FROM (SELECT id, label, count(*) AS votes FROM {_NEAR} WHERE r <= 5 GROUP BY id, label) QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) = 1")(lambda d: _knn(d, method="vote"))
query("knn_weighted", "embeddings", f"SELECT id, sum(w * label) / sum(w) AS prediction FROM {_WEIGHED} GROUP BY id")(lambda d: _knn(d, weights="distance"))

# --- what a permuted column costs: the model has one feature, so that SQL can fit it -----------------------------
_spiked = lambda d: d.select(F.col("o_orderkey").alias("k"), "o_totalprice", "o_custkey", F.col("price_spike").cast("double").alias("label"))
_PLACE = "row_number() OVER (ORDER BY CAST('0x' || substr(md5(k || '|{seed}'), 1, 13) AS BIGINT) % 1099511627776, k)"
query(
    "permutation_importance",
    "dirty",
    "WITH t AS MATERIALIZED (SELECT o_orderkey AS k, o_totalprice::DOUBLE AS x, price_spike::DOUBLE AS y FROM {dirty}),\n"
    "m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, var_pop(y) * count(*) AS total FROM t),\n"
    f"p AS (SELECT x, y, {_PLACE.replace('{seed}', '42')} AS place FROM t),\n"
    "d AS (" + " UNION ALL ".join(f"SELECT {r} AS rep, x, {_PLACE.replace('{seed}', str(43 + r))} AS place FROM t" for r in range(5)) + "),\n"
    "s AS (SELECT rep, 1 - sum(pow(a + b * d.x - y, 2)) / max(total) AS score FROM p JOIN d USING (place), m GROUP BY rep),\n"
    "l AS (SELECT (SELECT 1 - sum(pow(a + b * x - y, 2)) / max(total) FROM t, m) - score AS lost FROM s)\n"
    "SELECT 'o_totalprice' AS column_name, round(avg(lost), 8) AS importance, round(stddev_pop(lost), 8) AS deviation, 5::INT AS repeats FROM l\n"
    "UNION ALL SELECT 'o_custkey', 0.0, 0.0, 5::INT",
)(lambda d: M.permutation_importance(M.fit(_spiked(d), ["o_totalprice"], [], "linear", "regression"), _spiked(d), "k", ["o_totalprice", "o_custkey"]).select("column_name", F.round("importance", 8).alias("importance"), F.round("deviation", 8).alias("deviation"), "repeats"))

# --- shapes of groups ------------------------------------------------------------------------------------------
query(
    "violin",
    "orders",
    """WITH g AS (SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, stddev_pop(o_totalprice) AS sd, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders GROUP BY 1),
b AS (SELECT *, 0.9 * least(sd, CASE WHEN iqr > 0 THEN iqr / 1.34 ELSE sd END) * pow(n, -0.2) AS w, (hi - lo) / 64 AS step FROM g WHERE hi > lo),
c AS (SELECT o_orderpriority, least(floor((o_totalprice - lo) / step), 63) AS bin, count(*) AS m FROM orders JOIN b USING (o_orderpriority) GROUP BY 1, 2)
SELECT o_orderpriority, lo + (hi - lo) / 63 * k AS at, round(sum(m * exp(-pow(((hi - lo) / 63 * k - step * (bin + 0.5)) / w, 2) / 2)) / (n * w * sqrt(2 * pi())), 13) AS density
FROM c JOIN b USING (o_orderpriority), range(64) t(k) GROUP BY o_orderpriority, k, lo, hi, n, w""",
)(lambda d: G.chart_data(d, {"kind": "violin", "x": "o_orderpriority", "y": "o_totalprice"}).withColumn("density", F.round("density", 13)))
query(
    "box_outliers",
    "dirty",
    "WITH f AS (SELECT o_orderstatus, quantile_cont(price_spike, 0.25) AS a, quantile_cont(price_spike, 0.75) AS b FROM {dirty} GROUP BY 1) SELECT o_orderkey, o_orderstatus, price_spike, a - 1.5 * (b - a) AS lower_fence, b + 1.5 * (b - a) AS upper_fence FROM {dirty} JOIN f USING (o_orderstatus) WHERE price_spike < a - 1.5 * (b - a) OR price_spike > b + 1.5 * (b - a)",
)(lambda d: G.box_outliers(d, "price_spike", ["o_orderstatus"]).select("o_orderkey", "o_orderstatus", "price_spike", "lower_fence", "upper_fence"))
query("group_median_fill", "dirty", "SELECT o_orderkey, coalesce(price_null, median(price_null) OVER (PARTITION BY o_orderstatus), (SELECT median(price_null) FROM {dirty})) AS price_null FROM {dirty}")(lambda d: K.impute_missing(d, {"price_null": "median"}, by="o_orderstatus").select("o_orderkey", "price_null"))


# --- flows and sources -----------------------------------------------------------------------------------------
def _store(d) -> StateStore:
    s = StateStore(d.sparkSession, f"{use_checkpoints(d.sparkSession)}/query-{uuid.uuid4().hex}")
    s.register("dear", lambda df, least: df.where(F.col("o_totalprice") >= least))
    s.register("per_status", lambda df: df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")))
    s.register("share", lambda df, whole: df.join(whole.select("o_orderstatus", F.col("n").alias("of")), "o_orderstatus").select("o_orderstatus", "n", "of"))
    return s


_STEPS = [("dear", {"least": 200000}), ("per_status", {})]
_PER_STATUS = "SELECT o_orderstatus, count(*)::BIGINT AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice >= {} GROUP BY 1"


def _flow_from_path(d):
    s = _store(d)
    s.save_flow("dear by status", s.flow_from_path(s.run_flow_saved(d, _STEPS, "orders")[-1]))
    return s.run_flow(d.where("o_orderkey % 2 = 0"), s.flow("dear by status"))


def _replayed(d):
    s = _store(d)
    ids = s.run_flow_saved(d, [*_STEPS[:1], ("dear", {"least": 300000}), ("per_status", {})], "orders")
    for key in (ids[0], *ids[2:]):
        s.drop_data(key)
    return s.replay(ids[-1])


def _pushed(d):
    s = _store(d)
    root = s.save(d.where("o_totalprice < 100000"), "root")
    every = s.save(s.steps["per_status"](s.load(root)), "all", root, "per_status")
    dear = s.save(s.steps["dear"](s.load(root), least=200000), "dear", root, "dear", {"least": 200000})
    by = s.save(s.steps["per_status"](s.load(dear)), "dear by status", dear, "per_status")
    last = s.save(s.steps["share"](s.load(by), whole=s.load(every)), "share", by, "share")
    s.depend(last, every, "whole")
    s.update(root, d)
    s.push_dependencies(root)
    return s.load(last)


def _by_name(d):
    sources = SourceRegistry(d.sparkSession, f"{use_checkpoints(d.sparkSession)}/query-{uuid.uuid4().hex}")
    folder = f"{sources.folder}/orders-csv"
    d.select("o_orderkey", "o_orderstatus", "o_totalprice").write.csv(folder, header=True)
    sources.register("orders", "csv", folder, header="true", inferSchema="true")
    return SourceRegistry(d.sparkSession, sources.folder).read("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").cast("bigint").alias("last"))


query("flow_from_path", "orders", _PER_STATUS.format("200000") .replace("WHERE", "WHERE o_orderkey % 2 = 0 AND"))(_flow_from_path)
query("replay_nearest", "orders", _PER_STATUS.format("300000"))(_replayed)
query("push_dependencies", "orders", "SELECT o_orderstatus, count(*) FILTER (o_totalprice >= 200000)::BIGINT AS n, count(*)::BIGINT AS of FROM orders GROUP BY 1 HAVING count(*) FILTER (o_totalprice >= 200000) > 0")(_pushed)
query("register_source", "orders", "SELECT o_orderstatus, count(*)::BIGINT AS n, max(o_orderkey)::BIGINT AS last FROM orders GROUP BY 1")(_by_name)

# --- reports ---------------------------------------------------------------------------------------------------
_rated = lambda d: d.select("l_orderkey", "l_linenumber", F.ascii("l_returnflag").cast("double").alias("label"), F.when(F.col("l_quantity") > 40, 65.0).when(F.col("l_quantity") > 15, 78.0).otherwise(82.0).alias("prediction"))
_RATED = "(SELECT ascii(l_returnflag)::DOUBLE AS label, CASE WHEN l_quantity > 40 THEN 65.0 WHEN l_quantity > 15 THEN 78.0 ELSE 82.0 END::DOUBLE AS prediction FROM lineitem)"
query(
    "class_report",
    "lineitem",
    f"WITH c AS (SELECT v.label, (SELECT count(*) FROM {_RATED} r WHERE r.label = v.label) AS support, (SELECT count(*) FROM {_RATED} r WHERE r.prediction = v.label) AS predicted, (SELECT count(*) FROM {_RATED} r WHERE r.label = v.label AND r.prediction = v.label) AS tp FROM (SELECT label FROM {_RATED} UNION SELECT prediction FROM {_RATED}) v) "
    "SELECT label, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0)::DOUBLE, 0) AS f1, support::BIGINT AS support FROM c",
)(lambda d: R.class_report(_rated(d)))
query(
    "auc_one_vs_rest",
    "lineitem",
    "SELECT k::INT AS label, (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS r FROM (SELECT k, CASE k WHEN 0 THEN l_quantity WHEN 1 THEN l_tax ELSE l_discount END AS s, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END = k)::INT AS y FROM lineitem, range(3) t(k))) GROUP BY k",
)(lambda d: R.auc_one_vs_rest(d.select(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"), F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_tax", "l_discount"))).alias("probability"))))
_priced = lambda d: d.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("label"), (F.col("l_quantity").cast("double") * 1500).alias("prediction"))
query(
    "residual_bins",
    "lineitem",
    "WITH e AS (SELECT l_quantity::DOUBLE * 1500 - l_extendedprice::DOUBLE AS e FROM lineitem), b AS (SELECT min(e) AS lo, (max(e) - min(e)) / 20 AS w FROM e), c AS (SELECT least(floor((e - lo) / w), 19)::INT AS bin, count(*) AS n FROM e, b GROUP BY 1) "
    'SELECT k::INT AS bin, round(lo + w * k, 6) AS start, round(lo + w * (k + 1), 6) AS "end", coalesce(n, 0)::BIGINT AS n FROM range(20) t(k) CROSS JOIN b LEFT JOIN c ON c.bin = k',
)(lambda d: R.residual_bins(_priced(d)).withColumns({c: F.round(c, 6) for c in ("start", "end")}))
query(
    "prediction_sample",
    "orders",
    "SELECT o_orderkey, o_totalprice::DOUBLE AS actual, o_custkey::DOUBLE AS prediction, o_custkey - o_totalprice::DOUBLE AS residual, abs(o_custkey - o_totalprice::DOUBLE) AS absolute_error FROM orders ORDER BY md5(concat_ws('|', o_orderkey, '42')), o_orderkey LIMIT 25",
)(lambda d: R.prediction_sample(d.select("o_orderkey", F.col("o_totalprice").cast("double").alias("label"), F.col("o_custkey").cast("double").alias("prediction")), "o_orderkey"))
query("sort_visual", "dirty", "SELECT o_orderstatus, sum(price_null) AS y FROM {dirty} GROUP BY 1 ORDER BY y DESC NULLS LAST")(lambda d: R.sort_visual(G.group_agg(d, ["o_orderstatus"], "price_null"), "y_descending", "o_orderstatus", "y"))
query(
    "numeric_distribution",
    "dirty",
    "WITH q AS (SELECT quantile_cont(price_spike, 0.25) AS a, quantile_cont(price_spike, 0.75) AS b FROM {dirty}), f AS (SELECT count(*) FILTER (price_spike < a - 1.5 * (b - a) OR price_spike > b + 1.5 * (b - a)) AS n FROM {dirty}, q), t AS (SELECT sum(price_spike) AS top FROM (SELECT price_spike FROM {dirty} ORDER BY price_spike DESC LIMIT (SELECT ceil(count(price_spike) * 0.01)::BIGINT FROM {dirty}))) "
    "SELECT count(price_spike)::BIGINT AS non_null, round(avg(price_spike), 4) AS mean, median(price_spike) AS median, round(skewness(price_spike), 6) AS skew, quantile_cont(price_spike, 0.95) AS p95, (SELECT n FROM f)::BIGINT AS outliers, round((SELECT top FROM t) / sum(price_spike), 8) AS top_1pct_share, abs(skewness(price_spike)) >= 2 AS skewed FROM {dirty}",
)(lambda d: R.numeric_distribution(d, "price_spike").select("non_null", F.round("mean", 4).alias("mean"), "median", F.round("skew", 6).alias("skew"), "p95", "outliers", F.round("top_1pct_share", 8).alias("top_1pct_share"), "skewed"))
query(
    "apply_suggested_conversions",
    "dirty",
    "SELECT o_orderkey, TRY_CAST(trim(num_text) AS DOUBLE) AS num_text, CASE lower(trim(flag_text)) WHEN 'y' THEN 1 WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END::INT AS flag_text FROM {dirty}",
)(lambda d: R.apply_suggested_conversions(K.missing_like_to_null(d, ["num_text"])).select("o_orderkey", "num_text", "flag_text"))
_linear = lambda d: d.select("o_orderkey", "o_totalprice", F.col("price_spike").cast("double").alias("label"))
query(
    "named_contributions",
    "dirty",
    "SELECT o_orderkey, 'o_totalprice' AS feature, round((o_totalprice - m) * b, 2) AS contribution FROM {dirty}, (SELECT avg(o_totalprice) AS m, regr_slope(price_spike, o_totalprice) AS b FROM {dirty})",
)(lambda d: (lambda m, x: R.named_contributions(m, m.transform(x), "o_orderkey").withColumn("contribution", F.round("contribution", 2)))(M.fit(_linear(d), ["o_totalprice"], [], "linear", "regression"), _linear(d)))
