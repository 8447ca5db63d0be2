"""Decisions on top of profiles, plans and metrics: task, configuration, presets, parameter grids, ratings, saved predictions."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import modeling as M
from tessera.operators import rules as R

# Tasks and their confidence where no target is chosen, rating levels of the primary metric.
UNTARGETED = (("text", "text_exploration", 0.64), ("datetime", "time_aware_eda", 0.62))
NO_TASK = ("unsupervised_eda", 0.55)
RATINGS = {
    "regression": ("r2", ((0.75, "strong"), (0.4, "promising"), (0.0, "weak")), "poor"),
    "classification": ("accuracy", ((0.85, "strong"), (0.7, "promising"), (0.55, "weak")), "poor"),
    "clustering": ("squared_silhouette", ((0.5, "strong"), (0.25, "promising")), "exploratory"),
}
_TYPES = ("trim_strings", "standardize_missing", "parse_numeric", "parse_datetime", "binary_mapping")
#: Actions of each preset, None for all; the first takes those of high confidence only.
PRESETS = {
    "safe_defaults": _TYPES,
    "type_prep": _TYPES,
    "analysis_ready": ("column_rename_review", *_TYPES),
    "power_review": ("column_rename_review", *_TYPES, "numeric_outlier_review"),
    "audit_all": None,
}
SAFE = 0.9


def task_inference(df: DataFrame, target: str | None = None) -> DataFrame:
    """task, confidence, target: by the target's values; without one by text, then time columns."""
    spark = df.sparkSession
    out = "task string, confidence double, target string"
    if target:
        number = dict(df.dtypes)[target] not in ("string", "boolean")
        distinct = df.agg(F.count_distinct(target)).first()[0]
        return spark.createDataFrame([(R.infer_task(distinct, number), 0.95, target)], out)
    kinds = R.semantic_types(df).agg(F.collect_set("semantic_type")).first()[0]
    for kind, task, confidence in UNTARGETED:
        if any(k.startswith(kind) for k in kinds):
            return spark.createDataFrame([(task, confidence, None)], out)
    return spark.createDataFrame([(*NO_TASK, None)], out)


def suggested_config(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """setting, column_name, detail: ids, timestamps, conversions of text and flags, ambiguous flags marked for review."""
    facts = R.column_facts(df) if facts is None else facts
    types = R.semantic_types(df, facts)
    setting = F.when(F.col("role") == "id", "id_column").when(F.col("role") == "timestamp", "time_column").when(F.col("semantic_type") == "numeric-like", "parse_numeric").when(F.col("role") == "ignore_candidate", "ignore")
    roles = types.select(setting.alias("setting"), "column_name", F.col("semantic_type").alias("detail")).where("setting is not null")
    flags = R.binary_profile(df, facts=facts).select(F.when(F.col("ambiguous"), "review_flag").otherwise("binary_map").alias("setting"), "column_name", F.concat_ws("/", "zero_value", "one_value").alias("detail"))
    return roles.unionByName(flags)


def cleaning_preset(plan: DataFrame, preset: str) -> DataFrame:
    """The actions that a preset selects of a plan, which may hold the rows of cleaning_plan and review_plan."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; known are {', '.join(PRESETS)}")
    chosen = plan if PRESETS[preset] is None else plan.where(F.col("action").isin(*PRESETS[preset]))
    return chosen.where(F.col("confidence") >= SAFE) if preset == "safe_defaults" else chosen


def grid_search(df: DataFrame, key: str, numeric: list[str], categories: list[str], estimator: str, task: str, grid: dict[str, list], folds: int = 3) -> DataFrame:
    """params, mean, std, folds, rank for each combination of the grid: accuracy or r2 over hash folds of the key.

    Feature stages are fitted once a fold; the driver sees one score per combination and fold.
    """
    fold, metric = C.hash_part([key], folds, 7), "accuracy" if task == "classification" else "r2"
    score = M.classification_metrics if task == "classification" else M.regression_metrics
    combos, rows = [dict(zip(grid, values)) for values in product(*grid.values())], []
    for k in range(folds):
        train, test = df.where(fold != k), df.where(fold == k)
        prepared = Pipeline(stages=M.features(train, numeric, categories)).fit(train)
        train, test = prepared.transform(train).cache(), prepared.transform(test).cache()
        for params in combos:
            stage = M.ESTIMATORS[estimator, task]()
            value = score(stage.copy({stage.getParam(p): v for p, v in params.items()}).fit(train).transform(test)).first()[metric]
            rows.append((", ".join(f"{p}={v}" for p, v in params.items()), k, float(value)))
        train.unpersist(), test.unpersist()
    found = df.sparkSession.createDataFrame(rows, "params string, fold int, score double")
    found = found.groupBy("params").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("*").alias("folds"))
    return found.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean"))))


def model_assessment(metrics: DataFrame, task: str) -> DataFrame:
    """metric, value, rating for each row of a metrics table."""
    name, levels, lowest = RATINGS[task]
    rating = F.lit(lowest)
    for least, label in reversed(levels):
        rating = F.when(F.col(name) >= least, label).otherwise(rating)
    return metrics.select(F.lit(name).alias("metric"), F.col(name).alias("value"), F.when(F.col(name).isNull(), "needs_review").otherwise(rating).alias("rating"))


def cluster_separation(pred: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """clusters, calinski_harabasz, davies_bouldin over columns, from one aggregate of sizes, centres and spreads.

    Rows with a null in a column are left out. Davies-Bouldin takes the root mean square distance to the centre.
    """
    whole = pred.where(" and ".join(f"`{c}` is not null" for c in cols))
    g = whole.groupBy(F.col(cluster).alias("k")).agg(F.count("*").alias("n"), F.array(*(F.avg(c).cast("double") for c in cols)).alias("m"), sum((F.var_pop(c) for c in cols), F.lit(0.0)).alias("v"))
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    centre = g.agg(F.array(*(F.sum(F.col("m")[i] * F.col("n")) / F.sum("n") for i in range(len(cols)))).alias("mid"))
    total = g.join(F.broadcast(centre)).agg(F.count("*").alias("clusters"), F.sum("n").alias("rows"), F.sum(F.col("n") * far("m", "mid")).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    pairs = g.alias("a").join(g.alias("b"), F.col("a.k") != F.col("b.k"))
    worst = pairs.groupBy("a.k").agg(F.max(F.try_divide(F.sqrt("a.v") + F.sqrt("b.v"), F.sqrt(far("a.m", "b.m")))).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    ch = F.try_divide(F.col("between") * (F.col("rows") - F.col("clusters")), F.col("within") * (F.col("clusters") - 1))
    return total.select("clusters", ch.alias("calinski_harabasz")).join(F.broadcast(worst))


def write_predictions(pred: DataFrame, path: str, columns: list[str], format: str = "parquet") -> DataFrame:
    """Writes the named columns with label and prediction to a folder and returns what was written."""
    pred.select(*columns, "label", "prediction").write.format(format).mode("errorifexists").options(**({"header": "true"} if format == "csv" else {})).save(path)
    return pred.sparkSession.read.format(format).options(**({"header": "true"} if format == "csv" else {})).load(path)
