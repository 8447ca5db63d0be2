"""What a reader of models and scans asks for: classes one by one, residuals in bins, sample predictions, suggested conversions applied."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import modeling as M
from tessera.operators import profile as P
from tessera.operators.order import with_running


def class_report(pred: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support for each class that is a label or was predicted; 0 where a ratio has no rows."""
    cells = M.confusion(pred)
    sides = cells.select(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"))
    sides = sides.unionByName(cells.select(F.col("prediction").alias("c"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("tp")))
    g = sides.groupBy(F.col("c").alias("label")).agg(*(F.sum(x).alias(x) for x in ("support", "predicted", "tp")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    g = g.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    return g.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def auc_one_vs_rest(pred: DataFrame, scores: str = "probability", label: str = "label") -> DataFrame:
    """label, auc: of each class against the rest by its score, ties counted half; `scores` is a vector or array by class number.

    A row becomes one of (class, score) for each class; equal scores of a class are counted first and ranked by ranges.
    """
    values = F.col(scores) if pred.schema[scores].dataType.typeName() == "array" else vector_to_array(scores)
    long = pred.select(F.col(label).cast("int").alias("y"), F.posexplode(values).alias("class", "score"))
    g = long.groupBy("class", "score").agg(F.sum((F.col("y") == F.col("class")).cast("double")).alias("pos"), F.sum((F.col("y") != F.col("class")).cast("double")).alias("neg"))
    classes = [r[0] for r in g.select("class").distinct().orderBy("class").collect()]
    if not classes:
        return g.select(F.col("class").alias("label"), F.lit(None).cast("double").alias("auc"))
    run = with_running(g, "score", {f"below{c}": F.when(F.col("class") == c, F.col("neg")).otherwise(0.0) for c in classes}, tie=["class"])
    below = F.get(F.array(*(f"below{c}" for c in classes)), F.array_position(F.lit(classes), F.col("class")).cast("int") - 1)
    auc = F.try_divide(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)), F.sum("pos") * F.sum("neg"))
    return run.withColumn("below", below).groupBy(F.col("class").alias("label")).agg(auc.alias("auc"))


def residual_bins(pred: DataFrame, bins: int = 20, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """bin, start, end, n: prediction less label in bins of equal width, the last with its upper edge; one bin if all are equal."""
    rows = pred.select((F.col(prediction) - F.col(label)).cast("double").alias("e")).where(F.col("e").isNotNull() & ~F.isnan("e"))
    lo, hi = rows.agg(F.min("e"), F.max("e")).first()
    if lo is None or lo == hi:
        made = rows.groupBy().agg(F.count("*").alias("n")).where("n > 0")
        return made.select(F.lit(0).alias("bin"), F.lit(lo).cast("double").alias("start"), F.lit(hi).cast("double").alias("end"), "n")
    bins = max(2, bins)
    width = (hi - lo) / bins
    counts = rows.groupBy(F.least(F.floor((F.col("e") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    at = lambda k: F.lit(lo) + F.lit(width) * k
    return every.join(counts, "bin", "left").select("bin", at(F.col("bin")).alias("start"), at(F.col("bin") + 1).alias("end"), F.coalesce("n", F.lit(0)).alias("n"))


def prediction_sample(pred: DataFrame, key: str | list[str], limit: int = 25, numeric: bool = True) -> DataFrame:
    """The keys, label and prediction of a hash sample of rows, with residual and absolute error of a numeric prediction."""
    keys = [key] if isinstance(key, str) else list(key)
    gap = F.col("prediction") - F.col("label")
    more = [gap.alias("residual"), F.abs(gap).alias("absolute_error")] if numeric else []
    return C.hash_sample(pred, limit, keys).select(*keys, F.col("label").alias("actual"), "prediction", *more)


def named_contributions(model, pred: DataFrame, key: str, top: int = 12) -> DataFrame:
    """key, feature, contribution: of each row the `top` largest parts of a linear prediction by absolute value, by feature name.

    The parts are coefficients times centred features; with the intercept they add up to the prediction.
    """
    meta = pred.schema["raw"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"].replace("__f", "").replace("__h_", "=") for kind in meta.values() for a in kind}
    parts = M.linear_contributions(model, pred, key)
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), "position")  # as many rows as the model has features
    named = F.get(F.lit([names.get(i, str(i)) for i in range(max(names, default=0) + 1)]), F.col("position"))
    return parts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select(key, named.alias("feature"), "contribution")


def sort_visual(df: DataFrame, how: str, x: str | None = None, y: str | None = None) -> DataFrame:
    """A chart's table by x_ascending, x_descending, y_ascending or y_descending, nulls and what is no number last; else as it is."""
    by, _, way = how.partition("_")
    if by not in ("x", "y") or way not in ("ascending", "descending") or not (x if by == "x" else y):
        return df
    value: Column = F.col(x) if by == "x" else F.col(y) if C.is_numeric(dict(df.dtypes)[y]) else C.to_number(F.col(y), "")
    return df.orderBy(value.asc_nulls_last() if way == "ascending" else value.desc_nulls_last())


#: Fixed value: from this skew on, either way, a column counts as skewed.
SKEWED = 2


def numeric_distribution(df: DataFrame, c: str) -> DataFrame:
    """One row: non_null, the moments, shares and quantiles of a numeric column, its outliers by IQR, its top 1 percent's share, and whether it is skewed."""
    from tessera.operators.stats import top_share

    finite = df.select(F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c).cast("double")).alias(c))
    moments = P.numeric_metrics(finite, [c], quantiles=True).drop("integer_ratio", "infinite_count")
    fences = P.iqr_outliers(finite, [c]).select("column_name", "outliers", "outlier_ratio")
    share = top_share(finite, c).select(F.col("share").alias("top_1pct_share"))
    count = finite.agg(F.count(c).alias("non_null"))
    return moments.join(fences, "column_name").crossJoin(share).crossJoin(count).withColumn("skewed", F.coalesce(F.abs("skew") >= SKEWED, F.lit(False)))


def apply_suggested_conversions(df: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """df with what suggested_config() proposes: numbers and times parsed, unambiguous flags as 0 and 1; other columns as they are.

    Text that does not parse becomes null; a flag's two values are those of its row in the configuration.
    """
    from tessera.operators.assess import suggested_config
    from tessera.operators.rules import column_facts, semantic_types

    facts = column_facts(df)
    config = suggested_config(df, facts) if config is None else config
    rows = [r for r in config.collect() if r["column_name"] in df.columns]
    kinds, out = dict(df.dtypes), {}
    times = {r["column_name"] for r in semantic_types(df, facts).where("semantic_type = 'datetime-like'").collect()}
    for r in rows:
        c = r["column_name"]
        if r["setting"] == "binary_map":
            zero, one = r["detail"].split("/")
            text = F.lower(C.strip(F.col(c).cast("string")))
            out[c] = F.coalesce(C.to_flag(F.col(c)), F.when(text == one.lower(), 1).when(text == zero.lower(), 0)).cast("int")
        elif r["setting"] == "parse_numeric" and kinds[c] == "string":
            out.setdefault(c, C.to_number(F.col(c)))
    out |= {c: C.to_time(F.col(c)) for c in times if kinds.get(c) == "string" and c not in out}
    return df.withColumns(out)
