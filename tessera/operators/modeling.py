"""Models on Spark ML: features, splits, metrics from grouped tables, importances, clustering."""

from __future__ import annotations

import re
from itertools import accumulate
from math import prod

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, OneHotEncoder, PolynomialExpansion, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions.columns import hash_order, hash_part, is_numeric
from tessera.functions.shared import cut_lineage
from tessera.operators.clusters import dbscan, dendrogram, hierarchical  # noqa: F401
from tessera.operators.neighbours import knn_predict  # noqa: F401
from tessera.operators.order import MOST_RANGES, PER_RANGE, RANGES, exact_quantiles, quantiles_of, with_running


def split(df: DataFrame, key: str, test: float = 0.25, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash of the key: the same in every run."""
    u = hash_part([key], 10_000, seed)
    return df.where(u >= int(test * 10_000)), df.where(u < int(test * 10_000))


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.25, seed: int = 42) -> DataFrame:
    """df with is_test: the share of each class by hash order, ranked within ranges of the hash and their counts."""
    h = hash_order([key], seed)
    cut = df.withColumns({"__hash": h, "__range": F.substring(h, 1, 3)})
    counts = cut.groupBy(F.col(label).alias("__label"), F.col("__range").alias("__at")).agg(F.count("*").alias("__n"))
    of = Window.partitionBy("__label")
    before = F.coalesce(F.sum("__n").over(of.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__label", "__at", before.alias("__before"), F.sum("__n").over(of).alias("__all"))
    ranked = cut.join(counts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__range") == F.col("__at")))
    rank = F.col("__before") + F.rank().over(Window.partitionBy(label, "__range").orderBy("__hash", key))
    return ranked.withColumn("is_test", F.coalesce(F.try_divide(rank - 1, F.col("__all") - 1), F.lit(0.0)) < test).select(*df.columns, "is_test")


#: Semantic types that a model takes no feature from.
UNUSABLE = ("constant", "mostly_missing", "text", "json-like")


def derived_from(name: str, target: str) -> bool:
    """Whether a column's name suggests that it was made from the target: it holds its name, or is a price for a price per unit."""
    plain = lambda x: re.sub(r"[\W_]", "", x.lower())
    unit_price = "price" in target.lower() and re.search("price_per|per_price", name.lower())
    return bool(plain(target) and plain(target) in plain(name) or unit_price)


def feature_select(df: DataFrame, target: str, wanted: list[str] | None = None, keep_identifiers: bool = False, allow_derived: bool = False) -> DataFrame:
    """column_name, role (numeric, datetime, categorical or drop), reason: which columns a model of the target takes, and as what.

    Columns named in `wanted` are left out only as the target or as derived from it; without it, identifiers, constants, columns
    of nearly no values, long text and JSON go as well.
    """
    from tessera.operators.rules import semantic_types

    kind, semantic = dict(df.dtypes), F.col("semantic_type")
    marked = lambda names: F.col("column_name").isin(*names)
    reason = F.when(F.col("column_name") == target, "target")
    if not allow_derived:
        reason = reason.when(marked([c for c in df.columns if derived_from(c, target)]), "target_derived")
    if wanted is not None:
        reason = reason.when(~marked(wanted), "not_wanted")
    else:
        reason = reason.when(semantic.isin(*UNUSABLE, *([] if keep_identifiers else ["identifier"])), semantic)
    number = marked([c for c, k in kind.items() if is_numeric(k)]) | semantic.isin("numeric-like", "amount", "percentage")
    role = F.when(F.col("reason").isNotNull(), "drop").when(number, "numeric").when(semantic.isin("datetime", "datetime-like"), "datetime").otherwise("categorical")
    return semantic_types(df).withColumn("reason", reason).select("column_name", role.alias("role"), "reason")


def features(df: DataFrame, numeric: list[str], categories: list[str] = (), scale: bool = True, degree: int = 1) -> list:
    """Stages from columns to `features`: nulls and NaN become the exact median of df, levels become indicator columns."""
    middle = {r["column_name"]: (r["q"] or [0.0])[0] for r in exact_quantiles(df, list(numeric), [0.5]).collect()}
    filled = (f"coalesce(nanvl(cast(`{c}` as double), cast(null as double)), {middle[c]!r}D) as `{c}__f`" for c in numeric)
    out = [SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")]
    cats = [f"{c}__i" for c in categories]
    if categories:
        out += [StringIndexer(inputCols=list(categories), outputCols=cats, handleInvalid="keep"), OneHotEncoder(inputCols=cats, outputCols=[f"{c}__h" for c in categories])]
    out.append(VectorAssembler(inputCols=[f"{c}__f" for c in numeric] + [f"{c}__h" for c in categories], outputCol="raw"))
    if degree > 1:
        out.append(PolynomialExpansion(degree=degree, inputCol="raw", outputCol="poly"))
    last = "poly" if degree > 1 else "raw"
    return [*out, StandardScaler(inputCol=last, outputCol="features", withMean=True)] if scale else [*out, VectorAssembler(inputCols=[last], outputCol="features")]


ESTIMATORS = {
    ("random_forest", "classification"): lambda: RandomForestClassifier(labelCol="label", seed=42, numTrees=50),
    ("random_forest", "regression"): lambda: RandomForestRegressor(labelCol="label", seed=42, numTrees=50),
    ("gradient_boosting", "classification"): lambda: OneVsRest(classifier=GBTClassifier(seed=42, maxIter=20), labelCol="label"),
    ("gradient_boosting", "regression"): lambda: GBTRegressor(labelCol="label", seed=42, maxIter=20),
    ("linear", "classification"): lambda: LogisticRegression(labelCol="label", regParam=1e-4),
    ("linear", "regression"): lambda: LinearRegression(labelCol="label", solver="normal"),
}


def fit(df: DataFrame, numeric: list[str], categories: list[str], estimator: str, task: str, **kw):
    return Pipeline(stages=[*features(df, numeric, categories, **kw), ESTIMATORS[estimator, task]()]).fit(df)


def baseline(df: DataFrame, label: str, strategy: str = "mean") -> DataFrame:
    how = {"mean": F.avg(label), "median": F.median(label), "most_frequent": F.mode(label, True)}
    return df.agg(how[strategy].alias("prediction"))


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def classification_metrics(pred: DataFrame) -> DataFrame:
    """accuracy, balanced_accuracy, weighted precision, recall and f1, all from the confusion counts."""
    c = confusion(pred)
    by = c.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    made = c.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    m = by.join(made, "label", "left").withColumn("p", F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))).withColumn("r", F.col("tp") / F.col("support"))
    m = m.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    w = lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    return m.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("r").alias("balanced_accuracy"), w("p").alias("precision"), w("r").alias("recall"), w("f").alias("f1"))


def roc_points(pred: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """fpr, tpr, precision at each threshold: running sums over distinct scores from the highest."""
    g = pred.groupBy(score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg")).withColumn("down", -F.col(score))
    p, n = g.agg(F.sum("pos"), F.sum("neg")).first()
    run = with_running(g, "down", {"tp": F.col("pos"), "fp": F.col("neg")})
    return run.select(F.col(score).alias("threshold"), (F.col("fp") / F.lit(float(n or 1))).alias("fpr"), (F.col("tp") / F.lit(float(p or 1))).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def roc_auc(pred: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The rank-sum form, ties counted half."""
    g = pred.groupBy(score).agg(F.sum(label).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    run = with_running(g, score, {"below": F.col("neg")})
    return run.agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    e = F.col(prediction) - F.col(label)
    a = F.abs(e)
    spread = exact_quantiles(pred.select(a.alias("e")), ["e"], [0.5, 0.9]).select(F.col("q")[0].alias("median_ae"), F.col("q")[1].alias("p90_ae"))
    return pred.agg(F.avg(a).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(label) * F.count(label))).alias("r2"), F.avg(e).alias("bias"), F.max(a).alias("max_ae"), F.avg(F.try_divide(a, F.abs(label))).alias("mape"), F.avg((e > 0).cast("int")).alias("over_ratio"), F.avg((a <= 0.1 * F.abs(label)).cast("int")).alias("within_10"), F.avg((a <= 0.2 * F.abs(label)).cast("int")).alias("within_20")).crossJoin(spread)


def prediction_audit(pred: DataFrame, k: int = 15) -> DataFrame:
    """The k rows with the largest error, with their source columns."""
    return pred.withColumn("abs_error", F.abs(F.col("prediction") - F.col("label"))).orderBy(F.desc("abs_error")).limit(k)


SCORES = {
    "r2": lambda: 1 - F.try_divide(F.sum(F.pow(F.col("prediction") - F.col("label"), 2)), F.var_pop("label") * F.count("label")),
    "accuracy": lambda: F.avg((F.col("prediction") == F.col("label")).cast("double")),
    "neg_rmse": lambda: -F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))),
}


_LOST = lambda: F.sum(F.col("__spread") + F.col("__n") * F.pow(F.col("prediction") - F.col("label"), 2))
#: SCORES over rows of equal values together: __n of them with a label, their mean label, and the squares around it.
SCORES_ALIKE = {
    "r2": lambda spread: 1 - F.try_divide(_LOST(), F.lit(spread)),
    "accuracy": lambda spread: F.try_divide(F.sum(F.when(F.col("prediction") == F.col("label"), F.col("__n")).otherwise(0)), F.sum("__n")),
    "neg_rmse": lambda spread: -F.sqrt(F.try_divide(_LOST(), F.sum("__n"))),
}


def dealt_again(df: DataFrame, key: str, cols: list[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """df with __dealt, for each repeat a struct of cols as another row has them: a permutation of all rows a repeat.

    A row's place in the order of one hash of the key takes the values of the row at that place in the order of another;
    places come from counts of equal ranges of the hashes, all counted in one pass, and rows and values meet in a join on the place.
    """
    width = (1 << 40) // max(RANGES, min(MOST_RANGES, df.count() // PER_RANGE)) + 1
    h = lambda i: C.hash_part([key], 1 << 40, seed + i)
    at = lambda x: F.floor(x / width).cast("int")
    ranges = F.array(*(F.struct(F.lit(i).alias("i"), at(h(i)).alias("at")) for i in range(repeats + 1)))
    sizes = {(r["i"], r["at"]): r["count"] for r in df.select(F.explode(ranges).alias("x")).groupBy("x.i", "x.at").count().collect()}

    def ordered(d, i):
        before = F.lit([0, *accumulate(sizes.get((i, k), 0) for k in range((1 << 40) // width))]).cast("array<bigint>")
        inside = F.row_number().over(Window.partitionBy("__at").orderBy("__h", key))
        return d.withColumn("__h", h(i)).withColumn("__at", at(F.col("__h"))).withColumn("__place", F.get(before, F.col("__at")) + inside).drop("__h", "__at")

    out = cut_lineage(ordered(df, 0))
    for r in range(repeats):
        taken = ordered(df.select(key, *cols), 1 + r).select("__place", F.struct(*cols).alias(f"__values{r}"))
        out = out.join(taken, "__place")
    return out.withColumn("__dealt", F.array(*(f"__values{r}" for r in range(repeats)))).drop("__place", *(f"__values{r}" for r in range(repeats)))


def permutation_importance(model, df: DataFrame, key: str, cols: list[str], score: str = "r2", repeats: int = 5, seed: int = 42) -> DataFrame:
    """column_name, importance, deviation, repeats: the loss of a score (r2, accuracy or neg_rmse) when a column's values are dealt to other rows.

    Each repeat deals all rows anew. The rows as they are and those of all columns and repeats are copies in one plan, which the
    model scores in one job; where columns have few values, copies of equal values are scored once, with the mean of their labels
    and the spread around it; importance is the mean loss over the repeats and deviation its population standard deviation.
    """
    if score not in SCORES:
        raise ValueError(f"unknown score {score!r}; known are {', '.join(SCORES)}")
    dealt = dealt_again(df, key, cols, repeats, seed)
    cases = F.lit([[-1, -1], *([c, r] for c in range(len(cols)) for r in range(repeats))])
    copies = dealt.withColumn("__case", F.explode(cases)).withColumn("__values", F.get("__dealt", F.greatest(F.get("__case", F.lit(1)), F.lit(0))))
    copies = copies.withColumns({c: F.when(F.get("__case", F.lit(0)) == i, F.col("__values")[c]).otherwise(F.col(c)) for i, c in enumerate(cols)})
    case = [F.get("__case", F.lit(0)).alias("c"), F.get("__case", F.lit(1)).alias("r")]
    read = [c for c in df.columns if c not in (key, "label")]
    plain = all(is_numeric(k) or C.is_time(k) or k in ("string", "boolean") for k in (dict(df.dtypes)[c] for c in read))
    # an estimate: it only chooses the way
    kinds = [F.approx_count_distinct(c) for c in read if plain]
    rows, spread, *kinds = df.agg(F.count("*"), F.var_pop("label") * F.count("label"), *kinds).first()
    if plain and 2 * prod(k + 1 for k in kinds) <= rows:
        kept = [F.count("label").alias("__n")]
        if score != "accuracy":
            kept += [F.avg("label").alias("label"), (F.var_pop("label") * F.count("label")).alias("__spread")]
        alike = copies.groupBy(*case, *read, *(["label"] if score == "accuracy" else [])).agg(*kept)
        scores = model.transform(alike).groupBy("c", "r").agg(SCORES_ALIKE[score](spread).alias("score"))
    else:
        scores = model.transform(copies).groupBy(*case).agg(SCORES[score]().alias("score"))
    base = F.max(F.when(F.col("c") == -1, F.col("score"))).over(Window.partitionBy())  # a row a column and repeat
    lost = scores.withColumn("lost", base - F.col("score")).where("c >= 0")
    name = F.element_at(F.lit(list(cols)), F.col("c") + 1).alias("column_name")
    return lost.groupBy(name).agg(F.avg("lost").alias("importance"), F.stddev_pop("lost").alias("deviation"), F.count("*").cast("int").alias("repeats"))


def native_importance(model, pred: DataFrame) -> DataFrame:
    """Tree importances or absolute coefficients, summed by source column through the vector's attributes."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    meta = pred.schema["raw"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"].split("__")[0] for kind in meta.values() for a in kind}
    return pred.sparkSession.createDataFrame([(names[i], abs(float(v))) for i, v in enumerate(values.toArray()) if i in names], "column_name string, importance double").groupBy("column_name").agg(F.sum("importance").alias("importance"))


def linear_contributions(model, pred: DataFrame, key: str) -> DataFrame:
    """(key, position, contribution): exact parts of a linear prediction; the features are centred."""
    coef = F.array(*map(F.lit, model.stages[-1].coefficients.toArray().tolist()))
    return pred.select(key, F.posexplode(F.zip_with(vector_to_array("features"), coef, lambda x, c: x * c)).alias("position", "contribution"))


def model_comparison(df: DataFrame, key: str, numeric: list[str], categories: list[str], task: str, names=("random_forest", "linear")) -> DataFrame:
    """name, score, rank on one split; accuracy or negative RMSE."""
    train, test = (x.cache() for x in split(df, key))
    rows = []
    for n in names:
        m = (classification_metrics if task == "classification" else regression_metrics)(fit(train, numeric, categories, n, task).transform(test)).first()
        rows.append((n, float(m["accuracy"] if task == "classification" else -m["rmse"])))
    train.unpersist(), test.unpersist()
    return df.sparkSession.createDataFrame(rows, "name string, score double").withColumn("rank", F.rank().over(Window.orderBy(F.desc("score"))))


def modeling_baseline(df: DataFrame, key: str, numeric: list[str], categories: list[str], task: str, estimator: str = "random_forest", test: float = 0.25, seed: int = 42) -> DataFrame:
    """metric, baseline, model on held-out rows: the training rows' commonest class or median label against a model."""
    train, held = (x.cache() for x in split(df, key, test, seed))
    if task == "classification":
        measure, names = classification_metrics, ("accuracy", "balanced_accuracy")
        guess = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()
    else:
        measure, names = regression_metrics, ("mae", "rmse", "r2")
        guess = quantiles_of(train, "label", [0.5])
    made = measure(fit(train, numeric, categories, estimator, task).transform(held)).first()
    base = measure(held.withColumn("prediction", F.lit(guess[0]).cast("double"))).first()
    train.unpersist(), held.unpersist()
    return df.sparkSession.createDataFrame([(n, base[n], made[n]) for n in names], "metric string, baseline double, model double")


def target_importance(df: DataFrame, key: str, numeric: list[str], categories: list[str], task: str, suspicious: float = 0.45) -> DataFrame:
    """column_name, importance, permutation, deviation, suspicion: a forest's importances and the loss by permutation on held-out rows.

    A share of importance of `suspicious` or more may come from a leak of the target, or a proxy for it.
    """
    train, held = split(df, key)
    model = fit(train, numeric, categories, "random_forest", task)
    score = "accuracy" if task == "classification" else "r2"
    lost = permutation_importance(model, held, key, [*numeric, *categories], score).withColumnRenamed("importance", "permutation")
    out = lost.join(native_importance(model, model.transform(held)), "column_name", "left").na.fill(0.0, ["importance"])
    return out.select("column_name", "importance", "permutation", "deviation", F.when(F.col("importance") >= suspicious, "possible_leakage_or_proxy").alias("suspicion"))


def cross_validate(df: DataFrame, key: str, numeric: list[str], categories: list[str], estimator: str, task: str, folds: int = 3) -> DataFrame:
    rows = []
    fold = hash_part([key], folds, 7)
    for k in range(folds):
        pred = fit(df.where(fold != k), numeric, categories, estimator, task).transform(df.where(fold == k))
        m = (classification_metrics if task == "classification" else regression_metrics)(pred).first()
        rows.append((k, float(m["accuracy"] if task == "classification" else m["r2"])))
    return df.sparkSession.createDataFrame(rows, "fold int, score double")


def kmeans(df: DataFrame, cols: list[str], k: int = 3, scale: bool = True) -> DataFrame:
    """df with cluster."""
    return _cluster(df, cols, KMeans(k=k, seed=42, featuresCol="features", predictionCol="cluster"), scale)


def bisecting(df: DataFrame, cols: list[str], k: int = 3) -> DataFrame:
    """Divisive clusters. Columns are scaled but not centred: a split moves a centre in proportion to its norm, which would be 0."""
    stages = [*features(df, cols, scale=False), StandardScaler(inputCol="features", outputCol="scaled"), BisectingKMeans(k=k, seed=42, featuresCol="scaled", predictionCol="cluster")]
    return Pipeline(stages=stages).fit(df).transform(df)


def _cluster(df: DataFrame, cols: list[str], stage, scale: bool) -> DataFrame:
    return Pipeline(stages=[*features(df, cols, scale=scale), stage]).fit(df).transform(df)


def cluster_metrics(pred: DataFrame) -> DataFrame:
    s = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(pred)
    return pred.groupBy("cluster").agg(F.count("*").alias("size")).withColumn("squared_silhouette", F.lit(s))


def cluster_profile(pred: DataFrame, cols: list[str]) -> DataFrame:
    """feature, separation: the mean distance of the clusters' means from the overall mean."""
    g = pred.groupBy("cluster").agg(*(F.struct(F.avg(c).alias("mean"), F.sum(c).alias("sum"), F.count(c).alias("n")).alias(c) for c in cols)).unpivot("cluster", cols, "feature", "s")
    overall = F.sum("s.sum").over(Window.partitionBy("feature")) / F.sum("s.n").over(Window.partitionBy("feature"))
    return g.select("feature", F.abs(F.col("s.mean") - overall).alias("off")).groupBy("feature").agg(F.avg("off").alias("separation"))


def pca_project(df: DataFrame, cols: list[str], k: int = 2) -> DataFrame:
    """df with pc (array); signs are arbitrary."""
    m = Pipeline(stages=[*features(df, cols), PCA(k=k, inputCol="features", outputCol="pcs")]).fit(df)
    return m.transform(df).withColumn("pc", vector_to_array("pcs")).withColumn("explained", F.lit(float(sum(m.stages[-1].explainedVariance.toArray()))))


def preflight(df: DataFrame, label: str) -> DataFrame:
    g = df.where(F.col(label).isNotNull()).groupBy(label).count()
    return g.agg(F.sum("count").alias("rows"), F.count("*").alias("classes"), F.min("count").alias("smallest_class"), (F.max("count") / F.sum("count")).alias("imbalance")).withColumn("imbalanced", F.col("imbalance") >= 0.9)
