"""The tables behind charts: axis preparation, grouped aggregates, series windows, and a dispatcher by chart kind."""

from __future__ import annotations

from functools import reduce
from math import pi, sqrt
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import stats as S
from tessera.operators import views as V
from tessera.operators.order import exact_quantiles, grouped_quantiles, quantiles_of, with_running

ALIASES = {"avg": "mean", "average": "mean", "q1": "p25", "q3": "p75", "distinct": "nunique", "rows": "count", "stddev": "std", "variance": "var", "total": "sum", "minimum": "min", "maximum": "max"}
ROW_CAPS = {"scatter": 10_000, "strip": 10_000, "geo_scatter": 5_000, "scatter_matrix": 3_000, "parallel_coordinates": 3_000}


def aggregate(name: str, c: Column | None) -> Column:
    """The aggregate by name; sums of nothing are null."""
    name = ALIASES.get(name, name)
    if name == "count":
        return F.count(F.lit(1)) if c is None else F.count(c)
    if name[0] == "p" and name[1:].isdigit():
        return F.percentile(c, int(name[1:]) / 100)
    return {"sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct}[name](c)


def _quantile(how: str) -> float | None:
    name = "p50" if how == "median" else ALIASES.get(how, how)
    return int(name[1:]) / 100 if name[0] == "p" and name[1:].isdigit() else None


def group_agg(df: DataFrame, by: list[str], y: str | None = None, how: str = "sum", name: str = "y") -> DataFrame:
    """One value a group. Medians and percentiles are exact, by ranges of values, so that no group's values meet in one task."""
    if y and _quantile(how) is not None:
        q = grouped_quantiles(df.select(*by, F.col(y).alias("__y")), by, ["__y"], [_quantile(how)])
        return q.select(*by, F.col("__y")[0].alias(name))
    return df.groupBy(*by).agg(aggregate(how, F.col(y) if y else None).alias(name))


def weighted_mean(df: DataFrame, by: list[str], y: str, w: str) -> DataFrame:
    good = F.col(y).isNotNull() & F.col(w).isNotNull() & (F.col(w) != 0)
    return df.where(good).groupBy(*by).agg(F.try_divide(F.sum(F.col(y) * F.col(w)), F.sum(w)).alias("y"))


def hierarchy_agg(df: DataFrame, path: list[str], y: str | None = None) -> DataFrame:
    """Totals of each path and, by rollup in the same pass, of its ancestors (null below)."""
    return df.rollup(*path).agg(aggregate("sum" if y else "count", F.col(y) if y else None).alias("y"), F.grouping_id().alias("level"))


def share_agg(df: DataFrame, names: str, y: str | None = None) -> DataFrame:
    g = group_agg(df, [names], y, "sum" if y else "count")
    return g.withColumn("share", F.try_divide("y", F.sum("y").over(Window.partitionBy())))


def crosstab(df: DataFrame, a: str, b: str, normalise: bool = False) -> DataFrame:
    g = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a))) if normalise else g


def value_counts(df: DataFrame, c: str, limit: int = 25) -> DataFrame:
    g = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return g.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "value").limit(limit)


def positive_value(df: DataFrame, target: str) -> str:
    """The value that counts as positive: the commonest of the usual words for yes, else the rarer of two, else the commonest."""
    f = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("v")).agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), "v")
    yes = F.lower(C.strip(F.col("v"))).isin("true", "yes", "y", "1", "sold", "success", "win", "positive")
    r = f.agg(F.count("*").alias("k"), F.min_by("v", F.when(yes, order)).alias("yes"), F.max_by("v", order).alias("rarest"), F.min_by("v", order).alias("commonest")).first()
    return r["yes"] if r["yes"] is not None else r["rarest"] if r["k"] == 2 else r["commonest"]


def group_target_summary(df: DataFrame, target: str, by: list[str], positive: str | None = None, min_count: int = 1) -> DataFrame:
    """Per group the records, the target's mean and median or its positive rate, and the share without target."""
    stats = [F.avg((F.col(target).cast("string") == positive).cast("int")).alias("positive_rate")] if positive else [F.avg(target).alias("target_mean")]
    out = df.groupBy(*by).agg(F.count("*").alias("record_count"), *stats, F.avg(F.col(target).isNull().cast("int")).alias("missing_ratio")).where(F.col("record_count") >= min_count)
    if positive:
        return out
    middle = group_agg(df, by, target, "median", "target_median")
    return same_groups(out, middle, by).select(*by, "record_count", "target_mean", "target_median", "missing_ratio")


def same_groups(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a with the columns of b for the same group; null is a group like others."""
    b = b.withColumnsRenamed({c: f"__b_{c}" for c in by})
    return a.join(b, reduce(and_, (F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in by)), "left").drop(*(f"__b_{c}" for c in by))


def rolling_stat(df: DataFrame, x: str, y: str, n: int, how: str = "mean", by: list[str] = ()) -> DataFrame:
    """Statistic of the last n rows by x in each group; the input is already aggregated."""
    return df.withColumn("rolling", aggregate(how, F.col(y)).over(Window.partitionBy(*by).orderBy(x).rowsBetween(1 - n, 0)) if how != "median" else F.percentile(y, 0.5).over(Window.partitionBy(*by).orderBy(x).rowsBetween(1 - n, 0)))


def cumulative_sum(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    return df.withColumn("cumulative", F.sum(y).over(Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)))


def value_transform(df: DataFrame, y: str, how: str, by: list[str] = ()) -> DataFrame:
    """percent_total, percent_group, rank_desc or rank_asc of an aggregated value."""
    total = F.sum(y).over(Window.partitionBy(*(by if how == "percent_group" else ())))
    made = {"percent_total": F.try_divide(F.col(y) * 100.0, total), "percent_group": F.try_divide(F.col(y) * 100.0, total), "rank_desc": F.dense_rank().over(Window.partitionBy().orderBy(F.desc(y))), "rank_asc": F.dense_rank().over(Window.partitionBy().orderBy(y))}
    return df.withColumn("transformed", made[how])


def bump_rank(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumn("rank", F.dense_rank().over(Window.partitionBy(x).orderBy(F.desc(y))))


def pareto(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Groups by falling size with their cumulative percentage."""
    g = group_agg(df, [x], y, "sum" if y else "count")
    w = Window.orderBy(F.desc("y"), x).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("cumulative_percent", 100.0 * F.sum("y").over(w) / F.sum("y").over(Window.partitionBy()))


def waterfall(df: DataFrame, x: str, y: str) -> DataFrame:
    g = group_agg(df, [x], y).select(F.col(x).cast("string").alias("x"), "y")
    return g.unionByName(g.agg(F.lit("Total").alias("x"), F.sum("y").alias("y")))


def top_n_filter(df: DataFrame, c: str, n: int, y: str | None = None) -> DataFrame:
    """Rows of the n largest categories: a semi join to a table of n rows."""
    top = group_agg(df, [c], y, "sum" if y else "count").orderBy(F.desc("y"), c).limit(n).select(c)
    return df.join(F.broadcast(top), c, "left_semi")


def top_n_other(df: DataFrame, c: str, n: int, other: str = "Other") -> DataFrame:
    top = [r[0] for r in group_agg(df.where(F.col(c).isNotNull()), [c], None, "count").orderBy(F.desc("y"), c).limit(n).collect()]
    return df.withColumn(c, F.when(F.col(c).isin(*top), F.col(c)).when(F.col(c).isNotNull(), other))


def missing_category(df: DataFrame, c: str, label: str = "Missing") -> DataFrame:
    return df.withColumn(c, F.when(V.blank(c), label).otherwise(F.col(c)))


def axis_transform(c: Column, how: str) -> Column:
    return {"log": F.when(c > 0, F.log(c)), "log1p": F.when(c >= 0, F.log1p(c)), "sqrt": F.when(c >= 0, F.sqrt(c))}[how]


def date_bucket(c: Column, bucket: str) -> Column:
    return F.date_trunc(bucket, c).cast("timestamp_ntz")


def auto_bucket(df: DataFrame, c: str) -> str:
    """month, week, day or none by the whole days between the first and the last time."""
    span = df.agg(F.floor((F.unix_seconds(F.max(F.col(c).cast("timestamp"))) - F.unix_seconds(F.min(F.col(c).cast("timestamp")))) / 86_400)).first()[0] or 0
    return "month" if span >= 730 else "week" if span >= 120 else "day" if span >= 45 else "none"


def bin_width(c: Column, lo: float, width: float) -> Column:
    """Right-closed bins from lo; the first includes its lower edge."""
    return F.greatest(F.ceil((c - lo) / width) - 1, F.lit(0))


def bin_quantile(df: DataFrame, c: str, q: int, name: str = "bin") -> DataFrame:
    """Quantile bins, right-closed, without double edges."""
    edges = sorted({x for x in quantiles_of(df, c, [i / q for i in range(q + 1)]) if x is not None})
    inner = F.size(F.filter(F.array(*map(F.lit, edges[1:-1])), lambda e: e < F.col(c))) if len(edges) > 2 else F.lit(0)
    return df.withColumn(name, inner)


def histogram(df: DataFrame, c: str, bins: int = 40) -> DataFrame:
    from tessera.operators.profile import numeric_histogram

    h = numeric_histogram(df, c, bins)
    return h.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy()))


def box(df: DataFrame, c: str, by: list[str]) -> DataFrame:
    """Five numbers and the number of values per group, exact for groups of any size."""
    q = grouped_quantiles(df.select(*by, F.col(c).alias("__y")), by, ["__y"], [0.25, 0.5, 0.75])
    ends = df.groupBy(*by).agg(F.count(c).alias("n"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"))
    return same_groups(ends, q, by).select(*by, "n", "min", *(F.col("__y")[i].alias(x) for i, x in enumerate(("q1", "median", "q3"))), "max")


def box_outliers(df: DataFrame, c: str, by: list[str], factor: float = 1.5) -> DataFrame:
    """The rows beyond factor * IQR outside their group's quartiles, with the fences."""
    q = grouped_quantiles(df.select(*by, F.col(c).alias("__y")), by, ["__y"], [0.25, 0.75])
    q1, q3 = F.col("__y")[0], F.col("__y")[1]
    fences = q.select(*by, (q1 - factor * (q3 - q1)).alias("lower_fence"), (q3 + factor * (q3 - q1)).alias("upper_fence"))
    return same_groups(df, fences, by).where((F.col(c) < F.col("lower_fence")) | (F.col(c) > F.col("upper_fence")))


def violin(df: DataFrame, c: str, by: list[str], points: int = 64) -> DataFrame:
    """by, at, density: a Gaussian kernel density of each group's values at `points` places from its least to its greatest value.

    Values are counted in as many bins as there are places; the density is the sum of kernels around the bins' middles,
    weighted by the counts. The width is 0.9 min(deviation, IQR / 1.34) n^(-1/5), by exact quartiles. A group of one value only has none.
    """
    value = F.col(c).cast("double")
    rows = df.select(*by, value.alias("__y")).where(value.isNotNull() & ~F.isnan(value))
    q = grouped_quantiles(rows, by, ["__y"], [0.25, 0.75]).select(*by, (F.col("__y")[1] - F.col("__y")[0]).alias("iqr"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__y").alias("lo"), F.max("__y").alias("hi"), F.stddev_pop("__y").alias("sd")).where("hi > lo")
    wide = F.least(F.col("sd"), F.when(F.col("iqr") > 0, F.col("iqr") / 1.34).otherwise(F.col("sd")))
    ends = same_groups(ends, q, by).select(*by, "n", "lo", "hi", (0.9 * wide * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"))
    step = (F.col("hi") - F.col("lo")) / points
    named = ends.withColumnsRenamed({x: f"__b_{x}" for x in by})
    slot = F.least(F.floor((F.col("__y") - F.col("lo")) / step), F.lit(points - 1)).cast("int").alias("bin")
    bins = rows.join(named, reduce(and_, (F.col(x).eqNullSafe(F.col(f"__b_{x}")) for x in by))).groupBy(*by, "n", "lo", "hi", "bandwidth", slot).agg(F.count("*").alias("m"))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) / (points - 1) * F.col("k")
    gap = (at - F.col("lo") - step * (F.col("bin") + 0.5)) / F.col("bandwidth")
    spread = bins.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    kernel = F.sum(F.col("m") * F.exp(-gap * gap / 2)) / (F.first("n") * F.first("bandwidth") * F.lit(sqrt(2 * pi)))
    return spread.groupBy(*by, "k", at.alias("at")).agg(kernel.alias("density")).select(*by, "at", "density")


def ecdf(df: DataFrame, c: str) -> DataFrame:
    from tessera.operators.order import frequencies

    f = with_running(frequencies(df, c), "v", {"upto": F.col("n")})
    total = df.where(F.col(c).isNotNull()).count()
    return f.select(F.col("v").alias("value"), F.col("upto").alias("cumulative"), (F.col("upto") / F.lit(float(total))).alias("share"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def density_grid(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    a, b, c, d = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    slot = lambda v, lo, hi: F.least(F.floor((F.col(v) - lo) / ((hi - lo) / bins or 1.0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(slot(x, a, b).alias("x_bin"), slot(y, c, d).alias("y_bin")).agg(F.count("*").alias("n"))


def calendar_table(df: DataFrame, date: str, y: str | None = None) -> DataFrame:
    day = F.to_date(date)
    return df.groupBy(day.alias("day")).agg(aggregate("sum" if y else "count", F.col(y) if y else None).alias("y")).select("day", F.weekofyear("day").alias("iso_week"), F.weekday("day").alias("weekday"), "y")


def records_over_time(df: DataFrame, date: str, bucket: str = "month") -> DataFrame:
    return df.groupBy(date_bucket(F.col(date), bucket).alias("bucket")).agg(F.count("*").alias("n"))


def series_statistic(df: DataFrame, c: str, stat: str) -> DataFrame:
    name = "p50" if stat == "median" else ALIASES.get(stat, stat)
    if name[0] == "p" and name[1:].isdigit():
        return exact_quantiles(df, [c], [int(name[1:]) / 100]).select(F.col("q")[0].alias("value"))
    return df.agg(aggregate(stat, F.col(c)).alias("value"))


def histogram_outlier_options(df: DataFrame, c: str) -> DataFrame:
    q = exact_quantiles(df, [c], [0.5, 0.95, 0.99, 1.0])
    p50, p95, p99, top = (F.col("q")[i] for i in range(4))
    return q.select(((top >= 5 * p99) | (p99 >= 20 * p50) | (p95 >= 10 * p50)).alias("clip"), p99.alias("clip_at"))


def parallel_categories(df: DataFrame, dims: list[str]) -> DataFrame:
    return df.groupBy(*dims).agg(F.count("*").alias("n"))


def both_ways(pairs: DataFrame, value: str) -> DataFrame:
    """a, b, value for each pair in both orders: the cells of a heatmap beside its diagonal."""
    return pairs.select("a", "b", value).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), value))


def pca_scatter(df: DataFrame, numeric: list[str], by: list[str], limit: int) -> DataFrame:
    """x and y, the first two principal components, of a hash sample of rows."""
    from tessera.operators.modeling import pca_project

    keys = list(dict.fromkeys([*(c for c in by if c), *numeric]))
    made = pca_project(C.hash_sample(df.select(*keys), limit, keys), numeric)
    return made.select(*(c for c in by if c), F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


SERIES = ("line", "area", "bar", "lollipop", "slope", "funnel", "radar", "bump_chart")
#: Kinds that take all columns, or those of `columns`.
WHOLE_TABLE = ("correlation_heatmap", "association_heatmap", "missingness", "pca_scatter")
OTHER_KINDS = (
    "histogram", "box", "violin", "ecdf", "density_heatmap", "density_contour", "pie", "treemap", "sunburst", "choropleth", "heatmap", "pareto", "waterfall", "calendar_heatmap", "parallel_categories",
    "concentration_curve", "target_association", "target_profile", "qq_plot", "autocorrelation", "missingness_matrix", *WHOLE_TABLE,
)


def chart_data(df: DataFrame, spec: dict) -> DataFrame:
    """The table of a chart: kind, x, y, color, aggregation, filters, bucket, bins, top_n, transform."""
    kind, x, y = spec["kind"], spec.get("x"), spec.get("y")
    if kind not in SERIES and kind not in ROW_CAPS and kind not in OTHER_KINDS:
        raise ValueError(f"unknown chart kind {kind!r}")
    V.validate_spec(df, spec, [] if kind in WHOLE_TABLE else ["target"] if kind == "target_association" else ["path"] if kind in ("treemap", "sunburst", "parallel_categories") else ["x"])
    for f in spec.get("filters", ()):
        df = V.filter_op(df, f["column"], f["op"], f.get("value"), f.get("upper"))
    bucket = auto_bucket(df, x) if spec.get("bucket") == "auto" else spec.get("bucket") or "none"
    if bucket != "none":
        df = df.withColumn(x, date_bucket(F.col(x), bucket))
    if spec.get("top_n"):
        df = top_n_other(df, x, spec["top_n"])
    by = [x] + [spec[k] for k in ("color", "facet") if spec.get(k)]
    kinds = {c: k for c, k in df.dtypes if c in spec.get("columns", df.columns)}
    numbers, words = [c for c, k in kinds.items() if C.is_numeric(k)], [c for c, k in kinds.items() if k == "string"]
    if kind in SERIES:
        out = weighted_mean(df, by, y, spec["weight"]) if spec.get("weight") else group_agg(df, by, y, spec.get("aggregation", "sum" if y else "count"))
        out = rolling_stat(out, x, "y", spec["rolling"], by=by[1:]) if spec.get("rolling") else out
        out = cumulative_sum(out, x, "y", by[1:]) if spec.get("cumulative") else out
        out = bump_rank(out, x, "y") if kind == "bump_chart" else out
        return value_transform(out, "y", spec["transform"], by[1:]) if spec.get("transform") else out
    made = {
        "histogram": lambda: histogram(df, x, spec.get("bins", 40)), "box": lambda: box(df, y, by), "violin": lambda: violin(df, y, by, spec.get("points", 64)), "ecdf": lambda: ecdf(df, x), "density_heatmap": lambda: density_grid(df, x, y), "density_contour": lambda: density_grid(df, x, y),
        "pie": lambda: share_agg(df, x, y), "treemap": lambda: hierarchy_agg(df, spec["path"], y), "sunburst": lambda: hierarchy_agg(df, spec["path"], y), "choropleth": lambda: group_agg(df, [x], y, "sum" if y else "count"), "heatmap": lambda: group_agg(df, [x, y], spec.get("z"), spec.get("aggregation", "count")),
        "pareto": lambda: pareto(df, x, y), "waterfall": lambda: waterfall(df, x, y), "calendar_heatmap": lambda: calendar_table(df, x, y), "parallel_categories": lambda: parallel_categories(df, spec["path"]),
        "concentration_curve": lambda: S.lorenz_curve(df, x), "correlation_heatmap": lambda: both_ways(S.pearson_matrix(df, spec.get("columns")), "r"), "association_heatmap": lambda: both_ways(S.mixed_associations(df, numbers, words), "strength"), "target_association": lambda: S.target_associations(df, spec["target"], [c for c in numbers if c != spec["target"]], [c for c in words if c != spec["target"]]),
        "target_profile": lambda: group_target_summary(df, y, by, None if C.is_numeric(dict(df.dtypes)[y]) else positive_value(df, y), spec.get("min_count", 1)), "qq_plot": lambda: S.qq_points(df, x), "autocorrelation": lambda: S.autocorrelation(df, x, y, spec.get("lags", 10)),
        "missingness": lambda: S.missingness(df), "missingness_matrix": lambda: S.missingness_matrix(df, x, spec.get("limit", 250)), "pca_scatter": lambda: pca_scatter(df, numbers, by, spec.get("limit", ROW_CAPS["scatter"])),
    }
    if kind in ROW_CAPS:
        shown = list(dict.fromkeys(c for c in (x, y, *by) if c))  # rows that tie in all of them are alike
        return C.hash_sample(df.select(*shown), spec.get("limit", ROW_CAPS[kind]), shown)
    return made[kind]()
