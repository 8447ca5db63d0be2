"""Column and dataset profiles: one fused aggregate over the table, and one frequency pass for what needs values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.order import exact_quantiles

QUANTILES = (0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
QUANTILE_NAMES = ("p00", "p01", "p05", "p10", "p25", "p50", "p75", "p90", "p95", "p99", "p100")


def per_column(df: DataFrame, cols: list[str], measures: dict[str, callable]) -> DataFrame:
    """One row per column with the measures (name -> function of the column), from one pass over df."""
    if not cols:
        raise ValueError("no column fits")
    row = df.agg(*(F.struct(*(f(C.value(df, c)).alias(n) for n, f in measures.items())).alias(f"s{i}") for i, c in enumerate(cols)))
    items = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("s")) for i, c in enumerate(cols)))
    return row.select(F.explode(items).alias("x")).select("x.column_name", "x.s.*")


def value_counts(df: DataFrame, cols: list[str], nulls: bool = False) -> DataFrame:
    """(column_name, value, n) for all cols in one shuffle; counts are combined before it."""
    long = df.select(*(C.value(df, c).cast("string").alias(c) for c in cols)).unpivot([], cols, "column_name", "value")
    return (long if nulls else long.where("value is not null")).groupBy("column_name", "value").agg(F.count("*").alias("n"))


def value_facts(df: DataFrame, measures: dict[str, callable] | None = None) -> DataFrame:
    """column_name, rows, non_null, distinct_count, top and the measures of each column, worked out at once: a row a column, that the driver holds.

    A measure takes the column's type and gives an aggregate over its different values, `value` with its count `n`, or None where
    it says nothing of that type. Values keep their type; columns of one type share a shuffle, and counts are combined before it.
    """
    kinds: dict[str, list[str]] = {}
    for c, kind in df.dtypes:
        kinds.setdefault(kind, []).append(c)
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(None).cast("string").alias("column_name"), "rows")]
    for kind, cols in kinds.items():
        values = df.select(*(C.value(df, c).alias(c) for c in cols)).unpivot([], cols, "column_name", "value").where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
        more = {name: f(kind) for name, f in (measures or {}).items()}
        parts.append(values.groupBy("column_name").agg(F.sum("n").alias("non_null"), F.count("*").alias("distinct_count"), F.max("n").alias("top"), *((F.lit(None) if m is None else m).cast("double").alias(name) for name, m in more.items())))
    found = {r["column_name"]: r.asDict() for r in reduce(lambda a, b: a.unionByName(b, True), parts).collect()}
    names, empty = ["non_null", "distinct_count", "top", *(measures or {})], dict.fromkeys(("non_null", "distinct_count", "top"), 0)
    rows = [(c, found[None]["rows"], *(found.get(c, empty).get(n) for n in names)) for c in df.columns]
    shape = ", ".join(f"{n} {'double' if n in (measures or {}) else 'bigint'}" for n in ("rows", *names))
    return df.sparkSession.createDataFrame(rows, f"column_name string, {shape}").coalesce(1)


def column_counts(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    n = value_facts(df) if facts is None else facts
    return n.select("column_name", "non_null", (F.col("rows") - F.col("non_null")).alias("missing"), F.try_divide(F.col("rows") - F.col("non_null"), "rows").alias("missing_ratio"), "distinct_count", F.try_divide("distinct_count", "non_null").alias("distinct_ratio"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def dataset_summary(df: DataFrame) -> DataFrame:
    missing = reduce(lambda a, b: a + b, (C.value(df, c).isNull().cast("bigint") for c in df.columns))
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"))
    return one.crossJoin(duplicate_rows(df)).select("rows", "columns", "missing_cells", F.try_divide("missing_cells", F.col("rows") * F.col("columns")).alias("missing_ratio"), "duplicate_rows")


def top_values(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return value_counts(df, cols).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("column_name", "rank", "value", "n")


def frequency_facts(df: DataFrame, cols: list[str], rare: int = 5) -> DataFrame:
    """Per column: the mode with its share, rare values with their share, Shannon entropy (bits) and its ratio to the maximum."""
    f = value_counts(df, cols)
    t = f.groupBy("column_name").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("k"),
        F.max("n").alias("top"),
        F.min_by("value", F.struct(-F.col("n"), "value")).alias("dominant_value"),
        F.count_if(F.col("n") <= rare).alias("rare_values"),
        F.sum(F.when(F.col("n") <= rare, F.col("n")).otherwise(0)).alias("rare_rows"),
        F.sum(F.col("n") * F.log2("n")).alias("nlogn"),
    )
    h = F.greatest(F.lit(0.0), F.log2("total") - F.col("nlogn") / F.col("total"))
    return t.select("column_name", "dominant_value", (F.col("top") / F.col("total")).alias("dominant_share"), "rare_values", (F.col("rare_rows") / F.col("total")).alias("rare_share"), h.alias("entropy"), F.when(F.col("k") > 1, h / F.log2("k")).otherwise(0.0).alias("entropy_ratio"))


def _skew(c: Column) -> Column:
    n = F.count(c)
    return F.when(F.min(c) == F.max(c), 0.0).when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2))


def _kurtosis(c: Column) -> Column:
    n = F.count(c)
    return F.when(F.min(c) == F.max(c), 0.0).when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(c) + 6))


def numeric_metrics(df: DataFrame, cols: list[str] | None = None, quantiles: bool = False) -> DataFrame:
    """min, max, mean, median, std, bias-adjusted skew and kurtosis, shares of zero, negative, positive, integer-like; finite values only. With the 11 quantiles on demand."""
    cols = cols or C.columns_of(df, C.is_numeric)
    finite = lambda c: F.when(F.abs(c) < F.lit(float("inf")), c)
    share = lambda test: lambda c: F.avg(F.when(finite(c).isNotNull(), test(c).cast("int")))
    on = lambda f: lambda c: f(finite(c).cast("double"))
    measured = per_column(
        df, cols,
        {"min": on(F.min), "max": on(F.max), "mean": on(F.avg), "std": on(F.stddev_samp), "skew": on(_skew), "kurtosis": on(_kurtosis), "zero_ratio": share(lambda c: c == 0), "negative_ratio": share(lambda c: c < 0), "positive_ratio": share(lambda c: c > 0), "integer_ratio": share(lambda c: c == F.floor(c)), "infinite_count": lambda c: F.count_if(F.abs(c) == F.lit(float("inf")))},
    )
    places = exact_quantiles(df.select(*(finite(F.col(c).cast("double")).alias(c) for c in cols)), cols, list(QUANTILES) if quantiles else [0.5])
    named = [F.col("q")[i].alias(n) for i, n in enumerate(QUANTILE_NAMES)] if quantiles else []
    return measured.join(F.broadcast(places.select("column_name", F.col("q")[5 if quantiles else 0].alias("median"), *named)), "column_name", "left")


def quantiles11(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    q = exact_quantiles(df, cols or C.columns_of(df, C.is_numeric), list(QUANTILES))
    return q.select("column_name", *(F.col("q")[i].alias(n) for i, n in enumerate(QUANTILE_NAMES)))


def iqr_outliers(df: DataFrame, cols: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Per column the IQR and the values beyond factor * IQR; none where the IQR is 0. The fences of all columns are one small collect."""
    cols = cols or C.columns_of(df, C.is_numeric)
    q = {r["column_name"]: (r["p25"], r["p75"]) for r in quantiles11(df, cols).collect()}
    parts = []
    for c in cols:
        lo, hi = q[c]
        iqr = None if lo is None else hi - lo
        out = F.count_if((F.col(c) < lo - factor * iqr) | (F.col(c) > hi + factor * iqr)) if iqr else F.lit(0).cast("bigint")
        parts.append(F.struct(F.lit(c).alias("column_name"), F.lit(iqr).cast("double").alias("iqr"), out.alias("outliers"), F.try_divide(out, F.count(c)).alias("outlier_ratio")))
    return df.agg(*(p.alias(f"s{i}") for i, p in enumerate(parts))).select(F.explode(F.array(*(f"s{i}" for i in range(len(parts))))).alias("x")).select("x.*")


def string_metrics(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    words = lambda c: F.when(C.strip(c) == "", 0).otherwise(F.size(F.split(C.strip(c), r"\s+")))
    return per_column(
        df, cols or C.columns_of(df, lambda k: k == "string"),
        {"min_length": lambda c: F.min(F.length(c)), "max_length": lambda c: F.max(F.length(c)), "mean_length": lambda c: F.avg(F.length(c)), "median_length": lambda c: F.median(F.length(c)), "empty_count": lambda c: F.count_if(C.strip(c) == ""), "mean_words": lambda c: F.avg(F.when(c.isNotNull(), words(c))), "max_words": lambda c: F.max(F.when(c.isNotNull(), words(c)))},
    )


def missing_like_tokens(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or C.columns_of(df, lambda k: k == "string")
    return value_counts(df, cols).where(C.missing_like(F.col("value"))).groupBy("column_name", F.lower(C.strip(F.col("value"))).alias("token")).agg(F.sum("n").alias("n"))


def parse_ratios(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Shares of the non-null values that read as number, date, flag and JSON; and as number once $ , % are gone."""
    share = lambda test: lambda c: F.avg(F.when(c.isNotNull(), test(c).cast("int")))
    useful = lambda c: F.when(~C.missing_like(c), c)
    return per_column(
        df, cols or C.columns_of(df, lambda k: k == "string"),
        {"numeric_ratio": share(lambda c: C.to_number(c, "").isNotNull()), "datetime_ratio": share(lambda c: C.to_time(c).isNotNull()), "boolean_ratio": share(lambda c: C.to_flag(c).isNotNull()), "json_ratio": share(lambda c: c.rlike(r"^\s*[\[{]")), "numeric_parse_ratio": lambda c: share(lambda x: C.to_number(x).isNotNull())(useful(c))},
    )


def boolean_metrics(df: DataFrame, cols: list[str]) -> DataFrame:
    return per_column(df, cols, {"true_count": lambda c: F.count_if(C.to_flag(c) == 1), "false_count": lambda c: F.count_if(C.to_flag(c) == 0), "true_ratio": lambda c: F.avg((C.to_flag(c) == 1).cast("int")), "unmapped_ratio": lambda c: F.avg(F.when(c.isNotNull(), C.to_flag(c).isNull().cast("int")))})


def datetime_range(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return per_column(df, cols or C.columns_of(df, C.is_time), {"min": lambda c: F.min(c).cast("timestamp_ntz"), "max": lambda c: F.max(c).cast("timestamp_ntz"), "non_null": F.count})


def numeric_histogram(df: DataFrame, c: str, bins: int = 16) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins between minimum and maximum; one bin when they are equal."""
    lo, hi = df.agg(F.min(C.value(df, c)), F.max(C.value(df, c))).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    width = (hi - lo) / bins
    slot = F.least(F.floor((F.col(c) - lo) / width), F.lit(bins - 1)).cast("int") if width else F.lit(0)
    return df.where(C.value(df, c).isNotNull()).groupBy(slot.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(float(lo)) + F.col("bin") * width).alias("lo"), (F.lit(float(lo)) + (F.col("bin") + 1) * width).alias("hi"), "n")


def examples(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """The k smallest distinct values of each column."""
    return value_counts(df, cols).withColumn("r", F.row_number().over(Window.partitionBy("column_name").orderBy("value"))).where(F.col("r") <= k).select("column_name", F.col("r").alias("rank"), "value")


def fact_table(df: DataFrame) -> DataFrame:
    """Flat facts (subject, fact, value, mode, confidence) from the column counts."""
    c = column_counts(df)
    long = c.select("column_name", *(F.col(x).cast("double").alias(x) for x in c.columns[1:])).unpivot(["column_name"], c.columns[1:], "fact", "value")
    return long.select(F.col("column_name").alias("subject"), "fact", "value", F.lit("exact").alias("mode"), F.lit(1.0).alias("confidence"))


def column_profile(df: DataFrame) -> DataFrame:
    """The full numeric and frequency profile, one row per column."""
    out = column_counts(df).join(frequency_facts(df, df.columns), "column_name", "left")
    if cols := C.columns_of(df, C.is_numeric):
        out = out.join(numeric_metrics(df, cols, True), "column_name", "left").join(iqr_outliers(df, cols), "column_name", "left")
    return out
