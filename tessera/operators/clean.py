"""Cleaning and model-preparation transforms: DataFrame in, lazy DataFrame out; statistics are single-row aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.order import exact_quantiles, grouped_quantiles, quantiles_of, with_filled, with_filled_groups

NULL_POLICIES = {"preserve": (None, None), "treat_as_false": (None, 0), "treat_as_true": (None, 1), "false_to_null": (0, None), "true_to_null": (1, None)}
#: One-hot encoding without a number of levels makes at most so many columns.
MOST_LEVELS = 1000


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None, **kw) -> DataFrame:
    return df.toDF(*C.clean_names(df.columns, mapping, **kw))


def rename_preview(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(zip(df.columns, C.clean_names(df.columns))), "column_name string, proposed string")


def trim_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: C.strip(F.col(c)) for c in cols})


def whitespace_count(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count_if(F.col(c) != C.strip(F.col(c))).alias("n"))


def missing_like_to_null(df: DataFrame, cols: list[str], tokens=C.MISSING_TOKENS) -> DataFrame:
    return df.withColumns({c: F.when(~C.missing_like(F.col(c), tokens), F.col(c)) for c in cols})


def parse_numeric(df: DataFrame, c: str, percent: str = "strip", keep_raw: bool = False) -> DataFrame:
    """Text as a number; with keep_raw what does not parse stays in <c>_raw."""
    n = C.to_number(F.col(c), "$£€¥,%")
    n = F.when(F.col(c).contains("%"), n / 100).otherwise(n) if percent == "divide" else n
    return df.withColumns({c: n} | ({f"{c}_raw": F.when(n.isNull(), F.col(c))} if keep_raw else {}))


def parse_datetime(df: DataFrame, c: str, dayfirst: bool = False) -> DataFrame:
    return df.withColumn(c, C.to_time(F.col(c), dayfirst))


def invalid_count(df: DataFrame, c: str, kind: str = "numeric") -> DataFrame:
    bad = (C.to_number(F.col(c)) if kind == "numeric" else C.to_time(F.col(c))).isNull() & F.col(c).isNotNull() & ~C.missing_like(F.col(c))
    least = df.where(bad).select(F.col(c).alias("v")).distinct().orderBy("v").limit(8)
    return df.agg(F.count_if(bad).alias("invalid")).crossJoin(least.agg(F.array_sort(F.collect_list("v")).alias("examples")))


def format_clusters(df: DataFrame, c: str, limit: int = 8) -> DataFrame:
    shape = F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "[0-9]+", "9"), "[A-Za-z]+", "A")
    return df.where(F.col(c).isNotNull()).groupBy(shape.alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(limit)


def map_values(df: DataFrame, c: str, mapping: dict[str, str], default: str | None = "preserve", case_sensitive: bool = True) -> DataFrame:
    key = C.strip(F.col(c)) if case_sensitive else F.lower(C.strip(F.col(c)))
    table = F.create_map(*(F.lit(x) for k, v in mapping.items() for x in (k if case_sensitive else k.lower(), v)))
    return df.withColumn(c, F.coalesce(table[key], F.col(c) if default == "preserve" else F.lit(default)))


def category_variants(df: DataFrame, c: str) -> DataFrame:
    """Labels that are equal but for case and outer white space."""
    f = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
    return f.groupBy(F.lower(C.strip(F.col("v"))).alias("label")).agg(F.count("*").alias("forms"), F.sum("n").alias("n")).where("forms > 1")


def unify_binary_flags(df: DataFrame, cols: list[str], to: str = "int", null_policy: str = "preserve") -> DataFrame:
    """Flags as int, bool, yes_no or yn; `bool` raises where nulls are left."""
    gone, fill = NULL_POLICIES[null_policy]
    out = {}
    for c in cols:
        v = C.to_flag(F.col(c))
        v = F.when(v != gone, v) if gone is not None else v
        v = F.coalesce(v, F.lit(fill)) if fill is not None else v
        if to == "bool":
            v = F.when(v.isNull(), F.raise_error(F.lit(f"{c} has values that are no flag"))).otherwise(v)
        out[c] = v if to == "int" else v.cast("boolean") if to.startswith("bool") else F.when(v == 1, "Yes" if to == "yes_no" else "Y").when(v == 0, "No" if to == "yes_no" else "N")
    return df.withColumns(out)


def add_missing_indicators(df: DataFrame, cols: list[str], suffix: str = "_was_missing") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": C.value(df, c).isNull().cast("tinyint") for c in cols})


def impute_missing(df: DataFrame, strategies: dict[str, str], fill=None, by: str | None = None, indicators: bool = False) -> DataFrame:
    """Fill by mean, median, mode, zero, constant or the word Missing; with `by` per group first, then overall."""
    stat = {"mean": lambda c: F.avg(c), "median": lambda c: F.lit(None).cast("double"), "mode": lambda c: F.mode(c, True)}
    aggs = [stat[s](C.value(df, c)).alias(c) for c, s in strategies.items() if s in stat]
    row = df.agg(*aggs).first().asDict() if aggs else {}
    middle = [c for c, s in strategies.items() if s == "median"]
    row |= {r["column_name"]: (r["q"] or [None])[0] for r in exact_quantiles(df, middle, [0.5]).collect()} if middle else {}
    out = add_missing_indicators(df, list(strategies), "_was_imputed") if indicators else df
    if by and aggs:
        means = [stat[s](C.value(df, c)).alias(f"__{c}") for c, s in strategies.items() if s in stat and s != "median"]
        groups = df.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"), *means)
        if middle:
            local = grouped_quantiles(df, [by], middle, [0.5]).select(F.col(by).alias("__of"), *(F.col(c)[0].alias(f"__{c}") for c in middle))
            groups = groups.join(local, F.col("__by").eqNullSafe(F.col("__of")), "left")
        out = out.join(groups, F.col(by).eqNullSafe(F.col("__by")), "left")
    for c, s in strategies.items():
        last = row.get(c) if s in stat else {"zero": 0, "constant": fill, "missing": "Missing"}[s]
        local = [F.col(f"__{c}")] if by and s in stat else []
        out = out.withColumn(c, F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")) if dict(df.dtypes)[c] in ("double", "float") else F.col(c), *local, F.lit(last)))
    return out.select(*[c for c in out.columns if not c.startswith("__")])


def one_hot_encode(df: DataFrame, c: str, k: int | None = None, other: str = "Other", drop_first: bool = False, dummy_na: bool = False) -> DataFrame:
    """A column of 0 and 1 for each level: of the k most frequent and `other`, or of all; without k over MOST_LEVELS levels raise."""
    levels = [r[0] for r in df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(k or MOST_LEVELS + 1).collect()]
    if not k and len(levels) > MOST_LEVELS:
        raise ValueError(f"{c} has over {MOST_LEVELS} levels: give k, the number of levels with a column of their own")
    shown = levels[1:] if drop_first else levels
    out = {f"{c}_{v}": F.coalesce((F.col(c) == v).cast("tinyint"), F.lit(0).cast("tinyint")) for v in shown}
    if k:
        out[f"{c}_{other}"] = (F.col(c).isNotNull() & ~F.col(c).isin(*levels)).cast("tinyint")
    if dummy_na:
        out[f"{c}_nan"] = F.col(c).isNull().cast("tinyint")
    return df.withColumns(out).drop(c)


def scale_numeric(df: DataFrame, cols: list[str], method: str = "standard") -> DataFrame:
    """standard (population std), minmax, robust (median and IQR), maxabs; a scale of zero gives 0."""
    if method == "robust":
        q = {r["column_name"]: r["q"] or [None] * 3 for r in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).collect()}
        return df.withColumns({c: F.lit(0.0) if not q[c][2] or q[c][2] == q[c][0] else (C.value(df, c) - F.lit(q[c][1])) / F.lit(q[c][2] - q[c][0]) for c in cols})
    both = {"standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)), "maxabs": lambda c: (F.lit(0.0), F.max(F.abs(c)))}[method]
    row = df.agg(*(F.struct(*(x.alias(n) for x, n in zip(both(C.value(df, c)), "ab"))).alias(c) for c in cols)).first()
    return df.withColumns({c: F.lit(0.0) if not row[c]["b"] else (C.value(df, c) - F.lit(row[c]["a"])) / F.lit(row[c]["b"]) for c in cols})


def add_date_features(df: DataFrame, c: str, parts=("year", "quarter", "month", "day", "weekday", "is_weekend", "hour")) -> DataFrame:
    """Calendar parts; weekday is 0 on Monday, a null date is no weekend."""
    t = F.col(c)
    made = {"year": F.year(t), "quarter": F.quarter(t), "month": F.month(t), "day": F.dayofmonth(t), "weekday": F.weekday(t), "is_weekend": F.coalesce((F.weekday(t) >= 5).cast("int"), F.lit(0)), "hour": F.hour(t), "date": F.to_date(t)}
    return df.withColumns({f"{c}_{p}": made[p] for p in parts})


def add_ratio(df: DataFrame, a: str, b: str, output: str, zero: str = "null") -> DataFrame:
    r = F.try_divide(F.col(a), F.col(b))
    return df.withColumn(output, F.coalesce(r, F.lit(0.0)) if zero == "zero" else r)


def outlier_bounds(df: DataFrame, c: str, method: str = "iqr", factor: float | None = None) -> tuple[float | None, float | None]:
    """Fences by iqr, zscore, modified_zscore or percentile."""
    v = C.value(df, c)
    if method == "percentile":
        return tuple(quantiles_of(df, v, [0.01, 0.99]))
    if method == "zscore":
        mean, sd = df.agg(F.avg(v), F.stddev_pop(v)).first()
        return mean - (factor or 3) * sd, mean + (factor or 3) * sd
    if method == "modified_zscore":
        mid = quantiles_of(df, v, [0.5])[0]
        mad = quantiles_of(df, F.abs(v - F.lit(mid)), [0.5])[0]
        return mid - (factor or 3.5) * mad / 0.6745, mid + (factor or 3.5) * mad / 0.6745
    a, b = quantiles_of(df, v, [0.25, 0.75])
    return a - (factor or 1.5) * (b - a), b + (factor or 1.5) * (b - a)


def clean_numeric_outliers(df: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """rules: column -> (method, flag | null | clip | drop); all drops apply together at the end."""
    keep, out = F.lit(True), df
    for c, (method, action) in rules.items():
        lo, hi = outlier_bounds(df, c, method)
        outside = F.coalesce(~F.col(c).between(lo, hi), F.lit(False))
        if action == "flag":
            out = out.withColumn(f"{c}_is_outlier", outside.cast("tinyint"))
        elif action == "null":
            out = out.withColumn(c, F.when(~outside, F.col(c)))
        elif action == "clip":
            out = out.withColumn(c, F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)))
        else:
            keep = keep & ~outside
    return out.where(keep)


def geo_fix(df: DataFrame, lat: str, lon: str, treatment: str = "null_invalid") -> DataFrame:
    bad = (F.abs(lat) > 90) | (F.abs(lon) > 180)
    swapped = (F.abs(lat) > 90) & (F.abs(lat) <= 180) & (F.abs(lon) <= 90)
    test = swapped if treatment == "swap_likely" else bad
    a, b = (F.col(lon), F.col(lat)) if treatment == "swap_likely" else (F.lit(None), F.lit(None))
    return df.withColumns({lat: F.when(test, a).otherwise(F.col(lat)), lon: F.when(test, b).otherwise(F.col(lon))})


def geo_review(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.agg(F.count_if((F.abs(lat) > 90) | (F.abs(lon) > 180)).alias("invalid"), F.count_if((F.abs(lat) > 90) & (F.abs(lat) <= 180) & (F.abs(lon) <= 90)).alias("likely_swapped"))


def fill_forward(df: DataFrame, c: str, order_by: str, by: list[str] | None = None, backward: bool = False) -> DataFrame:
    """The last (backward: next) value that is not null, in the order within each group; without groups, in that of all rows."""
    if not by:
        return with_filled(df, order_by, c, backward=backward)
    return with_filled_groups(df, by, order_by, c, backward=backward)


def dedupe(df: DataFrame, subset: list[str] | None = None, keep: str = "first", order_by: str | None = None) -> DataFrame:
    """One row of each group by order_by, or with keep="none" only rows that are alone; whole rows without subset."""
    if not subset:
        return df.distinct()
    if keep == "none":
        return df.join(df.groupBy(*subset).count().where("count = 1").select(*subset), subset, "left_semi")
    if not order_by:
        raise ValueError("first and last need order_by")
    w = Window.partitionBy(*subset).orderBy(F.col(order_by).desc() if keep == "last" else F.col(order_by))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def duplicate_groups(df: DataFrame, subset: list[str]) -> DataFrame:
    g = df.groupBy(*subset).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_groups"), F.count_if(F.col("n") > 1).alias("groups"))


def downcast_plan(df: DataFrame) -> DataFrame:
    """column_name, from_type, to_type: the narrowest types that hold all values."""
    nums = C.columns_of(df, lambda k: k in ("int", "bigint", "double"))
    kinds = dict(df.dtypes)
    row = df.agg(*(F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.count_if(C.value(df, c) != F.floor(c)).alias("frac"), F.count_if(F.abs(C.value(df, c) - C.value(df, c).cast("float").cast("double")) > F.lit(1e-9) + F.lit(1e-6) * F.abs(c)).alias("loss")).alias(c) for c in nums)).first()
    out = []
    for c in nums:
        r = row[c]
        if r["lo"] is None:
            continue
        if not r["frac"]:
            to = next((t for t, b in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(2**b) <= r["lo"] and r["hi"] < 2**b), kinds[c])
        else:
            to = "float" if not r["loss"] else kinds[c]
        if to != kinds[c]:
            out.append((c, kinds[c], to))
    return df.sparkSession.createDataFrame(out, "column_name string, from_type string, to_type string")


def apply_downcast(df: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan's casts, checked anew: a column that no longer fits stays."""
    now = {r["column_name"]: r["to_type"] for r in downcast_plan(df).collect()}
    return df.withColumns({r["column_name"]: F.col(r["column_name"]).cast(r["to_type"]) for r in plan.collect() if now.get(r["column_name"]) == r["to_type"]})


def low_cardinality_plan(df: DataFrame, ratio: float = 0.5, most: int = 50_000) -> DataFrame:
    from tessera.operators.profile import column_counts

    text = C.columns_of(df, lambda k: k == "string")
    return column_counts(df.select(*text)).where((F.col("distinct_ratio") <= ratio) & (F.col("distinct_count") <= most)).select("column_name", "distinct_count", "distinct_ratio")


def cleaning_plan(df: DataFrame) -> DataFrame:
    """action, column_name, affected, confidence: proposed steps, all counts from one aggregate pass."""
    text = C.columns_of(df, lambda k: k == "string")
    tests = {"trim_strings": (lambda c: c != C.strip(c), 0.95), "standardize_missing": (lambda c: C.missing_like(c), 0.9), "parse_numeric": (lambda c: C.to_number(c).isNotNull(), 0.85), "parse_datetime": (lambda c: C.to_time(c).isNotNull(), 0.85), "binary_mapping": (lambda c: C.to_flag(c).isNotNull(), 0.9)}
    stats = [F.struct(F.lit(a).alias("action"), F.lit(c).alias("column_name"), F.count_if(t(F.col(c))).alias("affected"), F.count_if(F.col(c).isNotNull() & ~C.missing_like(F.col(c))).alias("useful"), F.lit(conf).alias("confidence")) for c in text for a, (t, conf) in tests.items()]
    if not stats:
        return df.sparkSession.createDataFrame([], "action string, column_name string, affected bigint, confidence double")
    row = df.agg(*(s.alias(f"s{i}") for i, s in enumerate(stats))).select(F.explode(F.array(*(f"s{i}" for i in range(len(stats))))).alias("x")).select("x.*")
    fits = F.when(F.col("action").isin("trim_strings", "standardize_missing"), F.col("affected") > 0).otherwise(F.col("affected") >= 0.9 * F.greatest("useful", F.lit(1)))
    return row.where(fits).select("action", "column_name", "affected", "confidence")


#: Names that a plan gives to the table's rows and to its column names.
ROWS, COLUMNS = "__rows__", "__columns__"


def review_plan(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """action, column_name, affected, confidence: what a person should look at, beside the steps of cleaning_plan.

    Column names to clean, repeated rows (those beyond the first), nulls, labels that are equal but for case and white
    space (the rows of the rarer forms), numbers outside the fences of the interquartile range.
    """
    from tessera.operators.profile import duplicate_rows, per_column

    spark, shape = df.sparkSession, "action string, column_name string, affected bigint, confidence double"
    renamed = sum(a != b for a, b in zip(df.columns, C.clean_names(df.columns)))
    out = spark.createDataFrame([("column_rename_review", COLUMNS, renamed, 0.88)] if renamed else [], shape)
    add = lambda d, action, confidence: out.unionByName(d.select(F.lit(action).alias("action"), "column_name", F.col("affected").cast("bigint").alias("affected"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence")).where("affected > 0"))
    out = add(duplicate_rows(df).select(F.lit(ROWS).alias("column_name"), F.col("duplicate_rows").alias("affected")), "duplicate_row_review", 0.94)
    out = add(per_column(df, df.columns, {"affected": lambda c: F.count_if(c.isNull())}), "missing_value_review", 0.8)
    text, numeric = C.columns_of(df, lambda k: k == "string"), C.columns_of(df, C.is_numeric)
    if text:
        forms = df.select(*text).unpivot([], text, "column_name", "v").where("v is not null").groupBy("column_name", "v").agg(F.count("*").alias("n"))
        labels = forms.groupBy("column_name", F.lower(C.strip(F.col("v"))).alias("label")).agg((F.sum("n") - F.max("n")).alias("rarer"))
        out = add(labels.groupBy("column_name").agg(F.sum("rarer").alias("affected")), "category_value_review", 0.72)
    if numeric:
        fences = {r["column_name"]: r["q"] for r in exact_quantiles(df, numeric, [0.25, 0.75]).collect() if r["q"]}
        wide = {c: (a - factor * (b - a), b + factor * (b - a)) for c, (a, b) in fences.items() if b > a}
        if wide:
            outside = df.agg(*(F.struct(F.count_if(~C.value(df, c).between(*wide[c])).alias("affected"), F.count(C.value(df, c)).alias("n")).alias(c) for c in wide)).unpivot([], list(wide), "column_name", "s").select("column_name", "s.*")
            out = add(outside, "numeric_outlier_review", F.when(F.col("affected") >= 0.05 * F.col("n"), 0.78).otherwise(0.66))
    return out


def apply_cleaning(df: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan's actions in a fixed order as one lazy plan; a column gets one type of parsing at most.

    Of the reviews, outliers are flagged, before values change, and names are cleaned at the end; the others change nothing.
    """
    actions: dict[str, set[str]] = {}
    for r in plan.collect():
        actions.setdefault(r["column_name"], set()).add(r["action"])
    out = clean_numeric_outliers(df, {c: ("iqr", "flag") for c, todo in actions.items() if "numeric_outlier_review" in todo})
    for c, todo in actions.items():
        if "trim_strings" in todo:
            out = trim_strings(out, [c])
        if "standardize_missing" in todo:
            out = missing_like_to_null(out, [c])
        if "binary_mapping" in todo:
            out = unify_binary_flags(out, [c])
        elif "parse_numeric" in todo:
            out = parse_numeric(out, c)
        elif "parse_datetime" in todo:
            out = parse_datetime(out, c)
    return rename_columns(out) if "column_rename_review" in actions.get(COLUMNS, ()) else out


def modeling_plan(df: DataFrame, target: str) -> DataFrame:
    """action, column_name: what prepares the columns for a model; the target is left alone."""
    from tessera.operators.rules import semantic_types

    s = semantic_types(df).where(F.col("column_name") != target)
    act = F.when(F.col("role") == "id", "drop_identifier").when(F.col("semantic_type") == "constant", "drop_constant").when(F.col("role") == "timestamp", "date_features").when(F.col("semantic_type").isin("category", "binary", "nullable_binary", "string"), "one_hot").when(F.col("semantic_type") == "text", "drop_text").otherwise("impute_median")
    return s.select(act.alias("action"), "column_name")


def apply_modeling(df: DataFrame, plan: DataFrame, max_categories: int = 20) -> DataFrame:
    kinds, out = dict(df.dtypes), df
    rows = sorted((r["action"], r["column_name"]) for r in plan.collect())
    # all medians come from the table as it is, at once, before levels become columns
    middle = [c for a, c in rows if a == "impute_median" and C.is_numeric(kinds[c])]
    for a, c in rows:
        if a.startswith("drop"):
            out = out.drop(c)
        elif a == "date_features":
            out = add_date_features(out, c, ("year", "month", "day", "weekday")).drop(c)
        elif a == "one_hot":
            out = one_hot_encode(out.withColumn(c, F.col(c).cast("string")), c, max_categories)
        elif middle and c == middle[0]:
            out = impute_missing(out, dict.fromkeys(middle, "median"), indicators=True)
    return out
