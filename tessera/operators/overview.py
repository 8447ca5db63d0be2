"""What a scan shows of a whole table: its size and kinds of columns, facts of all measures, times, associations by rank, split histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import profile as P
from tessera.operators import stats as S
from tessera.operators.charts import ROW_CAPS
from tessera.operators.order import exact_quantiles, with_lag, with_running
from tessera.operators.rules import infer_task, semantic_types, target_candidates

# Semantic types that an association scan takes as numbers and as categories.
AS_NUMBERS = ("numeric", "amount", "nonnegative_amount", "numeric-like", "percentage", "proportion", "numeric_discrete")
AS_CATEGORIES = ("category", "string", "binary", "nullable_binary", "boolean")
#: Bytes of a value of a fixed width.
WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
#: From this score on a likely target is taken without being named.
SURE_TARGET = 0.9
NORMS = ("count", "probability", "percent", "density")


def table_overview(df: DataFrame, sampled: bool = False) -> DataFrame:
    """One row: rows, columns, missing_cells, missing_ratio, duplicate_rows, value_bytes, semantic_counts (type -> columns), sampled.

    value_bytes are those of the values that are not null: the width of numbers and times, the UTF-8 length of text, the length
    of other kinds as text. `sampled` is what the caller knows of df: facts of a sample say so.
    """
    kinds = dict(df.dtypes)
    size = lambda c: F.when(F.col(c).isNotNull(), WIDTH[kinds[c]] if kinds[c] in WIDTH else 8 if C.is_numeric(kinds[c]) or C.is_time(kinds[c]) else F.octet_length(F.col(c).cast("string"))).otherwise(0).cast("bigint")
    total = df.agg(F.coalesce(F.sum(sum((size(c) for c in df.columns), F.lit(0))), F.lit(0)).alias("value_bytes"))
    types = semantic_types(df).groupBy("semantic_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("semantic_type", "n")))).alias("semantic_counts"))
    return P.dataset_summary(df).crossJoin(total).crossJoin(types).withColumn("sampled", F.lit(sampled))  # each is one row


def time_facts(df: DataFrame, cols: list[str], order_by: str | None = None) -> DataFrame:
    """column_name, non_null, parsed, parse_ratio, min, max, span_days, duplicates, duplicate_ratio, median_gap, max_gap, monotonic.

    Text is read by the known formats; parse_ratio is of all rows. duplicates are the values beyond the first of each instant, gaps
    the seconds between neighbours in time, equal instants included. monotonic (only with order_by, a key without ties, else
    null) tells whether no parsed value is before one of an earlier row. A column without a time has nulls and a ratio of 0.
    """
    kinds = dict(df.dtypes)
    at = {c: (F.col(c).cast("timestamp") if C.is_time(kinds[c]) else C.to_time(F.col(c)).cast("timestamp")) for c in cols}
    out = None
    for c in cols:
        x = df.select(*([F.col(order_by).alias("__k")] if order_by else []), F.unix_micros(at[c]).alias("__t"), F.col(c).isNotNull().alias("__given"))
        one = x.agg(F.count("*").alias("rows"), F.count_if("__given").alias("non_null"), F.count("__t").alias("parsed"), F.min("__t").alias("lo"), F.max("__t").alias("hi"))
        times = x.where("__t is not null")
        steps = with_lag(times.groupBy("__t").agg(F.count("*").alias("n")), "__t", "__t").select((F.col("__t") - F.col("previous")).alias("gap"), "n")
        # A gap of 0 for each further row of an instant, and one gap between instants.
        gaps = steps.where("gap is not null").groupBy("gap").agg(F.count("*").alias("n")).unionByName(steps.agg(F.lit(0).cast("bigint").alias("gap"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")))
        one = one.crossJoin(_gap_facts(gaps))
        if order_by:
            back = with_lag(times, "__k", "__t").agg(F.count_if(F.col("__t") < F.col("previous")).alias("back"))
            one = one.crossJoin(back).withColumn("monotonic", F.when(F.col("parsed") > 0, F.col("back") == 0))
        else:
            one = one.withColumn("monotonic", F.lit(None).cast("boolean"))
        fact = one.select(
            F.lit(c).alias("column_name"), "non_null", "parsed", F.coalesce(F.try_divide("parsed", "rows"), F.lit(0.0)).alias("parse_ratio"), F.timestamp_micros("lo").cast("timestamp_ntz").alias("min"), F.timestamp_micros("hi").cast("timestamp_ntz").alias("max"), ((F.col("hi") - F.col("lo")) / 86_400_000_000).alias("span_days"),
            "duplicates", F.coalesce(F.try_divide("duplicates", "parsed"), F.lit(0.0)).alias("duplicate_ratio"), (F.col("median") / 1e6).alias("median_gap"), (F.col("largest") / 1e6).alias("max_gap"), "monotonic",
        )
        out = fact if out is None else out.unionByName(fact)
    return out


def _gap_facts(gaps: DataFrame) -> DataFrame:
    """duplicates, median, largest of a table of gaps (gap, n), by the running count over distinct gaps."""
    run = with_running(gaps.groupBy("gap").agg(F.sum("n").alias("n")).where("n > 0"), "gap", {"upto": F.col("n")})
    whole = run.agg(F.max("upto").alias("all"), F.max("gap").alias("largest"), F.coalesce(F.max(F.when(F.col("gap") == 0, F.col("n"))), F.lit(0)).alias("duplicates"))
    place = lambda k: F.min(F.when(F.col("upto") > k, F.col("gap")))
    both = run.crossJoin(F.broadcast(whole)).groupBy("all", "largest", "duplicates").agg(((place(F.floor((F.col("all") - 1) / 2)) + place(F.floor(F.col("all") / 2))) / 2).alias("median"))
    none = whole.select("duplicates").limit(1)
    return none.join(both.drop("duplicates", "all"), F.lit(True), "left").select("duplicates", "median", "largest")


def all_facts(df: DataFrame, sampled: bool = False) -> DataFrame:
    """subject, fact, value, mode, confidence: every number of the profile as a row; nulls are left out.

    Counts and shares of all columns, moments and quantiles of numbers, lengths of text, and for the table (subject `*`) its
    size. mode is exact, or sampled if the caller says that df is a sample.
    """
    tables = [P.column_counts(df), P.frequency_facts(df, df.columns).drop("dominant_value")]
    numeric, text = C.columns_of(df, C.is_numeric), C.columns_of(df, lambda k: k == "string")
    tables += [P.numeric_metrics(df, numeric, True), P.iqr_outliers(df, numeric)] if numeric else []
    tables += [P.string_metrics(df, text), P.parse_ratios(df, text)] if text else []
    tables.append(P.dataset_summary(df).withColumn("column_name", F.lit("*")))
    out = None
    for t in tables:
        cols = [c for c in t.columns if c != "column_name"]
        long = t.select("column_name", *(F.col(c).cast("double").alias(c) for c in cols)).unpivot(["column_name"], cols, "fact", "value")
        out = long if out is None else out.unionByName(long)
    kept = out.where("value is not null").select(F.col("column_name").alias("subject"), "fact", "value")
    return kept.withColumns({"mode": F.lit("sampled" if sampled else "exact"), "confidence": F.lit(0.9 if sampled else 1.0)})


def ranked_associations(df: DataFrame, numeric: list[str] | None = None, categories: list[str] | None = None, most: int = 30) -> DataFrame:
    """rank, a, b, method, strength: the `most` strongest pairs of columns, by |r|, eta squared, Cramer's V and |phi| of nulls.

    Without names, columns are taken by their semantic types, those of one value or of at least 95 percent nulls left out. Phi compares
    the nulls of columns that have some and are not all null. Equal strengths rank by names.
    """
    if numeric is None or categories is None:
        s = semantic_types(df).join(P.column_counts(df).select("column_name", "distinct_count", "missing_ratio"), "column_name").where("distinct_count > 1 and missing_ratio < 0.95")
        kind = {r["column_name"]: r["semantic_type"] for r in s.collect()}
        types = dict(df.dtypes)
        numeric = [c for c in df.columns if kind.get(c) in AS_NUMBERS and C.is_numeric(types[c])] if numeric is None else numeric
        categories = [c for c in df.columns if kind.get(c) in AS_CATEGORIES and c not in numeric] if categories is None else categories
    out = S.mixed_associations(df, numeric, categories)
    if len(df.columns) > 1:
        phi = S.missingness_phi(df, df.columns)
        out = out.unionByName(phi.select("a", "b", F.lit("phi_of_nulls").alias("method"), F.abs("phi").alias("strength")))
    order = [F.desc("strength"), F.col("a"), F.col("b"), F.col("method")]
    best = out.where("strength is not null").orderBy(*order).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "a", "b", "method", "strength")  # of at most `most` rows


def histogram_by(df: DataFrame, c: str, by: str | None = None, bins: int = 40, norm: str = "count") -> DataFrame:
    """by, bin, lo, hi, n, y: one set of equal-width bins for all groups; y is the count, or the share, percent or density within the group.

    Bins go from the least to the largest value of all groups, the last one closed; null and NaN are left out, null is a group of its
    own, and bins without a row have none. The density of a group integrates to 1; where all values are equal it is null.
    """
    if norm not in NORMS:
        raise ValueError(f"norm is one of {', '.join(NORMS)}")
    v = C.value(df, c).cast("double")
    x = df.select(*([F.col(by)] if by else []), v.alias("__v")).where("__v is not null")
    lo, hi = x.agg(F.min("__v"), F.max("__v")).first()
    width = ((hi or 0.0) - (lo or 0.0)) / bins
    slot = F.least(F.floor((F.col("__v") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int") if width else F.lit(0)
    keys = [by] if by else []
    n = x.groupBy(*keys, slot.alias("bin")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))  # a row a group and bin
    y = {"count": F.col("n").cast("double"), "probability": share, "percent": share * 100, "density": share / F.lit(width) if width else F.lit(None).cast("double")}[norm]
    start = F.lit(lo).cast("double")
    return n.select(*keys, "bin", (start + F.col("bin") * width).alias("lo"), (start + (F.col("bin") + 1) * width).alias("hi"), "n", y.alias("y"))


def points(df: DataFrame, key: str, dimensions: list[str], colour: str | None = None, kind: str = "scatter_matrix") -> DataFrame:
    """key, the dimensions and the colour of as many rows as the chart shows (ROW_CAPS), those of the least hashes of the key.

    For charts of any number of dimensions, the scatter matrix and parallel coordinates; their limit is the chart's own.
    """
    if kind not in ROW_CAPS or not dimensions:
        raise ValueError(f"kind is one of {', '.join(ROW_CAPS)}, with a dimension at least")
    cols = list(dict.fromkeys([key, *dimensions, *([colour] if colour else [])]))
    return C.hash_sample(df.select(*cols), ROW_CAPS[kind], key)


def outlier_table(df: DataFrame, cols: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """column_name, outliers, outlier_ratio, lower, upper, iqr, p01, p99, confidence: numbers beyond the fences of the interquartile range.

    Text that reads as numbers counts too; infinite values are left out of quantiles and shares. Without a spread of the middle
    half there are no fences and no outliers; a column without a number has a confidence of 0.
    """
    kinds = dict(df.dtypes)
    cols = C.columns_of(df, C.is_numeric) if cols is None else list(cols)
    shape = "column_name string, outliers bigint, outlier_ratio double, lower double, upper double, iqr double, p01 double, p99 double, confidence double"
    if not cols:
        return df.sparkSession.createDataFrame([], shape)
    x = df.select(*((C.value(df, c).cast("double") if C.is_numeric(kinds[c]) else C.to_number(F.col(c))).alias(c) for c in cols))
    x = x.select(*(F.when(F.abs(c) < F.lit(float("inf")), F.col(c)).alias(c) for c in cols))
    q = {r["column_name"]: r["q"] for r in exact_quantiles(x, cols, [0.01, 0.25, 0.75, 0.99]).collect()}
    facts = []
    for c in cols:
        low, a, b, high = q.get(c) or [None] * 4
        lo, hi = (a - factor * (b - a), b + factor * (b - a)) if a is not None and b > a else (None, None)
        out = F.count_if((F.col(c) < lo) | (F.col(c) > hi)) if lo is not None else F.lit(0).cast("bigint")
        spread = None if a is None else b - a
        facts.append(F.struct(F.lit(c).alias("column_name"), out.alias("outliers"), F.coalesce(F.try_divide(out, F.count(c)), F.lit(0.0)).alias("outlier_ratio"), *(F.lit(v).cast("double").alias(n) for n, v in (("lower", lo), ("upper", hi), ("iqr", spread), ("p01", low), ("p99", high))), F.count(c).alias("n")))
    row = x.agg(*(f.alias(f"s{i}") for i, f in enumerate(facts))).select(F.explode(F.array(*(f"s{i}" for i in range(len(facts))))).alias("x")).select("x.*")
    return row.withColumn("confidence", F.when(F.col("n") == 0, 0.0).when(F.col("outlier_ratio") >= 0.05, 0.78).otherwise(0.66)).drop("n")


def target_summary(df: DataFrame, target: str | None = None, sure: float = SURE_TARGET, limit: int = 25) -> DataFrame:
    """value, n, ratio, target, task, source, confidence, imbalance_ratio: the commonest values of the target, null included.

    Without a name the likeliest column is the target if its score reaches `sure`; else there is no row. Ratios are of the shown values'
    rows, at most `limit` of them (the report's own limit), imbalance_ratio is that of the commonest; equal counts go by value.
    """
    if target is not None and target not in df.columns:
        raise ValueError(f"there is no column {target}")
    found = (target, 0.99) if target else next(((r["column_name"], r["score"]) for r in target_candidates(df).orderBy(F.desc("score"), "column_name").take(1) if r["score"] >= sure), None)
    shape = "value string, n bigint, ratio double, target string, task string, source string, confidence double, imbalance_ratio double"
    if not found:
        return df.sparkSession.createDataFrame([], shape)
    name, score = found
    distinct = P.column_counts(df.select(name)).first()["distinct_count"]
    top = df.groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_last()).limit(limit)
    every = Window.partitionBy()  # of at most `limit` rows
    ratio = F.col("n") / F.sum("n").over(every)
    shown = top.select("value", "n", ratio.alias("ratio"))
    given = {"target": name, "task": infer_task(distinct, C.is_numeric(dict(df.dtypes)[name])), "source": "user" if target else "inferred", "confidence": float(score)}
    return shown.select("*", *(F.lit(v).alias(k) for k, v in given.items()), F.max("ratio").over(every).alias("imbalance_ratio"))
