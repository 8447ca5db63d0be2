"""Semantic types, binary columns, targets and issues: rules over small profile tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import profile as P
from tessera.operators.order import exact_quantiles

# What column names suggest, whatever their case.
ID_NAME = r"(^id$|_id$|^id_|uuid|guid|key$|_key$)"
TIME_NAME = r"(date|time|timestamp|_ts$|created|updated)"
AMOUNT_NAME = r"(amount|revenue|sales|price|cost|spend|charge|payment|total|balance)"
PERCENT_NAME = r"(percent|percentage|pct|rate|ratio|share|probability|score)"
OUTCOME_NAME = r"(target|label|outcome|class|churn|default|fraud|converted|conversion|response|sold_price|sale_price|sale_amount|days_on_market|^dom$|^y$)"
POSTAL_NAME = r"(zip|zipcode|postal|postcode)"
GEO_NAME = r"(lat|latitude|lon|lng|longitude|geo|coord|city|state|country|county|tract)"
FLAG_NAME = r"(is_|has_|had_|can_|should_|flag|indicator|opt_in)"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
URL = r"^https?://"


def name_rules(names: list[str]) -> dict[str, list[str]]:
    """Which name patterns each column name fits."""
    rules = {"id": ID_NAME, "time": TIME_NAME, "amount": AMOUNT_NAME, "percentage": PERCENT_NAME, "outcome": OUTCOME_NAME, "postal": POSTAL_NAME, "geo": GEO_NAME}
    return {n: [k for k, p in rules.items() if re.search(p, n.lower())] for n in names}


def column_facts(df: DataFrame) -> DataFrame:
    """value_facts() with what the rules ask: shares of text that read as something, and the range of numbers."""
    v, n = F.col("value"), F.col("n")
    share = lambda test, of=None: F.try_divide(F.sum(F.when(test, n).otherwise(0)), F.sum(n if of is None else F.when(of, n)))
    text = lambda m: lambda kind: m if kind == "string" else None
    number = lambda m: lambda kind: m if C.is_numeric(kind) else None
    x = v.cast("double")
    return P.value_facts(
        df,
        {
            "num": text(share(C.to_number(v, "").isNotNull())), "date": text(share(C.to_time(v).isNotNull())), "email": text(share(v.rlike(EMAIL))), "url": text(share(v.rlike(URL))), "json": text(share(v.rlike(r"^\s*[\[{]"))),
            "mean_len": text(F.sum(F.length(v) * n) / F.sum(n)), "max_len": text(F.max(F.length(v))), "missing_like": text(F.sum(F.when(C.missing_like(v), n))),
            "int_share": number(share(x == F.floor(x))), "lo": number(F.min(x)), "hi": number(F.max(x)), "zero_ratio": number(share(x == 0, F.abs(x) < F.lit(float("inf")))),
        },
    )


def semantic_types(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """column_name, semantic_type, confidence, hypotheses, role: the most confident of the ranked hypotheses.

    All measures come from column_facts(), worked out here if not given; the rules are expressions over its few rows.
    """
    kinds, facts = dict(df.dtypes), (column_facts(df) if facts is None else facts).withColumnRenamed("distinct_count", "distinct")
    names = name_rules(df.columns)
    marks = F.create_map(*(x for n in df.columns for x in (F.lit(n), F.array(*map(F.lit, names[n])).cast("array<string>"))))
    types = F.create_map(*(x for n in df.columns for x in (F.lit(n), F.lit("number" if C.is_numeric(kinds[n]) else "time" if C.is_time(kinds[n]) else kinds[n]))))
    f = facts.withColumn("names", marks[F.col("column_name")]).withColumn("kind", types[F.col("column_name")])
    named = lambda x: F.array_contains("names", x)
    num, text = F.col("kind") == "number", F.col("kind") == "string"
    uniq = F.try_divide("distinct", "non_null")
    rules = [
        (F.col("distinct") <= 1, "constant", 1.0), (F.col("non_null") <= 0.05 * F.col("rows"), "mostly_missing", 0.95), ((F.col("distinct") == 2) & (F.col("non_null") == F.col("rows")), "binary", 0.98), (F.col("distinct") == 2, "nullable_binary", 0.94), (F.col("kind") == "time", "datetime", 0.99), (F.col("kind") == "boolean", "boolean", 0.99),
        (num & named("id") & (uniq > 0.75), "identifier", 0.94), (num & (uniq > 0.995) & (F.col("distinct") >= 20), "identifier", 0.74), (num & named("amount"), "amount", 0.88), (num & named("percentage"), "percentage", 0.82), (num & (F.col("int_share") > 0.98) & (F.col("distinct") <= 25) & (uniq < 0.2), "numeric_discrete", 0.78), (num & (F.col("lo") >= 0) & (F.col("hi") <= 1), "proportion", 0.8), (num & named("geo"), "geographic", 0.84), (num & named("amount") & (F.col("lo") >= 0), "nonnegative_amount", 0.72), (num, "numeric", 0.72),
        (text & (F.col("date") >= 0.92), "datetime-like", 0.9), (text & named("time") & (F.col("date") >= 0.75), "datetime-like", 0.92), (text & (F.col("num") >= 0.9), "numeric-like", 0.86), (text & (F.col("email") >= 0.75), "email", 0.94), (text & (F.col("url") >= 0.75), "url", 0.93), (text & (F.col("json") >= 0.8), "json-like", 0.9), (text & ((F.col("mean_len") > 50) | (F.col("max_len") > 500)), "text", 0.84), (text & ((F.col("distinct") <= 50) | (uniq <= 0.2)), "category", 0.82), (text & (uniq > 0.95) & named("id"), "identifier", 0.9), (text, "string", 0.62),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(-conf).alias("k"), F.lit(name).alias("type"), F.lit(conf).alias("confidence"))) for test, name, conf in rules)))
    out = f.withColumn("h", F.array_sort(found)).withColumn("semantic_type", F.coalesce(F.get("h", F.lit(0))["type"], F.lit("unknown")))
    role = F.when(F.col("semantic_type") == "identifier", "id").when(F.col("semantic_type").isin("datetime", "datetime-like"), "timestamp").when(F.col("semantic_type").isin("constant", "mostly_missing"), "ignore_candidate").otherwise("feature")
    return out.select("column_name", "semantic_type", F.coalesce(F.get("h", F.lit(0))["confidence"], F.lit(0.0)).alias("confidence"), F.transform("h", lambda x: F.struct(x["type"].alias("type"), x["confidence"].alias("confidence"))).alias("hypotheses"), role.alias("role"))


def binary_profile(df: DataFrame, cols: list[str] | None = None, most: int = 5, facts: DataFrame | None = None) -> DataFrame:
    """column_name, kind, confidence, ambiguous, zero_value, one_value for columns that behave like a flag.

    Nulls count as one of at most `most` raw values, which read as yes, no, missing or something else. Columns of more
    values leave by their count, before any value is gathered.
    """
    cols = cols or df.columns
    counts = P.value_facts(df.select(*cols)) if facts is None else facts.where(F.col("column_name").isin(cols))
    few = [r[0] for r in counts.where(F.col("distinct_count") + (F.col("non_null") < F.col("rows")).cast("int") <= most).collect()]
    values = P.value_counts(df, few, nulls=True) if few else df.sparkSession.createDataFrame([], "column_name string, value string, n bigint")
    v = F.col("value")
    read = F.when(v.isNull() | C.missing_like(v), "missing").when(v.try_cast("double") == 1, "true").when(v.try_cast("double") == 0, "false").when(C.to_flag(v) == 1, "true").when(C.to_flag(v) == 0, "false").otherwise("other")
    t = values.withColumn("read", read)
    count = lambda x: F.count_if(F.col("read") == x)
    order = F.when(F.col("read") != "missing", F.struct((-F.col("n")).alias("n"), "value"))
    t = t.groupBy("column_name").agg(F.count("*").alias("k"), count("true").alias("yes"), count("false").alias("no"), count("missing").alias("gone"), count("other").alias("other"), F.max(F.when(F.col("read") == "true", v)).alias("one"), F.max(F.when(F.col("read") == "false", v)).alias("zero"), F.min(order).alias("first"), F.max(order).alias("last"))
    flag_name = F.col("column_name").rlike("(?i)" + FLAG_NAME)
    yes, no, gone, other = F.col("yes") > 0, F.col("no") > 0, F.col("gone") > 0, F.col("other") > 0
    states = F.col("yes") + F.col("no") + F.col("other")
    kinds = [
        (yes & no & ~gone & ~other, "clean_binary", F.lit(0.98)),
        (yes & no & ~other, "nullable_binary", F.lit(0.94)),
        (yes & ~no & ~other, "positive_only_nullable_flag", F.when(flag_name, 0.78).otherwise(0.64)),
        ((yes.cast("int") + no.cast("int") + other.cast("int") == 1) & (F.col("other") <= 1) & (F.col("k") <= 2) & (states > 0), "single_observed_binary_state", F.lit(0.55)),
        ((states == 2) & flag_name, "binary_flag", F.lit(0.82)),
        (states == 2, "binary_categorical", F.lit(0.72)),
    ]
    found = F.coalesce(*(F.when(test, F.struct(F.lit(kind).alias("kind"), conf.alias("confidence"))) for test, kind, conf in kinds))
    t = t.withColumn("found", found).where("found is not null").select("*", "found.*")
    unread = F.col("kind").isin("binary_flag", "binary_categorical")
    zero = F.when(unread, F.col("first")["value"]).when(F.col("kind") == "single_observed_binary_state", F.coalesce("zero", F.col("first")["value"])).otherwise(F.col("zero"))
    one = F.when(unread, F.col("last")["value"]).otherwise(F.col("one"))
    return t.select("column_name", "kind", "confidence", F.col("kind").isin("positive_only_nullable_flag", "single_observed_binary_state", "binary_categorical").alias("ambiguous"), zero.alias("zero_value"), one.alias("one_value"))


def infer_task(distinct: int, numeric: bool) -> str:
    return "binary_classification" if distinct == 2 else "multiclass_classification" if distinct <= 20 else "regression" if numeric else "unknown"


def target_candidates(df: DataFrame, target: str | None = None, least: float = 0.28) -> DataFrame:
    """column_name, score: how likely each column is what a model should predict; a given target always shows."""
    facts = column_facts(df)
    c = P.column_counts(df, facts).join(semantic_types(df, facts).select("column_name", "semantic_type"), "column_name")
    c = c.join(binary_profile(df, facts=facts).select("column_name", F.lit(True).alias("flag")), "column_name", "left")
    names, is_type = name_rules(df.columns), F.col("semantic_type").isin
    outcome = F.col("column_name").isin(*[n for n in df.columns if "outcome" in names[n]] or [""])
    last, given = F.col("column_name") == df.columns[-1], F.col("column_name") == F.lit(target or "")
    add = lambda test, x: F.when(test, F.lit(x)).otherwise(0.0)
    flag = F.coalesce("flag", F.lit(False)) | is_type("binary", "nullable_binary", "boolean")
    few = (F.col("distinct_count") <= 20) & (F.col("distinct_ratio") < 0.2)
    shape = F.when(flag, F.when(outcome | last | given, 0.18).otherwise(0.04)).when(few, F.when(outcome | last, 0.12).otherwise(0.02)).when(is_type("numeric", "amount"), F.when(outcome, 0.18).otherwise(0.05)).otherwise(0.0)
    missing = F.when(F.col("missing_ratio") <= 0.05, 0.10).when(F.col("missing_ratio") >= 0.5, -0.25).otherwise(0.0)
    score = F.lit(0.05) + add(given, 0.85) + add(outcome, 0.45) + add(last, 0.08) + shape + missing - add(is_type("email", "url", "postal_code"), 0.35)
    out = c.where(~is_type("identifier", "datetime", "datetime-like", "mostly_missing")).select("column_name", F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)), 4).alias("score"))
    return out.where((F.col("score") >= least) | given)


def time_candidates(df: DataFrame) -> DataFrame:
    """column_name, score: columns that hold times, or whose names say so."""
    names, facts = name_rules(df.columns), column_facts(df)
    s = semantic_types(df, facts).join(P.column_counts(df, facts).select("column_name", "missing_ratio"), "column_name")
    named = F.col("column_name").isin(*[n for n in df.columns if "time" in names[n]] or [""])
    kind = F.when(F.col("semantic_type") == "datetime", 0.5).when(F.col("semantic_type") == "datetime-like", 0.42)
    score = F.lit(0.2) + F.coalesce(kind, F.lit(0.0)) + F.when(named, 0.18).otherwise(0.0) + F.when(F.col("missing_ratio") <= 0.1, 0.08).otherwise(0.0)
    return s.where(kind.isNotNull() | named).select("column_name", F.round(F.least(F.lit(0.99), score), 4).alias("score"))


def target_profile(df: DataFrame, target: str, limit: int = 25) -> DataFrame:
    n = df.where(F.col(target).isNotNull()).count()
    return df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit).withColumn("ratio", F.col("n") / F.lit(n))


#: Rank of a severity, for order.
SEVERITY = {"error": 3, "warning": 2, "info": 1}
MEASURED = ("numeric", "amount", "nonnegative_amount", "numeric-like", "percentage", "proportion", "identifier")


def column_issues(df: DataFrame, target: str | None = None, facts: DataFrame | None = None) -> DataFrame:
    """column_name, found: the rules of one column each, over tables of a row per column."""
    facts = column_facts(df) if facts is None else facts
    nums = C.columns_of(df, C.is_numeric)
    c = P.column_counts(df, facts).join(facts.select("column_name", F.try_divide("top", "non_null").alias("dominant_share"), "missing_like", "zero_ratio"), "column_name")
    c = c.join(semantic_types(df, facts).select("column_name", "semantic_type"), "column_name")
    c = c.join(binary_profile(df, facts=facts).select("column_name", F.col("kind").alias("flag"), F.col("confidence").alias("flag_confidence"), "ambiguous"), "column_name", "left")
    c = c.join(measured_shares(df, nums, {r["column_name"]: r["lo"] for r in facts.collect()}), "column_name", "left")
    x, kind = F.col, F.col("semantic_type").isin
    measures, flag = kind(*MEASURED), x("flag").isNotNull()
    rules = [
        ("mostly_missing", "warning", F.lit(1.0), x("missing_ratio") >= 0.95, "missing_ratio"),
        ("high_missing", "warning", F.lit(1.0), (x("missing_ratio") >= 0.5) & (x("missing_ratio") < 0.95), "missing_ratio"),
        ("constant", "info", F.lit(1.0), (x("non_null") > 0) & (x("distinct_count") <= 1), "distinct_count"),
        ("near_constant", "info", F.lit(0.9), (x("distinct_count") > 1) & (x("dominant_share") >= 0.98), "dominant_share"),
        ("numeric_like_text", "info", F.lit(0.9), kind("numeric-like"), "distinct_count"),
        ("datetime_like_text", "info", F.lit(0.85), kind("datetime-like"), "distinct_count"),
        ("missing_like_tokens", "info", F.lit(0.9), x("missing_like") > 0, "missing_like"),
        ("two_categories", "info", x("flag_confidence"), x("flag") == "binary_categorical", "distinct_count"),
        ("ambiguous_flag", "warning", x("flag_confidence"), flag & x("ambiguous") & (x("flag") != "binary_categorical"), "distinct_count"),
        ("flag", "info", x("flag_confidence"), flag & ~x("ambiguous"), "distinct_count"),
        ("top_1pct_dominates", "warning", F.lit(0.8), measures & ~kind("identifier") & (x("top_share") >= 0.5), "top_share"),
        ("mostly_zero", "info", F.lit(0.85), measures & (x("zero_ratio") >= 0.8), "zero_ratio"),
        ("iqr_outliers", "info", F.lit(0.75), measures & (x("outlier_ratio") >= 0.05), "outlier_ratio"),
        ("duplicate_timestamps", "info", F.lit(0.85), kind("datetime", "datetime-like") & (x("distinct_count") < x("non_null")), "distinct_ratio"),
        ("high_cardinality", "info", F.lit(0.8), kind("category", "string", "email", "url", "postal_code") & (x("distinct_count") >= 50) & (x("distinct_ratio") >= 0.5), "distinct_ratio"),
        ("imbalanced_target", "warning", F.lit(0.9), (x("column_name") == F.lit(target or "")) & (x("dominant_share") >= 0.9), "dominant_share"),
    ]
    made = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"), conf.alias("confidence"), x(v).cast("double").alias("value"))) for n, s, conf, test, v in rules)))
    return c.select("column_name", F.explode(made).alias("f")).select("f.issue", "column_name", "f.severity", "f.confidence", "f.value")


def measured_shares(df: DataFrame, nums: list[str], least: dict[str, float | None]) -> DataFrame:
    """column_name, outlier_ratio, top_share (of the largest hundredth in the sum of what is not negative) of all numbers at once.

    The value at 0.99 lies between the neighbours of the largest hundredth's border: what is above it, and as many rows of the
    largest value up to it as the hundredth still lacks, is that hundredth. `least` tells which columns hold negative values.
    """
    if not nums:
        return df.sparkSession.createDataFrame([], "column_name string, outlier_ratio double, top_share double")
    kept = {c: F.when(C.value(df, c) >= 0, C.value(df, c)).cast("double") for c in nums}
    signed = [i for i, c in enumerate(nums) if least[c] is not None and least[c] < 0]
    made = df.select(*(F.col(c).alias(f"v{i}") for i, c in enumerate(nums)), *(kept[nums[i]].alias(f"k{i}") for i in signed))
    q = {r["column_name"]: r["q"] or [None] * 3 for r in exact_quantiles(made, made.columns, [0.25, 0.75, 0.99]).collect()}
    sums = []
    for i, c in enumerate(nums):
        (a, b, _), top, v = q[f"v{i}"], q[f"k{i}" if i in signed else f"v{i}"][2], kept[c]
        out = F.count_if((F.col(c) < a - 1.5 * (b - a)) | (F.col(c) > b + 1.5 * (b - a))) if a is not None and b > a else F.lit(0)
        top = float("inf") if top is None else top
        sums.append(F.struct(F.lit(c).alias("column_name"), F.try_divide(out, F.count(c)).alias("outlier_ratio"), F.count(v).alias("n"), F.sum(v).alias("total"), F.count_if(v > top).alias("above"), F.sum(F.when(v > top, v)).alias("largest"), F.max(F.when(v <= top, v)).alias("border")))
    found = df.agg(*(x.alias(f"s{i}") for i, x in enumerate(sums))).select(F.explode(F.array(*(f"s{i}" for i in range(len(sums))))).alias("x")).select("x.*")
    lacking = F.greatest(F.ceil(F.col("n") * 0.01) - F.col("above"), F.lit(0))
    return found.select("column_name", "outlier_ratio", F.try_divide(F.coalesce("largest", F.lit(0.0)) + F.coalesce(lacking * F.col("border"), F.lit(0.0)), "total").alias("top_share"))


def issues(df: DataFrame, target: str | None = None) -> DataFrame:
    """issue, column_name, severity, confidence, value: findings of the data-quality rules, the most severe and surest first."""
    if len(set(df.columns)) < len(df.columns):  # nothing else can be said of columns without names of their own
        names = sorted({n for n in df.columns if df.columns.count(n) > 1})
        return df.sparkSession.createDataFrame([("duplicate_names", n, "error", 1.0, float(df.columns.count(n))) for n in names], "issue string, column_name string, severity string, confidence double, value double")
    facts = column_facts(df)
    counts = facts.select("rows", "distinct_count").collect()
    rows = counts[0]["rows"]
    # a column without two equal values has no repeated rows
    apart = any(r["distinct_count"] == rows for r in counts)
    dup = (df.sparkSession.createDataFrame([], "duplicate_rows bigint") if apart else P.duplicate_rows(df)).where("duplicate_rows > 0").select(F.lit("duplicate_rows").alias("issue"), F.lit("*").alias("column_name"), F.when(F.col("duplicate_rows") >= 0.01 * rows, "warning").otherwise("info").alias("severity"), F.lit(1.0).alias("confidence"), F.col("duplicate_rows").cast("double").alias("value"))
    rank = F.create_map(*(F.lit(y) for pair in SEVERITY.items() for y in pair))
    return column_issues(df, target, facts).unionByName(dup).orderBy(rank[F.col("severity")].desc(), F.desc("confidence"), "issue", "column_name")


def insights(df: DataFrame, target: str | None = None) -> DataFrame:
    """insight, column_name, severity, confidence, message: each once, the most severe and surest first.

    The issues, the share of missing cells, each flag and its kind, the target (given, or the likeliest) and the likeliest
    time column, in words.
    """
    whole = P.dataset_summary(df).first()
    spark, kinds = df.sparkSession, "insight string, column_name string, severity string, confidence double, message string"
    i = issues(df, target)
    out = i.select(F.concat(F.lit("issue."), "issue").alias("insight"), "column_name", "severity", "confidence", F.concat_ws(" ", F.col("column_name"), F.lit("shows"), F.regexp_replace("issue", "_", " ")).alias("message"))
    facts = []
    if whole["missing_cells"]:
        facts.append(("missing_cells", "*", "warning" if whole["missing_ratio"] >= 0.2 else "info", 1.0, f"{100 * whole['missing_ratio']:.1f}% of cells are missing"))
    best = target_candidates(df, target).orderBy(F.desc("score"), "column_name").first()
    if target or best:
        facts.append(("target." + ("selected" if target else "candidate"), target or best["column_name"], "info", 0.95 if target else float(best["score"]), f"{target or best['column_name']} is {'the target' if target else 'the strongest target candidate'}"))
    if when := time_candidates(df).orderBy(F.desc("score"), "column_name").first():
        facts.append(("time.candidate", when["column_name"], "info", float(when["score"]), f"{when['column_name']} is the strongest time column"))
    out = out.unionByName(spark.createDataFrame(facts, kinds))
    flags = binary_profile(df)
    warn = F.when(F.col("ambiguous") & (F.col("kind") != "binary_categorical"), "warning").otherwise("info")
    out = out.unionByName(flags.select(F.lit("binary").alias("insight"), "column_name", warn.alias("severity"), "confidence", F.concat_ws(" ", F.col("column_name"), F.lit("looks like"), F.regexp_replace("kind", "_", " ")).alias("message")))
    rank = F.create_map(*(F.lit(y) for pair in SEVERITY.items() for y in pair))
    once = out.groupBy("insight", "column_name").agg(F.max_by(F.struct("severity", "confidence", "message"), "confidence").alias("x")).select("insight", "column_name", "x.*")
    return once.orderBy(rank[F.col("severity")].desc(), F.desc("confidence"), "insight", "column_name")


def quality_flags(df: DataFrame) -> DataFrame:
    c = P.column_counts(df).join(P.frequency_facts(df, df.columns), "column_name", "left")
    return c.select("column_name", (F.col("distinct_count") <= 1).alias("constant"), F.coalesce(F.col("dominant_share") >= 0.98, F.lit(False)).alias("near_constant"), ((F.col("distinct_count") >= 50) & F.coalesce(F.col("distinct_ratio") >= 0.5, F.lit(False))).alias("high_cardinality"))


def grain_keys(df: DataFrame) -> DataFrame:
    """Columns that are unique and without nulls."""
    return P.column_counts(df).where("missing = 0 and distinct_count = non_null and non_null > 0").select("column_name", F.when(F.col("column_name").rlike("(?i)" + ID_NAME), 0.95).otherwise(0.75).alias("confidence"))


#: Semantic types that a shape counts as one kind of column.
KINDS = {"times": ("datetime", "datetime-like"), "nums": ("numeric", "amount", "numeric-like", "percentage", "proportion"), "ids": ("identifier",), "texts": ("text",), "geo": ("geographic", "postal_code"), "nested": ("json-like",), "amounts": ("amount",)}


def shape_hypotheses(df: DataFrame, target: str | None = None) -> DataFrame:
    """shape, confidence, evidence (the columns that speak for it): all ten shapes that names, semantic types and sizes can show."""
    facts = column_facts(df)
    s = semantic_types(df, facts).join(P.column_counts(df, facts).select("column_name", "missing_ratio", (F.col("non_null") + F.col("missing")).alias("rows")), "column_name")
    in_order = lambda k: F.filter(F.lit(df.columns), lambda c: F.array_contains(F.col(k), c))
    member = {k: F.col("semantic_type").isin(*types) for k, types in KINDS.items()}
    member["geo"] |= F.lower("column_name").isin("lat", "latitude", "lon", "lng", "longitude")
    # One row a column, so that the gathered lists are as long as the table is wide.
    found = s.agg(*(F.collect_set(F.when(test, F.col("column_name"))).alias(k) for k, test in member.items()), F.count("*").alias("wide"), F.max("rows").alias("rows"), F.max("missing_ratio").alias("emptiest"))
    found = found.withColumns({k: in_order(k) for k in KINDS})
    has = lambda k: F.size(k) > 0
    both = lambda a, b: F.concat(F.slice(a, 1, 3), F.slice(b, 1, 3))
    nothing = F.array().cast("array<string>")
    known = F.lit(target in df.columns)
    rules = [
        ("dataframe", F.lit(True), F.lit(1.0), nothing),
        ("time_series", has("times") & has("nums"), F.when(F.size("times") == 1, 0.72).otherwise(0.62), both("times", "nums")),
        ("event_log", has("times") & has("ids"), F.lit(0.82), both("times", "ids")),
        ("transaction_table", has("times") & has("amounts"), F.lit(0.72), both("times", "amounts")),
        ("targeted_modeling_table", known, F.lit(0.85), F.array(F.lit(target or ""))),
        ("feature_matrix", (F.col("wide") >= 10) & (F.size("nums") >= 0.5 * F.col("wide")), F.lit(0.72), F.slice("nums", 1, 3)),
        ("wide_sparse_matrix", (F.col("wide") > F.greatest("rows", F.lit(1))) | ((F.col("wide") >= 20) & (F.col("emptiest") > 0.5)), F.lit(0.68), nothing),
        ("text_corpus", has("texts"), F.lit(0.65), F.slice("texts", 1, 3)),
        ("geospatial_points", has("geo"), F.lit(0.66), F.slice("geo", 1, 5)),
        ("nested_records", has("nested"), F.lit(0.7), F.slice("nested", 1, 3)),
    ]
    made = F.array_compact(F.array(*(F.when(t, F.struct(F.lit(n).alias("shape"), c.cast("double").alias("confidence"), e.alias("evidence"))) for n, t, c, e in rules)))
    return found.select(F.explode(made).alias("x")).select("x.*")


def column_flags(df: DataFrame) -> DataFrame:
    """column_name, constant, near_constant, missing_like, iqr_outliers, high_cardinality: all five flags; identifiers and amounts may have many values."""
    text, nums = C.columns_of(df, lambda k: k == "string"), C.columns_of(df, C.is_numeric)
    c = P.column_counts(df).join(P.frequency_facts(df, df.columns).select("column_name", "dominant_share"), "column_name", "left").join(semantic_types(df).select("column_name", "semantic_type"), "column_name")
    none = df.sparkSession.createDataFrame([], "column_name string, x double")
    likes = P.missing_like_tokens(df, text).groupBy("column_name").agg(F.sum("n").alias("words")) if text else none.withColumnRenamed("x", "words")
    outside = P.iqr_outliers(df, nums).select("column_name", "outlier_ratio") if nums else none.withColumnRenamed("x", "outlier_ratio")
    c = c.join(likes, "column_name", "left").join(outside, "column_name", "left")
    sure = lambda test: F.coalesce(test, F.lit(False))
    return c.select(
        "column_name", ((F.col("distinct_count") <= 1) & (F.col("non_null") > 0)).alias("constant"), sure((F.col("distinct_count") > 1) & (F.col("dominant_share") >= 0.98)).alias("near_constant"), sure(F.col("words") > 0).alias("missing_like"), sure(F.col("outlier_ratio") >= 0.01).alias("iqr_outliers"),
        sure((F.col("distinct_count") >= 50) & (F.col("distinct_ratio") >= 0.5) & ~F.col("semantic_type").isin("identifier", "numeric", "amount")).alias("high_cardinality"),
    )
