"""Lenses: missingness, cadence, concentration, associations and target-aware splits, each in a fixed number of jobs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import profile as P
from tessera.operators.order import average_ranks, exact_quantiles, frequencies, grouped_quantiles, quantiles_of, range_of, top_amount, with_lag, with_running


def missingness(df: DataFrame) -> DataFrame:
    return P.per_column(df, df.columns, {"missing": lambda c: F.count_if(c.isNull()), "missing_ratio": lambda c: F.avg(c.isNull().cast("int"))})


def row_missingness(df: DataFrame) -> DataFrame:
    n = sum((C.value(df, c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.agg(F.min(n).alias("min_missing"), F.max(n).alias("max_missing"), F.avg(n).alias("mean_missing"))


def missingness_matrix(df: DataFrame, key: str, rows: int = 250) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    s = C.hash_sample(df, rows, key).select(F.col(key).alias("row_id"), *(C.value(df, c).isNull().cast("int").alias(c) for c in cols))
    return s.unpivot("row_id", cols, "column_name", "missing")


def missingness_phi(df: DataFrame, cols: list[str]) -> DataFrame:
    """Phi of all pairs of null masks from one aggregate."""
    mask = {c: C.value(df, c).isNull().cast("double") for c in cols}
    return _pairs(df, cols, lambda a, b: _pearson(mask[a], mask[b]), "phi").where("phi is not null")


def _pearson(x: Column, y: Column) -> Column:
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.when((F.min(u) < F.max(u)) & (F.min(v) < F.max(v)), F.try_divide(F.covar_pop(u, v), F.stddev_pop(u) * F.stddev_pop(v)))


def _pairs(df: DataFrame, cols: list[str], f, name: str) -> DataFrame:
    pairs = list(combinations(cols, 2))
    row = df.agg(*(f(a, b).alias(f"s{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{i}").alias(name)) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def pearson_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pairwise-complete correlations of all pairs, from one aggregate; null where a column is constant."""
    cols = cols or C.columns_of(df, C.is_numeric)
    return _pairs(df, cols, lambda a, b: _pearson(C.value(df, a), C.value(df, b)), "r")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks over pairwise-complete rows: the grid of value pairs meets the ranks, not the rows."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    grid = both.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    ra, rb = average_ranks(both, a).toDF("x", "rx"), average_ranks(both, b).toDF("y", "ry")
    middle = F.lit((both.count() + 1) / 2.0)
    part = lambda u, v: F.sum(F.col("n") * (F.col(u) - middle) * (F.col(v) - middle))
    return grid.join(ra, "x").join(rb, "y").agg(F.try_divide(part("rx", "ry"), F.sqrt(part("rx", "rx")) * F.sqrt(part("ry", "ry"))).alias("rho"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """tau-b without comparing pairs: the ranks of two values first differ at one bit, above which they are the same prefix.

    Each cell of the grid of value pairs counts once for each pair of bits of its two dense ranks; cells that share both
    prefixes are concordant where both bits differ alike. That is one grouping, with partial sums, and no join of the grid with itself.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    g = both.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").cast("double").alias("n"))
    bits = [max(1, int(k - 1).bit_length()) for k in g.agg(F.count_distinct("x"), F.count_distinct("y")).first()]
    dense = lambda c, name: with_running(frequencies(both, c, name), name, {"rank": F.lit(1)}).select(name, (F.col("rank") - 1).alias(f"r{name}"))
    cells = g.join(dense(a, "x"), "x").join(dense(b, "y"), "y")
    for r, name, k in (("rx", "i", bits[0]), ("ry", "j", bits[1])):
        cells = cells.withColumn(name, F.explode(F.array(*map(F.lit, range(k))))).withColumns({f"{r}_above": F.expr(f"shiftright({r}, {name} + 1)"), f"{r}_bit": F.expr(f"shiftright({r}, {name}) & 1")})
    at = lambda x, y: F.sum(F.when((F.col("rx_bit") == x) & (F.col("ry_bit") == y), F.col("n")).otherwise(0.0)).alias(f"n{x}{y}")
    s = cells.groupBy("i", "j", "rx_above", "ry_above").agg(at(0, 0), at(1, 1), at(0, 1), at(1, 0)).agg(F.sum(F.expr("n00 * n11 - n01 * n10")).alias("s"))
    ties = lambda c: g.groupBy(c).agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"tie_{c}"))
    n = g.agg((F.sum("n") * (F.sum("n") - 1) / 2).alias("pairs"))
    return s.crossJoin(ties("x")).crossJoin(ties("y")).crossJoin(n).select(F.try_divide("s", F.sqrt((F.col("pairs") - F.col("tie_x")) * (F.col("pairs") - F.col("tie_y")))).alias("tau"))


def eta_squared(df: DataFrame, numeric: str, category: str) -> DataFrame:
    """Share of variance between groups: no sums of squares of raw values, which cancel."""
    both = df.where(F.col(numeric).isNotNull() & F.col(category).isNotNull())
    g = both.groupBy(category).agg(F.count("*").alias("n"), F.avg(numeric).alias("m"), F.var_pop(numeric).alias("v"))
    within = F.sum(F.col("n") * F.col("v"))
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2))
    mean = g.agg(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n"))).first()[0]
    return g.withColumn("mean", F.lit(mean).cast("double")).agg(F.try_divide(between, between + within).alias("eta_squared"))


def correlation_ratio(df: DataFrame, numeric: str, category: str) -> DataFrame:
    return eta_squared(df, numeric, category).select(F.sqrt("eta_squared").alias("eta"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """From the counts of occurring cells: chi2 = n * (sum o^2 / (row * column) - 1)."""
    g = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("o"))
    g = g.withColumn("r", F.sum("o").over(Window.partitionBy(a))).withColumn("c", F.sum("o").over(Window.partitionBy(b)))
    t = g.agg((F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))) - 1).alias("phi2"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    return t.select(F.sqrt(F.greatest(F.lit(0.0), F.try_divide("phi2", F.least("ka", "kb") - 1))).alias("v"))


def mixed_associations(df: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """a, b, method, strength for all pairs: |r|, eta squared, Cramér's V; one batch per kind of pair."""
    spark = df.sparkSession
    out = pearson_matrix(df, numeric).select("a", "b", F.lit("pearson").alias("method"), F.abs("r").alias("strength")) if len(numeric) > 1 else spark.createDataFrame([], "a string, b string, method string, strength double")
    if numeric and categories:
        long = df.select(*(F.col(c).cast("double").alias(c) for c in numeric), *(F.col(c).cast("string").alias(c) for c in categories)).unpivot(numeric, categories, "b", "level")
        s = long.where("level is not null").groupBy("b", "level").agg(*(F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(c) for c in numeric)).unpivot(["b", "level"], numeric, "a", "s")
        s = s.select("a", "b", "s.*").where("n > 0")
        w = Window.partitionBy("a", "b")
        s = s.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)).groupBy("a", "b").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
        out = out.unionByName(s.select("a", "b", F.lit("eta_squared").alias("method"), F.try_divide("between", F.col("between") + F.col("within")).alias("strength")))
    if len(categories) > 1:
        pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in combinations(categories, 2)))
        g = df.select(F.explode(pairs).alias("p")).select("p.*").where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count("*").cast("double").alias("o"))
        g = g.withColumn("r", F.sum("o").over(Window.partitionBy("a", "b", "x"))).withColumn("c", F.sum("o").over(Window.partitionBy("a", "b", "y")))
        t = g.groupBy("a", "b").agg((F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))) - 1).alias("phi2"), F.count_distinct("x").alias("ka"), F.count_distinct("y").alias("kb"))
        out = out.unionByName(t.select("a", "b", F.lit("cramers_v").alias("method"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide("phi2", F.least("ka", "kb") - 1))).alias("strength")))
    return out


def time_cadence(df: DataFrame, ts: str) -> DataFrame:
    """Gaps between sorted timestamps in seconds: min, median, max, mean, 95th percentile, count above it, duplicates, span."""
    g = gaps(df, ts)
    q, middle = quantiles_of(g, "gap", [0.95, 0.5])
    return g.agg(F.min("gap").alias("min_gap"), F.lit(middle).cast("double").alias("median_gap"), F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"), F.lit(q).cast("double").alias("p95_gap"), F.count_if(F.col("gap") > F.lit(q)).alias("large_gaps"), F.count_if(F.col("gap") == 0).alias("duplicates"), F.sum("gap").alias("span"))


def gaps(df: DataFrame, ts: str, entity: str | None = None) -> DataFrame:
    """(at, gap) in global order, or (entity, at, gap) in each entity's order."""
    x = df.where(F.col(ts).isNotNull()).select(*([entity] if entity else []), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"))
    if entity:
        return x.withColumn("gap", F.col("at") - F.lag("at").over(Window.partitionBy(entity).orderBy("at"))).where("gap is not null")
    return with_lag(x, "at", "at").select("at", (F.col("at") - F.col("previous")).alias("gap")).where("gap is not null")


def lorenz(df: DataFrame, c: str) -> DataFrame:
    """Gini and the shares of the top 1, 5 and 10 percent of non-negative values, from one running count of frequencies."""
    kept = df.where(F.col(c) >= 0)
    n, total = kept.agg(F.count(c), F.sum(F.col(c).cast("double"))).first()
    run = with_running(frequencies(kept, c), "v", {"upto": F.col("n")})
    ranks = (F.col("upto") * 2 - F.col("n") + 1) * F.col("n") / 2.0  # sum of the ranks of a run of equal values
    tops = [F.try_divide(x, F.lit(total)).alias(f"top{p}_share") for x, p in zip(top_amount((0.01, 0.05, 0.10), n), (1, 5, 10))]
    return run.agg((2 * F.sum(ranks * F.col("v")) / F.lit(float(n) * float(total or 0) or None).cast("double") - F.lit((n + 1) / (n or 1))).alias("gini"), *tops)


def lorenz_curve(df: DataFrame, c: str) -> DataFrame:
    """Cumulative share of rows and of the amount, at each distinct value."""
    f = frequencies(df.where(F.col(c) >= 0), c)
    n, total = f.agg(F.sum("n"), F.sum(F.col("v") * F.col("n"))).first()
    return with_running(f, "v", {"rows": F.col("n"), "amount": F.col("v") * F.col("n")}).select((F.col("rows") / F.lit(float(n))).alias("row_share"), (F.col("amount") / F.lit(float(total))).alias("amount_share"))


def top_share(df: DataFrame, c: str, share: float = 0.01) -> DataFrame:
    kept = df.where(F.col(c) >= 0)
    n, total = kept.agg(F.count(c), F.sum(F.col(c).cast("double"))).first()
    return with_running(frequencies(kept, c), "v", {"upto": F.col("n")}).agg(F.try_divide(top_amount((share,), n)[0], F.lit(total)).alias("share"))


#: Rows of a series that one window holds.
STRETCH = 1 << 20


def autocorrelation(df: DataFrame, order_by: str, c: str, lags: int = 10) -> DataFrame:
    """lag, r: the correlation of the series of non-null values with itself 1..lags rows earlier.

    Rows are numbered by ranges of the order and cut into stretches; each stretch also holds the last `lags` rows of the one
    before, and one window per stretch gives all earlier values. Rows are neither joined nor repeated once for each lag.
    """
    x = with_running(df.where(F.col(c).isNotNull()).select(F.col(order_by), F.col(c).alias("y")), order_by, {"i": F.lit(1)}).select("y", (F.col("i") - 1).alias("i"))
    size = max(STRETCH, lags)
    own = F.floor(F.col("i") / size)
    halo = x.where(F.col("i") % size >= size - lags).select("y", "i", (own + 1).alias("stretch"), F.lit(True).alias("halo"))
    both = x.select("y", "i", own.alias("stretch"), F.lit(False).alias("halo")).unionByName(halo)
    w = Window.partitionBy("stretch").orderBy("i")
    seen = both.withColumns({f"lag{k}": F.lag("y", k).over(w) for k in range(1, lags + 1)}).where("not halo")
    row = seen.agg(*(_pearson(F.col(f"lag{k}"), F.col("y")).alias(f"r{k}") for k in range(1, lags + 1)))
    pairs = F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in range(1, lags + 1)))
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def target_balance(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(F.col(target).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))


def top_levels(df: DataFrame, cols: list[str], k: int = 20) -> dict[str, list[str]]:
    """The k commonest values, as text, of each column; of equally common ones the smaller."""
    out: dict[str, list[str]] = {c: [] for c in cols}
    if cols:
        long = df.select(*(F.col(c).cast("string").alias(c) for c in cols)).unpivot([], cols, "feature", "level").where("level is not null")
        w = Window.partitionBy("feature").orderBy(F.desc("n"), "level")
        best = long.groupBy("feature", "level").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
        for r in sorted(best.collect(), key=lambda r: r["r"]):
            out[r["feature"]].append(r["level"])
    return out


def numeric_target_associations(df: DataFrame, target: str, numeric: list[str], categories: list[str], levels: int = 20) -> DataFrame:
    """feature, method, strength with a numeric target: |r|, or the spread of its medians over the commonest levels by its IQR.

    The medians of all levels are one call of exact quantiles over the target split by level. Features of fewer than two levels are left out.
    """
    rows = df.where(F.col(target).isNotNull())
    parts = [(c, level) for c, found in top_levels(rows, categories, levels).items() if len(found) > 1 for level in found]
    split = rows.select(F.col(target).cast("double").alias("all"), *(F.when(F.col(c).cast("string") == level, F.col(target)).cast("double").alias(f"m{i}") for i, (c, level) in enumerate(parts)))
    found = {r["column_name"]: r["q"] for r in exact_quantiles(split, split.columns, [0.25, 0.5, 0.75]).collect()}
    scale = (found["all"][2] - found["all"][0] if found["all"] else 0.0) or 1.0
    medians: dict[str, list[float]] = {}
    for i, (c, _) in enumerate(parts):
        medians.setdefault(c, []).append(found[f"m{i}"][1])
    spreads = [(c, "median_spread", (max(m) - min(m)) / scale) for c, m in medians.items()]
    out = df.sparkSession.createDataFrame(spreads, "feature string, method string, strength double")
    if numeric:
        pearson = rows.agg(*(F.abs(_pearson(F.col(c), F.col(target))).alias(c) for c in numeric)).unpivot([], numeric, "feature", "strength")
        out = out.unionByName(pearson.select("feature", F.lit("pearson").alias("method"), "strength"))
    return out


def target_associations(df: DataFrame, target: str, numeric: list[str], categories: list[str]) -> DataFrame:
    """Strength with a class target: spread of the medians over the target's IQR scale, or spread of row shares.

    A target of a numeric type is taken as a number: see numeric_target_associations.
    """
    if C.is_numeric(dict(df.dtypes)[target]):
        return numeric_target_associations(df, target, numeric, categories)
    out = None
    if numeric:
        q = {r["column_name"]: (r["p75"] - r["p25"]) or 1.0 for r in P.quantiles11(df, numeric).collect()}
        m = grouped_quantiles(df.where(F.col(target).isNotNull()), [target], numeric, [0.5]).select(*(F.col(c)[0].alias(c) for c in numeric))
        s = m.agg(*((F.max(c) - F.min(c)).alias(c) for c in numeric)).unpivot([], numeric, "feature", "spread")
        scale = F.create_map(*(F.lit(x) for c in numeric for x in (c, q[c])))
        out = s.select("feature", F.lit("median_spread").alias("method"), (F.col("spread") / scale[F.col("feature")]).alias("strength"))
    if categories:
        long = df.select(F.col(target).cast("string").alias("t"), *(F.col(c).cast("string").alias(c) for c in categories if c != target)).unpivot("t", [c for c in categories if c != target], "feature", "level")
        g = long.where("t is not null and level is not null").groupBy("feature", "level", "t").agg(F.count("*").alias("n"))
        g = g.groupBy("feature", "level").agg((F.max("n") / F.sum("n")).alias("top"))
        g = g.groupBy("feature").agg((F.max("top") - F.min("top")).alias("strength")).select("feature", F.lit("share_spread").alias("method"), "strength")
        out = g if out is None else out.unionByName(g)
    return out


def target_best_splits(df: DataFrame, target: str, numeric: list[str], categories: list[str] = (), thresholds: int = 16, levels: int = 20, min_leaf: int = 5, regression: bool = False) -> DataFrame:
    """feature, kind, threshold, level, gain: the best two-way split of each feature, by bits for a class target or by variance.

    Numeric features are cut at quantiles from 5 to 95 percent, text features into one of the commonest levels and the
    rest. Rows are counted once by the slot between cuts, or level; candidates then meet those few counts, not rows.
    """
    rows, features = df.where(F.col(target).isNotNull()), [*numeric, *categories]
    m = max(3, thresholds)
    cuts = {r["column_name"]: sorted(set(r["q"] or [])) for r in exact_quantiles(rows, list(numeric), [0.05 + 0.9 * i / (m - 1) for i in range(m)]).collect()} if numeric else {}
    names = top_levels(rows, list(categories), levels)
    slot = [F.when(F.col(c).isNotNull(), range_of(F.col(c).cast("double"), cuts[c])).cast("int").alias(c) for c in numeric]
    slot += [(F.array_position(F.array(*map(F.lit, names[c])).cast("array<string>"), F.col(c).cast("string")) - 1).cast("int").alias(c) for c in categories]
    center = (rows.agg(F.avg(target)).first()[0] or 0.0) if regression else None
    t = (F.col(target).cast("double") - F.lit(float(center))) if regression else F.col(target).cast("string")
    long = rows.select(t.alias("t"), *slot).unpivot("t", features, "feature", "slot").where("slot is not null")
    options = [(c, "numeric_threshold", k, v, None) for c in numeric for k, v in enumerate(cuts[c])] + [(c, "category_one_vs_rest", k, None, v) for c in categories for k, v in enumerate(names[c])]
    options = df.sparkSession.createDataFrame(options, "feature string, kind string, k int, threshold double, level string")
    left = F.when(F.col("kind") == "numeric_threshold", F.col("slot") <= F.col("k")).otherwise(F.col("slot") == F.col("k")).alias("left")
    n = F.col("n")
    if regression:
        parent = rows.agg(F.var_pop(target)).first()[0]
        cells = long.groupBy("feature", "slot").agg(F.count("*").alias("n"), F.avg("t").alias("m"), F.var_pop("t").alias("v"))
        impurity = F.sum(n * (F.col("v") + F.col("m") * F.col("m"))) / F.sum(n) - F.pow(F.sum(n * F.col("m")) / F.sum(n), 2)
        sides = cells.join(options, "feature").groupBy("feature", "k", left)
    else:
        bits = lambda: F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)
        parent = rows.groupBy(target).agg(F.count("*").alias("n")).agg(bits()).first()[0]
        cells = long.groupBy("feature", "slot", "t").agg(F.count("*").alias("n"))
        impurity = bits()
        sides = cells.join(options, "feature").groupBy("feature", "k", left, "t").agg(F.sum("n").alias("n")).groupBy("feature", "k", "left")
    sides = sides.agg(F.sum(n).alias("size"), impurity.alias("impurity"))
    tried = sides.groupBy("feature", "k").agg(F.count("*").alias("sides"), F.min("size").alias("least"), (F.sum(F.col("size") * F.col("impurity")) / F.sum("size")).alias("child"))
    tried = tried.where((F.col("sides") == 2) & (F.col("least") >= min_leaf)).withColumn("gain", F.greatest(F.lit(0.0), F.lit(parent).cast("double") - F.col("child")))
    order = F.struct(-F.round(F.col("gain") / F.lit(parent or 1.0), 12), "k")
    best = tried.groupBy("feature").agg(F.min_by("k", order).alias("k"), F.max("gain").alias("gain"))
    return best.join(options, ["feature", "k"]).select("feature", "kind", "threshold", "level", "gain")


def qq_points(df: DataFrame, c: str) -> DataFrame:
    """Values against normal quantiles (i - .5) / n, by Acklam's rational approximation as column arithmetic."""
    n = df.where(F.col(c).isNotNull()).count()
    run = with_running(frequencies(df, c), "v", {"upto": F.col("n")})
    p = (F.col("upto") - F.col("n") / 2.0) / F.lit(float(n))
    return run.select(F.col("v").alias("value"), probit(p).alias("normal"))


# Acklam's coefficients for the inverse normal distribution.
PROBIT = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def probit(p: Column) -> Column:
    a, b, c, d = PROBIT

    def poly(xs, x):
        out = F.lit(xs[0])
        for k in xs[1:]:
            out = out * x + F.lit(k)
        return out

    q = p - 0.5
    tail = lambda x: poly(c, F.sqrt(-2 * F.log(x))) / poly(d, F.sqrt(-2 * F.log(x)))
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(poly(a, q * q) * q / poly(b, q * q))


def text_lengths(df: DataFrame, c: str) -> DataFrame:
    return P.string_metrics(df.select(c), [c])


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Schema hash and an order-free content hash."""
    import hashlib
    import json

    schema = hashlib.sha256(json.dumps(df.dtypes).encode()).hexdigest()
    return df.agg(F.lit(schema).alias("schema_hash"), F.count("*").alias("rows"), F.bit_xor(F.conv(F.substring(C.hash_order(df.columns), 1, 15), 16, 10).cast("bigint")).alias("content_hash"))
