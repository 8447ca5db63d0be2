"""Global order without a one-partition window: range buckets, their totals, and a window inside each bucket."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from operator import and_, or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_of(v: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below v, by halving: plain comparisons that Spark compiles."""
    def between(lo: int, hi: int) -> Column:
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(v <= F.lit(bounds[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))

    return F.when(v.isNull(), 0).otherwise(between(0, len(bounds)))


#: Rows that a range is to hold at most, and how many ranges there are at least and at most.
PER_RANGE, RANGES, MOST_RANGES = 4_000_000, 64, 8_192


def bounds_of(df: DataFrame, cols: list[str], buckets: int = RANGES) -> dict[str, list]:
    """Sorted bounds between ranges of about equally many rows of each column: approximate percentiles, more of them for more rows."""
    def near(k: int) -> list[Column]:
        return [F.percentile_approx(c, [i / k for i in range(1, k)], max(2_000, 10 * k)).alias(f"b{i}") for i, c in enumerate(cols)]

    row = df.agg(*near(buckets), F.count("*").alias("n")).first()
    grown = min(MOST_RANGES, row["n"] // PER_RANGE)
    if grown > buckets:
        row = df.agg(*near(grown)).first()
    return {c: sorted(set(row[i] or [])) for i, c in enumerate(cols)}


def with_ranges(df: DataFrame, bounds: dict[str, list], names: dict[str, str]) -> DataFrame:
    """df with a range number names[c] for each column c of bounds, growing with its values; 0 for null.

    Few bounds are plain comparisons, that Spark compiles; many are searched by halving in Spark's bucketizer.
    """
    kinds = dict(df.dtypes)
    many = [c for c, b in bounds.items() if len(b) > 4 * RANGES and (kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint"))]
    df = df.withColumns({names[c]: range_of(F.col(c), b) for c, b in bounds.items() if c not in many})
    for c in many:
        cut = Bucketizer(splits=[-float("inf"), *map(float, bounds[c]), float("inf")], inputCol="__cut", outputCol=names[c], handleInvalid="keep")
        df = cut.transform(df.withColumn("__cut", F.col(c).cast("double"))).drop("__cut").withColumn(names[c], F.when(F.col(c).isNull(), 0).otherwise(F.col(names[c]).cast("int")))
    return df


def bucketed(df: DataFrame, by: str, buckets: int = RANGES) -> DataFrame:
    """df with __bucket, growing with `by`: between approximate percentiles of it."""
    return with_ranges(df, bounds_of(df, [by], buckets), {by: "__bucket"})


def with_running(df: DataFrame, by: str, sums: dict[str, Column], tie: list[str] | None = None, buckets: int = RANGES) -> DataFrame:
    """df with a running sum, over the order of `by` and tie, for each of sums(name -> column).

    The totals of the buckets, a few rows, are summed up on the driver and looked up again by bucket.
    """
    cut = bucketed(df, by, buckets)
    totals = sorted(tuple(r) for r in cut.groupBy("__bucket").agg(*(F.sum(c).alias(f"__total_{n}") for n, c in sums.items())).collect())
    inside = Window.partitionBy("__bucket").orderBy(by, *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)
    out = cut
    for k, (n, c) in enumerate(sums.items(), 1):
        before = dict(zip((r[0] for r in totals), accumulate((r[k] or 0 for r in totals), initial=0)))
        offset = F.get(F.array(*(F.lit(before.get(i)) for i in range(max(before) + 1))), F.col("__bucket")) if totals else F.lit(0)
        out = out.withColumn(n, F.sum(c).over(inside) + offset)
    return out.drop("__bucket")


def with_lag(df: DataFrame, by: str, of: str, name: str = "previous", tie: list[str] | None = None, buckets: int = RANGES) -> DataFrame:
    """df with the value of `of` one row earlier in the order of `by`, carried over bucket borders."""
    cut = bucketed(df, by, buckets)
    keys = [by, *(tie or [])]
    last = sorted((r["__bucket"], r["__last"]) for r in cut.groupBy("__bucket").agg(F.max_by(of, F.struct(*keys)).alias("__last")).collect())
    kind = df.schema[of].dataType
    pairs = [F.lit(x) if i == 0 else F.lit(x).cast(kind) for (b, _), (_, v) in zip(last[1:], last) for i, x in enumerate((b, v))]
    carry = F.create_map(*pairs)[F.col("__bucket")] if pairs else F.lit(None).cast(kind)
    w = Window.partitionBy("__bucket").orderBy(*keys)
    return cut.withColumn(name, F.when(F.row_number().over(w) == 1, carry).otherwise(F.lag(of).over(w))).drop("__bucket")


def with_filled(df: DataFrame, by: str, c: str, tie: list[str] | None = None, backward: bool = False, buckets: int = RANGES) -> DataFrame:
    """df with nulls of c filled by the last value before them in the order of `by` (backward: the next one), over bucket borders."""
    cut = bucketed(df, by, buckets)
    keys = [by, *(tie or [])]
    edge = (F.min_by if backward else F.max_by)(c, F.when(F.col(c).isNotNull(), F.struct(*keys)))
    edges = sorted(((r[0], r[1]) for r in cut.groupBy("__bucket").agg(edge).collect()), key=lambda r: r[0], reverse=backward)
    kind, held, pairs = df.schema[c].dataType, None, []
    for bucket, value in edges:
        pairs += [F.lit(bucket), F.lit(held).cast(kind)]
        held = held if value is None else value
    outside = F.create_map(*pairs)[F.col("__bucket")] if pairs else F.lit(None).cast(kind)
    # backward is the last value in the reversed order: a frame up to the end would be worked out anew for each row
    w = Window.partitionBy("__bucket").orderBy(*(F.col(k).desc() if backward else F.col(k) for k in keys)).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn(c, F.coalesce(F.last(c, True).over(w), outside)).drop("__bucket")


def with_filled_groups(df: DataFrame, by: list[str], order_by: str, c: str, backward: bool = False, buckets: int = RANGES) -> DataFrame:
    """df with nulls of c filled by the last value before them (backward: the next) in the group's order.

    Windows are over a group's rows of one range of the order, so that a group of most rows is many of them; what a range starts
    with is the last value of the group's ranges before, a table with a row for each group and range.
    """
    cut, order = bucketed(df, order_by, buckets), F.col(order_by)
    held = (F.min_by if backward else F.max_by)(c, F.when(F.col(c).isNotNull(), order))
    edges = cut.groupBy(*(F.col(x).alias(f"__g_{x}") for x in by), F.col("__bucket").alias("__at")).agg(held.alias("__held"))
    place = F.col("__at").desc() if backward else F.col("__at")
    before = Window.partitionBy(*(f"__g_{x}" for x in by)).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("__carried", F.last("__held", True).over(before)).drop("__held")
    same = reduce(and_, (F.col(x).eqNullSafe(F.col(f"__g_{x}")) for x in by)) & (F.col("__bucket") == F.col("__at"))
    w = Window.partitionBy(*by, "__bucket").orderBy(order.desc() if backward else order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(edges, same).withColumn(c, F.coalesce(F.last(c, True).over(w), "__carried")).select(*df.columns)


def frequencies(df: DataFrame, c: str, name: str = "v") -> DataFrame:
    """The value-frequency table of one column, without nulls: (v, n)."""
    return df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(name)).agg(F.count("*").alias("n"))


def average_ranks(df: DataFrame, c: str) -> DataFrame:
    """(v, rank): the average rank of each value, from frequencies and their running count."""
    run = with_running(frequencies(df, c), "v", {"upto": F.col("n")})
    return run.select("v", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float], buckets: int = RANGES) -> DataFrame:
    """column_name, q (one value for each of qs, between neighbours by their distance) for all columns; nulls and NaN are left out.

    Approximate percentiles deal the rows into ranges, whose sizes tell which ranges hold the wanted ranks. Only rows of
    those are counted by value and ordered, so that no task holds a column's values. An empty column has null q.
    """
    spark = df.sparkSession
    as_double = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols))
    near = bounds_of(as_double, cols, buckets)
    # numbered names, each range worked out once: the comparisons of many columns are a lot of code
    place = {c: F.col(f"__range{i}") for i, c in enumerate(cols)}
    ranged = with_ranges(as_double, near, {c: f"__range{i}" for i, c in enumerate(cols)})
    ranged = ranged.withColumns({f"__range{i}": F.when(F.col(c).isNotNull(), F.col(f"__range{i}")) for i, c in enumerate(cols)})
    sizes = ranged.select(*(place[c].alias(c) for c in cols)).unpivot([], cols, "column_name", "range").where("range is not null")
    parts: dict[str, dict[int, int]] = {c: {} for c in cols}
    for r in sizes.groupBy("column_name", "range").agg(F.count("*")).collect():
        parts[r[0]][r[1]] = r[2]
    held = []
    for c in cols:
        total, before, wanted, offsets = sum(parts[c].values()), 0, [], []
        ranks = {int(q * (total - 1)) + k for q in qs for k in (0, 1)}
        for at in range(max(parts[c], default=-1) + 1):
            m = parts[c].get(at, 0)
            offsets.append(before)
            if any(before <= k < before + m for k in ranks):
                wanted.append(at)
            before += m
        offset = F.get(F.array(*map(F.lit, offsets)).cast("array<bigint>"), place[c])
        held.append(F.when(F.col(c).isNotNull() & place[c].isin(wanted), F.struct(F.col(c).alias("v"), place[c].alias("range"), offset.alias("before"), F.lit(total).cast("bigint").alias("total"))).alias(c))
    freq = ranged.select(*held).unpivot([], cols, "column_name", "x").where("x is not null").groupBy("column_name", "x").agg(F.count("*").alias("n")).select("column_name", "x.*", "n")
    run = freq.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("column_name", "range").orderBy("v")))
    rank = {q: F.floor(F.lit(float(q)) * (F.col("total") - 1)) for q in qs}

    found = run.groupBy("column_name").agg(F.array(*(_between(q, rank[q]) for q in qs)).alias("q"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, cols))).alias("column_name"))
    return names.join(found, "column_name", "left")


def grouped_quantiles(df: DataFrame, by: list[str], cols: list[str], qs: list[float], buckets: int = RANGES) -> DataFrame:
    """by, and for each of cols an array of its exact quantiles within the group, between neighbours by their distance.

    Nulls and NaN are left out; a group without a value has null. Ranges of all rows' values are counted by group, combined
    before the shuffle; their running counts tell which ranges hold a group's wanted ranks. Only values of those are
    counted and ordered, so that a group of nearly all rows is spread over the ranges like all others.
    """
    group = F.struct(*(F.col(c).alias(f"g{i}") for i, c in enumerate(by))).alias("__group")
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]
    rows = df.select(group, *values)
    bounds = bounds_of(rows, [f"v{i}" for i in range(len(cols))], buckets)
    ranged = with_ranges(rows, bounds, {v: f"__range{v}" for v in bounds})
    pair = F.array(*(F.struct(F.lit(i).alias("c"), F.when(F.col(v).isNotNull(), F.col(f"__range{v}")).alias("range"), F.col(v).alias("v")) for i, v in enumerate(bounds)))
    long = ranged.select("__group", F.explode(pair).alias("x")).select("__group", "x.*")
    counts = long.groupBy("__group", "c", "range").agg(F.count("v").alias("m"))
    of = Window.partitionBy("__group", "c")
    placed = counts.withColumns({"total": F.sum("m").over(of), "upto": F.sum("m").over(of.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))})
    rank = {q: F.floor(F.lit(float(q)) * (F.col("total") - 1)) for q in qs}
    inside = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("m") <= k)
    wanted = placed.where("range is not null").where(reduce(or_, (inside(rank[q] + k) for q in qs for k in (0, 1))))
    wanted = wanted.select("__group", "c", "range", (F.col("upto") - F.col("m")).alias("before"), "total")
    held = long.where("v is not null").join(wanted, ["__group", "c", "range"]).groupBy("__group", "c", "range", "before", "total", "v").agg(F.count("*").alias("n"))
    run = held.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("__group", "c", "range").orderBy("v")))
    found = run.groupBy("__group", "c").agg(F.array(*(_between(q, rank[q]) for q in qs)).alias("q"))
    found = found.groupBy("__group").agg(*(F.max(F.when(F.col("c") == i, F.col("q"))).alias(f"q{i}") for i in range(len(cols))))
    groups = counts.select("__group").distinct()
    return groups.join(found, "__group", "left").select(*(F.col(f"__group.g{i}").alias(c) for i, c in enumerate(by)), *(F.col(f"q{i}").alias(c) for i, c in enumerate(cols)))


def _between(q: float, rank: Column) -> Column:
    """Over value counts with their running count `upto`: the value at q of `total` rows, between neighbours by their distance."""
    low, high = F.min(F.when(F.col("upto") > rank, F.col("v"))), F.min(F.when(F.col("upto") > rank + 1, F.col("v")))
    part = F.max(F.lit(float(q)) * (F.col("total") - 1) - rank)
    return F.when(high.isNull() | (part == 0), low).otherwise(low + (high - low) * part)


def quantiles_of(df: DataFrame, v: Column | str, qs: list[float]) -> list[float | None]:
    """The exact quantiles of one column or expression."""
    return exact_quantiles(df.select((F.col(v) if isinstance(v, str) else v).alias("v")), ["v"], qs).first()["q"] or [None] * len(qs)


def top_amount(shares: tuple[float, ...], n: int) -> list[Column]:
    """Over a running count `upto` of frequencies (v, n): the sums of the largest ceil(share * n) values."""
    inside = lambda k: F.greatest(F.lit(0), F.least(F.col("n"), F.col("upto") - F.lit(n - k)))
    return [F.sum(F.col("v") * inside(-int(-n * s // 1))) for s in shares]
