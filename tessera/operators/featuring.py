"""Model features fitted on one table and applied to others: numbers, calendar parts, indicators with rare levels together, crosses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.ml.feature import Interaction, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.order import exact_quantiles
from tessera.operators.profile import value_counts

#: What a date column becomes.
CALENDAR = {"year": F.year, "month": F.month, "day": F.dayofmonth, "weekday": F.weekday}
#: The indicator that rare levels share, and the level that stands for nulls if they are not the commonest level.
RARE, GONE = "infrequent", "Missing"
SCALES = ("none", "standard", "minmax", "robust")


@dataclass(frozen=True)
class FeatureModel:
    """What fit_features() learned: values for nulls, shifts and widths of scales, levels, and the crosses to make."""

    numeric: list[str]
    dates: list[str]
    fill: dict[str, float]
    scale: dict[str, tuple[float, float]]
    levels: dict[str, list[str]]
    rare: frozenset[str]
    fill_level: dict[str, str]
    crosses: list[dict[str, int]]

    def lineage(self) -> list[tuple[str, list[str], str]]:
        """(feature, source columns, transform) in the order of the vector."""
        parts = {f"{c}_{p}": c for c in self.dates for p in CALENDAR}
        out = [(c, [c], "numeric") for c in self.numeric] + [(n, [c], "calendar") for n, c in parts.items()]
        out += [(f"{c}_{v}", [c], "one_hot") for c in self.levels for v in self.levels[c]]
        for powers in self.crosses:
            names = [""]
            for c, k in powers.items():
                ends = [f"{c}_{v}" for v in self.levels[c]] if c in self.levels else [c if k == 1 else f"{c}^{k}"]
                names = [f"{n} {e}".strip() for n in names for e in ends]
            out += [(n, list(dict.fromkeys(parts.get(c, c) for c in powers)), "polynomial_feature") for n in names]
        return out

    @property
    def names(self) -> list[str]:
        return [n for n, _, _ in self.lineage()]

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """df with the vector `output`, sparse where that is smaller; crosses only multiply what is not zero in a row."""
        of = {c: F.coalesce(x, F.lit(self.fill[c])) for c, x in numbers(df, self.numeric, self.dates).items()}
        for c, (shift, width) in self.scale.items():
            of[c] = (of[c] - F.lit(shift)) / F.lit(width) if width else F.lit(0.0)
        out = df.withColumns({f"__f_{c}": x for c, x in of.items()})
        blocks, made = {c: f"__f_{c}" for c in of}, []
        for i, (c, levels) in enumerate(self.levels.items()):
            v = F.coalesce(F.col(c).cast("string"), F.lit(self.fill_level[c]))
            own = levels[:-1] if c in self.rare else levels
            tests = [v == level for level in own] + ([~v.isin(*own)] if c in self.rare else [])
            out = out.withColumns({f"__l_{i}_{j}": t.cast("double") for j, t in enumerate(tests)})
            out = VectorAssembler(inputCols=[f"__l_{i}_{j}" for j in range(len(tests))], outputCol=f"__f_{c}").transform(out)
            blocks[c] = f"__f_{c}"
        for i, powers in enumerate(self.crosses):
            scalars = [(c, k) for c, k in powers.items() if c not in self.levels]
            sets = [blocks[c] for c in powers if c in self.levels]
            if scalars:
                out = out.withColumn(f"__s_{i}", reduce(lambda a, b: a * b, (F.col(blocks[c]) for c, k in scalars for _ in range(k))))
                sets = [f"__s_{i}", *sets]
            if len(sets) > 1:
                out = Interaction(inputCols=sets, outputCol=f"__c_{i}").transform(out)
            made.append(f"__c_{i}" if len(sets) > 1 else sets[0])
        out = VectorAssembler(inputCols=[*blocks.values(), *made], outputCol=output).transform(out)
        return out.select(*df.columns, output)


def numbers(df: DataFrame, numeric: list[str], dates: list[str]) -> dict[str, Column]:
    """Columns that are numbers, and calendar parts of dates or of text that reads as one; NaN and what does not parse are null."""
    kinds = dict(df.dtypes)
    out = {c: (C.value(df, c).cast("double") if C.is_numeric(kinds[c]) or kinds[c] == "boolean" else C.to_number(F.col(c))) for c in numeric}
    for c in dates:
        at = F.col(c) if C.is_time(kinds[c]) else C.to_time(F.col(c))
        out |= {f"{c}_{p}": part(at).cast("double") for p, part in CALENDAR.items()}
    return out


def common_levels(df: DataFrame, cols: list[str], most: int) -> dict[str, tuple[list[str], str | None, bool]]:
    """column -> (levels in order, commonest level, whether levels are left out): of more than `most` levels, the most - 1 commonest.

    Levels are counted over all rows; of equal counts the later level by code points counts as the commoner one, and the first
    as the commonest of all. At most `most` + 1 rows a column reach the driver.
    """
    counted = value_counts(df, cols)
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.desc("value"))
    top = counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most + 1).collect()
    first = {r["column_name"]: r["v"] for r in counted.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("v")).collect()}
    out = {}
    for c in cols:
        found = [r["value"] for r in sorted((r for r in top if r["column_name"] == c), key=lambda r: r["r"])]
        out[c] = (sorted(found if len(found) <= most else found[: most - 1]), first.get(c), len(found) > most)
    return out


def fit_features(
    df: DataFrame, numeric: list[str], categories: list[str] = (), dates: list[str] = (), fill: str = "median", fill_level: str = "most_frequent", max_levels: int = 30, scale: str = "none", degree: int = 1, interaction_only: bool = False
) -> FeatureModel:
    """Learns the features of df over all its rows.

    Nulls of numbers and calendar parts become the exact median or the mean, 0 where a column has no value; nulls of categories the
    commonest level, or with fill_level="constant" the level Missing. A category of more than max_levels levels has indicators
    of the max_levels - 1 commonest and one for the rest; without a rest, an unknown level sets no indicator. Scales (standard,
    minmax, robust) come before crosses. With a degree over 1 all products of up to that many columns follow, with
    interaction_only those of different columns; products that are 0 in every row or repeat another feature (of levels of
    one column) are left out. An empty df gives zeros and no level.
    """
    if scale not in SCALES or fill not in ("median", "mean") or degree < 1 or max_levels < 2:
        raise ValueError(f"scale is one of {', '.join(SCALES)}, fill median or mean, degree at least 1, max_levels at least 2")
    numeric, categories, dates = list(numeric), list(categories), list(dates)
    of = numbers(df, numeric, dates)
    if clash := sorted({c for c in [*of, *categories] if [*of, *categories].count(c) > 1} | {c for c in numeric if c in [f"{d}_{p}" for d in dates for p in CALENDAR]}):
        raise ValueError(f"two features would be named {', '.join(clash)}")
    bare = df.select(*(x.alias(c) for c, x in of.items()))
    if fill == "mean":
        means = bare.agg(*(F.avg(c).alias(c) for c in of)).first().asDict() if of else {}
        values = {c: float(means[c] or 0.0) for c in of}
    else:
        values = _quantiles(bare, list(of), [0.5])
        values = {c: float(q[0]) if q else 0.0 for c, q in values.items()}
    full = bare.select(*(F.coalesce(F.col(c), F.lit(values[c])).alias(c) for c in of))
    found, levels, rare, of_null = {}, {}, set(), {}
    if categories:
        text = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit(GONE if fill_level == "constant" else None).cast("string")).alias(c) for c in categories))
        found = common_levels(text, categories, max_levels)
    for c, (own, first, more) in found.items():
        levels[c] = [*own, RARE] if more else own
        of_null[c] = GONE if fill_level == "constant" else first or GONE
        if more:
            rare.add(c)
    levels = {c: v for c, v in levels.items() if v}
    blocks, crosses = [*of, *levels], []
    for k in range(2, degree + 1):
        for some in combinations_with_replacement(blocks, k):
            powers = {c: some.count(c) for c in some}
            if all(n == 1 or not interaction_only and c not in levels for c, n in powers.items()):
                crosses.append(powers)
    return FeatureModel(numeric, dates, values, _scales(full, list(of), scale), levels, frozenset(rare), of_null, crosses)


def _quantiles(df: DataFrame, cols: list[str], at: list[float]) -> dict[str, list[float] | None]:
    got = {r["column_name"]: r["q"] for r in exact_quantiles(df, cols, at).collect()} if cols else {}
    return {c: got.get(c) or None for c in cols}


def _scales(df: DataFrame, cols: list[str], how: str) -> dict[str, tuple[float, float]]:
    """column -> (shift, width): mean and population deviation, minimum and range, or median and interquartile range."""
    if how == "none" or not cols:
        return {}
    if how == "robust":
        return {c: (q[1], q[2] - q[0]) if q else (0.0, 0.0) for c, q in _quantiles(df, cols, [0.25, 0.5, 0.75]).items()}
    both = {"standard": lambda c: F.struct(F.avg(c).alias("a"), F.stddev_pop(c).alias("b")), "minmax": lambda c: F.struct(F.min(c).alias("a"), (F.max(c) - F.min(c)).alias("b"))}[how]
    row = df.agg(*(both(c).alias(c) for c in cols)).first()
    return {c: (row[c]["a"] or 0.0, row[c]["b"] or 0.0) for c in cols}


def fit_on(df: DataFrame, features: FeatureModel, estimator: str, task: str):
    """A model of `label` on the features; apply it to features.transform(other)."""
    from tessera.operators.modeling import ESTIMATORS

    return ESTIMATORS[estimator, task]().fit(features.transform(df))


def feature_table(df: DataFrame, features: FeatureModel) -> DataFrame:
    """feature, rows, total: in how many rows each feature is not zero, and its sum."""
    from pyspark.ml.functions import vector_to_array

    names = F.lit(features.names)
    long = features.transform(df).select(F.posexplode(vector_to_array("features")).alias("i", "x")).where("x <> 0")
    return long.groupBy("i").agg(F.count("*").alias("rows"), F.sum("x").alias("total")).select(F.element_at(names, F.col("i") + 1).alias("feature"), "rows", "total")
