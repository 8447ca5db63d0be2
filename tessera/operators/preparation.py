"""Plans for model tables and reviews of single columns: proposals as rows, applied as chosen and with a person's settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import clean as K
from tessera.operators import profile as P
from tessera.operators.rules import binary_profile, column_facts, semantic_types

# Semantic types that count as numbers, may be scaled, or become indicators.
SCALABLE = ("numeric", "amount", "numeric-like", "percentage", "proportion")
NUMBERS = (*SCALABLE, "numeric_discrete")
CATEGORIES = ("category", "string", "binary", "nullable_binary", "boolean")
# Parts of names of what is divided, and by what.
WORTH = ("price", "value", "amount", "revenue", "sales", "cost", "tax", "income", "rent")
EXTENT = ("sqft", "square", "area", "acre", "lot", "unit", "count", "room", "bed", "bath", "size")
DATE_PARTS = "year,quarter,month,weekday,is_weekend"
PLAN = "id string, action string, column_name string, confidence double, by_default boolean, distinct_count bigint, controls map<string,string>"


def model_table_plan(df: DataFrame, target: str | None = None, max_categories: int = 20, scaling: bool = True, most_ratios: int = 8) -> DataFrame:
    """id, action, column_name, confidence, by_default, distinct_count, controls: what turns df into a table for a model of the target.

    The target is only to be reviewed. Identifiers, constants and nearly empty columns go; columns with nulls are filled with an
    indicator; categories of at most max_categories levels become indicators, dates calendar parts. Scales and ratios (an amount
    by an extent, as names tell; at most most_ratios, in column order) are proposed, but not applied unless chosen.
    """
    facts = column_facts(df)
    s = semantic_types(df, facts).join(P.column_counts(df, facts).select("column_name", "missing_ratio", "distinct_count"), "column_name")
    kind, own = F.col("semantic_type"), F.col("column_name") == F.lit(target or "")
    gone = kind.isin("identifier", "constant", "mostly_missing")
    settings = lambda **kw: F.create_map(*(x for k, v in kw.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))))
    rules = [
        ("review_target", own, F.lit(0.7), False, settings(task="")),
        ("drop_identifier", ~own & (kind == "identifier"), F.col("confidence"), True, None),
        ("drop_constant", ~own & kind.isin("constant", "mostly_missing"), F.lit(0.95), True, None),
        ("impute_missing", ~own & ~gone & (F.col("missing_ratio") > 0), F.lit(0.76), True, settings(strategy=F.when(kind.isin(*NUMBERS), "median").otherwise("mode"), add_indicator="true")),
        ("encode_one_hot", ~own & ~gone & kind.isin(*CATEGORIES) & (F.col("distinct_count") <= max_categories), F.lit(0.78), True, settings(max_categories=str(max_categories), drop_first="false", dummy_na="false")),
        ("add_date_features", ~own & ~gone & kind.isin("datetime", "datetime-like"), F.lit(0.82), True, settings(features=DATE_PARTS, drop_original="false")),
        ("scale_numeric", ~own & ~gone & kind.isin(*SCALABLE) & F.lit(scaling), F.lit(0.66), False, settings(method="standard")),
    ]
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    made = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(a).alias("action"), conf.alias("confidence"), F.lit(default).alias("by_default"), (none if controls is None else controls).alias("controls"))) for a, test, conf, default, controls in rules)))
    plan = s.select("column_name", "distinct_count", F.explode(made).alias("x")).select(F.concat_ws(":", "x.action", "column_name").alias("id"), "x.action", "column_name", "x.confidence", "x.by_default", "distinct_count", "x.controls")
    number = {r["column_name"]: r["semantic_type"] for r in s.where(kind.isin(*NUMBERS) & ~own).collect()}
    named = lambda parts: [c for c in df.columns if c in number and any(p in c.lower() for p in parts)]
    worth = [c for c in df.columns if number.get(c) == "amount" or c in named(WORTH)]
    pairs = [(a, b) for a in worth for b in named(EXTENT) if a != b][:most_ratios]
    ratios = [(f"add_ratio:{o}", "add_ratio", o, 0.64, False, None, {"numerator": a, "denominator": b, "output": o, "zero": "null"}) for a, b in pairs for o in [C.clean_name(f"{a}_per_{b}")]]
    return plan.unionByName(df.sparkSession.createDataFrame(ratios, PLAN))


def apply_model_table(df: DataFrame, plan: DataFrame, ids: list[str] | None = None, controls: dict[str, dict] | None = None) -> DataFrame:
    """df as the plan's default actions leave it, or as those of `ids` do; `controls` replaces settings by action id.

    In a fixed order: columns go, nulls are filled, ratios, calendar parts, indicators, scales. An action on a column that is no longer
    there does nothing; text that is to be filled by a median or scaled is read as numbers first. An unknown id raises.
    """
    rows = {r["id"]: r for r in plan.collect()}
    if unknown := sorted(({*(ids or ())} | {*(controls or ())}) - set(rows)):
        raise ValueError(f"the plan has no action {', '.join(unknown)}")
    chosen = sorted(r for r, row in rows.items() if (row["by_default"] if ids is None else r in ids))
    todo = [(rows[i], dict(rows[i]["controls"] or {}) | (controls or {}).get(i, {})) for i in chosen]
    of = lambda action, out: [(r["column_name"], c, r) for r, c in todo if r["action"] == action and r["column_name"] in out.columns]
    yes = lambda c, k, default=False: str(c.get(k, default)).lower() in ("true", "1", "yes")
    out = df.drop(*(r["column_name"] for r, _ in todo if r["action"].startswith("drop_")))
    fills = of("impute_missing", out)
    out = _as_numbers(out, [c for c, how, _ in fills if how["strategy"] in ("median", "mean")])
    out = K.add_missing_indicators(out, [c for c, how, _ in fills if yes(how, "add_indicator", True)], "_was_imputed")
    alike: dict[tuple, dict[str, str]] = {}
    for c, how, _ in fills:
        alike.setdefault((how.get("fill_value"), how.get("by")), {})[c] = how["strategy"]
    for (value, by), strategies in alike.items():
        out = K.impute_missing(out, strategies, value, by)
    for r, how in todo:
        if r["action"] == "add_ratio" and {how["numerator"], how["denominator"]} <= set(out.columns):
            out = K.add_ratio(_as_numbers(out, [how["numerator"], how["denominator"]]), how["numerator"], how["denominator"], how["output"], how["zero"])
    for c, how, _ in of("add_date_features", out):
        at = out if C.is_time(dict(out.dtypes)[c]) else out.withColumn(c, C.to_time(F.col(c)))
        out = K.add_date_features(at, c, tuple(how["features"].split(",")))
        out = out.drop(c) if yes(how, "drop_original") else out
    for c, how, r in of("encode_one_hot", out):
        most, filled = int(how["max_categories"]), any(c == x for x, _, _ in fills)
        out = K.one_hot_encode(out.withColumn(c, F.col(c).cast("string")), c, most if r["distinct_count"] + filled > most else None, drop_first=yes(how, "drop_first"), dummy_na=yes(how, "dummy_na"))
    by_method: dict[str, list[str]] = {}
    for c, how, _ in of("scale_numeric", out):
        by_method.setdefault(how["method"], []).append(c)
    for method, cols in by_method.items():
        out = K.scale_numeric(_as_numbers(out, cols), cols, method)
    return out


def _as_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: C.to_number(F.col(c)) for c in cols if kinds[c] == "string"})


# --- coordinates -----------------------------------------------------------------------------------------------
def is_latitude(name: str) -> bool:
    return name.lower() in ("lat", "latitude") or name.lower().endswith("_lat") or "latitude" in name.lower()


def is_longitude(name: str) -> bool:
    return name.lower() in ("lon", "lng", "long", "longitude") or name.lower().endswith(("_lon", "_lng", "_long")) or "longitude" in name.lower()


def coordinate_pairs(names: list[str]) -> list[tuple[str | None, str | None]]:
    """(latitude, longitude) columns told by name: those of one name but for lat and lon, else the first longitude; the rest alone."""
    lats, lons = [n for n in names if is_latitude(n)], [n for n in names if is_longitude(n)]
    pairs, used = [], set()
    for lat in lats:
        like = [lat.lower().replace(a, b) for a, b in (("latitude", "longitude"), ("_lat", "_lon"), ("lat", "lon"))]
        lon = next((n for x in like for n in lons if n.lower() == x), lons[0] if lons else None)
        pairs.append((lat, lon))
        used.add(lon)
    return pairs + [(None, lon) for lon in lons if lon not in used]


def coordinate_review(df: DataFrame) -> DataFrame:
    """column_name (`lat,lon` for a pair), invalid, likely_swapped, affected, confidence, and the ranges found, for all coordinate columns.

    A latitude is invalid beyond 90 degrees, a longitude beyond 180; a pair is likely swapped where only the latitude is too
    large and both would fit the other way round. Values that are no number count as none. All counts come from one aggregate.
    """
    shape = "column_name string, invalid bigint, likely_swapped bigint, affected bigint, confidence double, lat_min double, lat_max double, lon_min double, lon_max double"
    pairs = coordinate_pairs(df.columns)
    if not pairs:
        return df.sparkSession.createDataFrame([], shape)
    made = []
    for lat, lon in pairs:
        a, b = (_degrees(df, c) for c in (lat, lon))
        bad, swapped = _wrong(a, b)
        made.append(F.struct(
            F.lit(",".join(c for c in (lat, lon) if c)).alias("column_name"), F.count_if(bad).alias("invalid"), F.count_if(swapped).alias("likely_swapped"), F.count_if(bad | swapped).alias("affected"), F.lit(0.72 if lat and lon else 0.68).alias("confidence"),
            F.min(a).alias("lat_min"), F.max(a).alias("lat_max"), F.min(b).alias("lon_min"), F.max(b).alias("lon_max"),
        ))
    row = df.agg(*(m.alias(f"s{i}") for i, m in enumerate(made)))
    return row.select(F.explode(F.array(*(f"s{i}" for i in range(len(made))))).alias("x")).select("x.*").where("affected > 0")


def _degrees(df: DataFrame, c: str | None):
    if c is None:
        return F.lit(None).cast("double")
    return C.value(df, c).cast("double") if C.is_numeric(dict(df.dtypes)[c]) else C.to_number(F.col(c))


def _wrong(a, b):
    lat, lon = F.coalesce(F.abs(a), F.lit(0.0)), F.coalesce(F.abs(b), F.lit(0.0))
    return (lat > 90) | (lon > 180), (lat > 90) & (lat <= 180) & (lon <= 90) & b.isNotNull()


# --- what a person decides -------------------------------------------------------------------------------------
TREATMENTS = ("inspect", "add_indicator", "drop_rows", "fill_constant", "fill_missing_label", "fill_mean", "fill_median", "fill_mode", "forward_fill", "back_fill")


def treat_missing(df: DataFrame, c: str, treatment: str, value=None, order_by: str | None = None, indicator: bool = False, by: list[str] | None = None) -> DataFrame:
    """df after one treatment of the nulls of c; `inspect` changes nothing, and fills in a direction need order_by.

    With `indicator` a column <c>_was_missing is added as well. A mean or median of text reads it as numbers; a column without
    any value stays as it is, but for constants and the word Missing.
    """
    if treatment not in TREATMENTS:
        raise ValueError(f"unknown treatment {treatment!r}; known are {', '.join(TREATMENTS)}")
    if treatment == "inspect":
        return df
    out = K.add_missing_indicators(df, [c]) if indicator or treatment == "add_indicator" else df
    if treatment == "drop_rows":
        return out.where(C.value(out, c).isNotNull())
    if treatment in ("forward_fill", "back_fill"):
        if not order_by:
            raise ValueError(f"{treatment} needs order_by: rows of a table have no order of their own")
        return K.fill_forward(out, c, order_by, by, backward=treatment == "back_fill")
    how = {"fill_constant": "constant", "fill_missing_label": "missing", "fill_mean": "mean", "fill_median": "median", "fill_mode": "mode"}.get(treatment)
    if how in ("mean", "median"):
        out = _as_numbers(out, [c])
    return K.impute_missing(out, {c: how}, value) if how else out


def ambiguous_flags(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column_name, kind, confidence, affected, zero_value, one_value: columns that look like flags, but that a person must confirm."""
    facts = P.value_facts(df.select(*(cols or df.columns)))
    flags = binary_profile(df, cols, facts=facts).where("ambiguous")
    return flags.join(P.column_counts(df, facts).select("column_name", F.col("non_null").alias("affected")), "column_name").select("column_name", "kind", "confidence", "affected", "zero_value", "one_value")


def every_review(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """The rows of review_plan, and those of coordinates out of range or likely swapped and of flags whose reading is not sure."""
    more = coordinate_review(df).select(F.lit("geo_coordinate_review").alias("action"), "column_name", "affected", "confidence")
    flags = ambiguous_flags(df).select(F.lit("binary_mapping_review").alias("action"), "column_name", "affected", "confidence")
    return K.review_plan(df, factor).unionByName(more).unionByName(flags)


def apply_reviews(df: DataFrame, decisions: dict[str, dict]) -> DataFrame:
    """df after a person's decisions, `review:column` -> settings, in the order given.

    geo_coordinate_review (treatment: inspect, swap_likely, null_invalid), binary_mapping_review (mapping of raw values to 0 and 1,
    null: what nulls become), missing_value_review (as treat_missing), category_value_review (mapping, case_sensitive),
    numeric_outlier_review (method, treatment: flag, null, clip, drop). Other names raise.
    """
    out = df
    for name, how in decisions.items():
        review, _, c = name.partition(":")
        if review == "geo_coordinate_review":
            out = _treat_coordinates(out, c, how.get("treatment", "inspect"))
        elif review == "binary_mapping_review":
            to = F.create_map(*(x for k, v in how["mapping"].items() for x in (F.lit(str(k)), F.lit(int(v)))))
            out = out.withColumn(c, F.coalesce(to[F.col(c).cast("string")], F.when(F.col(c).isNull(), F.lit(how.get("null")).cast("int"))))
        elif review == "missing_value_review":
            out = treat_missing(out, c, **how)
        elif review == "category_value_review":
            out = K.map_values(out, c, how["mapping"], case_sensitive=how.get("case_sensitive", False))
        elif review == "numeric_outlier_review":
            out = K.clean_numeric_outliers(out, {c: (how.get("method", "iqr"), how.get("treatment", "flag"))})
        else:
            raise ValueError(f"no review is named {review}")
    return out


def _treat_coordinates(df: DataFrame, c: str, treatment: str) -> DataFrame:
    if treatment not in ("inspect", "swap_likely", "null_invalid"):
        raise ValueError(f"unknown treatment {treatment!r}")
    names = c.split(",")
    lat, lon = names if len(names) == 2 else (c, None) if is_latitude(c) else (None, c)
    a, b = (_degrees(df, x) for x in (lat, lon))
    bad, swapped = _wrong(a, b)
    if treatment == "swap_likely" and lat and lon:
        return df.withColumns({lat: F.when(swapped, F.col(lon)).otherwise(F.col(lat)), lon: F.when(swapped, F.col(lat)).otherwise(F.col(lon))})
    if treatment == "null_invalid":
        return df.withColumns({x: F.when(~bad, F.col(x)) for x in (lat, lon) if x})
    return df
