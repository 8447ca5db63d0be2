"""Saved views: search, filters, sorts, column choice; and the row filters that charts use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C


def global_search(df: DataFrame, text: str) -> DataFrame:
    """Rows with the text, in any case, in any column."""
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False)) for c in df.columns)))


def blank(c: str) -> Column:
    return F.col(c).isNull() | (C.strip(F.col(c).cast("string")) == "")


def filter_empty(df: DataFrame, c: str) -> DataFrame:
    return df.where(blank(c))


def filter_not_empty(df: DataFrame, c: str) -> DataFrame:
    return df.where(~blank(c))


def _number(df: DataFrame, c: str) -> Column:
    return F.col(c) if C.is_numeric(dict(df.dtypes)[c]) else C.to_number(F.col(c), "")


def filter_numeric(df: DataFrame, c: str, lo=None, hi=None) -> DataFrame:
    x = _number(df, c)
    return df.where((x >= lo if lo is not None else F.lit(True)) & (x <= hi if hi is not None else F.lit(True)) & x.isNotNull())


def filter_datetime(df: DataFrame, c: str, lo=None, hi=None) -> DataFrame:
    x = F.col(c) if C.is_time(dict(df.dtypes)[c]) else C.to_time(F.col(c))
    at = lambda v: F.to_timestamp_ntz(F.lit(v))
    return df.where((x >= at(lo) if lo else F.lit(True)) & (x <= at(hi) if hi else F.lit(True)) & x.isNotNull())


def filter_text(df: DataFrame, c: str, text: str, how: str = "contains") -> DataFrame:
    x, text = F.lower(F.col(c).cast("string")), text.lower()
    return df.where({"contains": x.contains(text), "equals": x == text, "starts": x.startswith(text)}[how])


def filter_op(df: DataFrame, c: str, op: str, value=None, upper=None) -> DataFrame:
    """One chart filter; numbers and times compare as such, the rest as text."""
    kind = dict(df.dtypes)[c]
    x = F.col(c) if C.is_numeric(kind) or C.is_time(kind) else F.col(c).cast("string")
    v = (lambda y: float(y)) if C.is_numeric(kind) else (lambda y: F.to_timestamp_ntz(F.lit(y))) if C.is_time(kind) else str
    text = F.lower(F.col(c).cast("string"))
    tests = {
        "not_empty": lambda: ~blank(c), "empty": lambda: blank(c), "equals": lambda: x == v(value), "not_equals": lambda: x.isNull() | (x != v(value)), "contains": lambda: text.contains(str(value).lower()), "not_contains": lambda: ~F.coalesce(text.contains(str(value).lower()), F.lit(False)),
        "greater": lambda: x > v(value), "greater_equal": lambda: x >= v(value), "less": lambda: x < v(value), "less_equal": lambda: x <= v(value), "between": lambda: x.between(v(value), v(upper)), "in": lambda: x.isin(*[v(y.strip()) for y in str(value).split(",")]),
    }
    return df.where(tests[op]())


def range_clip(df: DataFrame, c: str, lo=None, hi=None) -> DataFrame:
    return df if lo is None and hi is None else filter_numeric(df, c, lo, hi)


def select_order(df: DataFrame, hidden: list[str] = (), order: list[str] = ()) -> DataFrame:
    shown = [c for c in df.columns if c not in hidden]
    return df.select(*[c for c in order if c in shown], *[c for c in shown if c not in order])


def sort_multi(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Mixed directions, nulls last."""
    return df.orderBy(*(F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in keys))


def apply_view(df: DataFrame, view: dict) -> DataFrame:
    """search, filters, sorts, hidden and order of a saved view, in that order."""
    out = global_search(df, view["search"]) if view.get("search") else df
    for f in view.get("filters", ()):
        out = filter_op(out, f["column"], f["op"], f.get("value"), f.get("upper"))
    out = sort_multi(out, view["sorts"]) if view.get("sorts") else out
    return select_order(out, view.get("hidden", ()), view.get("order", ()))


def view_summary(df: DataFrame, view: dict) -> DataFrame:
    out = apply_view(df, {k: v for k, v in view.items() if k != "sorts"})
    one = df.agg(F.count("*").alias("rows_before"), F.lit(len(df.columns)).cast("bigint").alias("columns_before"))
    return one.crossJoin(out.agg(F.count("*").alias("rows_after"), F.lit(len(out.columns)).cast("bigint").alias("columns_after"))).withColumn("row_ratio", F.try_divide("rows_after", "rows_before"))


def validate_spec(df: DataFrame, spec: dict, required: list[str]) -> None:
    """Raises before any job where a binding is missing or names no column."""
    for r in required:
        if not spec.get(r):
            raise ValueError(f"{spec.get('kind')} needs {r}")
    for k in ("x", "y", "color", "facet", "weight", "target"):
        if spec.get(k) and spec[k] not in df.columns:
            raise ValueError(f"no column {spec[k]}")
