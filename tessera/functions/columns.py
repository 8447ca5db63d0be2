"""Column expressions shared by all operators: missing values, parsing, names, deterministic sampling."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: texts that mean "missing" (trimmed, lower case).
MISSING_TOKENS = ("", "na", "n/a", "nan", "none", "null", "nil", "missing", "unknown", "?", "-", "--")
# Words for yes and no.
TRUE_TOKENS = ("1", "true", "t", "yes", "y", "active", "enabled", "on", "success", "pass", "passed", "positive")
FALSE_TOKENS = ("0", "false", "f", "no", "n", "inactive", "disabled", "off", "failure", "fail", "failed", "negative")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: What any of the formats can read looks like this; other text is not tried.
DATE_LIKE = r"^(\d{4,}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}/\d{1,2}/\d{4,}|\p{L}{3,4}\.? \d{1,2} \d{4,})( \d{1,2}:\d{1,2}(:\d{1,2})?)?$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MMM d yyyy")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def is_time(kind: str) -> bool:
    return kind.startswith(("timestamp", "date"))


def columns_of(df: DataFrame, test) -> list[str]:
    return [c for c, kind in df.dtypes if test(kind)]


def value(df: DataFrame, c: str) -> Column:
    """The column with NaN as null."""
    return F.nanvl(F.col(c), F.lit(None).cast("double")) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)


def strip(c: Column) -> Column:
    """Without white space at both ends; all kinds of it, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def missing_like(c: Column, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    return F.lower(strip(c.cast("string"))).isin(*tokens)


def to_number(c: Column, symbols: str = "$,%") -> Column:
    """A number from text without grouping, currency and percent signs; else null."""
    bare = strip(F.translate(c.cast("string"), symbols, ""))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def to_time(c: Column, dayfirst: bool = False) -> Column:
    """A timestamp from text in any of the known formats, with or without a time; else null."""
    text = strip(c.cast("string"))
    formats = [f.replace("MM/dd", "dd/MM") if dayfirst else f for f in DATE_FORMATS]
    return F.when(text.rlike(DATE_LIKE), F.coalesce(*(F.try_to_timestamp(text, F.lit(f + t)) for f in formats for t in ("", " HH:mm:ss", " HH:mm"))))


def to_flag(c: Column) -> Column:
    """1, 0 or null from the usual words."""
    t = F.lower(strip(c.cast("string")))
    return F.when(t.isin(*TRUE_TOKENS), 1).when(t.isin(*FALSE_TOKENS), 0)


def clean_name(name: str, case: str = "lower", separator: str = "_", digit_prefix: str = "col_") -> str:
    """A column name of letters, digits and the separator."""
    out = re.sub(r"[^0-9A-Za-z]+", separator, name.strip()).strip(separator)
    out = {"lower": out.lower(), "upper": out.upper(), "title": out.title()}.get(case, out)
    return digit_prefix + out if out[:1].isdigit() else out


def clean_names(names: list[str], mapping: dict[str, str] | None = None, **kw) -> list[str]:
    """Cleaned names, made unique by _2, _3, ...; mapped names come first."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        new = (mapping or {}).get(name) or clean_name(name, **kw)
        seen[new] = seen.get(new, 0) + 1
        out.append(new if seen[new] == 1 else f"{new}_{seen[new]}")
    return out


def hash_sample(df: DataFrame, n: int, key: str | list[str], seed: int = 42) -> DataFrame:
    """n rows, the same in every run and partitioning: those with the least hash of key and seed; rows of one key go by their other columns."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c, kind in df.dtypes if c not in keys and not re.search("map<|variant|interval", kind)]
    return df.orderBy(hash_order(keys, seed), *keys, *rest).limit(n)


def hash_order(keys: list[str], seed: int = 42) -> Column:
    """An MD5 of key columns and seed: an order that any engine can repeat."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))).cast("binary"))


def hash_part(keys: list[str], parts: int, seed: int = 42) -> Column:
    """A part number below `parts` from 52 bits of hash_order()."""
    return F.pmod(F.conv(F.substring(hash_order(keys, seed), 1, 13), 16, 10).cast("bigint"), F.lit(parts))
