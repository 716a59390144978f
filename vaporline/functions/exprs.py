"""Scalar expressions that several operators share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_WORDS = ("null", "nan", "none")
#: Other names of the semantic datatypes (fixed values).
DATATYPE_ALIASES = {
    "numeric": ("numeric", "number", "float", "double", "int", "integer", "continuous"),
    "binary": ("binary", "bool", "boolean"),
    "categorical": ("categorical", "category", "discrete", "enum", "state"),
    "high_cardinality": ("high_cardinality", "text", "string"),
    "constant": ("constant", "const"),
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(text: Column | str) -> Column:
    """Null, empty, or one of the words that stand for null."""
    t = col(text)
    return t.isNull() | (t == "") | F.lower(t).isin(*NULL_WORDS)


def as_number(text: Column | str) -> Column:
    """The number that a text is, else null; NaN is none."""
    n = col(text).try_cast("double")
    return F.when(~F.isnan(n), n)


def ratio(above: Column, below: Column, otherwise: float | None = None) -> Column:
    """Division that gives null, or a stated value, where the divisor is 0."""
    out = F.try_divide(above, below)
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def datatype(name: Column | str) -> Column:
    """The semantic datatype that a name stands for, unknown if none."""
    plain = F.regexp_replace(F.lower(F.trim(col(name))), r"[-\s]+", "_")
    out = F.lit("unknown")
    for kind, names in DATATYPE_ALIASES.items():
        out = F.when(plain.isin(*names), F.lit(kind)).otherwise(out)
    return out


def empty_map(key: str, value: str) -> Column:
    return F.create_map().cast(f"map<{key},{value}>")


def empty_array(of: str) -> Column:
    return F.array().cast(f"array<{of}>")


def sorted_map_json(m: Column | str) -> Column:
    """A map as JSON in key order, so that equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(m)))))


def column_or(df, name: str, default, kind: str) -> Column:
    """A column if the frame has it, with a default for nulls, else the default."""
    value = F.lit(default).cast(kind)
    return F.coalesce(F.col(name).cast(kind), value) if name in df.columns else value


def severity(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 6, "high").when(s >= 3, "medium").when(s > 1, "low").otherwise("normal")


def dwell_bucket(ms: Column | str) -> Column:
    d = col(ms)
    return F.when(d < 1_000, "<1s").when(d < 5_000, "1-5s").when(d < 30_000, "5-30s").otherwise(">=30s")


def positive_deviation(x: Column, center: Column, spread: Column) -> Column:
    return F.greatest(F.lit(0.0), (x - center) / F.greatest(spread, F.lit(1e-6)))


def absolute_deviation(x: Column, center: Column, spread: Column) -> Column:
    return F.abs(x - center) / F.greatest(spread, F.lit(1e-6))


def weighted(weights: Mapping[str, float]) -> Column:
    """The weighted sum of columns, null ones as 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.coalesce(F.col(name), F.lit(0.0))
    return total


def millis(ts: Column | str) -> Column:
    return F.unix_millis(col(ts))
