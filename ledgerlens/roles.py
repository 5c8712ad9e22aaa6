"""Column roles and input preparation.

Operators never guess at names: they take explicit roles.  ``detect_roles`` fills
them from the conventional names; ``prepare`` gives a projected frame in which a
missing value is always NULL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that a CSV reader treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_FEATURE = re.compile(r"^[Vv]\d+$")
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


@dataclass(frozen=True)
class Roles:
    """Which column plays which part."""

    time: str | None = None
    amount: str | None = None
    label: str | None = None
    features: tuple[str, ...] = ()


def numeric_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Integer, float and decimal columns; booleans are categorical."""
    skip = set(exclude)
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def categorical_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Every flat column that is not numeric."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema
        if not isinstance(f.dataType, (T.NumericType, *_NESTED)) and f.name not in skip
    ]


def feature_cols(df: DataFrame) -> list[str]:
    """Columns named V1, V2, … in either case."""
    return [c for c in df.columns if _FEATURE.match(c)]


def is_labelled_format(columns: Sequence[str]) -> bool:
    """True when the names cover time, amount, class and at least one V feature."""
    lowered = [c.lower() for c in columns]
    named = all(any(part in c for c in lowered) for part in ("time", "amount", "class"))
    return named and any(_FEATURE.match(c) for c in lowered)


def detect_roles(df: DataFrame) -> Roles:
    """Roles by conventional name (Time, Amount, Class, V1 …)."""

    def named(name: str) -> str | None:
        return name if name in df.columns else None

    return Roles(named("Time"), named("Amount"), named("Class"), tuple(feature_cols(df)))


def expand_vector(df: DataFrame, vector: str, size: int, prefix: str = "V") -> DataFrame:
    """Replace an array column by ``size`` scalar columns."""
    rest = [c for c in df.columns if c != vector]
    parts = [F.get(vector, i).cast("double").alias(f"{prefix}{i + 1}") for i in range(size)]
    return df.select(*rest, *parts)


def quoted(name: str) -> str:
    """The name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def _not_nan_sql(df: DataFrame, name: str) -> str:
    # SQL text is parsed in one call; wide tables build many of these.
    column = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return f"CASE WHEN NOT isnan({column}) THEN {column} END"
    return column


def not_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL."""
    return F.expr(_not_nan_sql(df, name))


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric column as double, NaN read as NULL."""
    return F.expr(f"CAST({_not_nan_sql(df, name)} AS DOUBLE)")


def normalise_missing(df: DataFrame, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """NaN and the textual NA spellings become NULL."""
    out = []
    for field in df.schema:
        value = not_nan(df, field.name)
        if isinstance(field.dataType, T.StringType):
            value = F.when(~F.trim(field.name).isin(*na_tokens), F.col(field.name))
        out.append(value.alias(field.name))
    return df.select(*out)


def _micros_of(df: DataFrame, name: str) -> Column | None:
    """Microseconds since the epoch for timestamp columns, whatever the session zone."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        origin = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
        return F.expr(f"timestampdiff(MICROSECOND, {origin}, `{name}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    return None


def seconds_of(df: DataFrame, name: str) -> Column:
    """A time column as seconds: numbers as they are, timestamps since the epoch."""
    micros = _micros_of(df, name)
    if micros is not None:
        return micros / F.lit(1e6)
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.unix_date(name) * F.lit(86400.0)
    return as_double(df, name)


def with_elapsed(df: DataFrame, time: str, out: str = "time") -> DataFrame:
    """Add seconds since the earliest time; the minimum is a scalar subquery."""
    micros = _micros_of(df, time)
    value = seconds_of(df, time) if micros is None else micros
    since = value - df.agg(F.min(value)).scalar()
    return df.withColumn(out, since if micros is None else since / F.lit(1e6))


def prepare(df: DataFrame, roles: Roles, keep: Sequence[str] = ()) -> DataFrame:
    """Project the role columns (plus ``keep``), NULL for missing, time as seconds."""
    wanted = [roles.time, roles.amount, roles.label, *roles.features, *keep]
    names = list(dict.fromkeys(c for c in wanted if c))
    clean = normalise_missing(df.select(*names))
    if roles.time:
        clean = clean.withColumn(roles.time, seconds_of(clean, roles.time))
    return clean
