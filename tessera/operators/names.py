"""Names and types of columns, and what is checked of them before a fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.families import Family, ModelError

INTERCEPT = "(Intercept)"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_double(df: DataFrame, name: str, lenient: bool = False) -> Column:
    """A column as double. Times and nested values are no numbers."""
    kind, c = df.schema[name].dataType, F.col(quoted(name))
    if isinstance(kind, T.DoubleType):
        return c
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        if lenient:
            return F.lit(None).cast("double")
        raise ModelError(f"column {name!r} cannot be cast to a number")
    return c.try_cast("double") if lenient else c.cast("double")


def number(df: DataFrame, name: str, lenient: bool = False) -> Column:
    """The same with NaN as NULL."""
    c = as_double(df, name, lenient)
    return F.when(~F.isnan(c), c)


def check_names(df: DataFrame, features: list[str]) -> None:
    for c in df.columns:
        if c.lower().startswith("__reg_"):
            raise ModelError(f"column name {c!r} is reserved")
    if INTERCEPT in features:
        raise ModelError(f"a feature may not be called {INTERCEPT}")


def missing_outcome(outcome: str) -> str:
    return f"outcome column {outcome!r} not found, entirely NULL, or table is empty"


def used_columns(df: DataFrame, outcome: str, offset_col: str | None, weights_col: str | None) -> list[str]:
    """The features by name: all columns but the outcome, the offset and the weights."""
    features = sorted(c for c in df.columns if c not in (outcome, offset_col, weights_col))
    check_names(df, features)
    if outcome not in df.columns:
        raise ModelError(missing_outcome(outcome))
    for kind, c in (("offset", offset_col), ("weights", weights_col)):
        if c and c not in df.columns:
            raise ModelError(f'{kind} column "{c}" not found')
    return features


def check_outcome(fam: Family, outcome: str, n: int, low: float, other: int) -> None:
    """``n`` outcomes are known, the lowest is ``low``, and ``other`` are neither 0 nor 1."""
    if not n:
        raise ModelError(missing_outcome(outcome))
    if fam.name == "logistic" and other:
        raise ModelError(f"outcome {outcome!r} must be binary (0 or 1)")
    if fam.name == "gamma" or (fam.name == "tweedie" and fam.extra >= 2):
        if low <= 0:
            raise ModelError(f"outcome {outcome!r} must be strictly positive")
    elif fam.log_link and low < 0:
        raise ModelError(f"outcome {outcome!r} must be non-negative")
