"""Numeric coercion, missing tests and the penalty grid as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dosewise.constants import (
    ALPHA_EXPONENT_HIGH,
    ALPHA_EXPONENT_LOW,
    N_ALPHAS,
    SMALLEST_NORMAL_DOUBLE,
)
from dosewise.functions.text import strip_blank

# Spark's cast also reads '1d' and '1f'; only this grammar counts as a number here.
_NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)$"


def to_number(c: Column) -> Column:
    """Text to DOUBLE; anything that is not a number, and NaN, becomes NULL."""
    stripped = strip_blank(c.cast("string"))
    return F.when(stripped.rlike(_NUMBER), stripped.try_cast("double"))


def is_missing(c: Column, dtype: str) -> Column:
    """NULL or, for floating-point columns, NaN."""
    if dtype in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def minus_log10(p: Column) -> Column:
    """-log10 with zero lifted to the smallest normal double first."""
    return -F.log10(F.when(p == 0, F.lit(SMALLEST_NORMAL_DOUBLE)).otherwise(p))


def alpha_at(i: Column) -> Column:
    """The i-th (0-based) value of the logarithmic penalty grid."""
    step = (ALPHA_EXPONENT_HIGH - ALPHA_EXPONENT_LOW) / (N_ALPHAS - 1)
    return F.pow(F.lit(10.0), F.lit(ALPHA_EXPONENT_LOW) + i * F.lit(step))


def alpha_values(n: int = N_ALPHAS) -> list[float]:
    """The penalty grid as numbers, ascending."""
    step = (ALPHA_EXPONENT_HIGH - ALPHA_EXPONENT_LOW) / max(1, n - 1)
    return [10.0 ** (ALPHA_EXPONENT_LOW + i * step) for i in range(n)]
