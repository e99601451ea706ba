"""Hypergeometric statistics as native column expressions (no UDF, no lookup table)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT_LIMIT = 20


def log_factorial(n: Column) -> Column:
    """ln(n!): exact up to 20!, beyond that Stirling's series (error below 1e-15).

    A closed form works for any background size, where a table of log factorials
    would have to be built and broadcast with it.
    """
    x = n.cast("double")
    inverse = 1.0 / x
    square = inverse * inverse
    tail = inverse * (1.0 / 12 - square * (1.0 / 360 - square * (1.0 / 1260 - square / 1680)))
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + tail
    return F.when(x <= _EXACT_LIMIT, F.ln(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def hypergeometric_log_tail(overlap: Column, drawn: Column, marked: Column, total: Column) -> Column:
    """ln P(X >= overlap) for ``drawn`` picks out of ``total`` of which ``marked`` are hits; minus infinity where it cannot be.

    The first term comes from its logarithm, the others from their ratio to the one before, so the sum is relative to the first
    term and the result is finite however small the probability. The sum exceeds the range of a double only where the first term,
    and all below it, is under 1e-308: then the tail is 1.
    """
    first = F.greatest(overlap, drawn + marked - total, F.lit(0))
    last = F.least(marked, drawn)
    log_first = (
        log_factorial(marked)
        - log_factorial(first)
        - log_factorial(marked - first)
        + log_factorial(total - marked)
        - log_factorial(drawn - first)
        - log_factorial(total - marked - drawn + first)
        - log_factorial(total)
        + log_factorial(drawn)
        + log_factorial(total - drawn)
    )
    steps = F.when(first < last, F.sequence(first, last - 1)).otherwise(F.array().cast("array<bigint>"))

    def add(acc: Column, x: Column) -> Column:
        ratio = ((marked - x) * (drawn - x)).cast("double") / ((x + 1) * (total - marked - drawn + x + 1)).cast("double")
        term = acc["term"] * ratio
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    relative = F.aggregate(steps, start, add, lambda acc: acc["sum"])
    return F.when(first > last, F.lit(float("-inf"))).otherwise(F.least(F.lit(0.0), log_first + F.ln(relative)))


def hypergeometric_tail(overlap: Column, drawn: Column, marked: Column, total: Column) -> Column:
    """P(X >= overlap); 0 where it is below the range of a double, where :func:`hypergeometric_log_tail` still tells it."""
    return F.exp(hypergeometric_log_tail(overlap, drawn, marked, total))


def odds_ratio(overlap: Column, drawn: Column, marked: Column, total: Column) -> Column:
    """Sample odds ratio of the 2x2 table; NULL where a cell on the diagonal is empty."""
    outside = (total - drawn - (marked - overlap)).cast("double")
    denominator = ((drawn - overlap) * (marked - overlap)).cast("double")
    return F.try_divide(overlap * outside, denominator)
