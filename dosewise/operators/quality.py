"""Data contracts as violation tables ``(check_name, n_violations, sample)``.

A sample holds at most five offending values. ``enforce`` raises on any violation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.constants import MIN_SHARED_FEATURES, RESERVED_OUTPUT_NAMES, VIOLATION_SAMPLE
from dosewise.functions.numbers import is_missing, to_number


class ContractViolation(ValueError):
    """At least one data contract does not hold."""


def _report(check: str, offenders: DataFrame, value: Column) -> DataFrame:
    """Count the offenders and keep the first few values; nothing but those few is gathered."""
    values = offenders.select(value.cast("string").alias("value"))
    count = values.agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("value"))
    first = values.where(F.col("value").isNotNull()).distinct().orderBy("value").limit(VIOLATION_SAMPLE)
    both = count.unionByName(first.select(F.lit(0).cast("bigint").alias("n"), "value"))
    return both.agg(
        F.lit(check).alias("check_name"),
        F.sum("n").alias("n_violations"),
        F.array_join(F.sort_array(F.collect_list("value")), ",").alias("sample"),
    ).select("check_name", "n_violations", "sample")


def _flag(check: str, violated: DataFrame) -> DataFrame:
    """One-row report from a one-row table with column ``n`` (0 = contract holds)."""
    return violated.select(F.lit(check).alias("check_name"), F.col("n").cast("bigint").alias("n_violations"), F.lit("").alias("sample"))


def not_empty(df: DataFrame, check: str = "not_empty") -> DataFrame:
    """The table has at least one row."""
    return _flag(check, df.limit(1).agg((F.lit(1) - F.count("*")).alias("n")))


def required_columns(catalogue: DataFrame, required: list[str]) -> DataFrame:
    """Per table the required column names it lacks, as a sorted text."""
    present = catalogue.groupBy("table_name").agg(
        *[F.max(F.col("column_name") == name).alias(f"h{i}") for i, name in enumerate(sorted(required))]
    )
    lacking = F.array_compact(
        F.array(*[F.when(~F.col(f"h{i}"), F.lit(name)) for i, name in enumerate(sorted(required))])
    )
    return present.select(
        "table_name",
        F.size(lacking).cast("bigint").alias("n_violations"),
        F.array_join(lacking, ",").alias("sample"),
    )


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """The table itself; a missing column raises."""
    lacking = sorted(set(required) - set(df.columns))
    if lacking:
        raise ContractViolation(f"Missing required columns: {lacking}")
    return df


def features_complete(df: DataFrame, row: str, features: str = "features", check: str = "features_complete") -> DataFrame:
    """No missing value inside the packed features; the sample names the rows."""
    broken = F.exists(features, lambda x: x.isNull() | F.isnan(x)) | F.col(features).isNull()
    return _report(check, df.where(broken), F.col(row))


def has_features(df: DataFrame, row: str, features: str = "features", check: str = "has_features") -> DataFrame:
    """Every row carries at least one feature."""
    return _report(check, df.where(F.coalesce(F.size(features), F.lit(0)) <= 0), F.col(row))


def target_complete(df: DataFrame, target: str, row: str, check: str = "target_complete") -> DataFrame:
    """No missing target."""
    return _report(check, df.where(is_missing(F.col(target), dict(df.dtypes)[target])), F.col(row))


def id_not_null(df: DataFrame, key: str, check: str = "id_not_null") -> DataFrame:
    """No missing identifier."""
    return _report(check, df.where(is_missing(F.col(key), dict(df.dtypes)[key])), F.col(key))


def id_unique(df: DataFrame, keys: list[str], check: str = "id_unique") -> DataFrame:
    """No identifier twice; the sample names repeated identifiers, joined by ``|``."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    return _report(check, repeated, F.concat_ws("|", *keys))


def id_set_equal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides hold the same identifiers; two rows, one per side."""
    only_left = left.select(key).distinct().join(right, key, "left_anti")
    only_right = right.select(key).distinct().join(left, key, "left_anti")
    return _report("missing_in_right", only_left, F.col(key)).unionByName(
        _report("missing_in_left", only_right, F.col(key))
    )


def min_shared_features(shared: DataFrame, minimum: int = MIN_SHARED_FEATURES) -> DataFrame:
    """At least ``minimum`` shared features; the sample is their number."""
    return shared.agg(F.count("*").alias("n")).select(
        F.lit("min_shared_features").alias("check_name"),
        (F.col("n") < minimum).cast("bigint").alias("n_violations"),
        F.col("n").cast("string").alias("sample"),
    )


def reserved_names(features: DataFrame, feature: str = "feature", reserved: list[str] | None = None) -> DataFrame:
    """No feature is named like an output column."""
    names = RESERVED_OUTPUT_NAMES if reserved is None else reserved
    clash = features.where(F.col(feature).isin(names)).select(feature).distinct()
    return _report("reserved_names", clash, F.col(feature))


def numeric(df: DataFrame, column: str, row: str, check: str = "numeric") -> DataFrame:
    """Every value reads as a number."""
    return _report(check, df.where(to_number(F.col(column)).isNull()), F.col(row))


def inputs_ready(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """Per declared table its rows and lacking columns; the counts come from file footers where possible."""
    reports = []
    for name, df in tables.items():
        lacking = sorted(set(required.get(name, [])) - set(df.columns))
        reports.append(
            df.agg(F.count("*").alias("n_rows")).select(
                F.lit(name).alias("table_name"),
                "n_rows",
                F.lit(",".join(lacking)).alias("missing_columns"),
                ((F.col("n_rows") == 0).cast("bigint") + F.lit(len(lacking))).cast("bigint").alias("n_violations"),
            )
        )
    return reduce(DataFrame.unionByName, reports)


def enforce(*reports: DataFrame) -> None:
    """Raise when any report counts a violation."""
    broken = [row.asDict() for report in reports for row in report.where("n_violations > 0").take(VIOLATION_SAMPLE)]
    if broken:
        raise ContractViolation(f"Data contracts violated: {broken}")
