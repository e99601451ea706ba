"""Exact order statistics of very large groups without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: str, right: str, groups: list[str]) -> Column:
    condition = F.lit(True)
    for g in groups:
        condition = condition & F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}"))
    return condition


def pick_ranks(
    rows: DataFrame,
    groups: list[str],
    bucket: str,
    value: str,
    ranks: Callable[[Column], Column],
) -> DataFrame:
    """The values at given 1-based ranks of each group: ``(groups, label, value)``.

    ``rows`` hold groups, bucket and value, where buckets follow the order of the
    values; ``ranks`` turns the size of a group into an array of ranks, whose index
    is the label. Running totals over the few buckets of a group tell which bucket
    holds a rank, and only that bucket is ordered, with equal values combined
    first. Bad buckets cost time, never exactness.
    """
    keys = [*groups, bucket]
    per_group = Window.partitionBy(*groups)
    spans = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("__n"))
        .withColumn("__total", F.sum("__n").over(per_group))
        .withColumn("__end", F.sum("__n").over(per_group.orderBy(bucket)))
    )
    before = F.col("__end") - F.col("__n")
    offsets = F.transform(
        ranks(F.col("__total")), lambda rank, label: F.struct(label.alias("label"), (rank - before).alias("offset"))
    )
    inside = F.filter(offsets, lambda t: (t["offset"] > 0) & (t["offset"] <= F.col("__n")))
    wanted = spans.select(*keys, inside.alias("__wanted")).where(F.size("__wanted") > 0)
    distinct_values = (
        rows.alias("r")
        .join(wanted.alias("w"), _same("r", "w", keys))
        .groupBy(*[F.col(f"r.{k}").alias(k) for k in keys], F.col(f"r.{value}").alias(value))
        .agg(F.count("*").alias("__copies"), F.first("w.__wanted").alias("__wanted"))
    )
    ranked = distinct_values.withColumn("__last", F.sum("__copies").over(Window.partitionBy(*keys).orderBy(value)))
    hits = F.filter(
        "__wanted",
        lambda t: (t["offset"] > F.col("__last") - F.col("__copies")) & (t["offset"] <= F.col("__last")),
    )
    return ranked.select(*groups, value, F.explode(hits).alias("__hit")).select(
        *groups, F.col("__hit.label").alias("label"), value
    )


# Share of a group, around its middle, that the sketch sets apart.
_MIDDLE = 5e-4
_SKETCH_ACCURACY = 10000


def exact_median(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Exact, interpolating median per group: ``(groups, median)``.

    A mergeable quantile sketch of fixed size sets a thin middle slice of each
    group apart; only that slice is ordered. ``median`` would hold all distinct
    values of a group in one buffer.
    """
    shares = [0.5 - _MIDDLE, 0.5 + _MIDDLE]
    present = rows.where(F.col(value).isNotNull()).select(*groups, value)
    borders = present.groupBy(*groups).agg(
        F.percentile_approx(value, shares, F.lit(_SKETCH_ACCURACY)).alias("__borders")
    )
    bucketed = (
        present.alias("p")
        .join(borders.alias("b"), _same("p", "b", groups))
        .select(
            *[F.col(f"p.{g}").alias(g) for g in groups],
            F.col(f"p.{value}").alias(value),
            F.size(F.filter("b.__borders", lambda edge: edge < F.col(f"p.{value}"))).alias("__bucket"),
        )
    )

    def middle_ranks(n: Column) -> Column:
        return F.array(F.floor((n + 1) / 2).cast("bigint"), F.floor((n + 2) / 2).cast("bigint"))

    middle = pick_ranks(bucketed, groups, "__bucket", value, middle_ranks)
    return middle.groupBy(*groups).agg(F.avg(value).alias("median"))
