"""Coefficient rankings, summaries and histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.constants import HISTOGRAM_BINS, TOP_FEATURES, TOP_PLOTTED_FEATURES
from dosewise.functions.text import gene_symbol
from dosewise.operators.order_stats import exact_median


def top_per_entity(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group with their ``rank``.

    Spark limits each group before the shuffle (for n up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 by default), so a large
    group arrives as n rows per task.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def with_magnitude(coefficients: DataFrame) -> DataFrame:
    """Add ``abs_coefficient``."""
    return coefficients.withColumn("abs_coefficient", F.abs("coefficient"))


def nonzero_features(coefficients: DataFrame) -> DataFrame:
    """Features the model uses."""
    return with_magnitude(coefficients).where(F.col("abs_coefficient") > 0)


def top_features(coefficients: DataFrame, entity: str, n: int = TOP_FEATURES) -> DataFrame:
    """Largest coefficients by magnitude; ties by name."""
    return top_per_entity(with_magnitude(coefficients), [entity], [F.desc("abs_coefficient"), F.asc("feature")], n)


def top_positive(coefficients: DataFrame, entity: str, n: int = TOP_FEATURES) -> DataFrame:
    """Largest positive coefficients."""
    rows = with_magnitude(coefficients).where(F.col("coefficient") > 0)
    return top_per_entity(rows, [entity], [F.desc("coefficient"), F.asc("feature")], n)


def top_negative(coefficients: DataFrame, entity: str, n: int = TOP_FEATURES) -> DataFrame:
    """Most negative coefficients."""
    rows = with_magnitude(coefficients).where(F.col("coefficient") < 0)
    return top_per_entity(rows, [entity], [F.asc("coefficient"), F.asc("feature")], n)


def plot_coefficients(coefficients: DataFrame, entity: str, n: int = TOP_PLOTTED_FEATURES) -> DataFrame:
    """Bars of both signs: ``(entity, sign, rank, feature, coefficient)``.

    Both signs are ranked in one window, as the largest magnitude comes first on
    either side.
    """
    sign = F.when(F.col("coefficient") > 0, F.lit("positive")).otherwise(F.lit("negative"))
    rows = nonzero_features(coefficients).withColumn("sign", sign)
    ranked = top_per_entity(rows, [entity, "sign"], [F.desc("abs_coefficient"), F.asc("feature")], n)
    return ranked.select(entity, "sign", "rank", "feature", "coefficient")


def gene_symbols(features: DataFrame, entity: str) -> DataFrame:
    """Symbol in place of the feature name."""
    return with_magnitude(features).select(
        entity, gene_symbol(F.col("feature")).alias("gene_symbol"), "coefficient", "abs_coefficient"
    )


def gene_symbols_top(coefficients: DataFrame, entity: str, n: int) -> DataFrame:
    """Symbols of the n largest non-zero coefficients, with their rank."""
    ranked = top_features(nonzero_features(coefficients), entity, n)
    return ranked.select(
        entity, "rank", gene_symbol(F.col("feature")).alias("gene_symbol"), "coefficient", "abs_coefficient"
    )


def coefficient_summary(coefficients: DataFrame, entity: str) -> DataFrame:
    """Counts, extremes, mean and exact median magnitude of the non-zero coefficients per entity.

    An extreme is NULL when its side is empty.
    """
    rows = nonzero_features(coefficients)
    c = F.col("coefficient")
    stats = rows.groupBy(entity).agg(
        F.count("*").alias("n_nonzero_features"),
        F.max(F.when(c > 0, c)).alias("max_positive_coefficient"),
        F.min(F.when(c < 0, c)).alias("min_negative_coefficient"),
        F.avg("abs_coefficient").alias("mean_abs_coefficient"),
        F.count_if(c > 0).alias("n_positive_coefficients"),
        F.count_if(c < 0).alias("n_negative_coefficients"),
    )
    medians = exact_median(rows, [entity], "abs_coefficient").withColumnRenamed(entity, "__entity")
    return stats.join(medians, F.col(entity).eqNullSafe(F.col("__entity"))).select(
        entity,
        "n_nonzero_features",
        "max_positive_coefficient",
        "min_negative_coefficient",
        "mean_abs_coefficient",
        F.col("median").alias("median_abs_coefficient"),
        "n_positive_coefficients",
        "n_negative_coefficients",
    )


def coefficient_histogram(coefficients: DataFrame, entity: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram per entity, right edge closed, empty bins shown.

    With a single distinct value everything falls into bin 0. The range comes from
    an aggregation joined back, not from a window over a whole entity.
    """
    span = coefficients.groupBy(entity).agg(F.min("coefficient").alias("lo"), F.max("coefficient").alias("hi"))
    side = span.withColumnRenamed(entity, "__entity")
    share = F.try_divide(F.col("coefficient") - F.col("lo"), F.col("hi") - F.col("lo"))
    placed = coefficients.join(side, F.col(entity).eqNullSafe(F.col("__entity"))).select(
        entity,
        F.least(F.coalesce(F.floor(share * bins), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"),
    )
    counts = placed.groupBy(entity, "bin").agg(F.count("*").alias("__n"))
    every = span.select(
        F.col(entity).alias("__entity"), "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("__bin")
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    joined = every.join(
        counts, F.col("__entity").eqNullSafe(F.col(entity)) & (F.col("__bin") == F.col("bin")), "left"
    )
    return joined.select(
        F.col("__entity").alias(entity),
        F.col("__bin").alias("bin"),
        (F.col("lo") + F.col("__bin") * width).alias("bin_start"),
        F.coalesce("__n", F.lit(0)).cast("bigint").alias("n"),
    )
