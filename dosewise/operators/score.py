"""Prediction, evaluation and the tables a fitted model turns into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.constants import SEED, TEST_FRACTION


def predict(df: DataFrame, model: DataFrame, entity: str, features: str = "features") -> DataFrame:
    """Add ``prediction`` to standardised rows; one model row per entity."""
    side = model.select(
        F.col(entity).alias("__entity"), F.col("coefficients").alias("__w"), F.col("intercept").alias("__b")
    )
    joined = df.join(side, F.col(entity).eqNullSafe(F.col("__entity")))
    products = F.zip_with(features, "__w", lambda x, w: x * w)
    total = F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
    return joined.select(*df.columns, (total + F.col("__b")).alias("prediction"))


def evaluate(df: DataFrame, entity: str, target: str, prediction: str = "prediction") -> DataFrame:
    """``(entity, n, rmse, r2)`` in one aggregation; a constant target gives r2 1 or 0."""
    error = F.pow(F.col(target) - F.col(prediction), F.lit(2))
    sums = df.groupBy(entity).agg(
        F.count("*").alias("n"),
        F.sum(error).alias("__sse"),
        (F.var_pop(target) * F.count("*")).alias("__sst"),
    )
    r2 = F.when(F.col("__sst") == 0, F.when(F.col("__sse") == 0, 1.0).otherwise(0.0)).otherwise(
        1 - F.try_divide("__sse", "__sst")
    )
    return sums.select(entity, "n", F.sqrt(F.col("__sse") / F.col("n")).alias("rmse"), r2.alias("r2"))


def coefficient_table(model: DataFrame, names: DataFrame, entity: str) -> DataFrame:
    """``(entity, feature, coefficient, abs_coefficient)``, one row per entity and feature."""
    long = model.select(entity, F.posexplode("coefficients").alias("pos", "coefficient"))
    return long.join(names, "pos").select(
        entity, "feature", "coefficient", F.abs("coefficient").alias("abs_coefficient")
    )


def model_table(model: DataFrame, scaler: DataFrame, names: DataFrame, entity: str) -> DataFrame:
    """Everything needed to score again: ``(entity, pos, feature, mean, scale, coefficient)``."""
    long = model.select(entity, F.posexplode("coefficients").alias("pos", "coefficient"))
    return (
        long.join(scaler, [entity, "pos"])
        .join(names, "pos")
        .select(entity, "pos", "feature", "mean", "scale", "coefficient")
    )


def metrics_record(
    dataset: DataFrame,
    metrics: DataFrame,
    model: DataFrame,
    entity: str,
    source: str,
    features: str = "features",
    test_fraction: float = TEST_FRACTION,
    seed: int = SEED,
) -> DataFrame:
    """One record per entity with sizes, split settings, test metrics and the chosen penalty."""
    sizes = dataset.groupBy(entity).agg(
        F.count("*").alias("n_samples"), F.max(F.size(features)).cast("bigint").alias("n_features")
    )
    return (
        sizes.join(metrics, entity)
        .join(model, entity)
        .select(
            entity,
            F.lit(source).alias("dataset"),
            "n_samples",
            "n_features",
            F.lit(test_fraction).alias("test_size"),
            F.lit(seed).cast("bigint").alias("random_state"),
            "r2",
            "rmse",
            F.col("alpha").alias("best_alpha"),
            F.col("l1_ratio").alias("best_l1_ratio"),
        )
    )
