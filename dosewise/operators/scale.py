"""Standardisation with training moments."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EPS = sys.float_info.epsilon


def fit_scaler(train: DataFrame, entity: str, features: str = "features") -> DataFrame:
    """``(entity, pos, mean, scale)``: mean and population deviation; constant features get scale 1.

    A variance within rounding error of zero counts as constant. The long form is
    combined per task before it is shuffled.
    """
    moments = (
        train.select(entity, F.posexplode(features).alias("pos", "value"))
        .groupBy(entity, "pos")
        .agg(F.avg("value").alias("mean"), F.var_pop("value").alias("__var"), F.count("value").alias("__n"))
    )
    noise = F.col("__n") * F.lit(_EPS) * F.col("__var") + F.pow(F.col("__n") * F.col("mean") * F.lit(_EPS), F.lit(2))
    scale = F.when(F.col("__var") <= noise, F.lit(1.0)).otherwise(F.sqrt("__var"))
    return moments.select(entity, "pos", "mean", scale.alias("scale"))


def pack(long: DataFrame, entity: str, *values: str) -> DataFrame:
    """One row per entity with an array per value column, in feature order.

    The arrays are as long as the feature list, whatever the number of rows.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", *values)))
    packed = long.groupBy(entity).agg(ordered.alias("__p"))
    return packed.select(entity, *[F.col(f"__p.{v}").alias(v) for v in values])


def apply_scaler(df: DataFrame, scaler: DataFrame, entity: str, features: str = "features") -> DataFrame:
    """Standardise packed features with the moments of the row's entity."""
    moments = pack(scaler, entity, "mean", "scale").select(
        F.col(entity).alias("__entity"), F.col("mean").alias("__mean"), F.col("scale").alias("__scale")
    )
    joined = df.join(moments, F.col(entity).eqNullSafe(F.col("__entity")))
    scaled = F.transform(
        features, lambda x, i: (x - F.get("__mean", i)) / F.get("__scale", i)
    )
    return joined.select(*[scaled.alias(c) if c == features else F.col(c) for c in df.columns])
