"""Feature names, long form, and the features two matrices share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions.text import looks_like_feature


def to_long(matrix: DataFrame, names: DataFrame | None = None, features: str = "features") -> DataFrame:
    """Packed rows to ``(…, pos, value)``, with ``feature`` when names are given."""
    keep = [c for c in matrix.columns if c != features]
    long = matrix.select(*keep, F.posexplode(features).alias("pos", "value"))
    return long if names is None else long.join(names, "pos")


def select_features(features: DataFrame, feature: str = "feature") -> DataFrame:
    """Feature names written ``SYMBOL (ENTREZ)``."""
    return features.where(looks_like_feature(F.col(feature)))


def shared_features(left: DataFrame, right: DataFrame) -> DataFrame:
    """Features of the left side that the right side has too, with the left positions."""
    return left.join(right.select("feature").distinct(), "feature", "left_semi").select("pos", "feature")


def restrict_features(matrix: DataFrame, positions: DataFrame, features: str = "features") -> DataFrame:
    """Packed rows cut down to the given positions, in their order.

    The positions are a header, so they fit in one array that every row uses.
    """
    wanted = positions.agg(F.sort_array(F.collect_list("pos")).alias("kept"))
    keep = [c for c in matrix.columns if c != features]
    return matrix.select(*keep, F.col(features).alias("__all"), wanted.scalar().alias("__kept")).select(
        *keep, F.transform("__kept", lambda i: F.get("__all", i)).alias(features)
    )


def shared_matrices(
    left: DataFrame, left_names: DataFrame, right: DataFrame, right_names: DataFrame, features: str = "features"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both matrices cut down to the features they share, in the left side's order, and ``(pos, feature)`` of that order."""
    both = left_names.select(F.col("pos").alias("__l"), "feature").join(right_names.select(F.col("pos").alias("__r"), "feature"), "feature")
    order = both.agg(F.sort_array(F.collect_list(F.struct("__l", "__r", "feature"))).alias("__p"))

    def cut(matrix: DataFrame, side: str) -> DataFrame:
        keep = [c for c in matrix.columns if c != features]
        wanted = order.select(F.col(f"__p.{side}"))
        return matrix.select(*keep, F.col(features).alias("__all"), wanted.scalar().alias("__kept")).select(
            *keep, F.transform("__kept", lambda i: F.get("__all", i)).alias(features)
        )

    names = order.select(F.posexplode("__p.feature").alias("pos", "feature"))
    return cut(left, "__l"), cut(right, "__r"), names
