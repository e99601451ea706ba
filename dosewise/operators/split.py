"""Seeded train/test split and k-fold assignment of every entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.constants import CV_FOLDS, SEED, TEST_FRACTION
from dosewise.operators.order_stats import pick_ranks

# Leading hex digits of the hash that form a bucket: 65,536 equally likely buckets.
_BUCKET_DIGITS = 4


def split_key(row_cols: list[str], seed: int) -> Column:
    """Pseudo-random order of the rows: md5 of the row key and the seed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row_cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def split_points(
    df: DataFrame,
    entity: str,
    row_cols: list[str],
    seed: int = SEED,
    test_fraction: float = TEST_FRACTION,
    folds: int = CV_FOLDS,
    distinct_keys: bool = False,
) -> DataFrame:
    """Per entity the hash values at which the test part and the folds end.

    Exactly ``ceil(test_fraction * n)`` rows are test; the training rows are cut
    into folds whose sizes differ by at most one, larger ones first. Only the row
    key is read, counted in hash buckets, and the few buckets holding a cut are
    ordered, so an entity with most of the data is still spread over many tasks.
    """
    keyed = df.select(entity, split_key(row_cols, seed).alias("__key"))
    keyed = keyed.distinct() if distinct_keys else keyed
    rows = keyed.withColumn("__bucket", F.substring("__key", 1, _BUCKET_DIGITS))

    def ends(n: Column) -> Column:
        n_test = F.ceil(F.lit(float(test_fraction)) * n).cast("bigint")
        n_train = n - n_test
        return F.array(
            *[
                n_test + F.lit(f) * F.floor(n_train / folds).cast("bigint") + F.least(F.lit(f), n_train % folds)
                for f in range(folds)
            ]
        )

    cuts = pick_ranks(rows, [entity], "__bucket", "__key", ends)
    return cuts.groupBy(entity).agg(
        *[F.max(F.when(F.col("label") == f, F.col("__key"))).alias(f"__cut{f}") for f in range(folds)]
    )


def assign_split(
    df: DataFrame,
    entity: str,
    row_cols: list[str],
    seed: int = SEED,
    test_fraction: float = TEST_FRACTION,
    folds: int = CV_FOLDS,
    group_col: str | None = None,
    points: DataFrame | None = None,
) -> DataFrame:
    """Add ``split`` ('train'/'test') and ``fold`` (1..k, NULL for test rows).

    ``row_cols`` must identify a row within its entity. The rows themselves are not
    shuffled: each is compared with the cut points of its entity. With
    ``group_col`` the groups are split instead of the rows, so that all rows of a
    sample fall on the same side. ``points`` takes stored cut points of the same
    settings.
    """
    keys = [group_col] if group_col else row_cols
    if points is None:
        points = split_points(df, entity, keys, seed, test_fraction, folds, distinct_keys=group_col is not None)
    points = points.withColumnRenamed(entity, "__entity")
    joined = df.withColumn("__key", split_key(keys, seed)).join(
        points, F.col(entity).eqNullSafe(F.col("__entity")), "left"
    )
    later = sum(((F.col("__key") > F.col(f"__cut{f}")).cast("int") for f in range(1, folds)), F.lit(1))
    is_test = F.col("__key") <= F.col("__cut0")
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias("split"),
        F.when(~is_test, later).cast("bigint").alias("fold"),
    )
