"""Dataset, table, record and list writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.constants import EMPTY_ENTITY


def write_entity_dataset(df: DataFrame, path: str, entity: str = "drug_slug", mode: str = "overwrite") -> None:
    """Parquet, one directory per entity.

    The rebalance step groups rows by entity for few files, and lets AQE cut an
    entity that holds much of the data into several write tasks. Only the
    entities at hand are overwritten. An empty name would come back as NULL; it is
    stored under a name that no slug has, and ``read_entity_dataset`` takes that back.
    """
    kept = df if dict(df.dtypes)[entity] != "string" else df.withColumn(entity, F.when(F.col(entity) == "", EMPTY_ENTITY).otherwise(F.col(entity)))
    (
        kept.hint("rebalance", F.col(entity))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(entity)
        .parquet(path)
    )


def write_table(df: DataFrame, path: str, sep: str = ",", single_file: bool = False) -> None:
    """CSV/TSV with a header. ``single_file`` is for result tables of bounded size only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").csv(
        path,
        sep=sep,
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object per row; NULL fields are written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_gene_list(df: DataFrame, path: str, symbol: str = "symbol", order: list | None = None) -> None:
    """Text, one symbol per line, missing symbols left out, in the given order."""
    symbols = df.where(F.col(symbol).isNotNull())
    if order:
        symbols = symbols.orderBy(*order)
    symbols.select(F.col(symbol).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_models(raw: DataFrame, names: DataFrame, target: str, path: str, entity: str = "drug_slug") -> None:
    """Models in raw features with everything that scoring needs: intercept, penalty, feature order and target's name.

    ``names`` (``pos, feature``) is a header, so it becomes one array that every row holds.
    """
    order = names.agg(F.sort_array(F.collect_list(F.struct("pos", "feature"))).alias("p")).select("p.feature")
    stored = raw.select(entity, "l1_ratio", "alpha", "intercept", "coefficients", order.scalar().alias("features"), F.lit(target).alias("target"))
    stored.write.mode("overwrite").parquet(path)
