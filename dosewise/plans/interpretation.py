"""Coefficients to symbols, enrichment and plot tables of every entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.constants import BACKGROUND_SIZE
from dosewise.operators import enrich, rank


def enrich_top_features(
    coefficients: DataFrame,
    library: DataFrame,
    entity: str,
    top_n: int | None = None,
    background: int | Column = BACKGROUND_SIZE,
) -> DataFrame:
    """Enrichment of the symbols of all non-zero, or of the ``top_n`` largest, coefficients."""
    if top_n is None:
        symbols = rank.gene_symbols(rank.nonzero_features(coefficients), entity)
    else:
        symbols = rank.gene_symbols_top(coefficients, entity, top_n)
    genes = symbols.select(entity, F.col("gene_symbol").alias("symbol"))
    return enrich.enrich(genes, library, entity, background)
