"""Over-representation of symbol lists in gene-set libraries, for all entities and libraries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.constants import BACKGROUND_SIZE, PREVIEW_TERMS, SIGNIFICANCE, TOP_TERMS
from dosewise.functions.numbers import minus_log10
from dosewise.functions.stats import hypergeometric_log_tail, odds_ratio
from dosewise.operators.rank import top_per_entity


def distinct_genes(genes: DataFrame, entity: str) -> DataFrame:
    """Each symbol of an entity once."""
    return genes.where(F.col("symbol").isNotNull()).select(entity, "symbol").distinct()


def overlaps(genes: DataFrame, library: DataFrame, entity: str) -> DataFrame:
    """Terms with at least one hit: ``(entity, gene_set, term, overlap, set_size, n_genes, genes)``.

    ``overlap`` and ``genes`` come from the matched symbols only, so a term gathers
    no more symbols than its list has; the set sizes are counted from the library
    alone. Spark broadcasts the symbol lists while they are small.
    """
    wanted = distinct_genes(genes, entity)
    sizes = library.groupBy("gene_set", "term").agg(F.countDistinct("symbol").alias("set_size"))
    list_sizes = wanted.groupBy(F.col(entity).alias("__entity")).agg(F.count("*").alias("n_genes"))
    hits = (
        library.join(wanted, "symbol")
        .groupBy(entity, "gene_set", "term")
        .agg(F.sort_array(F.collect_set("symbol")).alias("__hits"))
        .select(
            entity,
            "gene_set",
            "term",
            F.size("__hits").cast("bigint").alias("overlap"),
            F.array_join("__hits", ";").alias("genes"),
        )
    )
    return (
        hits.join(sizes, ["gene_set", "term"])
        .join(list_sizes, F.col(entity).eqNullSafe(F.col("__entity")))
        .select(entity, "gene_set", "term", "overlap", "set_size", "n_genes", "genes")
    )


def _counts() -> tuple[Column, Column, Column]:
    return F.col("overlap"), F.col("n_genes"), F.col("set_size")


def score_terms(hits: DataFrame, entity: str, background: int | Column = BACKGROUND_SIZE) -> DataFrame:
    """Add p-value, adjusted p-value (per entity and library), odds ratio, combined score, and the logarithms ``ln_p, ln_adj_p``.

    Correction and combined score are taken from the logarithms, so terms whose p-value is below the range of a double are still
    ordered, corrected and scored. Within an entity these depend only on overlap and set size. They are computed
    once per distinct pair, and the correction runs over the pairs weighted by
    their number of terms, so its window stays small however many terms there are.
    """
    total = background if isinstance(background, Column) else F.lit(int(background)).cast("bigint")
    keys = [entity, "gene_set", "overlap", "set_size", "n_genes"]
    sized = hits.withColumn("__total", total.cast("bigint"))
    pairs = sized.groupBy(*keys).agg(F.count("*").alias("__terms"), F.max("__total").alias("__total"))
    overlap, drawn, marked = _counts()
    scored = pairs.withColumn("ln_p", hypergeometric_log_tail(overlap, drawn, marked, F.col("__total"))).withColumn(
        "odds_ratio", odds_ratio(overlap, drawn, marked, F.col("__total"))
    )
    adjusted = adjust_log_p_values(scored, [entity, "gene_set"], "ln_p", "__terms")
    probabilities = adjusted.withColumn("p_value", F.exp("ln_p")).withColumn("adj_p", F.exp("ln_adj_p"))
    side = probabilities.withColumn("combined_score", -F.col("ln_p") * F.col("odds_ratio")).drop("__terms", "__total", "n_genes")
    side = side.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in side.columns])
    match = F.col(entity).eqNullSafe(F.col(f"__{entity}"))
    for k in ("gene_set", "overlap", "set_size"):
        match = match & (F.col(k) == F.col(f"__{k}"))
    return hits.join(side, match).select(
        *hits.columns, "p_value", "adj_p", "odds_ratio", "combined_score", "ln_p", "ln_adj_p"
    )


def adjust_log_p_values(df: DataFrame, groups: list[str], ln_p: str, weight: str) -> DataFrame:
    """Benjamini-Hochberg on logarithms over weighted rows: each row stands for ``weight`` equal p-values. Adds ``ln_adj_p``."""
    upward = Window.partitionBy(*groups).orderBy(ln_p).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    downward = Window.partitionBy(*groups).orderBy(F.desc(ln_p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.ln(F.sum(weight).over(Window.partitionBy(*groups)) / F.sum(weight).over(upward))
    return df.withColumn("__raw", F.col(ln_p) + share).withColumn("ln_adj_p", F.least(F.lit(0.0), F.min("__raw").over(downward))).drop("__raw")


def enrich(genes: DataFrame, library: DataFrame, entity: str, background: int | Column = BACKGROUND_SIZE) -> DataFrame:
    """Result table of every entity and library, with the two constant legacy columns."""
    scored = score_terms(overlaps(genes, library, entity), entity, background)
    return scored.select(
        entity,
        "gene_set",
        "term",
        F.concat_ws("/", F.col("overlap").cast("string"), F.col("set_size").cast("string")).alias("overlap"),
        "p_value",
        "adj_p",
        F.lit(0).cast("bigint").alias("old_p_value"),
        F.lit(0).cast("bigint").alias("old_adj_p"),
        "odds_ratio",
        "combined_score",
        "genes",
    )


def significant(results: DataFrame, level: float = SIGNIFICANCE) -> DataFrame:
    """Terms with an adjusted p-value below the level (strictly)."""
    return results.where(F.col("adj_p") < level)


def significant_counts(results: DataFrame, entity: str, level: float = SIGNIFICANCE) -> DataFrame:
    """Returned and significant terms per entity and library."""
    return results.groupBy(entity, "gene_set").agg(
        F.count("*").alias("n_terms"), F.count_if(F.col("adj_p") < level).alias("n_significant")
    )


def preview(results: DataFrame, entity: str, n: int = PREVIEW_TERMS, level: float = SIGNIFICANCE) -> DataFrame:
    """First significant terms by p-value."""
    first = top_per_entity(significant(results, level), [entity, "gene_set"], [F.asc("p_value"), F.asc("term")], n)
    return first.select(entity, "gene_set", "rank", "term", "adj_p")


def plot_terms(results: DataFrame, entity: str, n: int = TOP_TERMS, level: float = SIGNIFICANCE) -> DataFrame:
    """Bars: the first terms by adjusted p-value, significant ones only where there are any.

    Significant terms sort first, so the first n of all terms hold the first n
    significant ones; a term that is not significant stays only where rank 1 is not.
    """
    first = top_per_entity(results, [entity, "gene_set"], [F.asc("adj_p"), F.asc("term")], n)
    whole = Window.partitionBy(entity, "gene_set")
    kept = first.withColumn("__best", F.min("adj_p").over(whole)).where(
        (F.col("adj_p") < level) | (F.col("__best") >= level)
    )
    return kept.select(
        entity, "gene_set", "rank", "term", "adj_p", minus_log10(F.col("adj_p")).alias("score")
    )
