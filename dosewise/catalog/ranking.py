"""Coefficient tables and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.catalog.registry import Inputs, query
from dosewise.operators import enrich, rank

ENTITY = "drug_slug"


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "nonzero_features",
    "SELECT drug_slug, feature, round(coefficient, 6) AS coefficient, round(abs(coefficient), 6) AS abs_coefficient FROM coef WHERE coefficient <> 0",
    ("coef",),
)
def _nonzero(t: Inputs) -> DataFrame:
    return _rounded(rank.nonzero_features(t.coefficients), 6, "coefficient", "abs_coefficient")


def _top_sql(where: str, order: str) -> str:
    return f"""SELECT * FROM (SELECT drug_slug, feature, round(coefficient, 6) AS coefficient, round(abs(coefficient), 6) AS abs_coefficient,
  row_number() OVER (PARTITION BY drug_slug ORDER BY {order}, feature) AS rank FROM coef WHERE {where}) WHERE rank <= 25"""


@query("top_features", _top_sql("true", "abs(coefficient) DESC"), ("coef",))
def _top_features(t: Inputs) -> DataFrame:
    return _rounded(rank.top_features(t.coefficients, ENTITY), 6, "coefficient", "abs_coefficient")


@query("top_positive", _top_sql("coefficient > 0", "coefficient DESC"), ("coef",))
def _top_positive(t: Inputs) -> DataFrame:
    return _rounded(rank.top_positive(t.coefficients, ENTITY), 6, "coefficient", "abs_coefficient")


@query("top_negative", _top_sql("coefficient < 0", "coefficient"), ("coef",))
def _top_negative(t: Inputs) -> DataFrame:
    return _rounded(rank.top_negative(t.coefficients, ENTITY), 6, "coefficient", "abs_coefficient")


@query(
    "gene_symbols_top_n",
    """SELECT * FROM (SELECT drug_slug, row_number() OVER (PARTITION BY drug_slug ORDER BY abs(coefficient) DESC, feature) AS rank,
  regexp_extract(feature, '^([A-Za-z0-9-]+)', 1) AS gene_symbol, round(coefficient, 6) AS coefficient,
  round(abs(coefficient), 6) AS abs_coefficient FROM coef WHERE coefficient <> 0) WHERE rank <= 250""",
    ("coef",),
)
def _gene_symbols_top(t: Inputs) -> DataFrame:
    return _rounded(rank.gene_symbols_top(t.coefficients, ENTITY, 250), 6, "coefficient", "abs_coefficient")


@query(
    "coefficient_summary",
    """SELECT drug_slug, count(*) AS n_nonzero_features, round(max(coefficient) FILTER (coefficient > 0), 6) AS max_positive_coefficient,
  round(min(coefficient) FILTER (coefficient < 0), 6) AS min_negative_coefficient, round(avg(abs(coefficient)), 9) AS mean_abs_coefficient,
  round(median(abs(coefficient)), 6) AS median_abs_coefficient, count(*) FILTER (coefficient > 0) AS n_positive_coefficients,
  count(*) FILTER (coefficient < 0) AS n_negative_coefficients
FROM coef WHERE coefficient <> 0 GROUP BY drug_slug""",
    ("coef",),
)
def _summary(t: Inputs) -> DataFrame:
    summary = rank.coefficient_summary(t.coefficients, ENTITY)
    summary = _rounded(
        summary, 6, "max_positive_coefficient", "min_negative_coefficient", "median_abs_coefficient"
    )
    return _rounded(summary, 9, "mean_abs_coefficient")


@query(
    "coef_histogram",
    """WITH s AS (SELECT drug_slug, min(coefficient) AS lo, max(coefficient) AS hi FROM coef GROUP BY ALL),
b AS (SELECT c.drug_slug, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((coefficient - lo) / (hi - lo) * 30) AS BIGINT), 29) END AS bin, count(*) AS n
  FROM coef c JOIN s USING (drug_slug) GROUP BY ALL)
SELECT s.drug_slug, k.bin, round(lo + k.bin * (hi - lo) / 30, 6) AS bin_start, coalesce(n, 0) AS n
FROM s CROSS JOIN (SELECT unnest(range(30)) AS bin) k LEFT JOIN b ON b.drug_slug = s.drug_slug AND b.bin = k.bin""",
    ("coef",),
)
def _histogram(t: Inputs) -> DataFrame:
    bars = rank.coefficient_histogram(t.coefficients, ENTITY)
    return _rounded(bars.withColumn("bin", F.col("bin").cast("bigint")), 6, "bin_start")


@query(
    "plot_coefficients",
    """SELECT * FROM (SELECT drug_slug, CASE WHEN coefficient > 0 THEN 'positive' ELSE 'negative' END AS sign,
  row_number() OVER (PARTITION BY drug_slug, coefficient > 0 ORDER BY abs(coefficient) DESC, feature) AS rank,
  feature, round(coefficient, 6) AS coefficient FROM coef WHERE coefficient <> 0) WHERE rank <= 15""",
    ("coef",),
)
def _plot_coefficients(t: Inputs) -> DataFrame:
    return _rounded(rank.plot_coefficients(t.coefficients, ENTITY), 6, "coefficient")


# --- Enrichment: the symbols of every entity's non-zero coefficients against all libraries.


def _genes(t: Inputs) -> DataFrame:
    symbols = rank.gene_symbols(rank.nonzero_features(t.coefficients), ENTITY)
    return symbols.select(ENTITY, F.col("gene_symbol").alias("symbol"))


def _background(t: Inputs) -> Column:
    """As many background genes as there are parts."""
    return t.table("part").agg(F.count("*")).scalar()


def _scored(t: Inputs) -> DataFrame:
    return enrich.score_terms(enrich.overlaps(_genes(t), t.library, ENTITY), ENTITY, _background(t))


def _results(t: Inputs) -> DataFrame:
    return enrich.enrich(_genes(t), t.library, ENTITY, _background(t))


@query("gene_list_distinct", "SELECT drug_slug, symbol FROM genes", ("genes",))
def _gene_list(t: Inputs) -> DataFrame:
    return enrich.distinct_genes(_genes(t), ENTITY).orderBy(ENTITY, "symbol")


@query(
    "enrichment_overlap",
    "SELECT drug_slug, gene_set, term, overlap, set_size, n_genes, genes FROM counted",
    ("counted",),
)
def _overlap(t: Inputs) -> DataFrame:
    return enrich.overlaps(_genes(t), t.library, ENTITY)


@query("enrichment_pvalue", "SELECT drug_slug, gene_set, term, round(p_value, 8) AS p_value FROM tested", ("tested",))
def _pvalue(t: Inputs) -> DataFrame:
    return _rounded(_scored(t).select(ENTITY, "gene_set", "term", "p_value"), 8, "p_value")


@query(
    "enrichment_odds",
    """SELECT drug_slug, gene_set, term, round(odds_ratio, 6) AS odds_ratio, round(-ln(p_value) * odds_ratio, 5) AS combined_score
FROM tested""",
    ("tested",),
)
def _odds(t: Inputs) -> DataFrame:
    rows = _scored(t).select(ENTITY, "gene_set", "term", "odds_ratio", "combined_score")
    return _rounded(_rounded(rows, 6, "odds_ratio"), 5, "combined_score")


@query("enrichment_bh", "SELECT drug_slug, gene_set, term, round(adj_p, 8) AS adj_p FROM adjusted", ("adjusted",))
def _bh(t: Inputs) -> DataFrame:
    return _rounded(_scored(t).select(ENTITY, "gene_set", "term", "adj_p"), 8, "adj_p")


_RESULT_SQL = """SELECT drug_slug, gene_set, term, concat(overlap, '/', set_size) AS overlap, round(p_value, 8) AS p_value,
  round(adj_p, 8) AS adj_p, CAST(0 AS BIGINT) AS old_p_value, CAST(0 AS BIGINT) AS old_adj_p, round(odds_ratio, 6) AS odds_ratio,
  round(-ln(p_value) * odds_ratio, 5) AS combined_score, genes FROM adjusted"""


def _presentable(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(_rounded(df, 8, "p_value", "adj_p"), 6, "odds_ratio"), 5, "combined_score")


@query("enrichment", _RESULT_SQL, ("adjusted",))
def _enrichment(t: Inputs) -> DataFrame:
    return _presentable(_results(t)).orderBy(ENTITY, "gene_set", "p_value", "term")


@query("enrichment_significant", _RESULT_SQL + " WHERE adjusted.adj_p < 0.05", ("adjusted",))
def _significant(t: Inputs) -> DataFrame:
    return _presentable(enrich.significant(_results(t)))


@query(
    "enrichment_counts",
    "SELECT drug_slug, gene_set, count(*) AS n_terms, count(*) FILTER (adj_p < 0.05) AS n_significant FROM adjusted GROUP BY ALL",
    ("adjusted",),
)
def _counts(t: Inputs) -> DataFrame:
    return enrich.significant_counts(_results(t), ENTITY)


@query(
    "enrichment_preview",
    """SELECT drug_slug, gene_set, rank, term, round(adj_p, 8) AS adj_p FROM (SELECT *, row_number() OVER
  (PARTITION BY drug_slug, gene_set ORDER BY q, term) AS rank FROM adjusted WHERE adj_p < 0.05) WHERE rank <= 5""",
    ("adjusted",),
)
def _preview(t: Inputs) -> DataFrame:
    return _rounded(enrich.preview(_results(t), ENTITY), 8, "adj_p")


@query(
    "plot_enrichment",
    """WITH f AS (SELECT *, count(*) FILTER (adj_p < 0.05) OVER (PARTITION BY drug_slug, gene_set) AS n_sig FROM adjusted),
r AS (SELECT *, row_number() OVER (PARTITION BY drug_slug, gene_set ORDER BY round(adj_p, 12), term) AS rank
  FROM f WHERE adj_p < 0.05 OR n_sig = 0)
SELECT drug_slug, gene_set, rank, term, round(adj_p, 8) AS adj_p,
  round(-log10(CASE WHEN adj_p = 0 THEN 2.2250738585072014e-308 ELSE adj_p END), 6) AS score FROM r WHERE rank <= 10""",
    ("adjusted",),
)
def _plot(t: Inputs) -> DataFrame:
    return _rounded(_rounded(enrich.plot_terms(_results(t), ENTITY), 8, "adj_p"), 6, "score")


#: Symbols of the list, and the background, of the query of very small probabilities.
_TINY, _TINY_BACKGROUND = 300, 20_000


@query(
    "enrichment_tiny_p",
    f"""WITH n AS (SELECT count(*) AS n FROM part WHERE p_partkey BETWEEN 1 AND {_TINY}), t AS (SELECT unnest(range(1, 41)) AS i),
c AS (SELECT i, (SELECT count(*) FROM part WHERE p_partkey BETWEEN i AND {_TINY}) AS a, (SELECT count(*) FROM part WHERE p_partkey BETWEEN i AND {_TINY} + 2 * i) AS k, n FROM t, n),
x AS (SELECT i, a, k, n, unnest(range(a, least(k, n) + 1)) AS x FROM c),
l AS (SELECT i, a, k, n, lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma({_TINY_BACKGROUND} - k + 1) - lgamma(n - x + 1) - lgamma({_TINY_BACKGROUND} - k - n + x + 1)
  - lgamma({_TINY_BACKGROUND} + 1) + lgamma(n + 1) + lgamma({_TINY_BACKGROUND} - n + 1) AS l FROM x),
m AS (SELECT *, max(l) OVER (PARTITION BY i) AS top FROM l),
p AS (SELECT i, a, k, n, max(top) + ln(sum(exp(l - top))) AS ln_p FROM m GROUP BY ALL),
r AS (SELECT *, count(*) OVER (ORDER BY ln_p RANGE UNBOUNDED PRECEDING) AS rank, count(*) OVER () AS terms FROM p),
b AS (SELECT *, least(0, min(ln_p + ln(terms / rank)) OVER (ORDER BY ln_p DESC RANGE UNBOUNDED PRECEDING)) AS ln_adj_p FROM r)
SELECT 'd' AS drug_slug, 'tiny' AS gene_set, concat('t', i) AS term, round(ln_p, 5) AS ln_p, round(ln_adj_p, 5) AS ln_adj_p,
  round(CASE WHEN a < n AND a < k THEN -ln_p * (a * ({_TINY_BACKGROUND} - n - (k - a)) / CAST((n - a) * (k - a) AS DOUBLE)) END, 2) AS combined_score
FROM b WHERE a > 0""",
)
def _tiny(t: Inputs) -> DataFrame:
    """Terms that hold nearly all of a long list: their probabilities are far below the range of a double."""
    symbol = F.col("p_partkey").cast("string").alias("symbol")
    part = t.table("part").select("p_partkey")
    genes = part.where(F.col("p_partkey").between(1, _TINY)).select(F.lit("d").alias(ENTITY), symbol)
    terms = part.join(t.spark.range(1, 41), F.col("p_partkey").between(F.col("id"), _TINY + 2 * F.col("id")))
    library = terms.select(F.lit("tiny").alias("gene_set"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"), symbol)
    scored = enrich.score_terms(enrich.overlaps(genes, library, ENTITY), ENTITY, _TINY_BACKGROUND)
    return _rounded(_rounded(scored.select(ENTITY, "gene_set", "term", "ln_p", "ln_adj_p", "combined_score"), 5, "ln_p", "ln_adj_p"), 2, "combined_score")
