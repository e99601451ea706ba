"""Scalar functions, filters, joins and dataset assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.catalog.bindings import SQL_CLEAN_ID, SQL_SLUG
from dosewise.catalog.registry import Inputs, query
from dosewise.functions import text
from dosewise.operators import assemble, elasticnet, features, rank

# Feature arrays are compared as text of whole millionths.
_FEATURE_TEXT = "array_join(transform(features, x -> CAST(round(x * 1000000) AS BIGINT)), ',')"
_FEATURE_TEXT_SQL = "array_to_string([CAST(round(x * 1000000) AS BIGINT) for x in features], ',')"


@query(
    "clean_id",
    f"SELECT assay_id, cosmic_raw, {SQL_CLEAN_ID.format(c='cosmic_raw')} AS cosmic_id FROM resp"
    f" WHERE {SQL_CLEAN_ID.format(c='cosmic_raw')} IS NOT NULL",
    ("resp",),
)
def _clean_id(t: Inputs) -> DataFrame:
    rows = t.response.select("assay_id", "cosmic_raw", text.clean_id(F.col("cosmic_raw")).alias("cosmic_id"))
    return rows.where(text.usable_id(F.col("cosmic_id")))


@query(
    "entity_filter",
    "SELECT * FROM resp WHERE lower(trim(drug_name)) = 'purchase'",
    ("resp",),
)
def _entity_filter(t: Inputs) -> DataFrame:
    return assemble.entity_filter(t.response, "drug_name", " Purchase ")


@query(
    "target_clean",
    "SELECT assay_id, TRY_CAST(ln_ic50_raw AS DOUBLE) AS ln_ic50_raw FROM resp WHERE TRY_CAST(ln_ic50_raw AS DOUBLE) IS NOT NULL",
    ("resp",),
)
def _target_clean(t: Inputs) -> DataFrame:
    return assemble.clean_targets(t.response.select("assay_id", "ln_ic50_raw"), "ln_ic50_raw")


@query(
    "normalise_name",
    "SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS normalised FROM documents",
)
def _normalise_name(t: Inputs) -> DataFrame:
    return t.table("documents").select("doc_id", text.normalise_name(F.col("text")).alias("normalised"))


@query(
    "join_key_standardise",
    "SELECT assay_id, upper(regexp_replace(concat(drug_name, ' ', cosmic_raw), '\\s+', '', 'g')) AS join_key FROM resp",
    ("resp",),
)
def _join_key(t: Inputs) -> DataFrame:
    raw = F.concat(F.coalesce("drug_name", F.lit("")), F.lit(" "), F.coalesce("cosmic_raw", F.lit("")))
    return t.response.select("assay_id", text.join_key(raw).alias("join_key"))


_SLUG_INPUT = "concat('  ', p_name, ' (', p_type, ') ')"


@query(
    "slug",
    f"SELECT p_partkey, {SQL_SLUG.format(c=_SLUG_INPUT)} AS slug,"
    f" CASE WHEN p_size % 7 = 0 THEN 'drug' ELSE {SQL_SLUG.format(c=_SLUG_INPUT)} END AS file_slug FROM part",
)
def _slug(t: Inputs) -> DataFrame:
    raw = F.concat(F.lit("  "), F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(") "))
    no_letters = F.when(F.col("p_size") % 7 == 0, F.lit(" (-) ")).otherwise(raw)
    return t.table("part").select("p_partkey", text.slug(raw).alias("slug"), text.file_slug(no_letters).alias("file_slug"))


@query(
    "gene_symbols",
    "SELECT drug_slug, nullif(regexp_extract(feature, '^([A-Za-z0-9-]+)', 1), '') AS gene_symbol,"
    " round(coefficient, 6) AS coefficient, round(abs(coefficient), 6) AS abs_coefficient FROM coef WHERE coefficient <> 0",
    ("coef",),
)
def _gene_symbols(t: Inputs) -> DataFrame:
    rows = rank.gene_symbols(rank.nonzero_features(t.coefficients), "drug_slug")
    return rows.withColumns({c: F.round(c, 6) for c in ("coefficient", "abs_coefficient")})


@query(
    "null_tokens",
    """SELECT doc_id, CASE WHEN token NOT IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND',
  '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN token END AS decoded
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN 'null' WHEN 3 THEN 'na' WHEN 4 THEN '<NA>'
  ELSE text END AS token FROM documents)""",
)
def _null_tokens(t: Inputs) -> DataFrame:
    raw = F.expr(
        "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN 'null' WHEN 3 THEN 'na' WHEN 4 THEN '<NA>' ELSE text END"
    )
    return t.table("documents").select("doc_id", text.decode_missing(raw).alias("decoded"))


@query(
    "bridge_join",
    """SELECT e.vec_id AS model_id, m.cosmic_raw, CAST(len(e.embedding) AS BIGINT) AS n_features
FROM embeddings e LEFT JOIN meta m ON e.vec_id = m.model_id""",
    ("meta",),
)
def _bridge_join(t: Inputs) -> DataFrame:
    joined = assemble.bridge_join(t.expression, t.metadata)
    return joined.select("model_id", "cosmic_raw", F.size("features").cast("bigint").alias("n_features"))


@query(
    "expression_long",
    """SELECT vec_id AS model_id, CAST(pos AS BIGINT) AS pos, round(CAST(value AS DOUBLE), 7) AS value
FROM (SELECT vec_id, unnest(embedding) AS value, unnest(range(len(embedding))) AS pos FROM embeddings)""",
)
def _expression_long(t: Inputs) -> DataFrame:
    long = features.to_long(t.expression)
    return long.select("model_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 7).alias("value"))


@query(
    "per_entity_dataset",
    f"""SELECT assay_id, drug_slug, drug_name, cell_line_id, depmap_model_id, round(ln_ic50, 6) AS ln_ic50,
  {_FEATURE_TEXT_SQL} AS features FROM ds""",
    ("ds",),
)
def _per_entity_dataset(t: Inputs) -> DataFrame:
    return t.dataset.withColumns({"ln_ic50": F.round("ln_ic50", 6), "features": F.expr(_FEATURE_TEXT)})


@query(
    "align_entities",
    """SELECT x.vec_id AS model_id, CAST(len(x.embedding) AS BIGINT) AS n_features, y.label
FROM embeddings x JOIN embeddings y ON x.vec_id = y.vec_id""",
)
def _align(t: Inputs) -> DataFrame:
    target = t.table("embeddings").select(F.col("vec_id").alias("model_id"), "label")
    joined = assemble.align(t.expression, target, "model_id")
    return joined.select("model_id", F.size("features").cast("bigint").alias("n_features"), "label")


_FEATURE_NAME = """CASE WHEN p_size % 5 = 0 THEN concat('meta_', CAST(p_partkey AS STRING))
  ELSE concat(upper(replace(p_name, ' ', '-')), '-', CAST(p_partkey AS STRING), ' (', CAST(p_partkey AS STRING), ')') END AS feature"""


@query(
    "feature_select",
    f"SELECT feature FROM (SELECT {_FEATURE_NAME} FROM part) WHERE contains(feature, '(') AND contains(feature, ')')",
)
def _feature_select(t: Inputs) -> DataFrame:
    return features.select_features(t.table("part").select(F.expr(_FEATURE_NAME)))


# Feature lists of two matrices: all parts, and the parts that were ever sold.
_RIGHT_SQL = "SELECT DISTINCT l_partkey FROM lineitem"


def _sides(t: Inputs) -> tuple[DataFrame, DataFrame]:
    left = t.table("part").select(
        F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("feature")
    )
    sold = t.table("lineitem").select("l_partkey").distinct()
    right = left.join(sold, F.col("pos") == F.col("l_partkey"), "left_semi").select("feature")
    return left, right


@query(
    "shared_features",
    f"SELECT p_partkey AS pos, concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS feature FROM part WHERE p_partkey IN ({_RIGHT_SQL})",
)
def _shared_features(t: Inputs) -> DataFrame:
    return features.shared_features(*_sides(t))


@query(
    "alpha_grid",
    """SELECT e.drug_slug, l.l1_pos, l.l1_ratio, CAST(a.i AS BIGINT) AS alpha_pos,
  round(pow(CAST(10 AS DOUBLE), -3 + a.i * CAST(4 AS DOUBLE) / 49), 9) AS alpha
FROM (SELECT DISTINCT drug_slug FROM std WHERE drug_slug IS NOT NULL) e,
  (VALUES (CAST(0 AS BIGINT), CAST(0.1 AS DOUBLE)), (1, 0.5), (2, 0.9)) l(l1_pos, l1_ratio), (SELECT unnest(range(50)) AS i) a""",
    ("std",),
)
def _alpha_grid(t: Inputs) -> DataFrame:
    grid = elasticnet.penalty_grid(t.standard.where("drug_slug IS NOT NULL"), "drug_slug")
    return grid.select(
        "drug_slug",
        F.col("l1_pos").cast("bigint").alias("l1_pos"),
        "l1_ratio",
        F.col("alpha_pos").cast("bigint").alias("alpha_pos"),
        F.round("alpha", 9).alias("alpha"),
    )
