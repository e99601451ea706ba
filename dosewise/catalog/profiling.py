"""Profiles, stage counts and data contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.catalog.cleaning import _RIGHT_SQL, _sides
from dosewise.catalog.registry import Inputs, query
from dosewise.constants import EXACT_NAMES, RESPONSE_ROLES
from dosewise.functions.numbers import to_number
from dosewise.operators import assemble, features, profile, quality

_ROLE_SQL = ",\n".join(
    f"('{role}', [{', '.join(repr(a) for a in aliases)}])" for role, aliases in RESPONSE_ROLES.items()
)
_NORM = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_MATCH_SQL = f"""
SELECT c.table_name, r.role, c.column_name FROM cat c, (VALUES {_ROLE_SQL}) r(role, aliases)
WHERE len([a for a in r.aliases if contains({_NORM.format(c='c.column_name')}, {_NORM.format(c='a')})
  OR contains({_NORM.format(c='a')}, {_NORM.format(c='c.column_name')})]) > 0"""


@query("profile_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def _shape(t: Inputs) -> DataFrame:
    return profile.shape(t.table("lineitem"))


_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{d}' AS dtype, count({c}) AS non_null_count, count(*) - count({c}) AS missing_count,"
    f" round(CASE WHEN count(*) = 0 THEN 0 ELSE (count(*) - count({c})) / CAST(count(*) AS DOUBLE) END, 9) AS missing_proportion FROM std"
    for c, d in [
        ("assay_id", "bigint"),
        ("drug_slug", "string"),
        ("drug_name", "string"),
        ("cell_line_id", "string"),
        ("cosmic_id", "string"),
        ("ln_ic50", "double"),
    ]
)


@query("schema_summary", _MISSING_SQL, ("std",))
def _schema_summary(t: Inputs) -> DataFrame:
    summary = profile.schema_summary(t.standard)
    return summary.withColumn("missing_proportion", F.round("missing_proportion", 9))


@query(
    "missing_top20",
    f"SELECT column_name, missing_count FROM ({_MISSING_SQL}) ORDER BY missing_count DESC, column_name LIMIT 20",
    ("std",),
)
def _missing_top(t: Inputs) -> DataFrame:
    return profile.missing_top(t.standard)


@query(
    "duplicate_rows",
    """WITH twice AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 7 = 0)
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM twice)) AS BIGINT) AS n_duplicate_rows FROM twice""",
)
def _duplicates(t: Inputs) -> DataFrame:
    lines = t.table("lineitem")
    return profile.duplicate_rows(lines.union(lines.where("l_orderkey % 7 = 0")))


@query("column_candidates", _MATCH_SQL, ("cat",))
def _column_candidates(t: Inputs) -> DataFrame:
    return profile.column_candidates(t.catalogue, RESPONSE_ROLES)


@query(
    "key_columns",
    f"""SELECT n.table_name, r.role, count(m.column_name) AS n_candidates,
  CASE WHEN r.role = 'drug_name' AND n.has_drug THEN 'DRUG_NAME' WHEN count(m.column_name) = 1 THEN min(m.column_name)
    ELSE 'NOT_DETECTED_OR_AMBIGUOUS' END AS detected_column
FROM (SELECT table_name, bool_or(column_name = 'DRUG_NAME') AS has_drug FROM cat GROUP BY ALL) n
CROSS JOIN (VALUES {_ROLE_SQL}) r(role, aliases)
LEFT JOIN ({_MATCH_SQL}) m ON m.table_name = n.table_name AND m.role = r.role
GROUP BY n.table_name, r.role, n.has_drug""",
    ("cat",),
)
def _key_columns(t: Inputs) -> DataFrame:
    return profile.key_columns(t.catalogue, RESPONSE_ROLES, {"drug_name": EXACT_NAMES["drug_name"]})


_SUMMARY_SQL = """SELECT {name} AS drug_name, count(*) AS n_rows, count(DISTINCT cosmic_raw) AS n_unique_cell_lines,
  round(avg(CASE WHEN TRY_CAST(ln_ic50_raw AS DOUBLE) IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS prop_missing_ln_ic50
FROM resp GROUP BY {name}"""


def _summary(t: Inputs, normalise: bool) -> DataFrame:
    rows = t.response.withColumn("ln_ic50", to_number(F.col("ln_ic50_raw")))
    summary = profile.entity_summary(rows, "drug_name", "cosmic_raw", "ln_ic50", normalise)
    return summary.withColumn("prop_missing_ln_ic50", F.round("prop_missing_ln_ic50", 9))


@query("entity_summary", _SUMMARY_SQL.format(name="drug_name"), ("resp",))
def _entity_summary(t: Inputs) -> DataFrame:
    return _summary(t, normalise=False)


@query("entity_summary_normalised", _SUMMARY_SQL.format(name="trim(drug_name)"), ("resp",))
def _entity_summary_normalised(t: Inputs) -> DataFrame:
    return _summary(t, normalise=True)


@query(
    "key_overlap_report",
    """WITH l AS (SELECT DISTINCT drug_slug, cosmic_id FROM std WHERE cosmic_id IS NOT NULL),
r AS (SELECT DISTINCT cosmic_id FROM bridge JOIN embeddings ON vec_id = model_id),
f AS (SELECT l.*, r.cosmic_id IS NOT NULL AS shared,
  row_number() OVER (PARTITION BY drug_slug ORDER BY l.cosmic_id) AS a,
  row_number() OVER (PARTITION BY drug_slug, r.cosmic_id IS NOT NULL ORDER BY l.cosmic_id) AS b FROM l LEFT JOIN r USING (cosmic_id))
SELECT drug_slug, count(*) AS n_response_ids, count(*) FILTER (shared) AS n_shared_ids,
  coalesce(string_agg(cosmic_id, ',' ORDER BY cosmic_id) FILTER (a <= 10), '') AS response_sample,
  coalesce(string_agg(cosmic_id, ',' ORDER BY cosmic_id) FILTER (shared AND b <= 10), '') AS shared_sample,
  (SELECT count(*) FROM r) AS n_feature_ids,
  (SELECT string_agg(cosmic_id, ',' ORDER BY cosmic_id) FROM (SELECT cosmic_id FROM r ORDER BY 1 LIMIT 10)) AS feature_sample
FROM f GROUP BY drug_slug""",
    ("std", "bridge"),
)
def _key_overlap(t: Inputs) -> DataFrame:
    with_features = t.bridge.join(t.expression.select("model_id"), "model_id", "left_semi")
    return profile.key_overlap_report(t.standard, with_features)


@query(
    "stage_counts",
    """WITH fan AS (SELECT b.cosmic_id, count(*) AS k FROM bridge b JOIN embeddings e ON e.vec_id = b.model_id GROUP BY ALL)
SELECT drug_slug, count(*) AS n_entity_rows, count(s.cosmic_id) AS n_with_id, CAST(sum(coalesce(k, 0)) AS BIGINT) AS n_joined,
  CAST(sum(CASE WHEN ln_ic50 IS NULL THEN coalesce(k, 0) ELSE 0 END) AS BIGINT) AS n_bad_target,
  CAST(sum(CASE WHEN ln_ic50 IS NOT NULL THEN coalesce(k, 0) ELSE 0 END) AS BIGINT) AS n_modelled,
  sum(CASE WHEN ln_ic50 IS NOT NULL THEN coalesce(k, 0) ELSE 0 END) >= 100 AS eligible
FROM std s LEFT JOIN fan USING (cosmic_id) GROUP BY drug_slug""",
    ("std", "bridge"),
)
def _stage_counts(t: Inputs) -> DataFrame:
    return assemble.stage_counts(t.standard, t.bridge, t.expression, min_samples=100)


@query("dq_not_empty", "SELECT 'not_empty' AS check_name, CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_violations, '' AS sample FROM lineitem")
def _dq_not_empty(t: Inputs) -> DataFrame:
    return quality.not_empty(t.table("lineitem"))


@query(
    "dq_required_columns",
    """WITH need AS (SELECT unnest(['COSMIC-ID', 'DRUG_NAME', 'LN_IC50']) AS name), t AS (SELECT DISTINCT table_name FROM cat)
SELECT t.table_name, count(*) FILTER (c.table_name IS NULL) AS n_violations,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (c.table_name IS NULL), '') AS sample
FROM t CROSS JOIN need LEFT JOIN (SELECT DISTINCT table_name, column_name FROM cat) c ON c.table_name = t.table_name AND c.column_name = name
GROUP BY t.table_name""",
    ("cat",),
)
def _dq_required_columns(t: Inputs) -> DataFrame:
    return quality.required_columns(t.catalogue, ["DRUG_NAME", "COSMIC-ID", "LN_IC50"])


def _sample_sql(check: str, offenders: str) -> str:
    """Violation report of a one-column (``value``) list of offenders."""
    return f"""WITH bad AS ({offenders})
SELECT '{check}' AS check_name, (SELECT count(*) FROM bad) AS n_violations,
  coalesce((SELECT string_agg(value, ',' ORDER BY value) FROM
    (SELECT DISTINCT value FROM bad WHERE value IS NOT NULL ORDER BY value LIMIT 5)), '') AS sample"""


@query(
    "dq_features_complete",
    _sample_sql(
        "features_complete",
        "SELECT CAST(vec_id AS VARCHAR) AS value FROM embeddings WHERE vec_id % 11 = 0 OR len([x for x in embedding if x IS NULL]) > 0",
    ),
)
def _dq_features_complete(t: Inputs) -> DataFrame:
    damaged = t.expression.withColumn(
        "features",
        F.expr("CASE WHEN model_id % 11 = 0 THEN transform(features, (x, i) -> CASE WHEN i = 3 THEN double('NaN') ELSE x END) ELSE features END"),
    )
    return quality.features_complete(damaged, "model_id")


@query(
    "dq_target_complete",
    _sample_sql("target_complete", "SELECT CAST(assay_id AS VARCHAR) AS value FROM std WHERE ln_ic50 IS NULL"),
    ("std",),
)
def _dq_target_complete(t: Inputs) -> DataFrame:
    return quality.target_complete(t.standard, "ln_ic50", "assay_id")


@query("dq_id_not_null", _sample_sql("id_not_null", "SELECT cosmic_id AS value FROM std WHERE cosmic_id IS NULL"), ("std",))
def _dq_id_not_null(t: Inputs) -> DataFrame:
    return quality.id_not_null(t.standard, "cosmic_id")


@query(
    "dq_id_unique",
    _sample_sql(
        "id_unique",
        "SELECT concat(l_orderkey, '|', l_linenumber) AS value FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    ),
)
def _dq_id_unique(t: Inputs) -> DataFrame:
    return quality.id_unique(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "dq_id_set_equal",
    "SELECT * FROM ("
    + _sample_sql(
        "missing_in_right",
        "SELECT DISTINCT cosmic_id AS value FROM std WHERE cosmic_id NOT IN (SELECT cosmic_id FROM bridge)",
    )
    + ") UNION ALL SELECT * FROM ("
    + _sample_sql(
        "missing_in_left",
        "SELECT DISTINCT cosmic_id AS value FROM bridge WHERE cosmic_id NOT IN (SELECT cosmic_id FROM std WHERE cosmic_id IS NOT NULL)",
    )
    + ")",
    ("std", "bridge"),
)
def _dq_id_set_equal(t: Inputs) -> DataFrame:
    return quality.id_set_equal(t.standard.where("cosmic_id IS NOT NULL"), t.bridge, "cosmic_id")


@query(
    "dq_min_shared_features",
    f"""SELECT 'min_shared_features' AS check_name, CAST(CASE WHEN count(*) < 5000 THEN 1 ELSE 0 END AS BIGINT) AS n_violations,
  CAST(count(*) AS VARCHAR) AS sample FROM part WHERE p_partkey IN ({_RIGHT_SQL})""",
)
def _dq_min_shared(t: Inputs) -> DataFrame:
    return quality.min_shared_features(features.shared_features(*_sides(t)))


@query(
    "dq_reserved_names",
    _sample_sql(
        "reserved_names",
        "SELECT DISTINCT column_name AS value FROM cat WHERE column_name IN ('drug_name', 'cell_line_id', 'depmap_model_id', 'LN_IC50')",
    ),
    ("cat",),
)
def _dq_reserved(t: Inputs) -> DataFrame:
    return quality.reserved_names(t.catalogue, "column_name")


@query(
    "dq_numeric",
    _sample_sql("numeric", "SELECT CAST(assay_id AS VARCHAR) AS value FROM resp WHERE TRY_CAST(ln_ic50_raw AS DOUBLE) IS NULL"),
    ("resp",),
)
def _dq_numeric(t: Inputs) -> DataFrame:
    return quality.numeric(t.response, "ln_ic50_raw", "assay_id")


_NEEDED = {
    "events": ["event_id", "event_type", "user_id", "value"],
    "customer": ["c_custkey", "cosmic_id"],
    "embeddings": ["vec_id", "embedding"],
}


@query(
    "dq_inputs",
    """SELECT 'events' AS table_name, count(*) AS n_rows, '' AS missing_columns, CAST(0 AS BIGINT) AS n_violations FROM events
UNION ALL SELECT 'customer', count(*), 'cosmic_id', 1 FROM customer UNION ALL SELECT 'embeddings', count(*), '', 0 FROM embeddings""",
)
def _dq_inputs(t: Inputs) -> DataFrame:
    return quality.inputs_ready({name: t.table(name) for name in _NEEDED}, _NEEDED)
