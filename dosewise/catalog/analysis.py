"""Whole analyses, stored models, detected columns and matrices of two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.catalog.modelling import ENTITY, FIT_SQL, ROW, Fit, feature_names
from dosewise.catalog.registry import Inputs, query
from dosewise.operators import assemble, features, quality, score
from dosewise.plans import dataset, training
from dosewise.session import workspace
from dosewise.sources import readers, writers

MIN_SAMPLES = 1400


@query(
    "metadata_csv_roundtrip",
    "SELECT CAST(model_id AS VARCHAR) AS model_id, cosmic_raw FROM meta",
    ("meta",),
)
def _metadata_csv(t: Inputs) -> DataFrame:
    path = f"{workspace(t.spark)}/models.csv"
    writers.write_table(t.metadata, path)
    return readers.read_metadata(t.spark, path)


@query(
    "eligible_dataset",
    f"""SELECT assay_id, drug_slug, drug_name, depmap_model_id, round(ln_ic50, 6) AS ln_ic50 FROM ds
WHERE drug_slug IN (SELECT drug_slug FROM ds GROUP BY drug_slug HAVING count(*) >= {MIN_SAMPLES})""",
    ("ds",),
)
def _eligible(t: Inputs) -> DataFrame:
    rows = dataset.build_dataset(t.response, t.metadata, t.expression, min_samples=MIN_SAMPLES)
    return rows.select("assay_id", "drug_slug", "drug_name", "depmap_model_id", F.round("ln_ic50", 6).alias("ln_ic50"))


@query(
    "dq_has_features",
    """SELECT 'has_features' AS check_name, count(*) AS n_violations,
  coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT CAST(vec_id AS VARCHAR) AS v FROM embeddings WHERE vec_id % 10 = 3 ORDER BY v LIMIT 5)), '') AS sample
FROM embeddings WHERE vec_id % 10 = 3""",
)
def _has_features(t: Inputs) -> DataFrame:
    some = F.when(F.col("model_id") % 10 == 3, F.array().cast("array<double>")).otherwise(F.col("features"))
    return quality.has_features(t.expression.withColumn("features", some), "model_id")


@query("detect_metadata_roles", "SELECT model_id, cosmic_id FROM bridge", ("bridge",))
def _metadata_roles(t: Inputs) -> DataFrame:
    table = t.metadata.select(F.col("model_id").alias("ModelID"), F.lit("x").alias("Cell line name"), F.col("cosmic_raw").alias("COSMICID"))
    found = dataset.metadata_columns(table)
    return assemble.standardise_bridge(table, found["model_id"], found["cosmic_id"])


@query("detect_expression_roles", "SELECT vec_id AS model_id, CAST(len(embedding) AS BIGINT) AS n_features FROM embeddings")
def _expression_roles(t: Inputs) -> DataFrame:
    table = t.expression.select(F.lit(1).alias("profile"), F.col("model_id").alias("DepMap_ID"), "features")
    found = dataset.expression_id_column(table)
    return table.select(F.col(found).alias("model_id"), F.size("features").cast("bigint").alias("n_features"))


@query(
    "shared_matrices",
    """SELECT side, vec_id AS model_id, CAST(pos AS BIGINT) AS pos, round(CAST(embedding[2 * pos + 1] AS DOUBLE), 6) AS value
FROM embeddings, (SELECT unnest(range(32)) AS pos), (VALUES ('left'), ('right')) s(side)""",
)
def _shared_matrices(t: Inputs) -> DataFrame:
    """All features on the left; the even ones, in reverse order, on the right."""
    names = feature_names(t)
    even = names.where("pos % 2 = 0").select(((t.n_features - 2 - F.col("pos")) / 2).cast("int").alias("pos"), "feature")
    right = t.expression.withColumn("features", F.reverse(F.filter("features", lambda _, i: i % 2 == 0)))
    left_cut, right_cut, _ = features.shared_matrices(t.expression, names, right, even)
    both = left_cut.withColumn("side", F.lit("left")).unionByName(right_cut.withColumn("side", F.lit("right")))
    long = both.select("side", "model_id", F.posexplode("features").alias("pos", "value"))
    return long.select("side", "model_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query(
    "expression_csv_quoted",
    """SELECT concat('AC"H,', vec_id) AS model_id, CAST(pos AS BIGINT) AS pos, concat('G', pos, ', "x" (', pos, ')') AS feature,
  round(CAST(value AS DOUBLE), 6) AS value
FROM (SELECT vec_id, unnest(embedding) AS value, unnest(range(len(embedding))) AS pos FROM embeddings)""",
)
def _expression_quoted(t: Inputs) -> DataFrame:
    path = f"{workspace(t.spark)}/expression.csv"
    values = [F.col("features")[i].alias(f'G{i}, "x" ({i})') for i in range(t.n_features)]
    wide = t.expression.select(F.concat(F.lit('AC"H,'), F.col("model_id").cast("string")).alias('Model, "ID"'), *values)
    writers.write_table(wide, path)
    matrix, names = readers.read_expression_csv(t.spark, path, 'Model, "ID"')
    long = matrix.select("model_id", F.posexplode("features").alias("pos", "value")).join(names, "pos")
    return long.select("model_id", F.col("pos").cast("bigint").alias("pos"), "feature", F.round("value", 6).alias("value"))


_KEYS = """SELECT DISTINCT lower(trim(drug_name)) AS drug_key FROM (
  SELECT CASE assay_id % 4 WHEN 0 THEN drug_name || ' (a)' WHEN 1 THEN drug_name || '-A' WHEN 2 THEN '(-)' ELSE drug_name END AS drug_name FROM resp WHERE drug_name IS NOT NULL)"""


@query(
    "entity_key_collisions",
    f"""WITH k AS ({_KEYS}), s AS (SELECT drug_key, CASE WHEN slug = '' THEN 'drug' ELSE slug END AS slug FROM
  (SELECT drug_key, regexp_replace(regexp_replace(drug_key, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM k))
SELECT drug_key, CASE WHEN count(*) OVER (PARTITION BY slug) > 1 THEN concat(slug, '_', left(sha256(drug_key), 8)) ELSE slug END AS storage_name,
  count(*) OVER (PARTITION BY slug) AS n_keys FROM s""",
    ("resp",),
)
def _collisions(t: Inputs) -> DataFrame:
    name = F.expr(
        "CASE assay_id % 4 WHEN 0 THEN concat(drug_name, ' (a)') WHEN 1 THEN concat(drug_name, '-A') WHEN 2 THEN CASE WHEN drug_name IS NOT NULL THEN '(-)' END ELSE drug_name END"
    )
    return assemble.storage_names(t.response.withColumn("drug_name", name))


@query(
    "model_store_score",
    f"WITH {FIT_SQL} SELECT drug_slug, assay_id, depmap_model_id, round(prediction, 4) AS prediction FROM scored",
    ("z",),
)
def _model_store(t: Inputs) -> DataFrame:
    fitted = Fit(t)
    path = f"{workspace(t.spark)}/models"
    writers.write_models(fitted.raw, feature_names(t), "ln_ic50", path, ENTITY)
    stored = readers.read_models(t.spark, path, ENTITY)
    scored = score.predict(fitted.rows.where("split = 'test'"), stored, ENTITY)
    return scored.select(ENTITY, *ROW, F.round("prediction", 4).alias("prediction"))


@query(
    "expression_csv_multiline",
    """SELECT concat('AC"H', chr(10), ',', vec_id, CASE WHEN vec_id % 3 = 0 THEN chr(10) || chr(10) || '"' ELSE '' END) AS model_id, CAST(pos AS BIGINT) AS pos,
  concat('G', pos, ', "x"', chr(10), '(', pos, ')') AS feature, round(CAST(value AS DOUBLE), 6) AS value
FROM (SELECT vec_id, unnest(embedding) AS value, unnest(range(len(embedding))) AS pos FROM embeddings)""",
)
def _expression_multiline(t: Inputs) -> DataFrame:
    """Line breaks and quotes in header and cells; the file is read in parts that begin inside quotes too."""
    path = f"{workspace(t.spark)}/expression.csv"
    values = [F.col("features")[i].alias(f'G{i}, "x"\n({i})') for i in range(t.n_features)]
    name = F.concat(F.lit('AC"H\n,'), F.col("model_id").cast("string"), F.when(F.col("model_id") % 3 == 0, '\n\n"').otherwise(""))
    writers.write_table(t.expression.select(name.alias('Model, "ID"'), *values), path)
    matrix, names = readers.read_expression_csv(t.spark, path, 'Model, "ID"', multiline=True)
    long = matrix.select("model_id", F.posexplode("features").alias("pos", "value")).join(names, "pos")
    return long.select("model_id", F.col("pos").cast("bigint").alias("pos"), "feature", F.round("value", 6).alias("value"))


@query("align_checked", "SELECT vec_id AS model_id, CAST(len(embedding) AS BIGINT) AS n_features, round(vec_id * CAST(0.5 AS DOUBLE), 1) AS y FROM embeddings")
def _align_checked(t: Inputs) -> DataFrame:
    """Both sides cut to their shared features, and the left one aligned with a target under its contracts."""
    target = t.expression.select("model_id", (F.col("model_id") * 0.5).alias("y"))
    names = feature_names(t)
    rows, _, _ = dataset.aligned_pair(t.expression, names, t.expression, names, target, minimum=t.n_features)
    return rows.select("model_id", F.size("features").cast("bigint").alias("n_features"), F.round("y", 1).alias("y"))


_NAMES_SQL = "CASE assay_id % 4 WHEN 0 THEN 'Drug (A)' WHEN 1 THEN 'Drug A' WHEN 2 THEN '(-)' ELSE ' DRUG ' END"
_KEY_SQL = "CASE assay_id % 4 WHEN 0 THEN 'drug (a)' WHEN 1 THEN 'drug a' WHEN 2 THEN '(-)' ELSE 'drug' END"


@query(
    "entity_names_trained",
    f"""WITH named AS (SELECT {_KEY_SQL} AS drug_key, assay_id, depmap_model_id, ln_ic50, CASE assay_id % 4 WHEN 0 THEN 'drug_a' WHEN 1 THEN 'drug_a' ELSE 'drug' END AS slug FROM ds),
o AS (SELECT *, row_number() OVER (PARTITION BY drug_key ORDER BY md5(concat(assay_id, '|', depmap_model_id, '|42'))) AS pos,
  CAST(ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY drug_key)) AS BIGINT) AS n_test FROM named)
SELECT concat(any_value(slug), '_', left(sha256(drug_key), 8)) AS drug_slug, drug_key, count(*) AS n_rows, min(n_test) AS n_tested,
  round(avg(CASE WHEN pos > n_test THEN ln_ic50 END), 5) AS intercept, CAST(64 AS BIGINT) AS n_ranked FROM o GROUP BY drug_key""",
    ("ds",),
)
def _entity_names(t: Inputs) -> DataFrame:
    """Four names of two slugs through dataset, storage, training and ranking. Features are scaled on the training rows, so the
    intercept of a model is their mean target."""
    response = t.response.withColumn("drug_name", F.expr(_NAMES_SQL))
    rows = dataset.build_dataset(response, t.metadata, t.expression, narrow=True)
    path = f"{workspace(t.spark)}/per_entity"
    writers.write_entity_dataset(rows, path)
    stored = readers.read_entity_dataset(t.spark, path, rows.schema)
    run = training.train_all(stored, t.n_features, matrix=assemble.keyed_matrix(t.expression), l1_ratios=[0.5], n_alphas=6)
    ranked = score.coefficient_table(run.model, feature_names(t), "drug_slug").groupBy("drug_slug").agg(F.count("*").alias("n_ranked"))
    sizes = stored.groupBy("drug_slug", F.lower(F.trim("drug_name")).alias("drug_key")).agg(F.count("*").alias("n_rows"))
    tested = run.metrics.select("drug_slug", F.col("n").alias("n_tested"))
    return sizes.join(tested, "drug_slug").join(run.model.select("drug_slug", F.round("intercept", 5).alias("intercept")), "drug_slug").join(ranked, "drug_slug")
