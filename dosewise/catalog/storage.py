"""Readers and writers, each checked by writing derived data and reading it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.catalog.modelling import ALPHA, ENTITY, FIT_SQL, L1_RATIO, Fit, feature_names, rounded
from dosewise.catalog.ranking import _genes
from dosewise.catalog.registry import Inputs, query
from dosewise.operators import enrich, score
from dosewise.session import materialise, workspace
from dosewise.sources import readers, writers


@query("scan_parquet", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def _scan_parquet(t: Inputs) -> DataFrame:
    table = readers.read_table(t.spark, f"{t.sf_dir}/lineitem.parquet")
    return table.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


_TEXT_SQL = "SELECT assay_id, drug_name, CASE WHEN trim(cosmic_raw) <> 'nan' THEN cosmic_raw END AS cosmic_raw, ln_ic50_raw FROM (SELECT assay_id, drug_name, cosmic_raw, CASE WHEN ln_ic50_raw = 'bad' THEN ln_ic50_raw ELSE CAST(round(TRY_CAST(ln_ic50_raw AS DOUBLE) * 100) AS BIGINT)::VARCHAR END AS ln_ic50_raw FROM resp)"


def _text_round_trip(t: Inputs, suffix: str, sep: str) -> DataFrame:
    cents = F.expr("CASE WHEN ln_ic50_raw = 'bad' THEN ln_ic50_raw ELSE CAST(CAST(round(try_cast(ln_ic50_raw AS DOUBLE) * 100) AS BIGINT) AS STRING) END")
    path = f"{workspace(t.spark)}/response{suffix}"
    writers.write_table(t.response.withColumn("ln_ic50_raw", cents), path, sep)
    schema = "assay_id bigint, drug_name string, cosmic_raw string, ln_ic50_raw string"
    return readers.read_response(t.spark, path, schema)


@query("scan_csv_roundtrip", _TEXT_SQL, ("resp",))
def _csv(t: Inputs) -> DataFrame:
    return _text_round_trip(t, ".csv", ",")


@query("scan_tsv_roundtrip", _TEXT_SQL, ("resp",))
def _tsv(t: Inputs) -> DataFrame:
    return _text_round_trip(t, ".tsv", "\t")


@query(
    "documents_csv_roundtrip",
    "SELECT doc_id, text, lang, source, n_chars FROM documents",
)
def _documents_csv(t: Inputs) -> DataFrame:
    path = f"{workspace(t.spark)}/documents.csv"
    documents = t.table("documents")
    writers.write_table(documents, path)
    return readers.read_table(t.spark, path, schema=documents.schema, multiline=True)


@query(
    "per_entity_parquet_roundtrip",
    "SELECT drug_slug, count(*) AS n_rows, round(sum(ln_ic50), 4) AS total, CAST(sum(len(features)) AS BIGINT) AS n_values FROM ds GROUP BY drug_slug",
    ("ds",),
)
def _entity_parquet(t: Inputs) -> DataFrame:
    path = f"{workspace(t.spark)}/per_entity"
    writers.write_entity_dataset(t.dataset, path)
    back = readers.read_entity_dataset(t.spark, path, t.dataset.schema)
    return back.groupBy("drug_slug").agg(
        F.count("*").alias("n_rows"),
        F.round(F.sum("ln_ic50"), 4).alias("total"),
        F.sum(F.size("features")).alias("n_values"),
    )


@query(
    "entity_partition_scan",
    "SELECT assay_id, depmap_model_id, round(ln_ic50, 6) AS ln_ic50 FROM ds WHERE drug_slug = 'purchase'",
    ("ds",),
)
def _entity_partition(t: Inputs) -> DataFrame:
    path = f"{workspace(t.spark)}/per_entity"
    writers.write_entity_dataset(t.dataset, path)
    back = readers.read_entity_dataset(t.spark, path, t.dataset.schema, slug="purchase")
    return back.select("assay_id", "depmap_model_id", F.round("ln_ic50", 6).alias("ln_ic50"))


@query("gene_list_read", "SELECT symbol FROM genes", ("genes",))
def _gene_list(t: Inputs) -> DataFrame:
    path = f"{workspace(t.spark)}/genes.txt"
    genes = enrich.distinct_genes(_genes(t), ENTITY)
    writers.write_gene_list(genes, path, order=["symbol"])
    return readers.read_gene_list(t.spark, path)


@query(
    "expression_csv_roundtrip",
    """SELECT CAST(vec_id AS VARCHAR) AS model_id, CAST(pos AS BIGINT) AS pos, concat('G', pos, ' (', pos, ')') AS feature,
  round(CAST(value AS DOUBLE), 6) AS value
FROM (SELECT vec_id, unnest(embedding) AS value, unnest(range(len(embedding))) AS pos FROM embeddings)""",
)
def _expression_csv(t: Inputs) -> DataFrame:
    path = f"{workspace(t.spark)}/expression.csv"
    wide = t.expression.select(
        F.col("model_id").alias("ModelID"), *[F.col("features")[i].alias(f"G{i} ({i})") for i in range(t.n_features)]
    )
    writers.write_table(wide, path)
    matrix, names = readers.read_expression_csv(t.spark, path, "ModelID")
    long = matrix.select("model_id", F.posexplode("features").alias("pos", "value")).join(names, "pos")
    return long.select("model_id", F.col("pos").cast("bigint").alias("pos"), "feature", F.round("value", 6).alias("value"))


@query(
    "metrics_json_roundtrip",
    f"""WITH {FIT_SQL}, n AS (SELECT drug_slug, count(*) AS n_samples, CAST(max(len(features)) AS BIGINT) AS n_features FROM modelling GROUP BY ALL)
SELECT drug_slug, 'per_entity' AS dataset, n_samples, n_features, CAST(0.2 AS DOUBLE) AS test_size, CAST(42 AS BIGINT) AS random_state,
  round(r2, 4) AS r2, round(rmse, 5) AS rmse, CAST({ALPHA} AS DOUBLE) AS best_alpha, CAST({L1_RATIO} AS DOUBLE) AS best_l1_ratio
FROM n JOIN quality USING (drug_slug)""",
    ("z",),
)
def _metrics_json(t: Inputs) -> DataFrame:
    fitted = Fit(t)
    record = score.metrics_record(t.modelling, fitted.metrics, fitted.model, ENTITY, "per_entity")
    path = f"{workspace(t.spark)}/metrics"
    writers.write_records(record, path)
    back = readers.read_records(t.spark, path, record.schema)
    return rounded(rounded(back, 4, "r2"), 5, "rmse")


@query(
    "model_table",
    f"""WITH {FIT_SQL} SELECT k.drug_slug, CAST(k.j AS BIGINT) AS pos, concat('G', k.j, ' (', k.j, ')') AS feature, round(m.mean, 6) AS mean,
  round(m.scale, 6) AS scale, round(k.w, 5) AS coefficient FROM coefs k JOIN moments m ON m.drug_slug = k.drug_slug AND m.j = k.j""",
    ("z",),
)
def _model_table(t: Inputs) -> DataFrame:
    fitted = Fit(t)
    table = materialise(score.model_table(fitted.model, fitted.scaler, feature_names(t), ENTITY))
    table = table.withColumn("pos", F.col("pos").cast("bigint"))
    return rounded(rounded(table, 6, "mean", "scale"), 5, "coefficient")
