import pytest
from pyspark.sql import functions as F

from dosewise.constants import EXACT_NAMES, NOT_DETECTED, RESPONSE_ROLES
from dosewise.operators import profile, quality
from dosewise.plans import dataset as dataset_plan

# Published column names of a response release.
COLUMNS = (
    "DATASET NLME_RESULT_ID NLME_CURVE_ID COSMIC_ID CELL_LINE_NAME SANGER_MODEL_ID TCGA_DESC DRUG_ID DRUG_NAME "
    "PUTATIVE_TARGET PATHWAY_NAME COMPANY_ID WEBRELEASE MIN_CONC MAX_CONC LN_IC50 AUC RMSE Z_SCORE"
).split()


def catalogue(spark, *columns):
    return spark.createDataFrame([("t", c) for c in columns], "table_name string, column_name string")


def test_recorded_roles(spark):
    found = {r.role: r for r in profile.key_columns(catalogue(spark, *COLUMNS), RESPONSE_ROLES, {"drug_name": "DRUG_NAME"}).collect()}
    assert {k: v.detected_column for k, v in found.items()} == {
        "drug_name": "DRUG_NAME",
        "cell_line_name": "CELL_LINE_NAME",
        "cosmic_id": "COSMIC_ID",
        "ln_ic50": "LN_IC50",
        "auc": "AUC",
    }
    candidates = profile.column_candidates(catalogue(spark, *COLUMNS), RESPONSE_ROLES)
    assert {r.column_name for r in candidates.where("role = 'drug_name'").collect()} == {"DRUG_ID", "DRUG_NAME"}


def test_ambiguous_and_empty_names(spark):
    found = {r.role: r.detected_column for r in profile.key_columns(catalogue(spark, "drug", "drug id", "__"), RESPONSE_ROLES, {"drug_name": "DRUG_NAME"}).collect()}
    assert found["drug_name"] == NOT_DETECTED
    assert found["auc"] == "__"  # an empty normalised name is part of every alias


def test_required_roles_raise(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], "DRUG_NAME string, CELL_LINE_NAME string, LN_IC50 double")
    with pytest.raises(ValueError, match="cosmic_id"):
        dataset_plan.response_columns(df)
    full = df.withColumn("COSMIC_ID", F.lit("1"))
    assert dataset_plan.response_columns(full) == {"drug_name": "DRUG_NAME", "cosmic_id": EXACT_NAMES["join_id"], "ln_ic50": "LN_IC50"}
    meta = spark.createDataFrame([("a", "1", "x")], "ModelID string, COSMICID string, SangerModelID string")
    assert dataset_plan.metadata_columns(meta) == {"model_id": "ModelID", "cosmic_id": "COSMICID"}
    wide = spark.createDataFrame([("a", 1.0)], "`DepMap_ID` string, `KRAS (3845)` double")
    assert dataset_plan.expression_id_column(wide) == "DepMap_ID"


def test_schema_summary_counts_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "`x y` double, s string")
    got = {r.column_name: r for r in profile.schema_summary(df).collect()}
    assert (got["x y"].missing_count, got["x y"].non_null_count) == (2, 1)
    assert got["s"].missing_proportion == pytest.approx(1 / 3)
    empty = profile.schema_summary(df.limit(0)).collect()
    assert all(r.missing_proportion == 0.0 for r in empty)
    assert [r.column_name for r in profile.missing_top(df).collect()] == ["x y", "s"]


def test_duplicates_and_shape(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, 3.0)], "a int, b double")
    assert profile.duplicate_rows(df).first().n_duplicate_rows == 2
    assert profile.duplicate_rows(df.limit(0)).first().n_duplicate_rows == 0
    assert profile.shape(df).first().asDict() == {"n_rows": 4, "n_columns": 2}


def test_entity_summary_keeps_the_missing_group(spark):
    df = spark.createDataFrame(
        [("A", "c1", 1.0), ("A", "c1", None), ("A ", "c2", float("nan")), (None, None, 1.0)], "d string, c string, y double"
    )
    got = {r.drug_name: r for r in profile.entity_summary(df, "d", "c", "y").collect()}
    assert set(got) == {"A", "A ", None}
    assert (got["A"].n_rows, got["A"].n_unique_cell_lines, got["A"].prop_missing_ln_ic50) == (2, 1, 0.5)
    assert got[None].n_unique_cell_lines == 0
    merged = {r.drug_name: r.n_rows for r in profile.entity_summary(df, "d", "c", "y", normalise=True).collect()}
    assert merged == {"A": 3, None: 1}
    assert profile.entity_summary(df, None, "c", "y").count() == 0
    assert profile.entity_summary(df, "d", None, None).first().n_unique_cell_lines is None


def test_contracts(spark):
    df = spark.createDataFrame([("a", [1.0, None]), ("a", [1.0, 2.0]), (None, [])], "id string, features array<double>")
    one = lambda r: (r.first().n_violations, r.first().sample)
    assert one(quality.features_complete(df, "id")) == (1, "a")
    assert one(quality.id_unique(df, ["id"])) == (1, "a")
    assert one(quality.id_not_null(df, "id")) == (1, "")
    assert quality.has_features(df, "id").first().n_violations == 1
    assert one(quality.not_empty(df)) == (0, "") and one(quality.not_empty(df.limit(0))) == (1, "")
    other = spark.createDataFrame([(c,) for c in "bcdefgh"], "id string")
    sides = {r.check_name: r for r in quality.id_set_equal(df.where("id IS NOT NULL"), other, "id").collect()}
    assert (sides["missing_in_left"].n_violations, sides["missing_in_left"].sample) == (7, "b,c,d,e,f")
    assert sides["missing_in_right"].sample == "a"
    with pytest.raises(quality.ContractViolation):
        quality.enforce(quality.id_not_null(df, "id"))
    quality.enforce(quality.not_empty(df))
    with pytest.raises(quality.ContractViolation, match="missing"):
        quality.require_columns(df, ["id", "missing"])


def test_required_columns_and_reserved_names(spark):
    cat = catalogue(spark, "feature", "LN_IC50")
    row = quality.required_columns(cat, ["feature", "coefficient", "abs_coefficient"]).first()
    assert (row.n_violations, row.sample) == (2, "abs_coefficient,coefficient")
    assert quality.reserved_names(cat, "column_name").first().sample == "LN_IC50"


def test_key_overlap(spark):
    left = spark.createDataFrame([("x", "1"), ("x", "2"), ("x", "2"), ("y", "9"), ("x", None)], "drug_slug string, cosmic_id string")
    right = spark.createDataFrame([("2",), ("3",)], "cosmic_id string")
    got = {r.drug_slug: r for r in profile.key_overlap_report(left, right).collect()}
    assert (got["x"].n_response_ids, got["x"].n_shared_ids, got["x"].shared_sample, got["x"].feature_sample) == (2, 1, "2", "2,3")
    assert (got["y"].n_shared_ids, got["y"].shared_sample) == (0, "")
