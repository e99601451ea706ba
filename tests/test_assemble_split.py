import random
import statistics

import pytest
from pyspark.sql import functions as F

from dosewise.operators import assemble, features, order_stats, scale, split
from dosewise.plans import dataset as dataset_plan


@pytest.fixture(scope="module")
def inputs(spark):
    response = spark.createDataFrame(
        [
            (1, " Alpha ", "10.0", "1.5"),
            (2, "alpha", " 10", "2.5"),
            (3, "ALPHA", "11", "bad"),
            (4, "beta", "11.0", "3.5"),
            (5, "beta", "nan", "4.5"),
            (6, "beta", "99", "5.5"),
            (7, None, "10", "6.5"),
        ],
        "assay_id bigint, drug_name string, cosmic_raw string, ln_ic50_raw string",
    )
    metadata = spark.createDataFrame(
        [("m1", "10.0"), ("m2", "10"), ("m3", "11.0"), ("m4", None), (None, "11")], "model_id string, cosmic_raw string"
    )
    expression = spark.createDataFrame(
        [("m1", [1.0, 2.0]), ("m2", [3.0, 4.0]), ("m3", [5.0, 6.0]), ("m3", [7.0, 8.0]), (None, [9.0, 9.0])],
        "model_id string, features array<double>",
    )
    return response, metadata, expression


def test_many_to_many_join(inputs):
    rows = dataset_plan.build_dataset(*inputs).collect()
    pairs = sorted((r.assay_id, r.depmap_model_id or "-", r.features[0]) for r in rows)
    assert pairs == [
        (1, "m1", 1.0), (1, "m2", 3.0), (2, "m1", 1.0), (2, "m2", 3.0),
        (4, "-", 9.0), (4, "m3", 5.0), (4, "m3", 7.0), (7, "m1", 1.0), (7, "m2", 3.0),
    ]
    one = dataset_plan.build_dataset(*inputs, only_entity="ALPHA ").collect()
    assert {r.assay_id for r in one} == {1, 2}
    assert {r.drug_name for r in one} == {" Alpha ", "alpha"} and {r.cell_line_id for r in one} == {"10.0", " 10"}


def test_stage_counts_match_the_join(inputs):
    response, metadata, expression = inputs
    counts = {
        r.drug_slug: r
        for r in assemble.stage_counts(
            assemble.standardise_response(response), assemble.standardise_bridge(metadata), expression, min_samples=3
        ).collect()
    }
    assert counts["alpha"].asDict() == {
        "drug_slug": "alpha", "n_entity_rows": 3, "n_with_id": 3, "n_joined": 7, "n_bad_target": 3, "n_modelled": 4, "eligible": True,
    }
    assert (counts["beta"].n_with_id, counts["beta"].n_modelled, counts[None].n_modelled) == (2, 3, 2)
    kept = dataset_plan.build_dataset(*inputs, min_samples=4)
    assert {r.drug_slug for r in kept.select("drug_slug").distinct().collect()} == {"alpha"}


def test_bridge_join_matches_missing_with_missing(inputs):
    _, metadata, expression = inputs
    got = sorted((r.model_id or "-", r.cosmic_raw or "-") for r in assemble.bridge_join(expression, metadata).collect())
    assert got == [("-", "11"), ("m1", "10.0"), ("m2", "10"), ("m3", "11.0"), ("m3", "11.0")]


def test_shared_features_and_restriction(spark):
    left = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos int, feature string")
    right = spark.createDataFrame([(0, "c"), (1, "a"), (2, "a")], "pos int, feature string")
    shared = features.shared_features(left, right)
    assert [r.feature for r in shared.orderBy("pos").collect()] == ["a", "c"]
    matrix = spark.createDataFrame([("m", [1.0, 2.0, 3.0])], "model_id string, features array<double>")
    assert features.restrict_features(matrix, shared).first().features == [1.0, 3.0]


@pytest.mark.parametrize("n, n_test, folds", [(11, 3, [2, 2, 2, 1, 1]), (15, 3, [3, 3, 2, 2, 2]), (35, 8, [6, 6, 5, 5, 5]), (3, 1, [1, 1])])
def test_split_sizes_are_exact(spark, n, n_test, folds):
    # 0.2 * 35 is a hair above 7 in floating point, so one row more is tested.
    import math

    n_test = math.ceil(0.2 * n)
    df = spark.range(n).select(F.lit("e").alias("drug_slug"), F.col("id").alias("row"))
    rows = split.assign_split(df, "drug_slug", ["row"]).collect()
    assert sum(r.split == "test" for r in rows) == n_test
    sizes = [sum(r.fold == f for r in rows) for f in range(1, 6)]
    m = n - n_test
    assert sizes == [m // 5 + (f < m % 5) for f in range(5)]
    assert all((r.fold is None) == (r.split == "test") for r in rows)


def test_split_of_hot_and_small_entities_equals_a_sort(spark):
    import hashlib
    import math

    keys = [("hot", i) for i in range(3000)] + [("a", i) for i in range(40)] + [(None, i) for i in range(7)]
    df = spark.createDataFrame(keys, "drug_slug string, row bigint")
    got = {(r.drug_slug, r.row): (r.split, r.fold) for r in split.assign_split(df, "drug_slug", ["row"], seed=7).collect()}
    assert len(got) == len(keys)
    for entity in ("hot", "a", None):
        rows = sorted((k for k in keys if k[0] == entity), key=lambda k: hashlib.md5(f"{k[1]}|7".encode()).hexdigest())
        n_test = math.ceil(0.2 * len(rows))
        m = len(rows) - n_test
        ends = [f * (m // 5) + min(f, m % 5) for f in range(1, 6)]
        for i, k in enumerate(rows):
            expected = ("test", None) if i < n_test else ("train", 1 + sum(i - n_test >= e for e in ends))
            assert got[k] == expected


def test_group_split_keeps_samples_together(spark):
    df = spark.range(300).select(F.lit("e").alias("drug_slug"), F.col("id").alias("row"), (F.col("id") % 20).alias("line"))
    rows = split.assign_split(df, "drug_slug", ["row"], group_col="line").collect()
    sides = {}
    for r in rows:
        sides.setdefault(r.line, set()).add((r.split, r.fold))
    assert all(len(s) == 1 for s in sides.values())
    assert sum(next(iter(s))[0] == "test" for s in sides.values()) == 4


def test_exact_median_with_ties_and_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.choice([1, 2, 2, 2, 5]))) for _ in range(2001)]
    rows += [("wide", rng.gauss(0, 1)) for _ in range(1000)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), (None, 3.0), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in order_stats.exact_median(df, ["g"], "v").collect()}
    groups = {g for g, _ in rows}
    expected = {g: statistics.median(v for h, v in rows if h == g and v is not None) for g in groups}
    assert got == pytest.approx(expected)


def test_scaler(spark):
    df = spark.createDataFrame([("e", [1.0, 5.0]), ("e", [3.0, 5.0])], "drug_slug string, features array<double>")
    fitted = scale.fit_scaler(df, "drug_slug")
    got = {r.pos: (r.mean, r["scale"]) for r in fitted.collect()}
    assert got == {0: (2.0, 1.0), 1: (5.0, 1.0)}
    assert sorted(r.features for r in scale.apply_scaler(df, fitted, "drug_slug").collect()) == [[-1.0, 0.0], [1.0, 0.0]]
