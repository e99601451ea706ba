"""Entities by name, contracts in one pass, quoted line breaks in split files, probabilities in logarithms."""

import csv
import io
import math
import random

import pytest
from pyspark.sql import functions as F

from dosewise.functions import stats
from dosewise.operators import assemble, enrich, quality
from dosewise.plans import dataset
from dosewise.session import workspace
from dosewise.sources import readers, writers


def test_names_of_one_slug_stay_apart_on_disk(spark):
    names = ["Drug (A)", "Drug A", "(-)", "drug", " DRUG ", None, "other"]
    standard = assemble.standardise_response(spark.createDataFrame([(i, n, "1", "0.5") for i, n in enumerate(names)], "assay_id int, drug_name string, cosmic_raw string, ln_ic50_raw string"))
    keyed = assemble.name_entities(standard)
    found = {r["drug_name"]: r["drug_slug"] for r in keyed.collect()}
    assert found[None] is None and found["drug"] == found[" DRUG "] and found["other"] == "other"
    assert len({found[n] for n in names[:4]}) == 4 and "" not in found.values()
    path = workspace(spark)
    writers.write_entity_dataset(keyed, path)
    back = readers.read_entity_dataset(spark, path, keyed.schema)
    assert {r["drug_name"]: r["drug_slug"] for r in back.collect()} == found


def test_an_empty_slug_does_not_join_a_drug_of_the_fallback_name(spark):
    rows = spark.createDataFrame([("", 1), ("drug", 2), (None, 3)], "drug_slug string, n int")
    path = workspace(spark)
    writers.write_entity_dataset(rows, path)
    back = readers.read_entity_dataset(spark, path, rows.schema)
    assert sorted(map(tuple, back.select("drug_slug", "n").collect()), key=lambda r: r[1]) == [("", 1), ("drug", 2), (None, 3)]
    assert readers.read_entity_dataset(spark, path, rows.schema, slug="").collect()[0]["n"] == 1


def test_narrow_rows_get_the_features_of_the_wide_form(spark):
    """Also with models that stand twice in the matrix, or in the bridge."""
    response = spark.createDataFrame([(i, f"d{i % 2}", str(i % 5), str(i)) for i in range(40)], "assay_id int, drug_name string, cosmic_raw string, ln_ic50_raw string")
    metadata = spark.createDataFrame([(m, str(c)) for m, c in ((1, 1), (2, 2), (3, 3), (4, 1), (9, 4))], "model_id int, cosmic_raw string")
    matrix = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (2, [2.5]), (2, [2.0]), (3, [3.0]), (4, [4.0])], "model_id int, features array<double>")
    wide = dataset.build_dataset(response, metadata, matrix)
    narrow = dataset.build_dataset(response, metadata, matrix, narrow=True)
    assert "features" not in narrow.columns
    late = assemble.with_features(narrow, assemble.keyed_matrix(matrix)).select(wide.columns)
    assert sorted(map(str, late.collect())) == sorted(map(str, wide.collect())) and wide.count() > 40


def aligned(spark, left, right):
    features = spark.createDataFrame(left, "model_id string, features array<double>")
    target = spark.createDataFrame(right, "model_id string, y double")
    return assemble.checked_align(features, target, "model_id")


def test_contracts_are_watched_in_one_job(spark):
    good = [("a", [1.0]), ("b", [2.0])]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("align", "contracts")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # AQE runs each exchange as a job of its own
    try:
        found = aligned(spark, good, [("b", 4.0), ("a", 3.0)])
        jobs = tracker.getJobIdsForGroup("align")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    assert sorted(map(tuple, found.collect())) == [("a", [1.0], 3.0), ("b", [2.0], 4.0)]


@pytest.mark.parametrize(
    "left, right, name",
    [
        ([], [("a", 1.0)], "features_not_empty"),
        ([("a", [1.0])], [], "target_not_empty"),
        ([("a", [1.0]), (None, [2.0])], [("a", 1.0)], "features_id_not_null: 1"),
        ([("a", [1.0])], [("a", 1.0), (None, 2.0)], "target_id_not_null: 1"),
        ([("a", [1.0]), ("a", [2.0])], [("a", 1.0)], "features_id_unique"),
        ([("a", [1.0])], [("a", 1.0), ("a", 1.0)], "target_id_unique"),
        ([("a", [1.0]), ("b", [1.0])], [("a", 1.0)], "missing_in_right: 1, such as 'b'"),
        ([("a", [1.0])], [("a", 1.0), ("c", 1.0)], "missing_in_left: 1, such as 'c'"),
    ],
)
def test_broken_contracts_raise(spark, left, right, name):
    with pytest.raises(quality.ContractViolation, match=name):
        aligned(spark, left, right)


@pytest.mark.parametrize("seed", range(4))
def test_quoted_line_breaks_in_parts_of_a_file(spark, tmp_path, seed):
    """Two files with breaks, quotes and carriage returns in cells, read in parts of a few dozen bytes."""
    draw = random.Random(seed)
    every = {}
    for name in ("a", "b"):
        cell = lambda: "".join(draw.choice(['x', '"', ",", "\n", "\r\n", "ü", "\n\n", ""]) for _ in range(draw.choice([1, 3, 40])))
        rows = [[cell() + "k", cell(), cell()] for _ in range(30)]
        text = io.StringIO(newline="")
        csv.writer(text, lineterminator=draw.choice(["\n", "\r\n"])).writerows(rows)
        (tmp_path / f"{name}.csv").write_bytes(text.getvalue().encode())
        every[name] = rows
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        found = readers.quoted_records(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, rows in every.items():
        own = [r for r in found if r["file"].endswith(f"{name}.csv")]
        assert sum(r["first"] for r in own) == 1
        cells = [next(csv.reader(io.StringIO(r["record"], newline=""))) for r in own]
        assert sorted(cells) == sorted(rows) and cells[[r["first"] for r in own].index(True)] == rows[0]


def test_tails_below_the_range_of_a_double(spark):
    rows = [(250, 250, 250, 20_000), (249, 250, 250, 20_000), (3, 10, 20, 1000), (0, 10, 20, 1000), (400, 500, 450, 30_000), (10, 10, 10, 10), (5, 3, 9, 100)]
    table = spark.createDataFrame(rows, "a bigint, n bigint, k bigint, t bigint")
    for r in table.select("*", stats.hypergeometric_log_tail(F.col("a"), F.col("n"), F.col("k"), F.col("t")).alias("l")).collect():
        a, n, k, t = r["a"], r["n"], r["k"], r["t"]
        total = sum(math.comb(k, x) * math.comb(t - k, n - x) for x in range(a, min(k, n) + 1))
        if total == 0:
            assert r["l"] == -math.inf
        else:
            shift = max(0, total.bit_length() - 900)
            under = max(0, math.comb(t, n).bit_length() - 900)
            exact = math.log(total >> shift) + shift * math.log(2) - math.log(math.comb(t, n) >> under) - under * math.log(2)
            assert r["l"] == pytest.approx(exact, rel=1e-10, abs=1e-9)
    hits = spark.createDataFrame([("d", "g", f"t{i}", 249 - i, 250, 250, "x") for i in range(3)], "d string, gene_set string, term string, overlap bigint, set_size bigint, n_genes bigint, genes string")
    scored = {r["term"]: r for r in enrich.score_terms(hits, "d", 20_000).collect()}
    assert all(r["p_value"] == 0.0 and 1e3 < r["combined_score"] < math.inf for r in scored.values())
    assert scored["t0"]["ln_adj_p"] < scored["t1"]["ln_adj_p"] < scored["t2"]["ln_adj_p"]
