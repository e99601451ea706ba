import pytest

from dosewise.sources import readers, writers


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_round_trips_keep_awkward_text(spark, folder):
    rows = [("a,b", ' "quoted" ', 1.5), ("tab\tin", "  padded  ", None), ("NA", "", 2.0), (None, "null", 3.0), ("back\\slash", "x", -1e-7)]
    df = spark.createDataFrame(rows, "k string, s string, v double")
    expected = sorted((r for r in [("a,b", ' "quoted" ', 1.5), ("tab\tin", "  padded  ", None), (None, None, 2.0), (None, None, 3.0), ("back\\slash", "x", -1e-7)]), key=repr)
    for suffix, sep in ((".csv", ","), (".tsv", "\t")):
        path = f"{folder}/t{suffix}"
        writers.write_table(df, path, sep, single_file=True)
        back = readers.read_table(spark, path, schema=df.schema)
        assert sorted((tuple(r) for r in back.collect()), key=repr) == expected
    assert dict(readers.read_table(spark, f"{folder}/t.csv").dtypes)["v"] == "string"
    assert dict(readers.read_table(spark, f"{folder}/t.csv", infer=True).dtypes)["v"] == "double"


def test_reader_errors(spark, folder):
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, f"{folder}/absent.csv")
    with pytest.raises(ValueError, match="Unsupported"):
        readers.read_table(spark, f"{folder}/t.xlsx")
    with pytest.raises(ValueError, match="Unsupported"):
        readers.read_metadata(spark, f"{folder}/t.parquet")
    spark.createDataFrame([], "a string").write.parquet(f"{folder}/e.parquet")
    with pytest.raises(ValueError, match="empty"):
        readers.read_response(spark, f"{folder}/e.parquet")


def test_wide_expression(spark, folder):
    with open(f"{folder}/x.csv", "w") as f:
        f.write("G1 (1),ModelID,G2 (2)\n1.5,m1,NA\n2e1,m2,-3\n")
    matrix, names = readers.read_expression_csv(spark, f"{folder}/x.csv", "ModelID")
    assert sorted(tuple(r) for r in matrix.collect()) == [("m1", [1.5, None]), ("m2", [20.0, -3.0])]
    assert [tuple(r) for r in names.orderBy("pos").collect()] == [(0, "G1 (1)"), (1, "G2 (2)")]
    packed, same = readers.pack_features(readers.read_table(spark, f"{folder}/x.csv", infer=True), "ModelID")
    assert sorted(tuple(r) for r in packed.collect()) == [("m1", [1.5, None]), ("m2", [20.0, -3.0])]
    assert same.count() == 2


def test_entity_dataset_overwrites_only_its_partitions(spark, folder):
    schema = "drug_slug string, v int"
    path = f"{folder}/ds"
    writers.write_entity_dataset(spark.createDataFrame([("1", 1), ("b", 2), (None, 3)], schema), path)
    writers.write_entity_dataset(spark.createDataFrame([("b", 9)], schema), path)
    back = readers.read_entity_dataset(spark, path, "v int, drug_slug string")
    assert sorted(((r.drug_slug, r.v) for r in back.collect()), key=repr) == [("1", 1), ("b", 9), (None, 3)]
    assert readers.read_entity_dataset(spark, path, "v int, drug_slug string", slug="1").count() == 1


def test_gene_list_and_records(spark, folder):
    genes = spark.createDataFrame([(2, "B"), (1, "A"), (3, None), (4, " ")], "r int, symbol string")
    writers.write_gene_list(genes, f"{folder}/g.txt", order=["r"])
    assert [r.symbol for r in readers.read_gene_list(spark, f"{folder}/g.txt").collect()] == ["A", "B"]
    writers.write_gene_list(genes.where("r = 4"), f"{folder}/empty.txt")
    with pytest.raises(ValueError, match="empty"):
        readers.read_gene_list(spark, f"{folder}/empty.txt")
    record = spark.createDataFrame([("a", 1.5, None)], "drug_slug string, r2 double, rmse double")
    writers.write_records(record, f"{folder}/m")
    assert readers.read_records(spark, f"{folder}/m", record.schema).first().asDict() == {"drug_slug": "a", "r2": 1.5, "rmse": None}
    with open(f"{folder}/one.json", "w") as f:
        f.write('{\n "r2": 0.5,\n "n": 3\n}')
    assert readers.read_records(spark, f"{folder}/one.json").first().n == 3
    with open(f"{folder}/bad.json", "w") as f:
        f.write("not json")
    with pytest.raises(Exception):
        readers.read_records(spark, f"{folder}/bad.json").collect()


def test_wide_expression_quotes_and_ragged_rows(spark, folder):
    with open(f"{folder}/q.csv", "w") as f:
        f.write('"Model, ID","G1, a",G2\n"ACH,1","1.5",2\n"say ""hi""",,NA\nModel,3,4\n')
    matrix, names = readers.read_expression_csv(spark, f"{folder}/q.csv", "Model, ID")
    assert sorted(tuple(r) for r in matrix.collect()) == [("ACH,1", [1.5, 2.0]), ("Model", [3.0, 4.0]), ('say "hi"', [None, None])]
    assert [r["feature"] for r in names.orderBy("pos").collect()] == ["G1, a", "G2"]
    with open(f"{folder}/r.csv", "w") as f:
        f.write("ModelID,G1,G2\nm1,1,2\nm2,1\n")
    with pytest.raises(Exception, match="a line has 2 cells"):
        readers.read_expression_csv(spark, f"{folder}/r.csv", "ModelID")[0].collect()


def test_an_empty_name_survives_storage(spark, folder):
    path = f"{folder}/slugs"
    writers.write_entity_dataset(spark.createDataFrame([("", 1), (None, 2)], "drug_slug string, v int"), path)
    back = readers.read_entity_dataset(spark, path, "v int, drug_slug string")
    assert sorted((r["v"], r["drug_slug"]) for r in back.collect()) == [(1, "drug"), (2, None)]


def test_workers_import_the_package_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from dosewise.operators import elasticnet
rows = [("e", k % 2, [float(k), float(k * k % 7)], float(k)) for k in range(20)]
df = spark.createDataFrame(rows, "drug_slug string, fold bigint, features array<double>, ln_ic50 double")
print("ROWS", elasticnet.fold_factors(df, "drug_slug", 2).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 8" in done.stdout, done.stderr[-2000:]
