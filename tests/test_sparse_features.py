import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.catalog import wide  # noqa: F401
from dosewise.catalog.registry import QUERIES
from dosewise.operators import elasticnet
from dosewise.operators.matrices import Cells, Dense, Sparse, distinct

SCHEMA = "drug_slug string, fold bigint, features struct<places:array<int>,values:array<double>>, ln_ic50 double"


def sparse_rows(spark, x, y, names, folds):
    rows = [(n, int(f), (np.flatnonzero(v).tolist(), v[v != 0].tolist()), float(t)) for n, f, v, t in zip(names, folds, x, y, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def few_cells(n, p, seed, each=30):
    """Rows with few cells: some frequent columns, the rest of one row or none."""
    draw = np.random.default_rng(seed)
    x = np.zeros((n, p))
    for row in x:
        row[np.unique(np.append(draw.integers(0, 40, each // 2), draw.integers(40, p, each // 2)))] = draw.integers(1, 4)
    return x, x[:, :3] @ [2.0, -1.0, 0.5] + draw.normal(size=n)


def kkt_gap(x, y, w, alpha, ratio):
    pull = x.T @ (y - x @ w) - alpha * (1 - ratio) * w
    return max(np.abs(pull - alpha * ratio * np.sign(w))[w != 0].max(initial=0), (np.abs(pull)[w == 0] - alpha * ratio).max(initial=0))


@pytest.mark.parametrize("live", [None, 7])
def test_sparse_products_are_those_of_the_dense_matrix(live):
    x, r = few_cells(50, 300, 1)[0], np.random.default_rng(2).normal(size=50)
    x[:, 5] = 2.0  # no cell is 0 here
    one, mean, scale = np.linspace(0, 1, 50), x.mean(axis=0), np.linspace(1, 2, 300)
    row, place = np.nonzero(x)
    cells = Cells.of(lambda: iter([(np.bincount(row, minlength=50), place, *distinct(np.bincount(row, minlength=50), x[row, place]))]), 50, 300)
    rows = np.ones(50, bool) if live is None else np.arange(50) % live > 0
    full = Dense((x - np.outer(one, mean)) / scale * rows[:, None])
    own = Sparse(cells, one, mean, scale, None if live is None else rows)
    w, some = np.where(np.arange(300) % 3, 0, 0.5), np.array([0, 5, 7, 250, 299])
    np.testing.assert_allclose(own.pull(r * rows), full.pull(r * rows), atol=1e-12)
    np.testing.assert_allclose(own.dot(w), full.dot(w), atol=1e-12)
    np.testing.assert_allclose(own.squares(), full.squares(), atol=1e-12)
    np.testing.assert_allclose(own.outer(), full.outer(), atol=1e-12)
    np.testing.assert_allclose(own.take(some).pull(r * rows), full.take(some).pull(r * rows), atol=1e-12)
    np.testing.assert_allclose(own.products(some, some[:2]), full.products(some, some[:2]), atol=1e-12)
    np.testing.assert_allclose(own.column(5), full.column(5), atol=1e-12)


def test_a_search_over_many_features_holds_their_cells_only(spark):
    """Two hundred rows of three million features would be 4.8 GB in full, and as much for each fold."""
    x, y = few_cells(200, 5000, 3)
    folds = np.arange(200) % 4
    far = spark.createDataFrame(
        [("d", int(f), ((np.flatnonzero(v) * 600).tolist(), v[v != 0].tolist()), float(t)) for f, v, t in zip(folds, x, y, strict=True)], SCHEMA
    )
    for spread in (True, False):
        factors = elasticnet.fold_factors(far, "drug_slug", 3_000_000)
        found = elasticnet.search(factors, "drug_slug", [0.5], alphas=[0.5, 0.2], spread=spread)
        errors = {(r["alpha"], r["fold"]): r for r in elasticnet.errors_of(found, "drug_slug").collect()}
        assert len(errors) == 8 and all(r["converged"] for r in errors.values())
        scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        for (alpha, fold), row in errors.items():
            held = folds == fold
            z = x / scale
            centre, middle, root = z[~held].mean(axis=0), y[~held].mean(), np.sqrt((~held).sum())
            w = elasticnet.solve((z[~held] - centre) / root, (y[~held] - middle) / root, np.array([0.5, 0.2]), 0.5)[0][:, [0.5, 0.2].index(alpha)]
            assert row["mse"] == pytest.approx(((y[held] - middle - (z[held] - centre) @ w) ** 2).mean(), rel=1e-8)
    sizes = found.where("kind = 'model'").select(F.size("coefficients")).first()[0]
    assert sizes == 3_000_000


def test_sparse_fit_meets_its_conditions_and_scaler_is_that_of_the_rows(spark):
    x, y = few_cells(300, 20_000, 4)
    factors = elasticnet.fold_factors(sparse_rows(spark, x, y, ["d"] * 300, np.zeros(300)), "drug_slug", 20_000)
    penalty = spark.createDataFrame([("d", 0.5, 0.1)], "drug_slug string, l1_ratio double, alpha double")
    m = elasticnet.fit(factors, penalty, "drug_slug").first()
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    z = (x - x.mean(axis=0)) / scale / np.sqrt(300)
    w = np.array(m["coefficients"])
    assert m["converged"] and (w != 0).sum() > 3
    assert kkt_gap(z, (y - y.mean()) / np.sqrt(300), w, 0.1, 0.5) < 1e-8
    scaler = elasticnet.scaler_of(factors, "drug_slug").orderBy("pos").toPandas()
    np.testing.assert_allclose(scaler["mean"], x.mean(axis=0), atol=1e-12)
    np.testing.assert_allclose(scaler["scale"], scale, rtol=1e-12)


def test_many_sparse_rows_are_reduced_few_are_not(spark):
    """Of the first entity no more rows than columns are left, with the same products; one feature is a copy of another."""
    draw = np.random.default_rng(5)
    x = np.where(draw.random((500, 12)) < 0.5, draw.integers(1, 5, (500, 12)), 0).astype(float)
    x[:, 11] = x[:, 0]
    y, names = draw.normal(size=500), ["many"] * 490 + ["few"] * 10
    data = sparse_rows(spark, x, y, names, np.arange(500) % 2)
    found = elasticnet.fold_factors(data, "drug_slug", 12).collect()
    for name in ("many", "few"):
        for fold in (0, 1):
            own = [r["row"] for r in found if (r["drug_slug"], r["fold"]) == (name, fold)]
            full = np.zeros((len(own), 14))
            for k, r in enumerate(own):
                full[k, 0], full[k, -1] = r["one"], r["target"]
                full[k, np.array(r["places"], int) + 1] = r["values"]
            kept = (np.array(names) == name) & (np.arange(500) % 2 == fold)
            rows = np.column_stack([np.ones(500), x, y])[kept]
            assert len(own) == (5 if name == "few" else len(own)) and len(own) <= 14
            np.testing.assert_allclose(full.T @ full, rows.T @ rows, atol=1e-9)
    assert elasticnet.fold_factors(data.limit(0), "drug_slug", 12).count() == 0


@pytest.mark.parametrize("bad", [([0, 2], [1.0, float("nan")]), ([0, 3], [1.0, 1.0]), ([1, 0], [1.0, 1.0]), ([0], [1.0, 1.0]), ([0, None], [1.0, 1.0]), (None, None), None])
def test_bad_sparse_rows_raise_at_once(spark, bad):
    df = spark.createDataFrame([("e", 1, ([0, 2], [1.0, 2.0]), 1.0), ("e", 1, bad, 1.0)], SCHEMA)
    with pytest.raises(Exception, match="drug_slug 'e'"):
        elasticnet.fold_factors(df, "drug_slug", 3).collect()


def test_wide_queries_take_odd_texts(spark, tmp_path):
    """Texts that are missing or empty, blanks in a row, several line feeds, capitals; an id that stands twice and one that is missing."""
    rows = [(i, ("de", "en")[i % 2], f"aa B{i % 7}  aa\n\nccc{i % 5} {'aa ' * (i % 4)}", 20 + i) for i in range(40)]
    rows += [(40, "de", None, 5), (41, "en", "", 6), (42, "en", " \n ", 7), (3, "en", "aa ddd", 8), (None, "en", "aa b1", 9)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["elasticnet_cv_wide"](spark, str(tmp_path)).toPandas()
    assert found["converged"].all() and len(found) == 2 * 20 * (2 + 3)
    assert found["fold"].isin([-1, 0, 1, 2, 3]).all() and (found["fold"] == -1).sum() == 2 * 20
    got = {r["lang"]: r for r in QUERIES["elasticnet_wide"](spark, str(tmp_path)).collect()}
    assert {k: r["n_rows"] for k, r in got.items()} == {"de": 21, "en": 24} and all(r["converged"] for r in got.values())
