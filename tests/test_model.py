import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosewise.catalog import wide  # noqa: F401
from dosewise.catalog.registry import QUERIES
from dosewise.operators import elasticnet, score
from dosewise.plans import training


def frame(spark, groups, p, seed=0, signal=2):
    rng = np.random.default_rng(seed)
    rows = []
    for name, n in groups.items():
        x = rng.normal(size=(n, p))
        x[:, -1] = x[:, 0] + 0.1 * rng.normal(size=n)
        y = x[:, :signal].sum(axis=1) + rng.normal(size=n)
        rows += [(name, f"{name}{i}", int(i % 5 + 1), [float(v) for v in x[i]], float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "drug_slug string, row string, fold bigint, features array<double>, ln_ic50 double")


def arrays(df, entity):
    rows = df.where(F.col("drug_slug") == entity).orderBy("row").collect()
    return np.array([r.features for r in rows]), np.array([r.ln_ic50 for r in rows]), np.array([r.fold for r in rows])


def kkt_gap(x, y, w, b, alpha, ratio):
    slope = x.T @ (x @ w + b - y) / len(y) + alpha * (1 - ratio) * w
    return max(
        np.abs(slope + alpha * ratio * np.sign(w))[w != 0].max(initial=0),
        (np.abs(slope)[w == 0] - alpha * ratio).max(initial=0),
        abs((x @ w + b - y).mean()),
    )


@pytest.fixture(scope="module")
def data(spark):
    return frame(spark, {"hot": 400, "small": 40, "tiny": 12}, 15).cache()


def test_factors_have_the_products_of_the_rows(data):
    factors = elasticnet.fold_factors(data, "drug_slug", 15)
    found = np.array([r["row"] for r in factors.where("drug_slug = 'hot' AND fold = 2").collect()])
    x, y, fold = arrays(data, "hot")
    rows = np.column_stack([np.ones(len(y)), x, y])[fold == 2]
    assert len(found) <= 17
    assert np.allclose(found.T @ found, rows.T @ rows)
    scaler = elasticnet.scaler_of(factors, "drug_slug").where("drug_slug = 'hot'").orderBy("pos").collect()
    assert np.allclose([r["mean"] for r in scaler], x.mean(0)) and np.allclose([r["scale"] for r in scaler], x.std(0))


def standard(x):
    return (x - x.mean(0)) / x.std(0)


@pytest.mark.parametrize("ratio, alpha", [(0.1, 0.3), (0.5, 0.05), (0.9, 0.001), (1.0, 0.01), (0.5, 5.0)])
def test_fits_are_optimal(spark, data, ratio, alpha):
    factors = elasticnet.fold_factors(data, "drug_slug", 15)
    penalties = data.select("drug_slug").distinct().select("drug_slug", F.lit(ratio).alias("l1_ratio"), F.lit(alpha).alias("alpha"))
    for m in elasticnet.fit(factors, penalties, "drug_slug").collect():
        x, y, _ = arrays(data, m.drug_slug)
        assert m.converged
        assert kkt_gap(standard(x), y, np.array(m.coefficients), m.intercept, alpha, ratio) < 1e-8


def test_cross_validation_equals_refitting_every_fold(data):
    factors = elasticnet.fold_factors(data, "drug_slug", 15)
    errors = elasticnet.cross_validate(factors, "drug_slug").toPandas()
    assert len(errors) == 3 * 3 * 50 * 5 and errors.converged.all()
    x, y, fold = arrays(data, "small")
    x = standard(x)
    some = errors[(errors.drug_slug == "small")].iloc[::97]
    for row in some.itertuples():
        tr, te = fold != row.fold, fold == row.fold
        xc, yc = x[tr] - x[tr].mean(0), y[tr] - y[tr].mean()
        root = np.sqrt(tr.sum())
        w = elasticnet.solve(xc / root, yc / root, np.array([row.alpha]), row.l1_ratio)[0][:, 0]
        b = y[tr].mean() - x[tr].mean(0) @ w
        assert kkt_gap(x[tr], y[tr], w, b, row.alpha, row.l1_ratio) < 1e-8
        assert row.mse == pytest.approx(np.mean((y[te] - x[te] @ w - b) ** 2), rel=1e-8)


def test_as_wide_as_an_expression_matrix(spark):
    df = frame(spark, {"wide": 60}, 19215, seed=3, signal=5)
    factors = elasticnet.fold_factors(df, "drug_slug", 19215)
    penalties = df.select("drug_slug").distinct().select("drug_slug", F.lit(0.1).alias("l1_ratio"), F.lit(0.5).alias("alpha"))
    m = elasticnet.fit(factors, penalties, "drug_slug").first()
    x, y, _ = arrays(df, "wide")
    w = np.array(m.coefficients)
    assert m.converged and len(w) == 19215 and (w != 0).sum() > 60
    assert kkt_gap(standard(x), y, w, m.intercept, 0.5, 0.1) < 1e-8
    few = elasticnet.cross_validate(factors, "drug_slug", [0.5], n_alphas=4).toPandas()
    assert len(few) == 20 and few.converged.all()


@pytest.mark.parametrize("bad", [[1.0, None], [1.0, float("nan")], [1.0], None])
def test_bad_features_raise_at_once(spark, bad):
    rows = [("e", 1, [1.0, 2.0], 1.0), ("e", 2, bad, 2.0)]
    df = spark.createDataFrame(rows, "drug_slug string, fold bigint, features array<double>, ln_ic50 double")
    with pytest.raises(Exception, match="drug_slug 'e'"):
        elasticnet.fold_factors(df, "drug_slug", 2).collect()


def test_select_penalty_ties(spark):
    errors = spark.createDataFrame(
        [("e", 0.5, 1.0, 1, 2.0), ("e", 0.1, 1.0, 1, 2.0), ("e", 0.1, 3.0, 1, 2.0), ("e", 0.9, 9.0, 1, 2.5)],
        "drug_slug string, l1_ratio double, alpha double, fold bigint, mse double",
    )
    best = elasticnet.select_penalty(errors, "drug_slug").first()
    assert (best.l1_ratio, best.alpha) == (0.1, 3.0)


def test_evaluate_constant_target(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 1.0), ("c", 1.0, 1.5), ("c", 2.0, 1.5)],
        "drug_slug string, y double, prediction double",
    )
    got = {r.drug_slug: (r.rmse, r.r2) for r in score.evaluate(df, "drug_slug", "y").collect()}
    assert got["a"] == (0.0, 1.0) and got["b"][1] == 0.0 and got["c"] == (0.5, 0.0)


def test_whole_training(spark):
    df = frame(spark, {"a": 300, "b": 120}, 8, seed=4).drop("fold")
    run = training.train_all(df, 8, "drug_slug", ("row",))
    metrics = {r.drug_slug: r for r in run.metrics.collect()}
    assert (metrics["a"].n, metrics["b"].n) == (60, 24)
    assert metrics["a"].r2 > 0.5
    model = {r.drug_slug: r for r in run.model.collect()}
    best = run.errors.groupBy("drug_slug", "l1_ratio", "alpha").agg(F.avg("mse").alias("m")).toPandas()
    for name in ("a", "b"):
        chosen = best[best.drug_slug == name].sort_values("m").iloc[0]
        assert (model[name].l1_ratio, model[name].alpha) == (chosen.l1_ratio, chosen.alpha)
    names = spark.createDataFrame([(i, f"G{i} ({i})") for i in range(8)], "pos int, feature string")
    assert score.coefficient_table(run.model, names, "drug_slug").count() == 16
    assert score.model_table(run.model, run.scaler, names, "drug_slug").count() == 16
    record = score.metrics_record(df, run.metrics, run.model, "drug_slug", "stored").where("drug_slug = 'a'").first()
    assert (record.n_samples, record.n_features, record.test_size, record.random_state) == (300, 8, 0.2, 42)


def coordinate_descent(x, y, lasso, ridge):
    """Plain cyclic descent over all columns, apart from the library's solver."""
    w, rest, squares = np.zeros(x.shape[1]), y.copy(), (x**2).sum(axis=0)
    for _ in range(20_000):
        most = 0.0
        for j in range(x.shape[1]):
            pull = x[:, j] @ rest + squares[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - lasso, 0) / (squares[j] + ridge)
            if new != w[j]:
                rest -= x[:, j] * (new - w[j])
                most, w[j] = max(most, abs(new - w[j])), new
        if most < 1e-12:
            break
    return w


def test_wide_search_against_another_solver(spark, tmp_path):
    """Every error and the selected penalty of the wide query on a small table."""
    draw = np.random.default_rng(11)
    vocabulary = ["".join(draw.choice(list("abcdefgh"), draw.integers(1, 9))) for _ in range(60)]
    rows = [(i, ("de", "en")[i % 3 > 0], " ".join(draw.choice(vocabulary, draw.integers(5, 30)))) for i in range(70)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["elasticnet_cv_wide"](spark, str(tmp_path)).toPandas()
    assert found["converged"].all()
    for lang, own in found.groupby("lang"):
        texts = [(i, t.split()) for i, x, t in rows if x == lang]
        words = sorted({w for _, t in texts for w in t})
        x = np.array([[t.count(w) / len(t) for w in words] for _, t in texts])
        y = np.array([sum(map(len, t)) / len(t) for _, t in texts])
        z, folds = (x - x.mean(axis=0)) / x.std(axis=0), np.array([i % 4 for i, _ in texts])
        sums = {}
        for (ratio, alpha, fold), cell in own.groupby(["l1_ratio", "alpha", "fold"]):
            train = folds != fold
            n, centre, middle = train.sum(), z[train].mean(axis=0), y[train].mean()
            w = coordinate_descent((z[train] - centre) / np.sqrt(n), (y[train] - middle) / np.sqrt(n), alpha * ratio, alpha * (1 - ratio))
            error = ((y[~train] - middle - (z[~train] - centre) @ w) ** 2).mean()
            assert abs(error - cell["mse"].item()) < 1e-6
            sums[ratio, alpha] = sums.get((ratio, alpha), 0) + error
        best = own[own["selected"]][["l1_ratio", "alpha"]].drop_duplicates().to_numpy().tolist()
        assert len(own) == 2 * 20 * 4 and best == [list(min(sums, key=lambda k: (round(sums[k], 9), k[0], -k[1])))]


def test_search_in_one_exchange_or_spread(spark):
    """Both give the same errors, scalers and models; neither explodes factors."""
    draw = np.random.default_rng(4)
    rows = [(f"d{i % 3}", i % 4, draw.normal(size=9).tolist(), float(draw.normal())) for i in range(90)]
    data = spark.createDataFrame(rows, "drug_slug string, fold bigint, features array<double>, ln_ic50 double")
    factors = elasticnet.fold_factors(data, "drug_slug", 9)
    whole = elasticnet.search(factors, "drug_slug", [0.2, 0.9], 7)
    parts = elasticnet.search(factors, "drug_slug", [0.2, 0.9], 7, spread=True)
    assert "Generate" not in whole._jdf.queryExecution().toString() and "Generate" not in parts._jdf.queryExecution().toString()
    keys = ["drug_slug", "l1_ratio", "alpha", "fold"]
    a, b = (elasticnet.errors_of(f, "drug_slug").toPandas().sort_values(keys).reset_index(drop=True) for f in (whole, parts))
    assert len(a) == 3 * 2 * 7 * 4 and a["converged"].all()
    pd.testing.assert_frame_equal(a[[*keys, "mse"]], b[[*keys, "mse"]])
    assert sorted(map(tuple, elasticnet.scaler_from(whole, "drug_slug").collect())) == sorted(map(tuple, elasticnet.scaler_from(parts, "drug_slug").collect()))
    models = elasticnet.models_of(whole, "drug_slug").toPandas().set_index("drug_slug")
    chosen = elasticnet.select_penalty(elasticnet.errors_of(parts, "drug_slug"), "drug_slug")
    for m in elasticnet.fit(factors, chosen, "drug_slug").collect():
        own = models.loc[m["drug_slug"]]
        assert (own["l1_ratio"], own["alpha"]) == (m["l1_ratio"], m["alpha"])
        np.testing.assert_allclose(own["coefficients"], m["coefficients"], atol=1e-9)


def test_short_factors_are_not_merged(spark):
    rows = [("d", 0, [float(i), 1.0], 1.0) for i in range(40)]
    data = spark.createDataFrame(rows, "drug_slug string, fold bigint, features array<double>, ln_ic50 double")
    assert "Exchange" in elasticnet.fold_factors(data, "drug_slug", 2)._jdf.queryExecution().toString()
    assert "Exchange" not in elasticnet.fold_factors(data.limit(3).coalesce(1), "drug_slug", 2, merge=False)._jdf.queryExecution().executedPlan().toString().replace("Exchange SinglePartition", "")


@pytest.mark.parametrize("ratio", [0.1, 0.7, 1.0])
def test_solver_meets_all_conditions(ratio):
    """More features than rows, copies of features, features of one row; no feature with a weight is ruled out by the gap."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(40, 300))
    x[:, 100:150], x[:, 150:160] = x[:, :50], 0.0
    x[:, 200:210] = np.eye(40)[:, :1]
    y = x[:, :5] @ np.arange(1.0, 6) + draw.normal(size=40)
    x, y = (x - x.mean(axis=0)) / np.sqrt(40), (y - y.mean()) / np.sqrt(40)
    alphas = np.geomspace(3, 0.02, 25)
    weights, _, fine = elasticnet.solve(x, y, alphas, ratio)
    assert fine.all() and (weights[:, -1] != 0).any()
    for k, alpha in enumerate(alphas):
        w, lasso, ridge = weights[:, k], alpha * ratio, alpha * (1 - ratio)
        pull = x.T @ (y - x @ w) - ridge * w
        assert np.where(w != 0, np.abs(pull - lasso * np.sign(w)), np.abs(pull) - lasso).max() < 1e-7
        start = weights[:, max(0, k - 1)]
        rest = y - x @ start
        possible = elasticnet._possible(x.T @ rest - ridge * start, rest, y, start, (x**2).sum(axis=0), ridge, lasso)
        assert possible[np.abs(w) > 1e-9].all()
