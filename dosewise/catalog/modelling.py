"""Split, scaling, elastic net, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.catalog.registry import Inputs, query
from dosewise.operators import assemble, elasticnet, scale, score, split
from dosewise.plans import training
from dosewise.session import materialise

ENTITY = "drug_slug"
ROW = ["assay_id", "depmap_model_id"]


def _parts(t: Inputs) -> DataFrame:
    points = materialise(split.split_points(t.modelling, ENTITY, ROW))
    return split.assign_split(t.modelling, ENTITY, ROW, points=points)


def _scaled(t: Inputs) -> DataFrame:
    rows = _parts(t)
    return scale.apply_scaler(rows, scale.fit_scaler(rows.where("split = 'train'"), ENTITY), ENTITY)


@query("train_test_split", "SELECT drug_slug, assay_id, depmap_model_id, split FROM parts", ("parts",))
def _split(t: Inputs) -> DataFrame:
    return _parts(t).select(ENTITY, *ROW, "split")


@query(
    "kfold_assign",
    "SELECT drug_slug, assay_id, depmap_model_id, fold FROM parts WHERE split = 'train'",
    ("parts",),
)
def _kfold(t: Inputs) -> DataFrame:
    return _parts(t).where("split = 'train'").select(ENTITY, *ROW, "fold")


@query(
    "train_test_split_grouped",
    """WITH g AS (SELECT DISTINCT drug_slug, depmap_model_id FROM modelling),
o AS (SELECT *, row_number() OVER (PARTITION BY drug_slug ORDER BY md5(concat(depmap_model_id, '|42'))) AS pos,
  ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY drug_slug)) AS n_test FROM g)
SELECT m.drug_slug, m.assay_id, m.depmap_model_id, CASE WHEN pos <= n_test THEN 'test' ELSE 'train' END AS split
FROM modelling m JOIN o ON o.drug_slug = m.drug_slug AND o.depmap_model_id = m.depmap_model_id""",
    ("modelling",),
)
def _grouped(t: Inputs) -> DataFrame:
    rows = split.assign_split(t.modelling, ENTITY, ROW, group_col="depmap_model_id")
    return rows.select(ENTITY, *ROW, "split")


@query(
    "scaler_fit",
    "SELECT drug_slug, CAST(j AS BIGINT) AS pos, round(mean, 9) AS mean, round(scale, 9) AS scale FROM moments",
    ("moments",),
)
def _scaler_fit(t: Inputs) -> DataFrame:
    fitted = scale.fit_scaler(_parts(t).where("split = 'train'"), ENTITY)
    return fitted.select(
        ENTITY, F.col("pos").cast("bigint").alias("pos"), F.round("mean", 9).alias("mean"), F.round("scale", 9).alias("scale")
    )


@query(
    "scaler_transform",
    "SELECT drug_slug, assay_id, depmap_model_id, split, CAST(j AS BIGINT) AS pos, round(z, 6) AS z FROM z",
    ("z",),
)
def _scaler_transform(t: Inputs) -> DataFrame:
    return _scaled(t).select(
        ENTITY, *ROW, "split", F.posexplode("features").alias("pos", "z")
    ).select(ENTITY, *ROW, "split", F.col("pos").cast("bigint").alias("pos"), F.round("z", 6).alias("z"))


# A model stated by rule, so that scoring can be checked apart from fitting.
_RULE_SQL = """rule AS (SELECT drug_slug, j, (j * 7 + length(drug_slug) * 3) % 11 / CAST(10 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS w,
  length(drug_slug) / CAST(10 AS DOUBLE) AS b FROM (SELECT DISTINCT drug_slug FROM modelling), (SELECT unnest(range(64)) AS j)),
scored AS (SELECT z.drug_slug, z.assay_id, z.depmap_model_id, z.split, z.ln_ic50, sum(z.z * r.w) + min(r.b) AS prediction
  FROM z JOIN rule r ON r.drug_slug = z.drug_slug AND r.j = z.j GROUP BY ALL)"""


def _rule_model(t: Inputs) -> DataFrame:
    length = F.length(ENTITY)
    weights = F.transform(
        F.sequence(F.lit(0), F.lit(t.n_features - 1)), lambda j: (j * 7 + length * 3) % 11 / F.lit(10.0) - F.lit(0.5)
    )
    entities = t.standard.where("drug_slug IS NOT NULL").select(ENTITY).distinct()
    return entities.select(ENTITY, (length / F.lit(10.0)).alias("intercept"), weights.alias("coefficients"))


@query(
    "predict",
    f"WITH {_RULE_SQL} SELECT drug_slug, assay_id, depmap_model_id, split, round(prediction, 6) AS prediction FROM scored",
    ("z",),
)
def _predict(t: Inputs) -> DataFrame:
    scored = score.predict(_scaled(t), _rule_model(t), ENTITY)
    return scored.select(ENTITY, *ROW, "split", F.round("prediction", 6).alias("prediction"))


@query(
    "regression_metrics",
    f"""WITH {_RULE_SQL} SELECT drug_slug, count(*) AS n, round(sqrt(avg(pow(ln_ic50 - prediction, 2))), 6) AS rmse,
  round(1 - sum(pow(ln_ic50 - prediction, 2)) / (var_pop(ln_ic50) * count(*)), 5) AS r2 FROM scored WHERE split = 'test' GROUP BY drug_slug""",
    ("z",),
)
def _metrics(t: Inputs) -> DataFrame:
    scored = score.predict(_scaled(t).where("split = 'test'"), _rule_model(t), ENTITY)
    metrics = score.evaluate(scored, ENTITY, "ln_ic50")
    return metrics.select(ENTITY, "n", F.round("rmse", 6).alias("rmse"), F.round("r2", 5).alias("r2"))


@query(
    "model_select",
    """WITH g AS (SELECT l_suppkey AS drug_slug, CASE l_linenumber % 3 WHEN 0 THEN CAST(0.1 AS DOUBLE) WHEN 1 THEN 0.5 ELSE 0.9 END AS l1_ratio,
  CAST(l_quantity AS DOUBLE) AS alpha, avg(l_tax) AS mean_mse FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY drug_slug ORDER BY round(mean_mse, 12), l1_ratio, alpha DESC) AS k FROM g)
SELECT drug_slug, l1_ratio, alpha, round(mean_mse, 9) AS mean_mse FROM r WHERE k = 1""",
)
def _select(t: Inputs) -> DataFrame:
    errors = t.table("lineitem").select(
        F.col("l_suppkey").alias(ENTITY),
        F.expr("CASE l_linenumber % 3 WHEN 0 THEN 0.1D WHEN 1 THEN 0.5D ELSE 0.9D END").alias("l1_ratio"),
        F.col("l_quantity").alias("alpha"),
        F.col("l_tax").alias("mse"),
    )
    best = elasticnet.select_penalty(errors, ENTITY)
    return best.withColumn("mean_mse", F.round("mean_mse", 9))


# --- One stated penalty: fits that plain SQL can repeat by many small proximal steps.

L1_RATIO, ALPHA = 0.5, 0.05
FIT_SQL = f"""RECURSIVE t AS MATERIALIZED (SELECT drug_slug, assay_id, depmap_model_id, j, z, ln_ic50 AS y FROM z WHERE split = 'train'),
g AS MATERIALIZED (SELECT drug_slug, list(r ORDER BY i) AS gram, max(total) AS top FROM
  (SELECT a.drug_slug, a.j AS i, list(a.v ORDER BY a.k) AS r, sum(abs(a.v)) AS total FROM
    (SELECT p.drug_slug, p.j, q.j AS k, avg(p.z * q.z) - avg(p.z) * avg(q.z) AS v FROM t p
     JOIN t q ON q.drug_slug = p.drug_slug AND q.assay_id = p.assay_id AND q.depmap_model_id = p.depmap_model_id GROUP BY ALL) a
   GROUP BY ALL) GROUP BY drug_slug),
c AS MATERIALIZED (SELECT drug_slug, list(v ORDER BY j) AS slope, list(m ORDER BY j) AS x_mean, max(y_mean) AS y_mean FROM
  (SELECT drug_slug, j, avg(z * y) - avg(z) * avg(y) AS v, avg(z) AS m, avg(y) AS y_mean FROM t GROUP BY ALL) GROUP BY drug_slug),
fit AS (
  SELECT drug_slug, 0 AS step, [CAST(0 AS DOUBLE) for m in slope] AS w FROM c
  UNION ALL
  SELECT drug_slug, step + 1, [sign(u) * greatest(abs(u) - {ALPHA * L1_RATIO} / top, 0) / (1 + {ALPHA * (1 - L1_RATIO)} / top) for u in u]
  FROM (SELECT f.drug_slug, f.step, g.top,
          [f.w[i] - (list_dot_product(g.gram[i], f.w) - c.slope[i]) / g.top for i in range(1, len(f.w) + 1)] AS u
        FROM fit f JOIN g USING (drug_slug) JOIN c USING (drug_slug) WHERE f.step < 2000)),
final AS (SELECT f.drug_slug, f.w, c.y_mean - list_dot_product(f.w, c.x_mean) AS b FROM fit f JOIN c USING (drug_slug) WHERE f.step = 2000),
coefs AS (SELECT drug_slug, b, CASE WHEN abs(w) < 5e-6 THEN CAST(0 AS DOUBLE) ELSE w END AS w, j FROM
  (SELECT drug_slug, b, unnest(w) AS w, unnest(range(len(w))) AS j FROM final)),
scored AS (SELECT z.drug_slug, z.assay_id, z.depmap_model_id, z.ln_ic50, sum(z.z * k.w) + min(k.b) AS prediction
  FROM z JOIN coefs k ON k.drug_slug = z.drug_slug AND k.j = z.j WHERE z.split = 'test' GROUP BY ALL),
quality AS (SELECT drug_slug, sqrt(avg(pow(ln_ic50 - prediction, 2))) AS rmse,
  1 - sum(pow(ln_ic50 - prediction, 2)) / (var_pop(ln_ic50) * count(*)) AS r2 FROM scored GROUP BY drug_slug)"""


class Fit:
    """All entities fitted with the one stated penalty."""

    def __init__(self, t: Inputs):
        rows = _parts(t)
        self.rows = rows
        factors = materialise(elasticnet.fold_factors(rows.where("split = 'train'"), ENTITY, t.n_features))
        self.scaler = materialise(elasticnet.scaler_of(factors, ENTITY))
        penalties = self.scaler.select(
            ENTITY, F.lit(L1_RATIO).alias("l1_ratio"), F.lit(ALPHA).alias("alpha")
        ).distinct()
        self.model = materialise(elasticnet.fit(factors, penalties, ENTITY))
        self.raw = materialise(elasticnet.raw_model(self.model, self.scaler, ENTITY))

    @property
    def metrics(self) -> DataFrame:
        test = self.rows.where("split = 'test'")
        return score.evaluate(score.predict(test, self.raw, ENTITY), ENTITY, "ln_ic50")


def feature_names(t: Inputs) -> DataFrame:
    """Feature names by position: G<pos> (<pos>)."""
    return t.spark.range(t.n_features).select(F.col("id").cast("int").alias("pos")).select("pos", F.format_string("G%d (%d)", "pos", "pos").alias("feature"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "elasticnet_coefficients",
    f"WITH {FIT_SQL} SELECT drug_slug, CAST(j AS BIGINT) AS pos, round(w, 5) AS coefficient, round(b, 5) AS intercept FROM coefs",
    ("z",),
)
def _coefficients(t: Inputs) -> DataFrame:
    model = Fit(t).model.select(ENTITY, F.posexplode("coefficients").alias("pos", "coefficient"), "intercept")
    model = model.withColumn("pos", F.col("pos").cast("bigint"))
    return rounded(model, 5, "coefficient", "intercept")


@query(
    "coefficient_table",
    f"""WITH {FIT_SQL} SELECT drug_slug, concat('G', j, ' (', j, ')') AS feature, round(w, 5) AS coefficient,
  round(abs(w), 5) AS abs_coefficient FROM coefs""",
    ("z",),
)
def _coefficient_table(t: Inputs) -> DataFrame:
    table = score.coefficient_table(Fit(t).model, feature_names(t), ENTITY)
    return rounded(table, 5, "coefficient", "abs_coefficient")


# --- Cross-validated fits: 3 x 50 penalties and 5 folds per entity. The SQL takes many accelerated proximal steps.

_STEPS = 260
CV_SQL = f"""RECURSIVE t AS MATERIALIZED (SELECT drug_slug, assay_id, depmap_model_id, fold, j, z, ln_ic50 AS y FROM z WHERE split = 'train'),
prod AS MATERIALIZED (SELECT drug_slug, fold, j, k, sum(zz) AS s FROM
  (SELECT p.drug_slug, p.fold, p.j, q.j AS k, p.z * q.z AS zz FROM t p
   JOIN t q ON q.drug_slug = p.drug_slug AND q.assay_id = p.assay_id AND q.depmap_model_id = p.depmap_model_id) GROUP BY ALL),
lin AS MATERIALIZED (SELECT drug_slug, fold, j, count(*) AS n, sum(z) AS sz, sum(y) AS sy, sum(z * y) AS szy FROM t GROUP BY ALL),
rest_lin AS MATERIALIZED (SELECT a.drug_slug, a.fold, a.j, sum(b.n) AS n, sum(b.sz) AS sz, sum(b.sy) AS sy, sum(b.szy) AS szy
  FROM lin a JOIN lin b ON b.drug_slug = a.drug_slug AND b.j = a.j AND b.fold <> a.fold GROUP BY ALL),
rest AS (SELECT a.drug_slug, a.fold, a.j, a.k, sum(b.s) AS s FROM prod a
  JOIN prod b ON b.drug_slug = a.drug_slug AND b.j = a.j AND b.k = a.k AND b.fold <> a.fold GROUP BY ALL),
g AS MATERIALIZED (SELECT drug_slug, fold, list(r ORDER BY j) AS gram, max(total) AS top FROM
  (SELECT drug_slug, fold, j, list(v ORDER BY k) AS r, sum(abs(v)) AS total FROM
    (SELECT r.drug_slug, r.fold, r.j, r.k, r.s / x.n - x.sz / x.n * (y.sz / y.n) AS v FROM rest r
     JOIN rest_lin x ON x.drug_slug = r.drug_slug AND x.fold = r.fold AND x.j = r.j
     JOIN rest_lin y ON y.drug_slug = r.drug_slug AND y.fold = r.fold AND y.j = r.k) GROUP BY ALL) GROUP BY ALL),
c AS MATERIALIZED (SELECT drug_slug, fold, list(szy / n - sz / n * (sy / n) ORDER BY j) AS slope, list(sz / n ORDER BY j) AS x_mean, max(sy / n) AS y_mean
  FROM rest_lin GROUP BY ALL),
fit AS (
  SELECT drug_slug, fold, l1_ratio, i, pow(CAST(10 AS DOUBLE), -3 + i * CAST(4 AS DOUBLE) / 49) AS alpha, 0 AS step,
    [CAST(0 AS DOUBLE) for m in slope] AS w, [CAST(0 AS DOUBLE) for m in slope] AS v
  FROM c, (SELECT unnest([0.1, 0.5, 0.9]) :: DOUBLE AS l1_ratio), (SELECT unnest(range(50)) AS i)
  UNION ALL
  SELECT drug_slug, fold, l1_ratio, i, alpha, step + 1, nw, [nw[x] + 0.8 :: DOUBLE * (nw[x] - w[x]) for x in range(1, len(w) + 1)] FROM (
    SELECT drug_slug, fold, l1_ratio, i, alpha, step, w,
      [sign(u) * greatest(abs(u) - alpha * l1_ratio / top, 0) / (1 + alpha * (1 - l1_ratio) / top) for u in u] AS nw
    FROM (SELECT f.*, g.top, [f.v[x] - (list_dot_product(g.gram[x], f.v) - c.slope[x]) / g.top for x in range(1, len(f.v) + 1)] AS u
          FROM fit f JOIN g ON g.drug_slug = f.drug_slug AND g.fold = f.fold JOIN c ON c.drug_slug = f.drug_slug AND c.fold = f.fold
          WHERE f.step < {_STEPS}))),
best AS MATERIALIZED (SELECT f.drug_slug, f.fold, f.l1_ratio, f.alpha, f.w, c.y_mean - list_dot_product(f.w, c.x_mean) AS b
  FROM fit f JOIN c ON c.drug_slug = f.drug_slug AND c.fold = f.fold WHERE f.step = {_STEPS}),
held AS MATERIALIZED (SELECT drug_slug, fold, assay_id, depmap_model_id, list(z ORDER BY j) AS x, max(y) AS y FROM t GROUP BY ALL)"""


def _train(t: Inputs) -> training.Training:
    return training.train_all(t.modelling, t.n_features, ENTITY, tuple(ROW))


@query(
    "elasticnet_cv",
    f"""WITH {CV_SQL} SELECT m.drug_slug, m.l1_ratio, round(m.alpha, 9) AS alpha, m.fold,
  round(avg(pow(h.y - m.b - list_dot_product(h.x, m.w), 2)), 6) AS mse
FROM best m JOIN held h ON h.drug_slug = m.drug_slug AND h.fold = m.fold GROUP BY m.drug_slug, m.l1_ratio, m.alpha, m.fold""",
    ("z",),
)
def _cv(t: Inputs) -> DataFrame:
    errors = _train(t).errors.select(ENTITY, "l1_ratio", "alpha", "fold", "mse")
    return rounded(rounded(errors, 6, "mse"), 9, "alpha")


MODEL_SQL = f"""{CV_SQL},
sel AS MATERIALIZED (SELECT drug_slug, l1_ratio, alpha FROM (
  SELECT *, row_number() OVER (PARTITION BY drug_slug ORDER BY mean_mse, l1_ratio, alpha DESC) AS nth FROM (
    SELECT drug_slug, l1_ratio, alpha, avg(mse) AS mean_mse FROM (
      SELECT m.drug_slug, m.l1_ratio, m.alpha, m.fold, avg(pow(h.y - m.b - list_dot_product(h.x, m.w), 2)) AS mse
      FROM best m JOIN held h ON h.drug_slug = m.drug_slug AND h.fold = m.fold GROUP BY ALL) GROUP BY ALL)) WHERE nth = 1),
all_lin AS MATERIALIZED (SELECT drug_slug, j, sum(n) AS n, sum(sz) AS sz, sum(sy) AS sy, sum(szy) AS szy FROM lin GROUP BY ALL),
all_g AS MATERIALIZED (SELECT drug_slug, list(r ORDER BY j) AS gram, max(total) AS top FROM
  (SELECT drug_slug, j, list(v ORDER BY k) AS r, sum(abs(v)) AS total FROM
    (SELECT p.drug_slug, p.j, p.k, p.s / x.n - x.sz / x.n * (y.sz / y.n) AS v
     FROM (SELECT drug_slug, j, k, sum(s) AS s FROM prod GROUP BY ALL) p
     JOIN all_lin x ON x.drug_slug = p.drug_slug AND x.j = p.j JOIN all_lin y ON y.drug_slug = p.drug_slug AND y.j = p.k)
   GROUP BY ALL) GROUP BY drug_slug),
all_c AS MATERIALIZED (SELECT drug_slug, list(szy / n - sz / n * (sy / n) ORDER BY j) AS slope, list(sz / n ORDER BY j) AS x_mean, max(sy / n) AS y_mean
  FROM all_lin GROUP BY ALL),
refit AS (
  SELECT drug_slug, 0 AS step, [CAST(0 AS DOUBLE) for m in slope] AS w FROM all_c
  UNION ALL
  SELECT drug_slug, step + 1, [sign(u) * greatest(abs(u) - alpha * l1_ratio / top, 0) / (1 + alpha * (1 - l1_ratio) / top) for u in u]
  FROM (SELECT f.drug_slug, f.step, g.top, s.alpha, s.l1_ratio,
          [f.w[i] - (list_dot_product(g.gram[i], f.w) - c.slope[i]) / g.top for i in range(1, len(f.w) + 1)] AS u
        FROM refit f JOIN all_g g USING (drug_slug) JOIN all_c c USING (drug_slug) JOIN sel s USING (drug_slug) WHERE f.step < 2000)),
chosen AS (SELECT f.drug_slug, s.l1_ratio, s.alpha, f.w, c.y_mean - list_dot_product(f.w, c.x_mean) AS b
  FROM refit f JOIN all_c c USING (drug_slug) JOIN sel s USING (drug_slug) WHERE f.step = 2000),
weights AS (SELECT drug_slug, l1_ratio, alpha, b, CASE WHEN abs(w) < 5e-6 THEN CAST(0 AS DOUBLE) ELSE w END AS w, j FROM
  (SELECT drug_slug, l1_ratio, alpha, b, unnest(w) AS w, unnest(range(len(w))) AS j FROM chosen))"""


@query(
    "elasticnet_model",
    f"""WITH {MODEL_SQL} SELECT drug_slug, l1_ratio, round(alpha, 9) AS alpha, round(b, 4) AS intercept, CAST(j AS BIGINT) AS pos,
  round(w, 4) + 0.0 AS coefficient FROM weights""",
    ("z",),
)
def _model(t: Inputs) -> DataFrame:
    model = _train(t).model.select(
        ENTITY, "l1_ratio", "alpha", "intercept", F.posexplode("coefficients").alias("pos", "coefficient")
    )
    model = model.withColumn("pos", F.col("pos").cast("bigint"))
    # adding zero turns -0.0 into 0.0
    return rounded(rounded(model, 4, "intercept", "coefficient"), 9, "alpha").withColumn("coefficient", F.col("coefficient") + F.lit(0.0))


_METRICS_SQL = f"""WITH {MODEL_SQL}, tested AS (SELECT z.drug_slug, z.assay_id, z.depmap_model_id, min(z.ln_ic50) AS y, sum(z.z * k.w) + min(k.b) AS prediction
  FROM z JOIN weights k ON k.drug_slug = z.drug_slug AND k.j = z.j WHERE z.split = 'test' GROUP BY ALL)
SELECT drug_slug, count(*) AS n, round(sqrt(avg(pow(y - prediction, 2))), 4) AS rmse,
  round(1 - sum(pow(y - prediction, 2)) / (var_pop(y) * count(*)), 4) AS r2 FROM tested GROUP BY drug_slug"""


@query(
    "trained_metrics",
    _METRICS_SQL,
    ("z",),
)
def _trained_metrics(t: Inputs) -> DataFrame:
    return rounded(_train(t).metrics.select(ENTITY, "n", "rmse", "r2"), 4, "rmse", "r2")


@query("trained_metrics_late", _METRICS_SQL, ("z",))
def _trained_late(t: Inputs) -> DataFrame:
    """The same from a narrow dataset and a matrix by model that is joined where factors are built."""
    narrow = materialise(t.modelling.drop("features").withColumn("copy", F.lit(1)))
    run = training.train_all(narrow, t.n_features, ENTITY, tuple(ROW), matrix=assemble.keyed_matrix(t.expression))
    return rounded(run.metrics.select(ENTITY, "n", "rmse", "r2"), 4, "rmse", "r2")
