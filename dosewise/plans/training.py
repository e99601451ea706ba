"""Modelling dataset to fitted models, metrics and coefficient tables of every entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.constants import CV_FOLDS, N_ALPHAS, SEED, TEST_FRACTION
from dosewise.operators import assemble, elasticnet, score, split
from dosewise.session import materialise


@dataclass
class Training:
    """Tables of a training run; all of them hold every entity."""

    rows: DataFrame
    scaler: DataFrame
    errors: DataFrame
    model: DataFrame
    raw: DataFrame
    predictions: DataFrame
    metrics: DataFrame


def train_all(
    dataset: DataFrame,
    n_features: int,
    entity: str = "drug_slug",
    row_cols: tuple[str, ...] = ("assay_id", "depmap_model_id"),
    target: str = "ln_ic50",
    seed: int = SEED,
    test_fraction: float = TEST_FRACTION,
    folds: int = CV_FOLDS,
    group_col: str | None = None,
    l1_ratios: list[float] | None = None,
    n_alphas: int = N_ALPHAS,
    matrix: DataFrame | None = None,
) -> Training:
    """Split, standardise, cross-validate, refit and score all entities together.

    The scaler sees the whole training part before the folds are cut, like the
    procedure this follows. Rows without an entity name have no model. ``dataset``
    should be a stored table, as it is read several times. What is read twice along
    the way (cut points, factors, scaler, errors, models) is written to the workspace. A missing
    or non-finite feature or target, or a row of another length, raises with the entity's name before anything is fitted;
    ``errors`` and ``model`` tell for each fit whether it met its optimality conditions. ``raw`` scores raw features.
    With ``matrix`` (``assemble.keyed_matrix``) the dataset is a narrow one, and features are joined where factors are built and where
    test rows are scored; nothing as wide as the dataset is stored.
    """
    named = dataset.where(F.col(entity).isNotNull())
    keys = [group_col] if group_col else list(row_cols)
    points = materialise(
        split.split_points(named, entity, keys, seed, test_fraction, folds, distinct_keys=group_col is not None)
    )
    rows = split.assign_split(named, entity, list(row_cols), seed, test_fraction, folds, group_col, points)
    wide = (lambda part: part) if matrix is None else (lambda part: assemble.with_features(part, matrix))
    merge = None
    if matrix is not None:
        sizes = rows.where("split = 'train'").groupBy(entity, "fold").agg(F.count("*").alias("n"))
        merge = (sizes.agg(F.max("n")).first()[0] or 0) > n_features + 2
    factors = elasticnet.fold_factors(wide(rows.where("split = 'train'")), entity, n_features, target=target, merge=merge)
    # entities keep all cores busy, or their folds must
    spread = points.count() < named.sparkSession.sparkContext.defaultParallelism
    if spread:
        factors = materialise(factors)
    found = materialise(elasticnet.search(factors, entity, l1_ratios, n_alphas, spread))
    errors, scaler = elasticnet.errors_of(found, entity), materialise(elasticnet.scaler_from(found, entity))
    if spread:
        model = materialise(elasticnet.fit(factors, elasticnet.select_penalty(errors, entity), entity))
    else:
        model = elasticnet.models_of(found, entity)
    raw = materialise(elasticnet.raw_model(model, scaler, entity))
    predictions = score.predict(wide(rows.where("split = 'test'")), raw, entity)
    metrics = score.evaluate(predictions, entity, target)
    return Training(rows, scaler, errors, model, raw, predictions, metrics)
