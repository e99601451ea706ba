"""Raw response, metadata and expression to one modelling dataset over all entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.constants import (
    EXACT_NAMES,
    EXPRESSION_ID_ALIASES,
    METADATA_COSMIC_ALIASES,
    METADATA_MODEL_ALIASES,
    MIN_SHARED_FEATURES,
    RESPONSE_ROLES,
)
from dosewise.operators import assemble, features, profile, quality


def response_columns(response: DataFrame) -> dict[str, str]:
    """Entity, join-id and target column of a response table; each must be found.

    The join id has to be a COSMIC column: a cell line name could never match.
    """
    roles = {name: RESPONSE_ROLES[name] for name in ("drug_name", "cosmic_id", "ln_ic50")}
    exact = {"drug_name": EXACT_NAMES["drug_name"], "cosmic_id": EXACT_NAMES["join_id"]}
    return profile.resolve_columns(response, roles, exact, required=tuple(roles))


def expression_id_column(expression: DataFrame) -> str:
    """Identifier column of an expression table; it must be found."""
    roles = {"model_id": EXPRESSION_ID_ALIASES}
    return profile.resolve_columns(expression, roles, required=("model_id",))["model_id"]


def metadata_columns(metadata: DataFrame) -> dict[str, str]:
    """Model-id and COSMIC column of the metadata; both must be found."""
    roles = {"model_id": METADATA_MODEL_ALIASES, "cosmic_id": METADATA_COSMIC_ALIASES}
    exact = {"model_id": EXACT_NAMES["model_id"]}
    return profile.resolve_columns(metadata, roles, exact, required=tuple(roles))


def build_dataset(
    response: DataFrame,
    metadata: DataFrame,
    expression: DataFrame,
    min_samples: int | None = None,
    only_entity: str | None = None,
    narrow: bool = False,
) -> DataFrame:
    """One row per usable (response row, expression row) pair of every entity, or of one.

    ``response`` has ``assay_id, drug_name, cosmic_raw, ln_ic50_raw``; ``metadata``
    has ``model_id, cosmic_raw``; ``expression`` has ``model_id, features``. With
    ``min_samples`` smaller entities are left out. ``drug_slug`` is the entity's own key: names that differ in signs only, or have
    none but signs, stay apart. ``narrow`` leaves the features out, for ``train_all(..., matrix=keyed_matrix(expression))``.
    """
    chosen = response if only_entity is None else assemble.entity_filter(response, "drug_name", only_entity)
    standard = assemble.name_entities(assemble.standardise_response(chosen), assemble.storage_names(response))
    bridge = assemble.standardise_bridge(metadata)
    rows = (assemble.narrow_dataset if narrow else assemble.join_features)(standard, bridge, expression)
    if min_samples is None:
        return rows
    return assemble.eligible_rows(rows, assemble.stage_counts(standard, bridge, expression, min_samples))


def detected_dataset(
    response: DataFrame,
    metadata: DataFrame,
    expression: DataFrame,
    row_id: str,
    min_samples: int | None = None,
    features_col: str = "features",
) -> DataFrame:
    """:func:`build_dataset` on tables as they come: the columns' roles are detected from their names first."""
    own, side, wide = response_columns(response), metadata_columns(metadata), expression_id_column(expression)
    named = response.select(
        F.col(f"`{row_id}`").alias("assay_id"),
        F.col(f"`{own['drug_name']}`").alias("drug_name"),
        F.col(f"`{own['cosmic_id']}`").alias("cosmic_raw"),
        F.col(f"`{own['ln_ic50']}`").alias("ln_ic50_raw"),
    )
    bridge = metadata.select(F.col(f"`{side['model_id']}`").alias("model_id"), F.col(f"`{side['cosmic_id']}`").alias("cosmic_raw"))
    matrix = expression.select(F.col(f"`{wide}`").alias("model_id"), F.col(f"`{features_col}`").alias("features"))
    return build_dataset(named, bridge, matrix, min_samples)


def aligned_pair(
    left: DataFrame, left_names: DataFrame, right: DataFrame, right_names: DataFrame, target: DataFrame, key: str = "model_id", minimum: int = MIN_SHARED_FEATURES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two matrices cut to the features they share, in one order, and the left one aligned with ``target`` under the id contracts:
    training rows, the other side's rows, and the names by position."""
    own, other, names = features.shared_matrices(left, left_names, right, right_names)
    quality.enforce(quality.min_shared_features(names, minimum))
    return assemble.checked_align(own, target, key), other, names
