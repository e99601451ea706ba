"""Cleaning the response and joining it through the bridge to the features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from dosewise.functions.numbers import is_missing, to_number
from dosewise.functions.text import clean_id, entity_key, file_slug, slug, usable_id
from dosewise.operators import quality
from dosewise.session import materialise


def entity_filter(df: DataFrame, entity: str, name: str) -> DataFrame:
    """Rows of one entity, compared stripped and case-folded."""
    return df.where(entity_key(F.col(entity)) == entity_key(F.lit(name)))


def standardise_response(
    response: DataFrame,
    row_id: str = "assay_id",
    entity: str = "drug_name",
    sample: str = "cosmic_raw",
    target: str = "ln_ic50_raw",
) -> DataFrame:
    """All response rows with slug, cleaned join id and numeric target beside the raw names."""
    return response.select(
        F.col(row_id).alias("assay_id"),
        slug(F.col(entity)).alias("drug_slug"),
        F.col(entity).cast("string").alias("drug_name"),
        F.col(sample).cast("string").alias("cell_line_id"),
        clean_id(F.col(sample)).alias("cosmic_id"),
        to_number(F.col(target)).alias("ln_ic50"),
    )


def standardise_bridge(metadata: DataFrame, model: str = "model_id", sample: str = "cosmic_raw") -> DataFrame:
    """Bridge rows with a usable join id; repeats are kept, as they multiply matches."""
    bridge = metadata.select(F.col(model).alias("model_id"), clean_id(F.col(sample)).alias("cosmic_id"))
    return bridge.where(usable_id(F.col("cosmic_id")))


def storage_names(df: DataFrame, entity: str = "drug_name") -> DataFrame:
    """``(drug_key, storage_name, n_keys)``: entities by trimmed, case-folded name, and a name of its own for each on disk.

    The slug alone would pool names that differ in signs only; where several keys share one, the start of the key's hash is
    appended. ``n_keys`` counts the keys of a slug. One row per entity.
    """
    keys = df.select(entity_key(F.col(entity)).alias("drug_key")).where("drug_key IS NOT NULL").distinct()
    named = keys.withColumn("__slug", file_slug(F.col("drug_key")))
    shared = named.groupBy("__slug").agg(F.count("*").alias("n_keys"))
    own = F.concat("__slug", F.lit("_"), F.left(F.sha2("drug_key", 256), F.lit(8)))
    return named.join(shared, "__slug").select("drug_key", F.when(F.col("n_keys") > 1, own).otherwise(F.col("__slug")).alias("storage_name"), "n_keys")


def name_entities(standard: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The standard response with ``drug_slug`` replaced by the entity's storage name, which no other entity has.

    ``names`` are those of :func:`storage_names` over the whole response; they are resolved once and then carried as the key
    through dataset, split, training, ranking and storage. Rows without a name keep a null key.
    """
    names = storage_names(standard) if names is None else names
    side = names.select(F.col("drug_key").alias("__key"), F.col("storage_name").alias("__name"))
    joined = standard.join(side, entity_key(F.col("drug_name")) == F.col("__key"), "left")
    return joined.select(*[F.col("__name").alias(c) if c == "drug_slug" else F.col(c) for c in standard.columns])


def bridge_join(expression: DataFrame, metadata: DataFrame, model: str = "model_id") -> DataFrame:
    """Every expression row with its metadata; a missing model id matches a missing one.

    No broadcast is forced: Spark broadcasts the metadata while its size is below
    the session's threshold, and sorts and splits skewed partitions beyond it.
    """
    side = metadata.withColumnRenamed(model, "__model")
    joined = expression.join(side, F.col(model).eqNullSafe(F.col("__model")), "left")
    return joined.drop("__model")


def join_features(response: DataFrame, bridge: DataFrame, expression: DataFrame) -> DataFrame:
    """Response rows x bridge x expression, many to many, bad targets left out.

    The narrow tables are joined first, so that feature arrays travel once, and the
    target filter runs before any join. Ids need no filter of their own: the bridge
    holds usable ones only. Features and target stay in one row.
    """
    usable = response.where(F.col("ln_ic50").isNotNull())
    matched = usable.join(bridge.withColumnRenamed("model_id", "__model"), "cosmic_id")
    rows = matched.join(expression, F.col("__model").eqNullSafe(F.col("model_id")))
    return rows.select(
        "assay_id",
        "drug_slug",
        "drug_name",
        "cell_line_id",
        F.col("model_id").cast("string").alias("depmap_model_id"),
        "ln_ic50",
        "features",
    )


def narrow_dataset(response: DataFrame, bridge: DataFrame, expression: DataFrame) -> DataFrame:
    """:func:`join_features` without the features: rows keep the model's id, by which the matrix is joined where factors are built.

    Of the matrix only the ids are read. A model that stands twice in it gives two rows here, as in the wide form, and ``copy`` tells
    them apart; :func:`keyed_matrix` numbers its rows alike.
    """
    usable = response.where(F.col("ln_ic50").isNotNull())
    matched = usable.join(bridge.withColumnRenamed("model_id", "__model"), "cosmic_id")
    models = expression.groupBy("model_id").agg(F.count("*").alias("__n"))
    rows = matched.join(models, F.col("__model").eqNullSafe(F.col("model_id")))
    return rows.select(
        "assay_id",
        "drug_slug",
        "drug_name",
        "cell_line_id",
        F.col("model_id").cast("string").alias("depmap_model_id"),
        F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("copy"),
        "ln_ic50",
    )


def keyed_matrix(expression: DataFrame) -> DataFrame:
    """``depmap_model_id, copy, features``: the matrix by model, repeats numbered in the order of their features' hash."""
    order = Window.partitionBy("model_id").orderBy(F.xxhash64("features"))
    return expression.select(F.col("model_id").cast("string").alias("depmap_model_id"), F.row_number().over(order).alias("copy"), "features")


def with_features(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """Rows of :func:`narrow_dataset` (any further columns) with their features. The matrix travels once, the rows are narrow."""
    side = matrix.select(F.col("depmap_model_id").alias("__model"), F.col("copy").alias("__copy"), "features")
    same = F.col("depmap_model_id").eqNullSafe(F.col("__model")) & (F.col("copy") == F.col("__copy"))
    return rows.join(side, same).drop("__model", "__copy")


def stage_counts(
    response: DataFrame,
    bridge: DataFrame,
    expression: DataFrame,
    min_samples: int = 0,
) -> DataFrame:
    """Rows left per entity after each stage, and whether enough remain.

    Matches per join id are counted first, so the fan-out of the join is summed
    up instead of being produced.
    """
    models = expression.groupBy("model_id").agg(F.count("*").alias("__rows"))
    fan_out = (
        bridge.withColumnRenamed("model_id", "__model")
        .join(models, F.col("__model").eqNullSafe(F.col("model_id")))
        .groupBy("cosmic_id")
        .agg(F.sum("__rows").alias("__matches"))
    )
    usable = usable_id(F.col("cosmic_id"))
    # rows without a usable id match nothing, so they do not travel to the join
    with_id = response.where(usable).join(fan_out, "cosmic_id", "left").select("drug_slug", "cosmic_id", "ln_ic50", "__matches")
    without = response.where(~F.coalesce(usable, F.lit(False))).select("drug_slug", "cosmic_id", "ln_ic50", F.lit(0).cast("bigint").alias("__matches"))
    rows = with_id.unionByName(without)
    matches = F.coalesce("__matches", F.lit(0))
    counts = rows.groupBy("drug_slug").agg(
        F.count("*").alias("n_entity_rows"),
        F.count_if(usable).alias("n_with_id"),
        F.sum(matches).alias("n_joined"),
        F.sum(F.when(F.col("ln_ic50").isNotNull(), matches).otherwise(0)).alias("n_modelled"),
    )
    return counts.select(
        "drug_slug",
        "n_entity_rows",
        "n_with_id",
        "n_joined",
        (F.col("n_joined") - F.col("n_modelled")).alias("n_bad_target"),
        "n_modelled",
        ((F.col("n_modelled") > 0) & (F.col("n_modelled") >= min_samples)).alias("eligible"),
    )


def eligible_rows(dataset: DataFrame, counts: DataFrame) -> DataFrame:
    """Dataset rows of the named entities that have enough samples."""
    return dataset.join(counts.where("eligible").select("drug_slug"), "drug_slug", "left_semi")


def align(features: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """1:1 join of features and target by id, for sides that passed the id contracts."""
    return features.join(target, key)


def clean_targets(df: DataFrame, target: str) -> DataFrame:
    """Numeric target in place of the raw one; rows without a number are dropped."""
    numeric: Column = to_number(F.col(target))
    return df.withColumn(target, numeric).where(F.col(target).isNotNull())


def checked_align(features: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """:func:`align` with the id contracts watched in the pass that joins: both sides have rows, ids are present and unique, and both
    hold the same ids. What breaks them raises with a count and an example, and the aligned table, written to the workspace, is
    read back otherwise: one job instead of one per contract.

    Rows are joined in full and by null-safe keys, so that what is missing on a side is seen; how often a key stands on a side is
    counted within the join's own partitioning.
    """
    taken = {c.lower() for c in (*features.columns, *target.columns)}
    assert not {"__left", "__right", "__key"} & taken
    kinds = dict(features.dtypes)[key], dict(target.dtypes)[key]
    own = features.withColumn("__left", F.count("*").over(Window.partitionBy(key)))
    other = target.withColumn("__right", F.count("*").over(Window.partitionBy(key))).withColumnRenamed(key, "__key")
    joined = own.join(other, F.col(key).eqNullSafe(F.col("__key")), "full")
    shown = F.coalesce(F.col(key).cast("string"), F.col("__key").cast("string"))
    left, right = F.col("__left").isNotNull(), F.col("__right").isNotNull()
    broken = {
        "features_id_not_null": left & is_missing(F.col(key), kinds[0]),
        "target_id_not_null": right & is_missing(F.col("__key"), kinds[1]),
        "features_id_unique": left & (F.col("__left") > 1),
        "target_id_unique": right & (F.col("__right") > 1),
        "missing_in_right": left & ~right,
        "missing_in_left": right & ~left,
    }
    watched = Observation()
    seen = joined.observe(
        watched,
        F.count_if(left).alias("features_rows"),
        F.count_if(right).alias("target_rows"),
        *(F.count_if(c).alias(name) for name, c in broken.items()),
        *(F.min(F.when(c, shown)).alias(f"{name}_sample") for name, c in broken.items()),
    )
    out = materialise(seen.where(left & right).drop("__left", "__right", "__key"))
    found = watched.get
    empty = [name for name in ("features", "target") if not found[f"{name}_rows"]]
    faults = [f"{name}_not_empty" for name in empty] + [f"{name}: {found[name]}, such as {found[f'{name}_sample']!r}" for name in broken if found[name]]
    if faults:
        raise quality.ContractViolation(f"Data contracts violated: {faults}")
    return out
