"""Profiling: shape, schema summary, duplicates, column roles, per-entity counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.constants import NOT_DETECTED, OVERLAP_SAMPLE, TOP_MISSING_COLUMNS
from dosewise.functions.numbers import is_missing
from dosewise.functions.text import normalise_name, strip_blank


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def schema_summary(df: DataFrame) -> DataFrame:
    """One row per column with its type and missing counts; a single pass over the table."""
    if not df.columns:
        raise ValueError("The table has no columns")
    counts = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(is_missing(F.col(f"`{c}`"), t)).alias(f"m{i}") for i, (c, t) in enumerate(df.dtypes)],
    )
    per_column = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.col(f"m{i}").alias("missing_count"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return counts.select("n", F.inline(per_column)).select(
        "column_name",
        "dtype",
        (F.col("n") - F.col("missing_count")).alias("non_null_count"),
        "missing_count",
        F.coalesce(F.try_divide(F.col("missing_count"), F.col("n")), F.lit(0.0)).alias("missing_proportion"),
    )


def missing_top(df: DataFrame, n: int = TOP_MISSING_COLUMNS) -> DataFrame:
    """The columns with most missing values; ties by name."""
    summary = schema_summary(df).select("column_name", "missing_count")
    return summary.orderBy(F.desc("missing_count"), "column_name").limit(n)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of second and later copies of fully equal rows.

    Copies collapse on the map side, so a row repeated very often is shuffled once
    per task.
    """
    copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("__n"))
    return copies.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("n_duplicate_rows"))


def matches_any(name: Column, aliases: list[str]) -> Column:
    """Normalised name equal to, contained in, or containing one of the normalised aliases."""
    known = F.array(*[normalise_name(F.lit(alias)) for alias in aliases])
    seen = normalise_name(name)
    return F.exists(known, lambda alias: seen.contains(alias) | F.contains(alias, seen))


def column_candidates(catalogue: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """``(table_name, role, column_name)`` for every column that may play a role.

    The roles are a short literal list, so they are matched row by row: no join
    between columns and aliases takes place.
    """
    hits = F.array_compact(
        F.array(*[F.when(matches_any(F.col("column_name"), aliases), F.lit(role)) for role, aliases in roles.items()])
    )
    return catalogue.select("table_name", F.explode(hits).alias("role"), "column_name")


def key_columns(catalogue: DataFrame, roles: dict[str, list[str]], exact: dict[str, str] | None = None) -> DataFrame:
    """Per table and role the one detected column, or the not-detected mark.

    A column with the exact name of a role wins outright; otherwise exactly one
    candidate is needed. One partial aggregation over the catalogue.
    """
    exact = exact or {}
    stats = []
    for i, (role, aliases) in enumerate(roles.items()):
        hit = matches_any(F.col("column_name"), aliases)
        stats += [F.count_if(hit).alias(f"n{i}"), F.min(F.when(hit, F.col("column_name"))).alias(f"c{i}")]
        if role in exact:
            stats.append(F.max(F.col("column_name") == exact[role]).alias(f"x{i}"))
    found = []
    for i, role in enumerate(roles):
        choice = F.when(F.col(f"n{i}") == 1, F.col(f"c{i}")).otherwise(F.lit(NOT_DETECTED))
        if role in exact:
            choice = F.when(F.col(f"x{i}"), F.lit(exact[role])).otherwise(choice)
        found.append(
            F.struct(F.lit(role).alias("role"), F.col(f"n{i}").alias("n_candidates"), choice.alias("detected_column"))
        )
    return catalogue.groupBy("table_name").agg(*stats).select("table_name", F.inline(F.array(*found)))


def catalogue_of(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, column_name)`` of given tables; only their schemas are looked at."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, column) for name, df in tables.items() for column in df.columns]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def resolve_columns(
    df: DataFrame,
    roles: dict[str, list[str]],
    exact: dict[str, str] | None = None,
    required: tuple[str, ...] = (),
) -> dict[str, str | None]:
    """Detected column per role of one table; a required role without a single column raises."""
    found = {
        r["role"]: None if r["detected_column"] == NOT_DETECTED else r["detected_column"]
        for r in key_columns(catalogue_of({"table": df}), roles, exact).collect()
    }
    unresolved = [role for role in required if found.get(role) is None]
    if unresolved:
        raise ValueError(f"No single column for: {', '.join(unresolved)}")
    return found


def entity_summary(
    df: DataFrame,
    entity: str | None,
    sample: str | None,
    target: str | None,
    normalise: bool = False,
) -> DataFrame:
    """Rows, distinct samples and missing-target share per entity, largest first.

    One grouped pass; the missing entity stays a group, and a role that was not
    detected gives a NULL column. An undetected entity column gives an empty table.
    ``normalise`` strips the entity names first.
    """
    kinds = dict(df.dtypes)
    name = F.lit(None).cast("string") if entity is None else F.col(f"`{entity}`").cast("string")
    name = strip_blank(name) if normalise else name
    n_samples = F.lit(None).cast("bigint") if sample is None else F.countDistinct(F.col(f"`{sample}`"))
    missing = (
        F.lit(None).cast("double")
        if target is None
        else F.avg(is_missing(F.col(f"`{target}`"), kinds[target]).cast("double"))
    )
    summary = (
        (df if entity is not None else df.limit(0))
        .groupBy(name.alias("drug_name"))
        .agg(
            F.count("*").alias("n_rows"),
            n_samples.alias("n_unique_cell_lines"),
            missing.alias("prop_missing_ln_ic50"),
        )
    )
    return summary.orderBy(F.desc("n_rows"), F.asc_nulls_last("drug_name"))


def key_overlap_report(
    response: DataFrame,
    features: DataFrame,
    entity: str = "drug_slug",
    key: str = "cosmic_id",
    sample: int = OVERLAP_SAMPLE,
) -> DataFrame:
    """Per entity: distinct ids in the response, in the features and in both, with first ids of each.

    Samples come from a per-entity row limit that Spark applies before the
    shuffle; the counts from distinct ids.
    """
    left = response.where(F.col(key).isNotNull()).select(entity, key).distinct()
    right = features.where(F.col(key).isNotNull()).select(key).distinct()
    flagged = left.join(right.withColumn("__shared", F.lit(True)), key, "left").withColumn(
        "__shared", F.coalesce("__shared", F.lit(False))
    )

    def first_ids(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(key)
        firsts = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= sample)
        return firsts.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(key)), ",").alias(name))

    counts = flagged.groupBy(entity).agg(
        F.count("*").alias("n_response_ids"),
        F.count_if("__shared").alias("n_shared_ids"),
    )
    response_ids = first_ids(flagged, [entity], "response_sample")
    shared_ids = first_ids(flagged.where("__shared"), [entity], "shared_sample")
    report = (
        counts.alias("c")
        .join(response_ids.alias("r"), F.col(f"c.{entity}").eqNullSafe(F.col(f"r.{entity}")), "left")
        .join(shared_ids.alias("s"), F.col(f"c.{entity}").eqNullSafe(F.col(f"s.{entity}")), "left")
    )
    totals = right.agg(F.count("*").alias("n_feature_ids"))
    firsts = right.orderBy(key).limit(sample).agg(
        F.array_join(F.sort_array(F.collect_list(key)), ",").alias("feature_sample")
    )
    return report.select(
        F.col(f"c.{entity}").alias(entity),
        "n_response_ids",
        "n_shared_ids",
        F.coalesce("response_sample", F.lit("")).alias("response_sample"),
        F.coalesce("shared_sample", F.lit("")).alias("shared_sample"),
        totals.scalar().alias("n_feature_ids"),
        firsts.scalar().alias("feature_sample"),
    )
