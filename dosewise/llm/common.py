"""Helpers shared by the corpus operators: reading, Arrow batch limits, scratch tables, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, ship_package

#: Rows and bytes that one Arrow batch may hold, so that a worker's memory does not follow the length of the texts.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

#: Fixed byte classes of the contracts: ASCII white space, and A-Z to a-z.
ASCII_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def prepare(spark: SparkSession) -> None:
    """Let workers import this package and keep their batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str) -> Column:
    """The text as UTF-8 bytes, null as empty: batches reach Python without being decoded."""
    return F.coalesce(F.col(quoted(column)), F.lit("")).cast("binary")


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Apply a row function to batches of ``df``.

    ``make`` runs once per task and returns a function from the row's values to the tuple of
    ``schema``'s values.
    """
    spark = df.sparkSession
    out = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            made = [row(*values) for values in zip(*columns, strict=True)]
            if made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, f.type) for values, f in zip(zip(*made, strict=True), out, strict=True)], schema=out
                )

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string, fixed on the driver. Every operator with Python workers asks for one before it starts
    them, so this is also where the session is prepared."""
    prepare(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def free_name(taken: list[str], wish: str) -> str:
    """A column name that does not clash with those taken (names are compared without case)."""
    lower = {t.lower() for t in taken}
    name, n = wish, 0
    while name.lower() in lower:
        n += 1
        name = f"{wish}_{n}"
    return name


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` (long ids, undirected) as ``(id, component)``.

    Every node takes the smallest label among its neighbours' labels, then the label of its
    label; rounds end when nothing changes. Labels only fall and each is a node of the same
    component, so the fixed point is the smallest id of the component and is always reached. Rounds
    are written tables; links and labels stay in Spark.
    """
    edges = materialise(
        links.select(F.col("a").alias("x"), F.col("b").alias("y"))
        .union(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
        .where("x <> y")
        .distinct()
    )
    labels = materialise(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("label")))
    while True:
        near = (
            edges.join(labels.withColumnRenamed("id", "y"), "y")
            .groupBy(F.col("x").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "id").select("id", F.least("label", "near").alias("lowest"), F.col("label").alias("old"))
        up = labels.select(F.col("id").alias("lowest"), F.col("label").alias("up"))
        moved = materialise(
            lower.join(up, "lowest", "left").select("id", "old", F.least("lowest", F.coalesce("up", "lowest")).alias("label"))
        )
        labels = moved.select("id", "label")
        if moved.where("old <> label").limit(1).count() == 0:
            return labels.select("id", F.col("label").alias("component"))
