"""Session settings and the shared scratch space for tables that are read more than once."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Joins and writes lean on AQE: it splits partitions that one key has made too
# large and turns a join into a broadcast only when the measured size is small.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
}


#: Bytes that one Arrow batch may hold.
BATCH_BYTES = 16 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended SQL settings to a running session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per Spark context, so that they can import it from any folder."""
    context = spark.sparkContext
    if getattr(context, "_dosewise_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="dosewise-"), "dosewise.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._dosewise_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Rows go to the workers in batches of few bytes, so that wide rows do not fill executors beside their heap."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string, fixed on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def workspace(spark: SparkSession) -> str:
    """A fresh folder for intermediate tables.

    It lies below ``spark.checkpoint.dir``, the storage all executors share. Only a session on one
    machine may lack that setting; it gets a local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="dosewise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that were written since and are not used any more, instead of when its driver
    happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the workspace and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/table"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
