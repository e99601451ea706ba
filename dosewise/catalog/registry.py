"""Query registration: a callable per key, and where possible the SQL giving the same table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.catalog import bindings
from dosewise.operators import assemble
from dosewise.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The given tables, and the pipeline inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def bind(self, sql: str, *tables: str) -> DataFrame:
        return self.spark.sql(sql, **{t: self.table(t) for t in tables})

    @cached_property
    def response(self) -> DataFrame:
        return self.bind(bindings.RESPONSE, "events")

    @cached_property
    def metadata(self) -> DataFrame:
        return self.bind(bindings.METADATA, "customer")

    @cached_property
    def expression(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("model_id"), F.col("embedding").cast("array<double>").alias("features")
        )

    @cached_property
    def n_features(self) -> int:
        return self.expression.select(F.size("features")).first()[0]

    @cached_property
    def coefficients(self) -> DataFrame:
        return self.bind(bindings.COEFFICIENTS, "part")

    @cached_property
    def library(self) -> DataFrame:
        return self.bind(bindings.LIBRARY, "part")

    @cached_property
    def catalogue(self) -> DataFrame:
        return self.bind(bindings.CATALOGUE, "part")

    @cached_property
    def standard(self) -> DataFrame:
        return assemble.standardise_response(self.response)

    @cached_property
    def bridge(self) -> DataFrame:
        return assemble.standardise_bridge(self.metadata)

    @cached_property
    def dataset(self) -> DataFrame:
        return assemble.join_features(self.standard, self.bridge, self.expression)

    @cached_property
    def modelling(self) -> DataFrame:
        """The stored dataset of named entities with a target that depends on the features."""
        signal = (
            2 * F.col("features")[0]
            - 1.5 * F.col("features")[1]
            + 0.5 * F.col("features")[2]
            + 0.1 * ((F.col("assay_id") * 7919 % 1000) / F.lit(1000.0) - 0.5)
        )
        return materialise(self.dataset.where("drug_slug IS NOT NULL").withColumn("ln_ic50", signal))


def query(name: str, oracle: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(inputs) -> DataFrame``; ``uses`` names the bindings its SQL builds on."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = bindings.with_bindings(oracle, uses)
        return fn

    return wrap
