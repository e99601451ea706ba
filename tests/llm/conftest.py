import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from dosewise.llm.common import prepare


@pytest.fixture(scope="module")
def corpus(spark):
    """Make a documents table; extra columns clash with names that operators use."""
    prepare(spark)
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("kept", StringType()), StructField("gone", StringType())])

    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], schema)

    return make
