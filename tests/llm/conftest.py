import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture
def docs(spark):
    """A small table of documents from (id, text) pairs."""
    return lambda rows: spark.createDataFrame(rows, DOCS)
