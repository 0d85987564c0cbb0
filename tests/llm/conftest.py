from __future__ import annotations

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents table from (doc_id, text[, lang[, source]]) rows, with an extra column."""
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("length", StringType())])

    def make(rows, parts=3):
        full = [(*r, *([None] * (4 - len(r))), None if r[1] is None else len(r[1]), "x") for r in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make
