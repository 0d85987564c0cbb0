"""Aggregates over bytes, hash chains and tallies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.binary import entropy
from ..functions.text import col

GENESIS = "0" * 64
#: Fixed value: a quality score from here on counts as good.
GOOD_FROM = 60


def symbol_entropy(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """(keys, entropy): Shannon entropy in bits of the characters of a text. A row's characters are counted where it lies; only counts are shuffled."""
    counts = df.where(F.length(body) > 0).select(*keys, F.explode(_character_counts(F.col(body))).alias("_x")).select(*keys, F.col("_x.code").alias("_c"), F.col("_x.n").alias("_n"))
    counts = counts.groupBy(*keys, "_c").agg(F.sum("_n").alias("_n"))
    total, part = F.sum("_n"), F.sum(F.col("_n") * F.log2(F.col("_n").cast("double")))
    return counts.groupBy(*keys).agg((F.log2(total.cast("double")) - part / total).alias("entropy"))


@F.pandas_udf(ArrayType(StructType([StructField("code", IntegerType()), StructField("n", LongType())])))
def _character_counts(texts: pd.Series) -> pd.Series:
    def counts(text: str) -> list[dict]:
        codes, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        return [{"code": int(c), "n": int(k)} for c, k in zip(codes, n)]

    return texts.map(counts)


@F.pandas_udf(DoubleType())
def _byte_entropy(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else entropy(bytes(x)))


def byte_entropy(data: Column | str, most: int | None = None) -> Column:
    """Shannon entropy in bits of the first bytes of binary data, or of all; 0 for none."""
    return _byte_entropy(col(data) if most is None else F.substring(col(data), 1, most))


def outcome_totals(results: DataFrame, keys: list[str]) -> DataFrame:
    """Recoveries that succeeded without zero-filled gaps, and the others."""
    good = F.col("success") & ~F.coalesce("zero_filled", F.lit(False))
    return results.groupBy(*keys).agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))


def quality_tally(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count_if(F.col("score") >= GOOD_FROM).alias("good"), F.count_if(F.coalesce(F.col("score") < GOOD_FROM, F.lit(False))).alias("bad"))


def chained(lines: DataFrame, keys: list[str], order: str, message: str) -> DataFrame:
    """lines with link (from 1) and digest: of each log, digest = sha256(digest before || message), the first after 64 zeros.

    A chain is sequential by nature. A log is sorted by Spark and folded as it streams by, with one open digest, so its length
    takes no memory; logs are chained in parallel. Ties in order go by message. From a null message on, digests are null.
    """
    columns = lines.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, digest, link = None, GENESIS, 0
        for batch in batches:
            digests, links = [], []
            for of, text in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column(message).to_pylist()):
                if of != log:
                    log, digest, link = of, GENESIS, 0
                digest = None if digest is None or text is None else hashlib.sha256((digest + text).encode()).hexdigest()
                link += 1
                digests.append(digest)
                links.append(link)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(links, pa.int64()), pa.array(digests, pa.string())], names=[*columns, "link", "digest"])

    schema = StructType([*lines.schema.fields, StructField("link", LongType()), StructField("digest", StringType())])
    return lines.repartition(*keys).sortWithinPartitions(*keys, order, message).mapInArrow(fold, schema)


def hash_chain(lines: DataFrame, keys: list[str], order: str, message: str) -> DataFrame:
    """(keys, head, links): the last digest of each log, and its number of lines."""
    linked = chained(lines.select(*keys, order, message), keys, order, message)
    return linked.groupBy(*keys).agg(F.max_by("digest", "link").alias("head"), F.max("link").alias("links"))


def verify_chain(lines: DataFrame, keys: list[str], order: str, message: str, digest: str) -> DataFrame:
    """lines with valid: whether a line's digest follows from the one before it; no fold is needed to check."""
    from pyspark.sql import Window

    before = F.lag(digest, 1, GENESIS).over(Window.partitionBy(*keys).orderBy(order))
    return lines.withColumn("valid", F.sha2(F.concat(before, F.col(message)), 256) == F.col(digest))
