"""Helpers that the corpus operators share: reading, cutting lineage, distributed prefix sums."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one numbering bucket holds on average.
BUCKET_ROWS = 256
#: Buckets whose prefix sums one task computes.
SUPER = 4096
#: Rows of an Arrow batch; of texts of a few KB, a few MB.
BATCH_ROWS = 1000
#: A key of more than this share of all rows is joined apart.
HOT_SHARE = 1 / 1000
#: White space of the corpus contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session hands no more than BATCH_ROWS rows to Python at once from now on, as rows hold whole texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine may lack that setting and gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return at or f"file://{tempfile.gettempdir()}/lodestrata-{os.getpid()}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark writes to."""
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the reliable checkpoint folder and read back from there, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of a loop, each round's written to the shared folder and read back; the round before goes.

    Unlike a checkpoint, a table that is read has a size of its own, so size estimates don't multiply from round to round.
    The last round's table stays until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, None

    def next(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/rounds-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if self.path:
            remove(self.spark, self.path)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of the columns has, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def no_broadcast_bound(df: DataFrame, most_rows: int) -> bool:
    """Whether df has more than most_rows rows; it counts no further than that."""
    return df.limit(most_rows + 1).count() > most_rows


def look_up(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows, left-joined with table (one row a key) on key. hot: the keys of more than HOT_SHARE of all rows.

    As there are no more than 1 / HOT_SHARE hot keys, these and their rows of table are broadcast, and rows of hot keys stay
    where they are. So do rows without a key, which find nothing.
    """
    hot = F.broadcast(hot.select(key))
    there = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left")
    rest = rows.where(F.col(key).isNotNull()).join(hot, key, "left_anti").join(table, key, "left")
    return there.unionByName(rest).unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def numbers_of_copies(rows: DataFrame, same: list[str], row: str) -> DataFrame:
    """rows, whose number in column row stays if more than BUCKET_ROWS rows are the same in some columns and is null if not.

    A hash of those columns stands for them; one that two groups share costs numbers that were not needed. row has to be fixed
    (of rows that were cut).
    """
    rows = rows.withColumn("_same", F.xxhash64(*same))
    often = cut(rows.groupBy("_same").agg(F.count("*").alias("_n")).where(F.col("_n") > BUCKET_ROWS))
    if not often.limit(1).count():
        return rows.drop("_same").withColumn(row, F.lit(None).cast("long"))
    hot = often.where(F.col("_n") > rows.count() * HOT_SHARE)
    found = look_up(rows, often, "_same", hot)
    return found.withColumn(row, F.when(F.col("_n").isNotNull(), F.col(row))).drop("_same", "_n")


def with_offsets(counts: DataFrame, group: list[str], bucket: str, count: str, out: str) -> DataFrame:
    """counts (one row per group and bucket) with the sum of count over the smaller buckets of the same group, as out.

    Two levels: SUPER buckets make one window, and the totals of those make another, so no task sees all buckets.
    """
    wide = counts.withColumn("_super", F.floor(F.col(bucket) / F.lit(SUPER)).cast("long"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = wide.groupBy(*group, "_super").agg(F.sum(count).alias("_n"))
    tops = tops.select(*group, "_super", F.coalesce(F.sum("_n").over(before(Window.partitionBy(*group).orderBy("_super"))), F.lit(0)).alias("_top"))
    inner = F.coalesce(F.sum(count).over(before(Window.partitionBy(*group, "_super").orderBy(bucket))), F.lit(0))
    return wide.withColumn("_in", inner).join(tops, [*group, "_super"]).withColumn(out, F.col("_top") + F.col("_in")).drop("_super", "_top", "_in")


def buckets_for(rows: int) -> int:
    return max(1, math.ceil(rows / BUCKET_ROWS))


def unit31(*cols) -> "F.Column":
    """A seeded hash of cols as a long in [0, 2^31)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 33)
