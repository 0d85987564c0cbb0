"""Proportional stratified interleaving: shards that each hold the sources in the corpus' proportions.

Rows are shuffled by a seeded hash and ranked within their source, the rank becomes a fraction of the source's size, the
rows of all sources are merged by that fraction, and the merged order is cut into shards of equal row counts. A source's
rows lie evenly in the merged order, so each cut matches the mixture to within a row or so per source.

Both rankings are distributed: a row's bucket follows from its hash (or fraction), a window numbers the rows inside a
bucket, and prefix sums over bucket counts make the numbers global. No task sorts a source or the table. What is needed of
the rows is written once, so the input is read once. Rows that repeat more often than a bucket is large get a number of
their own into the hash, or else they would share one bucket.

Defined results: a null source is a source of its own; a null text has size 16 and the CRC of the empty string; rows that
repeat in all columns are placed separately, and it doesn't matter which gets which place; an empty table gives no rows;
columns other than doc_id, text and source are ignored. Slots count from 0 in each shard without gaps.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, buckets_for, cut, no_broadcast_bound, read, unit31, with_offsets

#: Sources whose counts are broadcast; with more of them, Spark plans the join by their size.
BROADCAST_SOURCES = 20_000


def interleaved_shards(docs: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, source, shard, slot; row counts of any two shards differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("source"),
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("_key"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = cut(rows)
    total = rows.count()
    same = ["doc_id", "text_crc32", "size", "_key"]
    often = rows.groupBy(*same).agg(F.count("*").alias("_n")).where(F.col("_n") > BUCKET_ROWS).drop("_n")
    known = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in same]
    often = cut(often.select(*[F.col(c).alias(f"_{c}_") for c in same], F.lit(True).alias("_often")))  # no more than one in BUCKET_ROWS rows
    rows = rows.join(often, reduce(and_, known), "left").withColumn("_row", F.when(F.col("_often"), F.col("_row"))).drop("_often", *[f"_{c}_" for c in same])
    sizes = rows.groupBy("_key").agg(F.count("*").alias("_of"))
    if not no_broadcast_bound(sizes, BROADCAST_SOURCES):
        sizes = F.broadcast(sizes)
    rows = rows.withColumn("_u", unit31(F.lit(seed), F.col("doc_id"), F.col("text_crc32"), F.col("_row"))).join(sizes, "_key")
    rows = rows.withColumn("_bucket", F.floor(F.col("_u") * F.ceil(F.col("_of") / F.lit(BUCKET_ROWS)) / F.lit(2**31)).cast("long"))

    ties = ["_u", "doc_id", "text_crc32", "size"]
    offsets = with_offsets(rows.groupBy("_key", "_bucket").agg(F.count("*").alias("_n")), ["_key"], "_bucket", "_n", "_off").drop("_n")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy(*ties)))
    ranked = ranked.join(offsets, ["_key", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_off") - 1).drop("_off", "_bucket")
    # each source starts at a seeded place within its first step, or else all small sources would meet at one fraction
    start = unit31(F.lit(seed + 1), F.col("_key")) / F.lit(2.0**31)
    ranked = ranked.withColumn("_at", (F.col("_rank") + start) / F.col("_of"))

    ranked = ranked.withColumn("_bucket", F.floor(F.col("_at") * F.lit(buckets_for(total))).cast("long"))
    offsets = with_offsets(ranked.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0)), ["_all"], "_bucket", "_n", "_off").select("_bucket", "_off")
    placed = ranked.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy("_at", "_key", "_rank")))
    placed = placed.join(offsets, "_bucket").withColumn("_place", F.col("_place") + F.col("_off") - 1)
    shard = F.expr(f"_place * {n_shards}L div {max(total, 1)}L")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")  # the first place that falls into the shard
    return placed.withColumn("slot", (F.col("_place") - first).cast("long")).select("doc_id", "size", "text_crc32", "source", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = interleaved_shards(read(spark, sf_dir, "documents"), n_shards=40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
