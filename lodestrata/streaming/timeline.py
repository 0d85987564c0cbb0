"""Timelines as streams: journal rows split from file rows, windowed counts, speed meters as state, incremental copies by a table of spans."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.classify import usn_event_type
from ..operators.intervals import bucketed, carved_copies, marked_by_copy
from ..operators.windows import eta_fold

#: Sectors of a stretch of kept spans (8 GiB), and stretches of a batch that are listed to read no other folders.
KEPT_STRETCH, LISTED_STRETCHES = 1 << 24, 1000


def timeline_events(rows: DataFrame) -> DataFrame:
    """Timeline rows of journal rows; the reason bits are in status."""
    journal = rows.where(F.col("source").endswith("usn_journal"))
    return journal.select("scan_id", F.col("modified_at").alias("timestamp"), usn_event_type("status").alias("event_type"), F.col("name").alias("file_name"), F.col("parent_id").alias("mft_ref"), "source")


def file_rows(rows: DataFrame) -> DataFrame:
    """What is left for the files table: no journal rows, no log hints."""
    return rows.where(~F.col("source").endswith("usn_journal") & ~F.col("source").isin("ntfs_logfile", "ntfs_logfile_restart"))


def route(rows: DataFrame, files_path: str, timeline_path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of scan rows to two tables; a batch that is repeated after a failure overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        file_rows(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(files_path)
        timeline_events(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(timeline_path)
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events a type and window of event time; rows later than the watermark are dropped. (An extension.)"""
    timed = events.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every, slide), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of events of a key. (An extension.)"""
    timed = events.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), key).agg(F.count("*").alias("n"))


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All rows that a batch has of a key. Frames are cut at any row and come as the shuffle brings them, so only the whole has an order."""
    return pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


def eta_stream(ticks: DataFrame, key: str) -> DataFrame:
    """(key, time_ms, work, speed, eta_seconds, stalled) of ticks (key, time_ms, work, total); the meter is the state.

    A batch's ticks of a key are put in order by one task. Ticks older than those of earlier batches count at the latest time seen.
    """
    kind = ticks.schema[key].dataType.simpleString()
    out = f"{key} {kind}, time_ms long, work long, speed double, eta_seconds double, stalled boolean"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        frame = _in_order(frames, ["time_ms", "work"])
        held, speed, left, stalled = eta_fold(held, *(frame[c].to_numpy(dtype="int64") for c in ("time_ms", "work", "total")))
        state.update((json.dumps(held),))
        yield pd.DataFrame({key: k[0], "time_ms": frame["time_ms"].to_numpy(), "work": frame["work"].to_numpy(), "speed": speed, "eta_seconds": left, "stalled": stalled})

    return ticks.groupBy(key).applyInPandasWithState(step, out, "held string", "append", GroupStateTimeout.NoTimeout)


def write_copies(carved: DataFrame, keys: list[str], rows_path: str, kept_path: str, checkpoint: str, stretch: int = KEPT_STRETCH, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream of carved rows to a table, marked if they overlap a kept one by half of the shorter.

    Batches count in order of arrival, and the rows of one batch in order of id. What was kept is a table of spans, in a folder
    for each stretch of sectors and batch (a span lies in each stretch that it touches). A batch reads the folders of the
    stretches that its rows lie in, and of these the volumes that it has; what it keeps it adds. Rows are dealt by volume and
    stretch and folded by groups of spans that touch, so a volume is many tasks and no state of a volume is ever in one
    place. A batch that is repeated after a failure sees the spans of earlier batches only and overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        touched = bucketed(batch.select(*keys, "start_sector", (F.col("end_sector") + 1).alias("_end")), "start_sector", "_end", stretch).select(*keys, F.col("_bucket").alias("stretch")).distinct()
        stretches = [r[0] for r in touched.select("stretch").distinct().limit(LISTED_STRETCHES + 1).collect()]
        schema = StructType([*[batch.schema[k] for k in keys], *[StructField(c, LongType()) for c in ("start_sector", "end_sector", "stretch", "batch")]])
        spark.createDataFrame([], schema).write.mode("append").partitionBy("stretch", "batch").parquet(kept_path)
        kept = spark.read.schema(schema).parquet(kept_path).where(F.col("batch") < number)
        if len(stretches) <= LISTED_STRETCHES:  # with more, all folders are read and the join picks
            kept = kept.where(F.col("stretch").isin(stretches))
        kept = kept.join(touched, [*keys, "stretch"], "left_semi").select(*keys, "start_sector", "end_sector").distinct()
        marked = carved_copies(batch, keys, kept=kept).persist()
        out = lambda df: df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        # rows first: a write to kept_path makes Spark drop what it holds of plans that read there
        out(marked_by_copy(marked)).partitionBy("batch").parquet(rows_path)
        new = bucketed(marked.where(~F.col("_copy")).select(*keys, F.col("start_sector").cast("long").alias("start_sector"), F.col("end_sector").cast("long").alias("end_sector"), (F.col("end_sector") + 1).alias("_end")), "start_sector", "_end", stretch)
        out(new.select(*keys, "start_sector", "end_sector", F.col("_bucket").cast("long").alias("stretch")).repartition("stretch")).partitionBy("stretch", "batch").parquet(kept_path)
        marked.unpersist()
        batch.unpersist()

    return carved.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def live_summary(rows: DataFrame, name: str, every: str = "3 seconds") -> StreamingQuery:
    """Keeps counts by source and category of a stream in a memory table, renewed every few seconds."""
    counts = rows.groupBy("source", "category").agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(processingTime=every).start()


def stop_when(query: StreamingQuery, cancelled: Callable[[], bool], poll: float = 0.5) -> None:
    """Runs a query until it ends or is cancelled."""
    while query.isActive and not query.awaitTermination(poll):
        if cancelled():
            query.stop()
