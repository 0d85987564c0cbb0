"""Tables as append-only logs: scans as state events with the latest as view, cases, reclaiming, runs as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from ..schema import COMPLETE, FAILED, PAUSED, RUNNING, SPARSE, STOPPED


def latest(events: DataFrame, key: str = "id", order: tuple[str, ...] = ("updated_at", "seq")) -> DataFrame:
    """The last event of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*").select(*events.columns)


def reclaim_orphans(scans: DataFrame) -> DataFrame:
    """scans with changed: running ones become complete if all was scanned and (quick or metadata complete), else paused."""
    running = F.col("status") == RUNNING
    done = (F.col("total_sectors") > 0) & (F.col("scanned_sectors") >= F.col("total_sectors")) & ((F.col("scan_type") == "quick") | F.coalesce("metadata_complete", F.lit(False)))
    return scans.withColumn("changed", running).withColumn("status", F.when(running & done, COMPLETE).when(running, PAUSED).otherwise(F.col("status")))


def end_status(status: Column, flush_failed: Column, scanned: Column, total: Column) -> Column:
    """How a scan ends: failed writes fail it; one stopped midway is paused."""
    return F.when(flush_failed, FAILED).when((status == STOPPED) & (scanned > 0) & (scanned < total), PAUSED).otherwise(status)


def resumable(scans: DataFrame) -> DataFrame:
    return scans.where((F.col("status") == PAUSED) & (F.col("scan_type") != "quick"))


def resumed(scans: DataFrame, files: DataFrame) -> DataFrame:
    """Scans that may go on, each with the spans of the files that it stored already, which marking copies goes on from.

    (scan_id, from_sector, id, path, start_sector, end_sector, source, confidence); a scan without files has one row of nulls.
    """
    rows = resumable(scans).select(F.col("id").alias("scan_id"), F.coalesce("carve_resume_sector", "scanned_sectors").alias("from_sector"))
    spans = files.where("start_sector is not null").select("scan_id", "id", "path", "start_sector", "end_sector", "source", "confidence")
    return rows.join(spans, "scan_id", "left").select("scan_id", "from_sector", "id", "path", "start_sector", "end_sector", "source", "confidence")


def upsert_case(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """new over old by key; the first created_at stays."""
    rest = [c for c in new.columns if c not in (key, "created_at")]
    both = old.alias("o").join(new.alias("n"), key, "full")
    fresh = F.col("n.updated_at").isNotNull()
    return both.select(key, *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest], F.coalesce("o.created_at", "n.created_at").alias("created_at")).select(*new.columns)


def recovered_counts(scans: DataFrame, recoveries: DataFrame) -> DataFrame:
    """scans with recovered_files from the recovery rows (scan_id, success)."""
    n = recoveries.where("success").groupBy(F.col("scan_id").alias("id")).agg(F.count("*").alias("_n"))
    return scans.join(n, "id", "left").withColumn("recovered_files", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n").select(*scans.columns)


def resume_ranges(ranges: DataFrame, done: int, keys: list[str]) -> DataFrame:
    """What is left of [start, end) ranges after done sectors of their sequence, within keys."""
    length = F.col("end") - F.col("start")
    before = F.coalesce(F.sum(length).over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = ranges.withColumn("_skip", F.greatest(F.lit(0), F.lit(done) - before)).where(F.col("_skip") < length)
    return cut.withColumn("start", F.col("start") + F.col("_skip")).drop("_skip")


def encode_runs(runs: Column | str) -> Column:
    """Runs as [[start,count],...]; a sparse run starts at the largest unsigned 64-bit value; no runs are an empty text."""
    one = lambda r: F.concat(F.lit("["), F.when(r["is_sparse"], F.lit(str(SPARSE))).otherwise(r["start_sector"].cast("string")), F.lit(","), r["sector_count"].cast("string"), F.lit("]"))
    return F.when(F.size(col(runs)) > 0, F.concat(F.lit("["), F.array_join(F.transform(col(runs), one), ","), F.lit("]"))).otherwise("")


def decode_runs(text: Column | str) -> Column:
    """Runs from text; anything malformed, out of range or empty of sectors makes it no runs at all."""
    t = F.coalesce(col(text), F.lit(""))
    whole = t.rlike(r"^\[\s*(?:\[\d{1,20},\d{1,19}\][\s,]*)*\]\s*$")
    parts = F.regexp_extract_all(t, F.lit(r"\[(\d{1,20}),\d{1,19}\]"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"\[\d{1,20},(\d{1,19})\]"), F.lit(1))
    sparse = lambda s: s == str(SPARSE)
    runs = F.zip_with(*parts, lambda s, n: F.struct(F.when(sparse(s), F.lit(None)).otherwise(s.try_cast("long")).alias("start_sector"), n.try_cast("long").alias("sector_count"), sparse(s).alias("is_sparse")))
    good = F.forall(runs, lambda r: (r["start_sector"].isNotNull() | r["is_sparse"]) & r["sector_count"].isNotNull() & (r["sector_count"] > 0))
    none = F.from_json(F.lit("[]"), "array<struct<start_sector:bigint,sector_count:bigint,is_sparse:boolean>>")
    return F.when(whole & good, runs).otherwise(none)
