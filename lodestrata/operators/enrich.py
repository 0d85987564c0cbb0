"""Joins that enrich file rows: journal and log cross-checks, recycle-bin pairs, inode and extent lookups, hash sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_text
from ..schema import text

# Gains and confidences of the cross-checks.
LOG_GAIN, JOURNAL_GAIN, RECYCLE_GAIN, RECYCLE_MOST = 12, 15, 15, 95
I30_CONFIDENCE = 35
LIVE_ENTRY, DELETED_ENTRY, NO_INODE, NO_NUMBER = 95, 60, 50, 45
APFS_NAME, APFS_WITH_EXTENT, APFS_EXTENT = 70, 85, 60
#: Low bits of a file reference that hold the record number.
RECORD_MASK = 0x0000FFFFFFFFFFFF


def best_record(rows: DataFrame, key: str = "mft_record", seq: str = "seq", keys: list[str] | None = None) -> DataFrame:
    """Of the rows of one record number the most confident, the first one on ties; streams and rows without number all stay.

    Here and below, keys are the columns that tell volumes (or scans) apart, as record numbers count anew in each.
    """
    loose = F.coalesce(F.col(key).isNull() | (F.col("source") == "ntfs_ads"), F.lit(False))
    best = rows.where(~loose).groupBy(*(keys or []), key).agg(F.max_by(F.struct(*rows.columns), F.struct("confidence", (-F.col(seq)).alias("s"))).alias("row"))
    return rows.where(loose).unionByName(best.select("row.*"))


def confirm_by_log(files: DataFrame, hints: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """files (name, mft_record, source, confidence) confirmed by log hints (name_lower, mft_ref), by name first, else by record number."""
    keys = keys or []
    by_name = hints.where(text("name_lower") != "").groupBy(*keys, F.col("name_lower").alias("_lower")).agg(F.min("mft_ref").alias("_ref"))
    by_ref = hints.where("mft_ref is not null").groupBy(*keys, F.col("mft_ref").alias("_record")).agg(F.min("name_lower").alias("_name"))
    rows = files.withColumns({"_lower": F.lower("name"), "_record": F.col("mft_record")})
    rows = rows.join(by_name.withColumn("_by_name", F.lit(True)), [*keys, "_lower"], "left")
    rows = rows.join(by_ref.withColumn("_by_ref", F.lit(True)), [*keys, "_record"], "left")
    hit = F.coalesce("_by_name", F.lit(False)) | F.coalesce("_by_ref", F.lit(False))
    return rows.withColumns({
        "confidence": F.when(hit, F.least(F.lit(100), F.col("confidence") + LOG_GAIN)).otherwise(F.col("confidence")),
        "source": F.when(hit & (F.col("source") == "ntfs_mft"), "ntfs_mft_logfile").otherwise(F.col("source")),
        "name": F.when(F.col("_by_name").isNull() & F.col("_by_ref").isNotNull() & (text("name") == ""), F.col("_name")).otherwise(F.col("name")),
        "mft_record": F.coalesce("mft_record", "_ref"),
    }).select(*files.columns)


def confirm_by_journal(files: DataFrame, deletions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Deleted files whose record number a journal deletion (file_reference) names."""
    keys = keys or []
    refs = deletions.select(*keys, F.col("file_reference").bitwiseAND(RECORD_MASK).alias("mft_record")).distinct().withColumn("_hit", F.lit(True))
    rows = files.join(refs, [*keys, "mft_record"], "left")
    hit = F.col("_hit").isNotNull() & (F.col("status") == 0)
    return rows.withColumns({
        "confidence": F.when(hit, F.least(F.lit(100), F.col("confidence") + JOURNAL_GAIN)).otherwise(F.col("confidence")),
        "source": F.when(hit & F.col("source").isin("ntfs_mft", "ntfs_mft_logfile"), "ntfs_mft_usn").otherwise(F.col("source")),
    }).select(*files.columns)


def pair_recycle_bin(files: DataFrame, seq: str = "seq") -> DataFrame:
    r"""$R rows named by the $I row of the same suffix, the last one of each kind. files also have info (original_path, file_size, deleted_unix).

    info is what parse_recycle_info made of the $I row's bytes; without it (bytes elsewhere, malformed) nothing is paired.
    """
    kind, key = F.upper(F.regexp_extract("name", r"^\$([IiRr]).", 1)), F.lower(F.substring("name", 3, 1 << 20))
    rows = files.withColumns({"_kind": kind, "_pair": F.when(kind != "", key)})
    last = Window.partitionBy("_pair", "_kind").orderBy(F.desc(seq))
    marked = rows.withColumn("_last", F.col("_pair").isNotNull() & (F.row_number().over(last) == 1))
    metas = marked.where("_last and _kind = 'I' and info is not null").select("_pair", F.col("info").alias("_info"))
    contents = marked.where("_last and _kind = 'R'").select("_pair")
    found = marked.join(metas.join(contents, "_pair"), "_pair", "left")
    paired = F.col("_last") & F.col("_info").isNotNull()
    r, i = paired & (F.col("_kind") == "R"), paired & (F.col("_kind") == "I")
    leaf = F.regexp_extract("_info.original_path", r"([^/\\]*)$", 1)
    new = {
        "name": F.when(r & (leaf != ""), leaf).otherwise(F.col("name")),
        "path": F.when(r, F.col("_info.original_path")).otherwise(F.col("path")),
        "size_bytes": F.when(r & (F.col("_info.file_size") > 0), F.col("_info.file_size")).otherwise(F.col("size_bytes")),
        "created_at": F.when(r & (F.col("_info.deleted_unix") > 0), F.col("_info.deleted_unix")).otherwise(F.col("created_at")),
        "source": F.when(r, "ntfs_recycle").when(i, "ntfs_recycle_meta").otherwise(F.col("source")),
        "status": F.when(r, 0).otherwise(F.col("status")),
        "confidence": F.when(r, F.least(F.lit(RECYCLE_MOST), F.col("confidence") + RECYCLE_GAIN)).otherwise(F.col("confidence")),
    }
    return found.withColumns(new).select(*files.columns)


def slack_names(hints: DataFrame, index: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Index hints (child, parent, name) whose record is unknown or has another name; each child and name once."""
    keys = keys or []
    known = index.select(*keys, F.col("node").alias("child"), F.col("name").alias("_name"))
    rows = hints.where((text("name") != "") & (F.col("child") != 0)).join(known, [*keys, "child"], "left")
    rows = rows.where(F.col("_name").isNull() | (F.col("_name") != F.col("name"))).dropDuplicates([*keys, "child", "name"])
    return rows.select(*keys, "child", "parent", "name", F.lit(0).alias("status"), F.lit("ntfs_i30").alias("source"), F.lit(I30_CONFIDENCE).alias("confidence"))


def entries_with_inodes(entries: DataFrame, inodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Directory entries (inode, name, file_type) with their inodes (inode, deleted, ...): status and confidence by what was found.

    keys: columns that tell volumes (or scans) apart, as inodes count anew in each.
    """
    meta = inodes.withColumn("_known", F.lit(True))
    rows = entries.where((F.col("inode") != 0) | (F.col("file_type") == 1)).join(meta, [*(keys or []), "inode"], "left")
    lost, known, gone = F.col("inode") == 0, F.col("_known").isNotNull(), F.coalesce("deleted", F.lit(False))
    return rows.withColumns({
        "confidence": F.when(lost, NO_NUMBER).when(known & gone, DELETED_ENTRY).when(known, LIVE_ENTRY).otherwise(NO_INODE),
        "status": F.when(lost | (known & gone), 0).otherwise(1),
    }).drop("_known")


def names_with_extents(names: DataFrame, extents: DataFrame, sector_size: int = 512) -> DataFrame:
    """Directory names (oid, name) and extents (oid, runs), each with the other if it is there."""
    rows = names.join(extents.where(F.size("runs") > 0), "oid", "full")
    has, sectors = F.col("runs").isNotNull(), F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["sector_count"])
    named = F.col("name").isNotNull()
    return rows.select(
        F.coalesce("name", F.concat(F.lit("extent_"), F.col("oid").cast("string"))).alias("name"),
        F.when(named, F.concat(F.lit("/apfs/"), "name")).otherwise(F.concat(F.lit("/apfs/extent/"), F.col("oid").cast("string"))).alias("path"),
        "runs",
        F.when(has, F.col("runs")[0]["start_sector"]).alias("start_sector"),
        F.when(has, F.col("runs")[0]["start_sector"] + sectors).alias("end_sector"),
        F.when(has, sectors * sector_size).otherwise(0).alias("size_bytes"),
        F.when(named & has, APFS_WITH_EXTENT).when(named, APFS_NAME).otherwise(APFS_EXTENT).alias("confidence"),
        F.when(named, "apfs_file").otherwise("apfs_extent").alias("source"),
    )


def bind_snapshots(snapshots: DataFrame, volumes: DataFrame) -> DataFrame:
    """Snapshots with a volume of the same serial and, unless one is unknown (0), the same size: hits and whether they collide.

    Volumes are counted by serial and size first, so no pair is made.
    """
    same = volumes.groupBy("serial", "size_bytes").agg(F.count("*").alias("_same"))
    total = same.groupBy("serial").agg(F.sum("_same").alias("_all"), F.sum(F.when(F.col("size_bytes") == 0, F.col("_same"))).alias("_unknown"))
    rows = snapshots.where("serial <> 0").groupBy(*snapshots.columns).agg(F.count("*").alias("_n")).join(total, "serial").join(same, ["serial", "size_bytes"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    each = F.when(F.col("size_bytes") == 0, F.col("_all")).otherwise(none("_unknown") + none("_same"))
    rows = rows.select(*snapshots.columns, (F.col("_n") * each).alias("hits")).where("hits > 0")
    return rows.withColumn("collision", F.col("hits") > 1)


def flag_known(files: DataFrame, hashes: DataFrame, column: str = "md5") -> DataFrame:
    """files with known: whether their MD5 is in the hash set (md5)."""
    known = hashes.select(F.col("md5").alias("_md5")).distinct().withColumn("_hit", F.lit(True))
    rows = files.join(known, md5_text(column) == F.col("_md5"), "left")
    return rows.withColumn("known", F.col("_hit").isNotNull()).drop("_md5", "_hit")


def backfill(rows: DataFrame, indexed: DataFrame, key: str = "id") -> DataFrame:
    """Rows that an index lacks."""
    return rows.join(indexed.select(key).distinct(), key, "left_anti")


def destination_allowed(targets: DataFrame, members: list[str]) -> DataFrame:
    """targets (drive) with allowed: never a drive that is scanned itself or belongs to a scanned array."""
    return targets.withColumn("allowed", ~F.upper("drive").isin(*[m.upper() for m in members]) if members else F.lit(True))


def tag_raid(files: DataFrame) -> DataFrame:
    """Files found on an assembled array: source gets its prefix, and is_raid keeps the fact apart from it."""
    return files.withColumns({"is_raid": F.lit(True), "source": F.when(F.col("source").startswith("raid_"), F.col("source")).otherwise(F.concat(F.lit("raid_"), text("source")))})
