"""Row types and vocabulary. Timestamps are Unix seconds (0: unknown); sectors and sizes are longs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DecimalType, IntegerType, LongType, StringType, StructField, StructType


def _struct(text: str) -> StructType:
    kinds = {"long": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType(), "binary": BinaryType(), "u64": DecimalType(20, 0), "runs": RUNS}
    return StructType([StructField(name, kinds[kind]) for name, kind in (x.split(":") for x in text.split())])


RUN = StructType([StructField("start_sector", LongType()), StructField("sector_count", LongType()), StructField("is_sparse", BooleanType())])
RUNS = ArrayType(RUN)
FILES = _struct(
    "id:long scan_id:long parent_id:long name:string extension:string path:string size_bytes:long start_sector:long end_sector:long status:int "
    "compressed:boolean confidence:int category:string source:string created_at:long modified_at:long runs:runs resident:binary integrity_checksum:u64"
)
SCANS = _struct(
    "id:long drive_index:int scan_type:string total_sectors:long scanned_sectors:long status:int recovered_files:long started_at:long updated_at:long "
    "partition_start_sector:long partition_size_sectors:long metadata_complete:boolean carve_resume_sector:long"
)
TIMELINE = _struct("id:long scan_id:long timestamp:long event_type:string file_name:string mft_ref:long source:string")
CASE = _struct("id:int case_number:string investigator:string agency:string notes:string created_at:long updated_at:long")
CONTENT = _struct("file_id:long chunk_no:long body:string")
CHUNKS = _struct("volume_id:string chunk_no:long byte_offset:long data:binary")

# File status, scan status, scan kinds.
DELETED, ALLOCATED, ENCRYPTED = 0, 1, 2
RUNNING, COMPLETE, STOPPED, FAILED, PAUSED = 0, 1, 2, 3, 4
USABLE = (COMPLETE, PAUSED)
SCAN_TYPES = ("quick", "deep", "full_carve", "carve_only")

# Sources that only tell of a thing's existence and that lists hide.
DISCOVERY_SOURCES = (
    "apfs_container", "apfs_volume", "apfs_file", "bitlocker_detect", "bitlocker_fve", "vss_unbound", "vss_bind", "vss_snapshot", "hfs_limit",
    "hfs_vh", "hfs_catalog", "usn_journal", "ntfs_logfile", "ntfs_logfile_restart", "ntfs_recycle_meta", "ntfs_i30", "Folder", "refs_volume",
)
DUPLICATE = "carver_duplicate"
CARVED_SOURCES = ("carver", "carver_bgc")
#: The largest unsigned 64-bit value, which marks a sparse run in interchange text.
SPARSE = 2**64 - 1


def empty(df_session, schema: StructType) -> DataFrame:
    return df_session.createDataFrame([], schema)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df with exactly the schema's columns: missing ones are null (old tables lack columns that came later), others go."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def text(column: Column | str) -> Column:
    """Text with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
