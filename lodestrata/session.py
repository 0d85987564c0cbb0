"""The public interface: one object over the tables of a case, each method a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.crypto import volume_key
from .functions.text import sanitize_content
from .operators import carve, enrich, graph, intervals, lifecycle, listing, raid, recover, search
from .schema import CASE, CONTENT, FILES, SCANS, TIMELINE, conform, empty
from .sources import evidence, partitions, volumes

TABLES = {"files": FILES, "scans": SCANS, "timeline_events": TIMELINE, "case_info": CASE, "content": CONTENT}


class ForensicSession:
    """Tables live as Parquet under root, partitioned by scan where they have one; missing tables are empty."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.root, self.given = spark, root, tables or {}

    def table(self, name: str) -> DataFrame:
        if name in self.given:
            return conform(self.given[name], TABLES[name])
        try:
            return conform(self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}"), TABLES[name])
        except Exception as e:  # a table that was never written
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return empty(self.spark, TABLES[name])
            raise

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; a write takes place as a whole or not at all."""
        out = conform(rows, TABLES[name]).write.mode("append")
        (out.partitionBy("scan_id") if "scan_id" in TABLES[name].names else out).parquet(f"{self.root}/{name}")

    # Lists and summaries.

    def files(self, scan_id: int | None = None, where: listing.FileFilter = listing.FileFilter()) -> DataFrame:
        return listing.files(self.table("files"), scan_id, where)

    def files_page(self, scan_id: int, offset: int, limit: int, where: listing.FileFilter = listing.FileFilter(), query: str = "") -> DataFrame:
        """A page of the list; with a query, of the search in that list."""
        rows = self.files(scan_id, where)
        return listing.page(search.search_files(rows, query) if query else rows, offset, limit, "id")

    def file_count(self, scan_id: int, where: listing.FileFilter = listing.FileFilter(), query: str = "") -> DataFrame:
        rows = self.files(scan_id, where)
        return (search.search_files(rows, query) if query else rows).agg(F.count("*").alias("n"))

    def file(self, file_id: int, scan_id: int | None = None) -> DataFrame:
        return listing.file_by_id(self.table("files"), file_id, scan_id)

    def scan_summary(self, scan_id: int) -> DataFrame:
        return listing.report_remainders(listing.scan_summary(self.table("files"), self.table("timeline_events"), scan_id))

    def timeline(self, scan_id: int, offset: int = 0, limit: int = 200, event_type: str = "") -> DataFrame:
        return listing.timeline_page(self.table("timeline_events"), offset, limit, scan_id, event_type)

    def timeline_counts(self, scan_id: int) -> DataFrame:
        return listing.timeline_counts(self.table("timeline_events"), scan_id)

    def scans(self) -> DataFrame:
        """The present state of each scan."""
        return lifecycle.latest(self.table("scans"), "id", ("updated_at", "scanned_sectors"))

    def latest_scan(self, usable_only: bool = False) -> DataFrame:
        return listing.latest_scan(self.scans(), usable_only)

    def reclaim_orphans(self) -> DataFrame:
        return lifecycle.reclaim_orphans(self.scans())

    def directories(self, scan_id: int) -> DataFrame:
        return graph.tree_children(self.files(scan_id).where(F.coalesce("path", F.lit("")) != ""))

    # Search.

    def search_files(self, scan_id: int, query: str, mode: str = "auto", where: listing.FileFilter = listing.FileFilter()) -> DataFrame:
        return search.search_files(self.files(scan_id, where), query, mode)

    def search_content(self, scan_id: int, query: str, mode: str = "token") -> DataFrame:
        return search.search_content(self.files(scan_id), self.table("content"), query, mode)

    def search_content_page(self, scan_id: int, query: str, offset: int, limit: int, mode: str = "token") -> DataFrame:
        return search.search_content_page(self.files(scan_id), self.table("content"), query, offset, limit, mode)

    def search_content_count(self, scan_id: int, query: str, mode: str = "token") -> DataFrame:
        return search.search_content_count(self.files(scan_id), self.table("content"), query, mode)

    def content_index_complete(self, scan_id: int) -> DataFrame:
        return search.content_index_complete(self.files(scan_id), self.table("content"))

    def index_content(self, scan_id: int, chunks: DataFrame, volume_id: str) -> DataFrame:
        """Content windows of a scan's files, read from the volume that they lie on."""
        found = volumes.file_bytes(self.files(scan_id).withColumn("volume_id", F.lit(volume_id)), chunks.where(F.col("volume_id") == volume_id))
        return search.content_chunks(found.select(F.col("id").alias("file_id"), sanitize_content("data", 1 << 30).alias("body")))

    # Enrichment and recovery.

    def mark_copies(self, scan_id: int) -> DataFrame:
        rows = self.files(scan_id, listing.FileFilter(include_duplicates=True))
        carved = F.col("source").startswith("carver")
        return intervals.mark_copies(rows.where(carved), rows.where(~carved), ["scan_id"])

    def known_files(self, scan_id: int, recovered: DataFrame, *hash_lists: str) -> DataFrame:
        return enrich.flag_known(recovered, evidence.hash_set(self.spark, *hash_lists))

    def recover(self, scan_id: int, ids: list[int], chunks: DataFrame, volume_id: str) -> DataFrame:
        wanted = self.spark.createDataFrame([(i,) for i in listing.id_list(ids)], "id long")
        rows = self.table("files").where(F.col("scan_id") == scan_id).join(wanted, "id", "left_semi")
        return recover.recover(rows.withColumn("volume_id", F.lit(volume_id)), chunks)

    # Evidence: volumes, arrays, carving, images, hash lists, reports.

    def images(self, *paths: str) -> DataFrame:
        """Raw images, or segmented ones by their .E01 file, as chunks."""
        parts = [evidence.read_ewf(self.spark, p) if p.lower().endswith(".e01") else volumes.read_images(self.spark, p) for p in paths]
        return reduce(DataFrame.unionByName, parts)

    def array(self, chunks: DataFrame, disks: list[str], level: int, name: str = "array") -> DataFrame:
        return raid.assemble(chunks, disks, level, name)

    def unlocked(self, chunks: DataFrame, key: str) -> DataFrame:
        """Chunks of an encrypted volume whose key (hexadecimal) is known."""
        return volumes.decrypted(chunks, volume_key(key))

    def partitions(self, chunks: DataFrame) -> DataFrame:
        return partitions.partitions(chunks)

    def carve(self, scan_id: int, chunks: DataFrame, allowed: DataFrame | None = None, signatures=None) -> DataFrame:
        """Carved files of volumes as rows of the files table, scored."""
        known = carve.known_signatures(self.spark) if signatures is None else signatures
        found = carve.carves(carve.hits(chunks, known, allowed), volumes.sector_count(chunks), known)
        rows = carve.scored(carve.first_per_start(found), chunks, known).withColumns({"scan_id": F.lit(scan_id), "path": F.concat(F.lit("/carved/"), "name"), "status": F.lit(0)})
        return conform(rows, FILES)

    def mark_carved_copies(self, scan_id: int) -> DataFrame:
        return intervals.mark_carved_copies(self.files(scan_id, listing.FileFilter(include_duplicates=True)).where(F.col("source").startswith("carver")), ["scan_id"])

    def catalogue_truncated(self, scan_id: int) -> DataFrame:
        return listing.truncated(self.table("files").where(F.col("scan_id") == scan_id))

    def hash_list(self, *paths: str) -> DataFrame:
        return evidence.hash_set(self.spark, *paths)

    def write_image(self, chunks: DataFrame, path: str, size: int, container: str = "raw", allowed: tuple[str, ...] = ()) -> tuple[str, int]:
        return recover.write_image(chunks, path, size, container=container, allowed=allowed)

    def export_csv(self, scan_id: int, path: str, where: listing.FileFilter = listing.FileFilter()) -> None:
        recover.write_csv(self.files(scan_id, where), path)

    def report(self, scan_id: int, case: dict[str, str]) -> tuple[str, str]:
        return recover.html_report(self.scan_summary(scan_id), case)

    def resumed(self) -> DataFrame:
        return lifecycle.resumed(self.scans(), self.table("files"))

    def clear(self) -> None:
        """Takes the data of all scans away. Cases stay."""
        for name in TABLES:
            if name != "case_info":
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # Case.

    def case(self) -> DataFrame:
        return lifecycle.latest(self.table("case_info"), "id", ("updated_at",)).limit(1)

    def update_case(self, rows: DataFrame) -> DataFrame:
        return lifecycle.upsert_case(self.case(), conform(rows, CASE))
