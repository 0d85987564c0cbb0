"""Lists, counts, summaries and timelines over the files and timeline tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import CHIP_CATEGORIES
from ..schema import CARVED_SOURCES, DISCOVERY_SOURCES, DUPLICATE, USABLE


@dataclass(frozen=True)
class FileFilter:
    """A conjunction of conditions on files; the defaults hide duplicates and discovery rows."""

    status: int = -1
    category: str = ""
    source_like: str = ""
    source_not_like: str = ""
    include_duplicates: bool = False
    include_discovery: bool = False
    sectors: tuple[int, int] | None = None

    def column(self) -> Column:
        """The condition. A null source fails every condition on the source, as in SQL."""
        out, source = F.lit(True), F.col("source")
        if self.status >= 0:
            out &= F.col("status") == self.status
        if self.category:
            out &= F.col("category") == self.category
        if self.source_like:
            out &= source.ilike(self.source_like)
        if self.source_not_like:
            out &= ~source.ilike(self.source_not_like)
        if not self.include_duplicates:
            out &= source != DUPLICATE
        if not self.include_discovery:
            out &= ~source.isin(*DISCOVERY_SOURCES)
        if self.sectors:
            out &= (F.col("start_sector") < self.sectors[1]) & (F.col("end_sector") >= self.sectors[0])
        return out


def chip_filter(status_chip: str = "all", type_chip: str = "", show_duplicates: bool = False) -> FileFilter:
    """The filter behind the list's chips: carved, deleted (metadata only), allocated or all, and a file type."""
    category = CHIP_CATEGORIES.get(type_chip, "")
    if status_chip == "carved":
        return FileFilter(category=category, source_like="carver%", include_duplicates=show_duplicates)
    if status_chip == "deleted":
        return FileFilter(0, category, source_not_like="carver%", include_duplicates=show_duplicates)
    return FileFilter(1 if status_chip == "allocated" else -1, category, include_duplicates=show_duplicates)


def of_scan(df: DataFrame, scan_id: int | None) -> DataFrame:
    return df if scan_id is None else df.where(F.col("scan_id") == scan_id)


def files(df: DataFrame, scan_id: int | None = None, where: FileFilter = FileFilter()) -> DataFrame:
    return of_scan(df, scan_id).where(where.column())


def page(df: DataFrame, offset: int, limit: int, *order: str) -> DataFrame:
    """Rows offset to offset + limit in a total order; ends in a top-k of each partition."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_by_name(df: DataFrame, offset: int, limit: int, name: str = "name", locale: str = "tr") -> DataFrame:
    """A page in the order of a language's alphabet."""
    return df.orderBy(F.collate(F.col(name), locale)).offset(offset).limit(limit)


def truncated(files: DataFrame, source: str = "hfs_limit", needle: str = "catalog truncated") -> DataFrame:
    """One row: whether a scan left a mark that a catalogue was too long. Such marks are hidden from lists, so all rows are looked at."""
    hit = (F.col("source") == source) & F.coalesce(F.contains(F.lower("name"), F.lit(needle)), F.lit(False))
    return files.agg(F.coalesce(F.max(hit), F.lit(False)).alias("truncated"))


def page_after(df: DataFrame, last_id: int, limit: int) -> DataFrame:
    """The next rows by id: a range condition that reaches the scan, however deep the page lies."""
    return df.where(F.col("id") > last_id).orderBy("id").limit(limit)


def file_page(df: DataFrame, scan_id: int | None, offset: int, limit: int, where: FileFilter = FileFilter()) -> DataFrame:
    return page(files(df, scan_id, where), offset, limit, "id")


def file_count(df: DataFrame, scan_id: int | None = None, where: FileFilter = FileFilter()) -> DataFrame:
    return files(df, scan_id, where).agg(F.count("*").alias("n"))


def file_by_id(df: DataFrame, file_id: int, scan_id: int | None = None) -> DataFrame:
    return of_scan(df, scan_id).where(F.col("id") == file_id)


def scan_summary(files_df: DataFrame, timeline_df: DataFrame, scan_id: int | None = None) -> DataFrame:
    """One row of counters over non-discovery files (duplicates included) and timeline events."""
    kinds = {"image": "Image", "document": "Document", "video": "Video", "audio": "Audio", "archive": "Archive"}
    ones = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    source = F.col("source")
    seen = of_scan(files_df, scan_id).where(~source.isin(*DISCOVERY_SOURCES))
    counts = seen.agg(
        F.count("*").alias("total_files"),
        ones((F.col("status") == 0) & ~source.ilike("carver%")).alias("deleted_files"),
        *(ones(F.col("category") == c).alias(f"{k}_files") for k, c in kinds.items()),
        ones(source.isin(*CARVED_SOURCES)).alias("carved_files"),
    )
    # one row each, so this join moves two rows
    return counts.join(F.broadcast(timeline_counts(timeline_df, scan_id)), F.lit(True))


def timeline_counts(df: DataFrame, scan_id: int | None = None, create: str = "create", delete: str = "delete", renames=("rename_old", "rename_new")) -> DataFrame:
    kind = F.col("event_type")
    return of_scan(df, scan_id).agg(F.count("*").alias("timeline_events"), F.count_if(kind == create).alias("usn_creates"), F.count_if(kind == delete).alias("usn_deletes"), F.count_if(kind.isin(*renames)).alias("usn_renames"))


def timeline_page(df: DataFrame, offset: int, limit: int, scan_id: int | None = None, event_type: str = "") -> DataFrame:
    rows = of_scan(df, scan_id)
    return page(rows.where(F.col("event_type") == event_type) if event_type else rows, offset, limit, "timestamp", "id")


def timeline_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(F.count("*").alias("n"))


def latest_scan(scans: DataFrame, usable_only: bool = False) -> DataFrame:
    """One row: the largest scan id, -1 without any."""
    rows = scans.where(F.col("status").isin(*USABLE)) if usable_only else scans
    return rows.agg(F.coalesce(F.max("id"), F.lit(-1)).cast("long").alias("scan_id"))


def tail(lines: DataFrame, most: int, *order: str) -> DataFrame:
    """The last rows in order: a top-k downwards, sorted upwards again."""
    return lines.orderBy(*[F.desc(x) for x in order]).limit(most).orderBy(*order)


def id_list(values) -> list[int]:
    """The distinct positive ids of a list, in order; anything else in it is an error."""
    out: dict[int, None] = {}
    for v in values:
        if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
            raise ValueError(f"not an id: {v!r}")
        out[v] = None
    return list(out)


def report_remainders(summary: DataFrame) -> DataFrame:
    """summary with the files of no counted category and the allocated ones."""
    kinds = ("image", "document", "video", "audio", "archive")
    return summary.withColumns({"other_files": F.greatest(F.lit(0), F.col("total_files") - sum((F.col(f"{k}_files") for k in kinds), F.lit(0))), "allocated_files": F.col("total_files") - F.col("deleted_files")})
