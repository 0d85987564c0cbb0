"""Classification of files and events as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CARVED_SOURCES, DISCOVERY_SOURCES, DUPLICATE
from .text import col, extension_of

# Extensions by category.
NAME_CATEGORIES = {
    "Image": "jpg jpeg png gif bmp tiff webp heic heif avif svg raf jp2 cr3",
    "Video": "mp4 avi mkv mov flv wmv mpg mpeg 3gp webm m4v",
    "Audio": "mp3 wav flac ogg aac wma m4a opus",
    "Document": "doc docx pdf txt xls xlsx ppt pptx rtf odt",
    "Archive": "zip rar 7z gz tar iso cab",
    "Executable": "exe dll sys elf",
}
# Extensions by category where a carved file's category is unknown.
CARVE_CATEGORIES = {
    "Image": "jpg jpeg png gif bmp webp",
    "Video": "mp4 mov mkv avi ts",
    "Audio": "mp3 wav flac ogg",
    "Document": "pdf doc docx xls xlsx",
    "Archive": "zip rar 7z",
}
# Extensions by list chip, and the categories of chips.
CHIPS = {
    "img": "jpg png gif jpeg bmp webp heic heif avif tiff svg",
    "doc": "doc docx pdf txt xls xlsx ppt pptx",
    "video": "mp4 avi mkv mov flv wmv m4v webm",
    "audio": "mp3 wav flac ogg aac",
    "archive": "zip rar 7z gz tar iso",
}
CHIP_CATEGORIES = {"img": "Image", "doc": "Document", "video": "Video", "audio": "Audio", "archive": "Archive"}
# Change-journal reasons by weight, the first that is set decides.
USN_REASONS = (
    (0x00000002, "delete"), (0x00010000, "rename_old"), (0x00020000, "rename_new"), (0x00000010, "truncate"),
    (0x00000008, "extend"), (0x00000004, "overwrite"), (0x00000001, "create"),
)
# Thresholds of entropy (bits a byte) and of printable bytes (percent).
ENCRYPTED_FROM, TEXT_TO, PRINTABLE_FROM = 7.6, 4.2, 85
# What sources are shown as.
SOURCE_LABELS = {
    "apfs_container": "APFS discovery", "apfs_volume": "APFS discovery", "apfs_file": "APFS catalog name (no extent, not recoverable)",
    "apfs_extent": "APFS extent (recoverable)", "hfs_limit": "HFS catalog limit", "vss_unbound": "VSS not bound",
    "vss_bind": "VSS bound (serial and size)", "vss_snapshot": "VSS snapshot (metadata)", "vss_ntfs": "VSS NTFS", "vss_fat": "VSS FAT",
    "bitlocker_detect": "BitLocker (no key)", "bitlocker_fve": "BitLocker FVE (not decrypted)",
    "ntfs_mft_logfile": "NTFS MFT (confirmed by LogFile)", "ntfs_mft_usn": "NTFS MFT (deletion confirmed by USN)",
    "ntfs_recycle": "Recycle bin ($R)", "ntfs_recycle_meta": "Recycle bin ($I, name only)", "ntfs_i30": "NTFS $I30 slack (name only)",
    "ntfs_thumbcache": "NTFS thumbcache (embedded JPEG)", "usn_journal": "USN timeline", "ntfs_logfile": "LogFile hint (not recoverable)",
    "carver_duplicate": "Carved copy (overlaps the MFT)",
}


def _by_list(value: Column, lists: dict[str, str], otherwise) -> Column:
    return reduce(lambda c, item: F.when(value.isin(item[1].split()), item[0]).otherwise(c), reversed(lists.items()), otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def category_for_name(name: Column | str) -> Column:
    return _by_list(extension_of(name), NAME_CATEGORIES, "Other")


def refined_category(current: Column | str, extension: Column | str, entropy: Column | str, printable_percent: Column | str) -> Column:
    """The category of a carved file whose category is unknown, from the first bytes' entropy and printable share."""
    now, ext = F.coalesce(col(current), F.lit("")), F.lower(F.regexp_replace(F.coalesce(col(extension), F.lit("")), r"^\.", ""))
    rest = F.when((col(entropy) <= TEXT_TO) & (col(printable_percent) >= PRINTABLE_FROM), "Text").when(now == "", "Unknown").otherwise(now)
    guess = F.when(col(entropy) >= ENCRYPTED_FROM, "Encrypted").otherwise(_by_list(ext, CARVE_CATEGORIES, rest))
    return F.when(~now.isin("", "Unknown", "Other"), now).otherwise(guess)


def type_chip(extension: Column | str) -> Column:
    return _by_list(F.lower(col(extension)), CHIPS, "other")


def record_chip(name: Column | str, category: Column | str, extension: Column | str) -> Column:
    """The chip of a file: by category if that says it, else by extension, else by name."""
    cat = F.lower(F.coalesce(col(category), F.lit("")))
    ext = F.regexp_replace(F.coalesce(F.nullif(col(extension), F.lit("")), extension_of(name)), r"^\.", "")
    out = type_chip(ext)
    for chip, c in {**CHIP_CATEGORIES, "archive": "Archive"}.items():
        out = F.when(cat == c.lower(), chip).otherwise(out)
    return F.when(cat == "container", "archive").otherwise(out)


def is_carved(source: Column | str) -> Column:
    return col(source).startswith("carver")


def is_discovery(source: Column | str) -> Column:
    return col(source).isin(*DISCOVERY_SOURCES, DUPLICATE)


def is_recoverable(source: Column | str, has_runs: Column) -> Column:
    """Whether a file's bytes can be had. An APFS extent needs runs."""
    return ~is_discovery(source) & ((col(source) != "apfs_extent") | has_runs)


def quality_hint(source: Column | str, confidence: Column | str) -> Column:
    c = F.coalesce(col(confidence), F.lit(0))
    bands = lambda hi, mid, lo: F.when(c >= 85, hi).when(c >= 60, mid).otherwise(lo)
    return F.when(col(source).isin(*CARVED_SOURCES), bands("likely complete", "doubtful", "weak")).when(c > 0, bands("high", "medium", "low")).otherwise("-")


def status_label(status: Column | str, source: Column | str) -> Column:
    return F.when(is_carved(source), "carved").when(col(status) == 1, "allocated").otherwise("deleted")


def source_label(source: Column | str) -> Column:
    pairs = [F.lit(x) for item in SOURCE_LABELS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(source)), col(source), F.lit(""))


def usn_event_type(reason: Column | str) -> Column:
    return reduce(lambda c, r: F.when(col(reason).bitwiseAND(r[0]) != 0, r[1]).otherwise(c), reversed(USN_REASONS), F.lit("touch"))


def mft_confidence(in_use: Column, fixup_ok: Column, is_directory: Column, size: Column, has_runs: Column, has_resident: Column) -> Column:
    """0 to 100: records in use start at 100, deleted ones at 45 and gain by what is left of their data."""
    data = F.when(has_runs & (size > 0), 35).when(has_resident & (size > 0), 25).when(size > 0, 10).otherwise(0)
    deleted = F.lit(45) + data - F.when(is_directory, 10).otherwise(0) - F.when(fixup_ok, 0).otherwise(20)
    return F.when(in_use, F.when(fixup_ok, 100).otherwise(75)).otherwise(F.greatest(F.lit(0), F.least(F.lit(95), deleted))).cast("int")


def fat_deleted_cap(confidence: Column | str, deleted: Column, has_chain: Column) -> Column:
    """A deleted file whose cluster chain is gone is at most 35; to be applied after confidence is set."""
    return F.when(deleted & ~has_chain, F.least(col(confidence), F.lit(35))).otherwise(col(confidence))


def ata_health(reallocated: Column | str, pending: Column | str) -> Column:
    r, p = F.coalesce(col(reallocated), F.lit(0)) > 0, F.coalesce(col(pending), F.lit(0)) > 0
    return F.when(r & p, "Bad").when(r | p, "Warning").otherwise("Good")


def nvme_health(warning: Column | str, spare: Column | str, spare_threshold: Column | str, used_percent: Column | str) -> Column:
    worn = (col(spare) >= 0) & (col(spare_threshold) >= 0) & (col(spare) <= col(spare_threshold))
    return F.when(col(warning) != 0, "Bad").when(F.coalesce(worn, F.lit(False)) | F.coalesce(col(used_percent) > 100, F.lit(False)), "Warning").otherwise("Good")


def nvme_bytes(data_units: Column | str) -> Column:
    """Bytes of NVMe data units: thousands of 512-byte blocks."""
    return col(data_units) * F.lit(512_000)


def entropy_class(entropy: Column | str) -> Column:
    return F.when(col(entropy) > 7, "high").when(col(entropy) > 4.5, "mid").otherwise("low")


def _starts(data: Column, signature: bytes, at: int = 0) -> Column:
    return F.substring(data, at + 1, len(signature)) == F.lit(signature)


def sniff_mime(data: Column | str) -> Column:
    """The type that a file's first bytes show; empty if they show none. data is binary."""
    d = col(data)
    little = lambda at: F.conv(F.concat(*[F.hex(F.substring(d, at + k + 1, 1)) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    size, offset = little(2), little(10)
    bmp = _starts(d, b"BM") & (F.octet_length(d) >= 14) & offset.between(14, 1 << 20) & ((size == 0) | (size >= offset))
    bmp &= (F.octet_length(d) < 18) | little(14).isin(12, 40, 108, 124)
    # Signatures.
    return (
        F.when(d.isNull() | (F.octet_length(d) < 3), "")
        .when(_starts(d, b"\xff\xd8\xff"), "image/jpeg")
        .when(_starts(d, b"\x89PNG\r\n\x1a\n"), "image/png")
        .when(_starts(d, b"GIF87a") | _starts(d, b"GIF89a"), "image/gif")
        .when(_starts(d, b"RIFF") & _starts(d, b"WEBP", 8), "image/webp")
        .when(bmp, "image/bmp")
        .when(_starts(d, b"%PDF"), "application/pdf")
        .otherwise("")
    )


def is_container(data: Column | str) -> Column:
    d = col(data)
    return _starts(d, b"ftyp", 4) | _starts(d, b"RIFF") | _starts(d, b"\x1a\x45\xdf\xa3") | _starts(d, b"PK") | _starts(d, b"MZ")


def printable_percent(data: Column | str, most: int, utf8: bool = False) -> Column:
    """The share of tabs, line ends and printable ASCII in the first bytes, in whole percent; null for no bytes. utf8: well-formed
    UTF-8 beyond ASCII counts too, control characters and what stands for malformed bytes do not."""
    head = F.substring(col(data), 1, most)
    n = F.octet_length(head)
    if utf8:
        shown = F.octet_length(F.regexp_replace(F.make_valid_utf8(head.cast("string")), r"[^\t\n\r\x20-\x7e\u00a0-\x{10ffff}]|\ufffd", ""))
    else:
        shown = F.char_length(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^\t\n\r\x20-\x7e]", ""))
    return F.when(n > 0, F.floor(shown * 100 / n))


def preview_kind(name: Column | str, data: Column | str, utf8: bool = False) -> Column:
    """Struct of kind (image, pdf, text, binary) and mime. First bytes beat the extension. utf8: accented text is text too."""
    mime, ext = sniff_mime(data), extension_of(name)
    # Types by extension.
    images = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "ico": "image/x-icon"}
    by_ext = F.create_map(*[F.lit(x) for item in images.items() for x in item])
    text = ext.isin("txt", "log", "csv", "json", "xml", "md", "html", "htm")
    body = ~is_container(data) & F.coalesce(printable_percent(data, 512, utf8) >= PRINTABLE_FROM, F.lit(False))
    pair = lambda kind, m: F.struct(F.lit(kind).alias("kind"), (m if isinstance(m, Column) else F.lit(m)).alias("mime"))
    return (
        F.when(mime.startswith("image/"), pair("image", mime))
        .when(mime == "application/pdf", pair("pdf", mime))
        .when(ext.isin("bmp", "tif", "tiff"), pair("binary", ""))
        .when(ext.isin(*images), pair("image", F.try_element_at(by_ext, ext)))
        .when(ext == "pdf", pair("pdf", ""))
        .when(text, pair("text", ""))
        .when(body, pair("text", "text/plain"))
        .otherwise(pair("binary", ""))
    )


def media_container(data: Column | str) -> Column:
    """mp4, riff kind, matroska, ogg, flac or mp3, as the first bytes show; empty otherwise."""
    d = col(data)
    return (
        F.when(_starts(d, b"ftyp", 4), "mp4")
        .when(_starts(d, b"RIFF"), F.lower(F.trim(F.decode(F.substring(d, 9, 4), "ISO-8859-1"))))
        .when(_starts(d, b"\x1a\x45\xdf\xa3"), "matroska")
        .when(_starts(d, b"OggS"), "ogg")
        .when(_starts(d, b"fLaC"), "flac")
        .when(_starts(d, b"ID3"), "mp3")
        .otherwise("")
    )


def pdf_info(data: Column | str, field: str) -> Column:
    """A literal string of a PDF's info dictionary, such as Title or Producer; empty if absent."""
    return F.regexp_extract(F.decode(col(data), "ISO-8859-1"), rf"/{field}\s*\(([^)]*)\)", 1)


def phase_step(phase: Column | str, scan_type: Column | str) -> Column:
    """'step/of' of a scan: deep scans have a metadata and a carve step."""
    deep = col(scan_type).isin("deep", "full_carve")
    return F.when(deep & F.coalesce(col(phase), F.lit("")).isin("carve", "carve_skipped"), "2/2").when(deep, "1/2").otherwise("1/1")


def progress_percent(done: Column | str, total: Column | str) -> Column:
    return F.when(col(total) > 0, F.least(F.lit(100), F.floor(col(done) * 100 / col(total)))).otherwise(0).cast("int")
