"""Partition tables and file-system probes."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from .volumes import SECTOR, slice_at

PARTITIONS = "volume_id string, scheme string, number int, start_sector long, size_sectors long, type string, active boolean"


def mbr(sector0: bytes) -> list[tuple[int, int, int, str, bool]]:
    """(number, start, sectors, type, active) of the primary entries whose type isn't 0."""
    if len(sector0) < 512 or sector0[510:512] != b"\x55\xaa":
        return []
    out = []
    for k in range(4):
        flag, kind, start, size = struct.unpack_from("<B3xB3xII", sector0, 446 + 16 * k)
        if kind:
            out.append((k + 1, start, size, f"0x{kind:02X}", flag == 0x80))
    return out


def gpt(head: bytes, sector: int = SECTOR) -> list[tuple[int, int, int, str, bool]]:
    """(number, start, sectors, type, False) of the used entries. head: the volume's first sectors."""
    if head[sector : sector + 8] != b"EFI PART":
        return []
    table, count, size = struct.unpack_from("<QII", head, sector + 72)
    out = []
    for k in range(min(count, 128) if size >= 128 else 0):
        at = table * sector + k * size
        if at + 48 > len(head):
            break
        first, last = struct.unpack_from("<QQ", head, at + 32)
        if any(head[at : at + 16]) and last >= first:
            out.append((k + 1, first, last - first + 1, str(uuid.UUID(bytes_le=bytes(head[at : at + 16]))), False))
    return out


def partitions(chunks: DataFrame, sector: int = SECTOR, chunk: int | None = None) -> DataFrame:
    """The partitions of each volume; a GPT that has entries replaces the MBR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for v, head in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, scheme = gpt(head, sector), "gpt"
                if not found:
                    found, scheme = mbr(head), "mbr"
                rows += [(v, scheme, *x) for x in found]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in PARTITIONS.split(", ")])

    head = slice_at(chunks, 0, 34 * sector, chunk) if chunk else slice_at(chunks, 0, 34 * sector)
    return head.mapInArrow(run, PARTITIONS)


def _at(data: Column, offset: int, text: bytes) -> Column:
    return F.substring(data, offset + 1, len(text)) == F.lit(text)


def filesystem(data: Column | str) -> Column:
    """What the first 2 KiB of a partition show; the order decides between signatures that overlap. Stays in the JVM."""
    d = col(data)
    end = _at(d, 510, b"\x55\xaa")
    return (
        F.when(_at(d, 3, b"ReFS\0\0\0\0"), "ReFS")
        .when(_at(d, 3, b"NTFS    ") & end, "NTFS")
        .when(_at(d, 3, b"EXFAT   "), "exFAT")
        .when(_at(d, 82, b"FAT32   ") & end, "FAT32")
        .when(_at(d, 54, b"FAT16   ") & end, "FAT16")
        .when(_at(d, 54, b"FAT12   ") & end, "FAT12")
        .when(_at(d, 32, b"NXSB"), "APFS")
        .when(_at(d, 1024, b"H+") | _at(d, 1024, b"HX"), "HFS+")
        .when(_at(d, 1080, b"\x53\xef"), "EXT")
        .otherwise("unknown")
    )


def bitlocker(data: Column | str) -> Column:
    """Struct (found, offset of the first metadata block) of a boot sector."""
    d = col(data)
    little = F.conv(F.concat(*[F.hex(F.substring(d, 177 + k, 1)) for k in range(7, -1, -1)]), 16, 10)
    hit = _at(d, 3, b"-FVE-FS-")
    return F.struct(hit.alias("found"), F.when(hit, little.cast("decimal(20,0)")).alias("metadata_offset"))


def volume_serial(data: Column | str) -> Column:
    """The serial number of a boot sector: 8 bytes of NTFS and exFAT, 4 bytes of FAT; 0 for others."""
    d, kind = col(data), filesystem(data)
    little = lambda at, n: F.conv(F.concat(*[F.hex(F.substring(d, at + k + 1, 1)) for k in range(n - 1, -1, -1)]), 16, 10).cast("decimal(20,0)")
    return F.when(kind == "NTFS", little(72, 8)).when(kind == "exFAT", little(100, 4)).when(kind == "FAT32", little(67, 4)).when(kind.isin("FAT16", "FAT12"), little(39, 4)).otherwise(0)


def scan_boot_sectors(chunks: DataFrame, step: int = 512, sector: int = SECTOR) -> DataFrame:
    """(volume_id, start_sector, type): boot sectors at every step sectors, found chunk by chunk. A chunk holds whole steps."""
    spots = F.sequence(F.lit(0), F.octet_length("data") - 1, F.lit(step * sector))
    rows = chunks.select("volume_id", "byte_offset", "data", F.explode(spots).alias("_at")).select("volume_id", ((F.col("byte_offset") + F.col("_at")) / sector).cast("long").alias("start_sector"), F.expr("substring(data, _at + 1, 2048)").alias("head"))
    return rows.withColumn("type", filesystem("head")).where("type <> 'unknown'").select("volume_id", "start_sector", "type")
