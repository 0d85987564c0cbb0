"""HFS+ and APFS: catalogs and trees are read leaf by leaf, wherever a leaf lies; names, extents and paths meet in joins."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import utf16
from ..functions.times import EPOCH_1904
from ..operators.graph import rebuild_paths

#: HFS+ root folder, confidence of catalog rows.
HFS_ROOT, HFS_CONFIDENCE = 2, 90


# HFS+.


@dataclass(frozen=True)
class HfsVolume:
    block: int
    blocks: int
    catalog: list[tuple[int, int]]
    overflow: list[tuple[int, int]]
    catalog_size: int


def fork(raw: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(size, (first block, blocks) of up to eight extents)."""
    pairs = struct.unpack_from(">16I", raw, 16)
    return struct.unpack_from(">Q", raw)[0], [(a, n) for a, n in zip(pairs[::2], pairs[1::2]) if n]


def hfs_volume(header: bytes) -> HfsVolume | None:
    """From the 512 bytes at offset 1024 of a volume."""
    if header[:2] not in (b"H+", b"HX") or len(header) < 512:
        return None
    block, blocks = struct.unpack_from(">II", header, 40)
    size, catalog = fork(header[272:352])
    return HfsVolume(block, blocks, catalog, fork(header[192:272])[1], size) if block >= 512 and not block & (block - 1) else None


def node_records(node: bytes) -> tuple[int, list[bytes]]:
    """(kind, records) of a tree node; kind -1 is a leaf."""
    kind, count = struct.unpack_from(">b", node, 8)[0], struct.unpack_from(">H", node, 10)[0]
    if 14 + 2 * (count + 1) > len(node):
        return kind, []
    ends = struct.unpack(f">{count + 1}H", node[-2 * (count + 1) :])[::-1]
    return kind, [node[a:b] for a, b in zip(ends, ends[1:]) if 14 <= a < b <= len(node)]


def hfs_entry(record: bytes) -> dict | None:
    """A folder or file of a catalog leaf record."""
    key, parent, n = struct.unpack_from(">HIH", record)
    at = 2 + key + (key & 1)
    if at + 20 > len(record) or 8 + 2 * n > at:
        return None
    kind, node, created, modified = struct.unpack_from(">h6xIII", record, at)
    if kind not in (1, 2):
        return None
    size, extents = fork(record[at + 88 : at + 168]) if kind == 2 and at + 168 <= len(record) else (0, [])
    unix = lambda t: max(0, t - EPOCH_1904)
    return {"node": node, "parent": parent, "name": utf16(record[8 : 8 + 2 * n], big=True), "is_directory": kind == 1, "size_bytes": size, "created_at": unix(created), "modified_at": unix(modified), "extents": extents}


def hfs_nodes(read: Callable[[int, int], bytes]) -> Iterator[bytes]:
    """The nodes of a volume's catalog. read(offset, size) reads bytes of the volume."""
    v = hfs_volume(read(1024, 512))
    if v is None or not v.catalog:
        return
    data = b"".join(read(a * v.block, n * v.block) for a, n in v.catalog)[: v.catalog_size]
    size = struct.unpack_from(">H", data, 32)[0]
    for at in range(size, len(data), size or len(data)):
        yield data[at : at + size]


_RUN = pa.struct([("start_sector", pa.int64()), ("sector_count", pa.int64()), ("is_sparse", pa.bool_())])
_HFS = pa.schema([("node", pa.int64()), ("parent", pa.int64()), ("name", pa.string()), ("is_directory", pa.bool_()), ("size_bytes", pa.int64()), ("created_at", pa.int64()), ("modified_at", pa.int64()), ("runs", pa.list_(_RUN))])
_RUNS_DDL = "runs array<struct<start_sector:bigint,sector_count:bigint,is_sparse:boolean>>"


def hfs_files(nodes: DataFrame, block: int, sector: int = 512, volume_sector: int = 0) -> DataFrame:
    """File rows of catalog nodes (data). A parent may come after its children; one that is missing ends the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(0).to_pylist():
                kind, records = node_records(raw)
                for e in filter(None, map(hfs_entry, records if kind == -1 else [])):
                    runs = [{"start_sector": volume_sector + a * block // sector, "sector_count": n * block // sector, "is_sparse": False} for a, n in e.pop("extents")]
                    rows.append(e | {"runs": runs})
            yield pa.RecordBatch.from_pylist(rows, schema=_HFS)

    rows = nodes.select("data").mapInArrow(run, f"node long, parent long, name string, is_directory boolean, size_bytes long, created_at long, modified_at long, {_RUNS_DDL}")
    rows = rows.where(F.col("node") != HFS_ROOT)
    paths = rebuild_paths(rows.select("node", "parent", "name"), root=HFS_ROOT)
    return rows.join(paths, "node").withColumns({"source": F.lit("hfs_catalog"), "status": F.lit(1), "confidence": F.lit(HFS_CONFIDENCE)})


# APFS.

#: Record types in file-system trees, and the kinds of tree nodes.
INODE, EXTENT, ENTRY = 3, 8, 9
TREE_ROOT, TREE_NODE, FS_TREE = 2, 3, 14


def container(block: bytes) -> dict | None:
    """Geometry and volume ids of a container superblock."""
    if block[32:36] != b"NXSB":
        return None
    size, blocks = struct.unpack_from("<IQ", block, 36)
    omap = struct.unpack_from("<Q", block, 160)[0]
    return {"block": size, "blocks": blocks, "omap": omap, "volumes": [x for x in struct.unpack_from("<100Q", block, 184) if x] if len(block) >= 984 else []}


def volume_name(block: bytes) -> str | None:
    """The name of an APSB volume superblock."""
    return block[704:960].split(b"\0", 1)[0].decode("utf-8", "replace") if block[32:36] == b"APSB" else None


def tree_records(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of a leaf node of a file-system tree."""
    kind, subtype = struct.unpack_from("<II", block, 24)
    flags, level, count, toc_at, toc_size = struct.unpack_from("<HHIHH", block, 32)
    if kind & 0xFFFF not in (TREE_ROOT, TREE_NODE) or subtype != FS_TREE or level or not flags & 2 or flags & 4:
        return
    toc, keys, end = 56 + toc_at, 56 + toc_at + toc_size, len(block) - (40 if flags & 1 else 0)
    for k in range(count):
        if toc + 8 * k + 8 > len(block):
            return
        ko, kn, vo, vn = struct.unpack_from("<HHHH", block, toc + 8 * k)
        if keys + ko + kn <= len(block) and 0 <= end - vo and end - vo + vn <= len(block):
            yield block[keys + ko : keys + ko + kn], block[end - vo : end - vo + vn]


def apfs_rows(block: bytes, size: int, sector: int = 512, volume_sector: int = 0) -> Iterator[dict]:
    """Directory entries (oid, name) and extents (oid, logical, run) of a leaf."""
    for key, value in tree_records(block):
        if len(key) < 8:
            continue
        head = struct.unpack_from("<Q", key)[0]
        oid, kind = head & (1 << 60) - 1, head >> 60
        if kind == ENTRY and len(key) >= 12 and len(value) >= 8:
            n = struct.unpack_from("<I", key, 8)[0] & 0x3FF
            yield {"oid": struct.unpack_from("<Q", value)[0], "parent": oid, "name": key[12 : 12 + n].rstrip(b"\0").decode("utf-8", "replace"), "logical": None, "start_sector": None, "sector_count": None}
        elif kind == EXTENT and len(key) >= 16 and len(value) >= 16:
            length, first = struct.unpack_from("<QQ", value)
            length &= (1 << 56) - 1
            yield {"oid": oid, "parent": None, "name": None, "logical": struct.unpack_from("<Q", key, 8)[0], "start_sector": volume_sector + first * size // sector, "sector_count": -(-length // sector)}


_APFS = pa.schema([("oid", pa.int64()), ("parent", pa.int64()), ("name", pa.string()), ("logical", pa.int64()), ("start_sector", pa.int64()), ("sector_count", pa.int64())])


def apfs_files(chunks: DataFrame, block: int = 4096, sector: int = 512, volume_sector: int = 0) -> DataFrame:
    """File rows of all tree leaves of a volume; chunks hold whole blocks."""
    from ..operators.enrich import names_with_extents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(0).to_pylist():
                for at in range(0, len(data) - block + 1, block):
                    if data[at + 28 : at + 32] == b"\x0e\0\0\0":
                        rows += apfs_rows(data[at : at + block], block, sector, volume_sector)
            yield pa.RecordBatch.from_pylist(rows, schema=_APFS)

    rows = chunks.select("data").mapInArrow(run, "oid long, parent long, name string, logical long, start_sector long, sector_count long")
    names = rows.where("name is not null").select("oid", "name").distinct()
    run_of = F.struct("logical", F.struct(F.col("start_sector"), F.col("sector_count"), F.lit(False).alias("is_sparse")).alias("r"))
    extents = rows.where("logical is not null").groupBy("oid").agg(F.transform(F.array_sort(F.collect_set(run_of)), lambda x: x["r"]).alias("runs"))
    return names_with_extents(names, extents, sector)


# ReFS.


def refs_boot(data: bytes) -> dict | None:
    if data[3:11] != b"ReFS\0\0\0\0" or len(data) < 64:
        return None
    sectors, sector, per = struct.unpack_from("<QII", data, 24)
    return {"sectors": sectors, "sector": sector, "cluster": sector * per, "major": data[40], "minor": data[41], "serial": struct.unpack_from("<Q", data, 56)[0]}


def refs_pages(chunks: DataFrame, page: int = 16384) -> DataFrame:
    """(volume_id, byte_offset, kind) of superblocks, checkpoints and tree pages at page bounds; chunks hold whole pages. In the JVM."""
    at = F.sequence(F.lit(0), F.octet_length("data") - 1, F.lit(page))
    rows = chunks.select("volume_id", "byte_offset", "data", F.explode(at).alias("_at"))
    rows = rows.select("volume_id", (F.col("byte_offset") + F.col("_at")).alias("byte_offset"), F.expr("substring(data, _at + 1, 4)").alias("_mark"))
    kind = F.when(F.col("_mark") == F.lit(b"SUPB"), "superblock").when(F.col("_mark") == F.lit(b"CHKP"), "checkpoint").when(F.col("_mark") == F.lit(b"MSB+"), "tree")
    return rows.withColumn("kind", kind).where("kind is not null").drop("_mark")


def refs_integrity(good: bool | None, page: bool = True) -> int:
    """Confidence of a page or file by its checksum."""
    return (95 if page else 92) if good else (35 if page else 30)
