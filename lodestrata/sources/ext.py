"""ext2, ext3 and ext4 volumes as tables: superblocks, group descriptors, inodes, their blocks, directories.

Each level is one look-up in the chunks for all volumes at once: superblocks give the groups, descriptors the inode tables,
inodes the heads of extent trees and of block maps. Inner nodes of extent trees and pointer blocks of one, two and three
levels are one frontier, expanded round by round until only runs of blocks are left, six rounds at most. Directories are read
from their runs, entries meet inodes in a join, and paths come from the links. No task holds a volume.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import entries_with_inodes
from ..operators.graph import rebuild_paths
from .volumes import CHUNK, blocks_at, cut, dealt, first_sectors, little, runs_of, spanned, table

# The root folder, the first inode that isn't reserved, the flag of inodes with extents, the deepest tree.
ROOT, FIRST, EXTENTS, DEEPEST = 2, 11, 0x80000, 5
#: Bytes of an inode table that are read as one piece; a power of two, as inodes are.
PIECE = 1 << 16


@dataclass(frozen=True)
class Super:
    block: int
    blocks: int
    inodes: int
    blocks_a_group: int
    inodes_a_group: int
    inode_size: int
    first_block: int
    descriptor: int


def superblock(data: bytes) -> Super | None:
    """From the 1024 bytes at offset 1024 of a volume."""
    if len(data) < 264 or data[56:58] != b"\x53\xef":
        return None
    inodes, blocks = struct.unpack_from("<II", data, 0)
    first, log = struct.unpack_from("<II", data, 20)
    per_block, _, per_inode = struct.unpack_from("<III", data, 32)
    revision = struct.unpack_from("<I", data, 76)[0]
    size = struct.unpack_from("<H", data, 88)[0] if revision else 128
    wide = struct.unpack_from("<I", data, 96)[0] & 0x80
    descriptor = max(32, struct.unpack_from("<H", data, 254)[0]) if wide else 32
    if wide and len(data) >= 340:
        blocks |= struct.unpack_from("<I", data, 336)[0] << 32
    if log > 6 or not per_block or not per_inode:
        return None
    return Super(1024 << log, blocks, inodes, per_block, per_inode, size or 128, first, descriptor)


def directory_entries(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(inode, file type, name); type 1 is a file and 2 a directory. Deleted entries that a record's length covers are shown with inode 0."""
    at = 0
    while at + 8 <= len(data):
        number, size, n, kind = struct.unpack_from("<IHBB", data, at)
        if size < 8 or at + size > len(data):
            return
        name = data[at + 8 : at + 8 + n].decode("utf-8", "replace")
        if n and name not in (".", ".."):
            yield number, kind, name
        hidden = at + (8 + n + 3 & ~3)
        while number and hidden + 8 < at + size:
            i, _, m, k = struct.unpack_from("<IHBB", data, hidden)
            if not m or hidden + 8 + m > at + size or k not in (1, 2) or not i:
                break
            yield 0, k, data[hidden + 8 : hidden + 8 + m].decode("utf-8", "replace")
            hidden += 8 + m + 3 & ~3
        at += size


def supers(chunks: DataFrame, chunk: int = CHUNK, start: int = 0) -> DataFrame:
    """Geometry of each volume that has a superblock."""
    names = "block long, blocks long, inodes long, blocks_a_group long, inodes_a_group long, inode_size long, first_block long, descriptor long"
    return table(first_sectors(chunks, start + 1024, 1024, chunk), ["volume_id", "data"], lambda v, d: [(v, *astuple(s))] if (s := superblock(d)) else [], f"volume_id string, {names}")


def inode(raw: bytes) -> tuple | None:
    """(is_directory, size, created, modified, deleted, whether it has extents, its 60 bytes of places); None for one never used."""
    mode, size, links, flags = struct.unpack_from("<H", raw)[0], struct.unpack_from("<I", raw, 4)[0], struct.unpack_from("<H", raw, 26)[0], struct.unpack_from("<I", raw, 32)[0]
    created, modified, deleted = struct.unpack_from("<III", raw, 12)
    kind = mode >> 12
    if kind not in (4, 8):
        return None
    if kind == 8:
        size |= struct.unpack_from("<I", raw, 108)[0] << 32
    if len(raw) >= 148 and struct.unpack_from("<H", raw, 128)[0] >= 20:
        created = struct.unpack_from("<I", raw, 144)[0]
    return kind == 4, size, created, modified, bool(deleted) or not links, bool(flags & EXTENTS), raw[40:100]


def inodes(chunks: DataFrame, geometry: DataFrame, chunk: int = CHUNK, start: int = 0) -> DataFrame:
    """(volume_id, inode, is_directory, size_bytes, created_at, modified_at, deleted, extents, places, block) of the inodes in use or once in use."""
    groups = geometry.withColumn("group", F.explode(F.sequence(F.lit(0), F.ceil(F.col("blocks") / F.col("blocks_a_group")) - 1)))
    at = F.lit(start) + (F.col("first_block") + 1) * F.col("block") + F.col("group") * F.col("descriptor")
    found = blocks_at(groups.withColumns({"byte_offset": at, "length": F.col("descriptor")}), chunks, chunk)
    place = little("data", 8, 4) + F.when(F.col("descriptor") > 32, F.shiftleft(little("data", 40, 4), 32)).otherwise(0)
    tables = found.select("volume_id", "group", "block", "inode_size", "inodes_a_group", place.alias("at")).where("at > 0")
    size, bytes_ = F.lit(min(PIECE, 1 << chunk.bit_length() - 1)), F.col("inodes_a_group") * F.col("inode_size")
    pieces = tables.withColumn("skip", F.explode(F.sequence(F.lit(0).cast("long"), bytes_ - 1, size.cast("long"))))
    pieces = pieces.select("volume_id", "block", "inode_size", (F.col("group") * F.col("inodes_a_group") + F.col("skip") / F.col("inode_size") + 1).cast("long").alias("first"), (F.lit(start) + F.col("at") * F.col("block") + F.col("skip")).alias("byte_offset"), F.least(size, bytes_ - F.col("skip")).alias("length"))

    def parse(volume: str, block: int, size: int, first: int, data: bytes) -> Iterator[tuple]:
        for k in range(len(data) // size):
            found = inode(data[k * size : (k + 1) * size]) if first + k == ROOT or first + k >= FIRST else None
            if found:
                yield volume, block, first + k, *found

    schema = "volume_id string, block long, inode long, is_directory boolean, size_bytes long, created_at long, modified_at long, deleted boolean, extents boolean, places binary"
    return table(blocks_at(pieces, chunks, chunk), ["volume_id", "block", "inode_size", "first", "data"], parse, schema)


def extent_node(node: bytes, level: int) -> Iterator[tuple[int, int, int, int]]:
    """(level, first file block, block, blocks) of an extent tree's node: runs on level 0, else children one level down."""
    if node[:2] != b"\x0a\xf3":
        return
    n, _, depth = struct.unpack_from("<HHH", node, 2)
    if depth > level:
        return
    for at in range(12, min(12 + 12 * n, len(node) - 11), 12):
        if depth:
            first, low, high = struct.unpack_from("<IIH", node, at)
            yield depth, first, high << 32 | low, 0
        else:
            first, length, high, low = struct.unpack_from("<IHHI", node, at)
            yield 0, first, high << 32 | low, length if length <= 32768 else length - 32768


def pointers(data: bytes, level: int, first: int, per: int) -> Iterator[tuple[int, int, int, int]]:
    """As extent_node for the numbers of a pointer block: neighbours on the lowest level are one run, zeros are holes."""
    step, run = per ** (level - 1), None
    for k, block in enumerate(struct.unpack(f"<{len(data) // 4}I", data[: len(data) & ~3])):
        if level > 1:
            if block:
                yield level - 1, first + k * step, block, 0
        elif run and block == run[1] + run[2]:
            run[2] += 1
        else:
            if run:
                yield 0, *run
            run = [first + k, block, 1] if block else None
    if run:
        yield 0, *run


def heads(places: bytes, extents: bool, per: int) -> Iterator[tuple[int, int, int, int]]:
    """What an inode's own places say, in the same form."""
    if extents:
        yield from extent_node(places, DEEPEST)
        return
    yield from pointers(places[:48], 1, 0, per)
    first = 12
    for level, block in enumerate(struct.unpack_from("<III", places, 48), 1):
        if block:
            yield level, first, block, 0
        first += per**level


def block_runs(chunks: DataFrame, found: DataFrame, chunk: int = CHUNK, start: int = 0) -> DataFrame:
    """(volume_id, inode, block, first, at, n): the runs of blocks of inodes (with places, extents, size_bytes), round by round."""
    schema = "volume_id string, inode long, block long, extents boolean, most long, level int, first long, at long, n long"
    known = found.withColumn("most", F.ceil(F.col("size_bytes") / F.col("block")))
    names = ["volume_id", "inode", "block", "extents", "most"]

    def opened(v: str, i: int, block: int, extents: bool, most: int, places: bytes) -> Iterator[tuple]:
        return ((v, i, block, extents, most, *x) for x in heads(places, extents, block // 4) if x[1] < most)

    def deeper(v: str, i: int, block: int, extents: bool, most: int, level: int, first: int, data: bytes) -> Iterator[tuple]:
        for x in extent_node(data, level - 1) if extents else pointers(data, level, first, block // 4):
            if x[1] < most:
                yield v, i, block, extents, most, *x

    rows, out = cut(table(known, [*names, "places"], opened, schema)), []
    while True:
        out.append(rows.where("level = 0"))
        frontier = rows.where("level > 0")
        if not frontier.limit(1).count():
            break
        wanted = frontier.withColumns({"byte_offset": F.lit(start) + F.col("at") * F.col("block"), "length": F.col("block")})
        rows = cut(table(blocks_at(wanted, chunks, chunk), [*names, "level", "first", "data"], deeper, schema))
    runs = reduce(DataFrame.unionByName, out)
    return runs.select("volume_id", "inode", "block", "first", "at", F.least("n", F.col("most") - F.col("first")).alias("n"), "most")


def files(chunks: DataFrame, chunk: int = CHUNK, sector: int = 512, start: int = 0) -> DataFrame:
    """File and folder rows of all volumes; a volume's file system begins at byte `start`, and a chunk holds a block at least.

    volume_id, inode, parent, name, path, is_directory, size_bytes, created_at, modified_at, runs (holes are sparse),
    start_sector, end_sector, status, confidence, source. Rows come from directory entries: with their inode, with one that is
    gone, without inode, or names left in the slack of a record, whose number is 0. A file with two names has two rows.
    """
    key = ["volume_id"]
    geometry = cut(supers(chunks, chunk, start))
    found = cut(inodes(chunks, geometry, chunk, start))
    blocks = cut(block_runs(chunks, found, chunk, start))
    per = F.col("block") / sector
    spans = blocks.select(*key, "inode", (F.col("first") * per).cast("long").alias("logical"), (F.lit(start // sector) + F.col("at") * per).cast("long").alias("start_sector"), (F.col("n") * per).cast("long").alias("sector_count"), (F.col("most") * per).cast("long").alias("total"))
    runs = runs_of(spans, [*key, "inode"])

    folders = found.where("is_directory").select(*key, "inode")
    places = blocks.join(dealt(folders), [*key, "inode"], "left_semi").select(*key, F.col("inode").alias("parent"), "block", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("at"))
    read = blocks_at(places.select(*key, "parent", (F.lit(start) + F.col("at") * F.col("block")).alias("byte_offset"), F.col("block").alias("length")), chunks, chunk)
    entries = cut(table(read, [*key, "parent", "data"], lambda v, p, d: ((v, p, i, t, n) for i, t, n in directory_entries(d)), "volume_id string, parent long, inode long, file_type int, name string"))

    links = entries.where("file_type = 2 and inode <> 0").groupBy(*key, F.col("inode").alias("node")).agg(F.min(F.struct("parent", "name")).alias("x")).select(*key, "node", "x.*")
    paths = rebuild_paths(dealt(cut(links)), root=ROOT, keys=key, settle=lambda df: dealt(cut(df))).withColumnRenamed("node", "parent").withColumnRenamed("path", "_above")
    all_ = entries_with_inodes(entries, dealt(found.drop("block", "extents", "places").join(dealt(runs), [*key, "inode"], "left")), key).join(dealt(paths), [*key, "parent"], "left")
    first, last = spanned(F.col("runs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return all_.select(
        *key, "inode", "parent", "name", F.concat(F.coalesce("_above", F.lit("")), F.lit("/"), F.col("name")).alias("path"), F.coalesce("is_directory", F.col("file_type") == 2).alias("is_directory"),
        zero("size_bytes"), zero("created_at"), zero("modified_at"), "runs", first.alias("start_sector"), last.alias("end_sector"), F.col("status").cast("int").alias("status"), "confidence", F.lit("ext4_dirent").alias("source"),
    )


def free_blocks(bitmap: bytes, first: int, count: int) -> list[int]:
    """Blocks of a group whose bit is clear."""
    return [first + k for k in range(count) if not bitmap[k // 8] >> (k % 8) & 1]
