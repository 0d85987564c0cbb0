"""APFS containers as tables: objects of all transactions, the state at a checkpoint, and the files of its trees.

One pass over the chunks finds the metadata objects (superblocks, object maps, tree nodes) by their type and checksum,
whatever transaction wrote them. Everything else is joins over this small table: an object map's tree gives (object,
transaction, address), an as-of look-up keeps of each object the one of the largest transaction that is no later than the
checkpoint's, and a tree is expanded level by level, its frontier joined with the map and with the nodes. So nodes that a
later transaction replaced, or that no tree reaches, give no rows, and all volumes of all containers are read in the same few
rounds. apple.apfs_files reads leaves without any map, for containers whose maps are lost.

A container starts at `start` bytes of its volume, by whole blocks; chunks hold whole blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import APFS_EXTENT, APFS_NAME, APFS_WITH_EXTENT
from ..operators.graph import rebuild_paths
from .apple import ENTRY, EXTENT, INODE, container, volume_name
from .volumes import FEW, cut, dealt, little, runs_of, spanned

# Object types (the low 16 bits) that are kept, flags of tree nodes and of map entries, the root folder,
# the inode field that holds a stream's size, and the kind of folders in directory entries.
SUPERBLOCK, TREE_ROOT, TREE_NODE, MAP, VOLUME = 1, 2, 3, 11, 13
KEPT = (SUPERBLOCK, TREE_ROOT, TREE_NODE, MAP, VOLUME)
IS_ROOT, IS_LEAF, FIXED = 1, 2, 4
MAP_DELETED = 1
ROOT = 2
STREAM = 8
FOLDER = 4


def fletcher(words: np.ndarray) -> np.ndarray:
    """The checksum of each row of 32-bit words (a block without its first eight bytes)."""
    most, w = np.uint64(2**32 - 1), words.astype(np.uint64)
    one = w.sum(axis=1) % most
    two = (w * np.arange(w.shape[1], 0, -1, dtype=np.uint64)).sum(axis=1) % most
    low = most - (one + two) % most
    high = most - (one + low) % most
    return high << np.uint64(32) | low


OBJECT = pa.schema([("volume_id", pa.string()), ("paddr", pa.int64()), ("oid", pa.int64()), ("xid", pa.int64()), ("type", pa.int32()), ("data", pa.binary())])
OBJECT_DDL = "volume_id string, paddr long, oid long, xid long, type int, data binary"


def objects(chunks: DataFrame, block: int = 4096, start: int = 0) -> DataFrame:
    """(volume_id, paddr, oid, xid, type, data) of the metadata blocks whose checksum is right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for volume, offset, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                skip = (start - offset) % block if offset >= start else start - offset
                n = max(0, len(data) - skip) // block
                words = np.frombuffer(data, "<u4", n * block // 4, skip).reshape(n, -1) if n else np.zeros((0, 8), "<u4")
                at = np.flatnonzero(np.isin(words[:, 6] & 0xFFFF, KEPT))
                sums = words[at, 0].astype(np.uint64) | words[at, 1].astype(np.uint64) << np.uint64(32)
                at = at[fletcher(words[at, 2:]) == sums]
                heads = np.ascontiguousarray(words[at, 2:6]).view("<i8")
                rows = [[volume] * len(at), ((offset + skip - start) // block + at).tolist(), heads[:, 0].tolist(), heads[:, 1].tolist(), (words[at, 6] & 0xFFFF).tolist(), [data[skip + k * block : skip + (k + 1) * block] for k in at.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, OBJECT)], schema=OBJECT)

    return chunks.select("volume_id", "byte_offset", "data").mapInArrow(run, OBJECT_DDL)


def node(block: bytes) -> tuple[int, bool, list[tuple[bytes, bytes]]]:
    """(level, whether it is a leaf, (key, value) pairs) of a tree node. Pairs that leave the block are left out."""
    flags, level, count, toc_at, toc_size = struct.unpack_from("<HHIHH", block, 32)
    fixed, toc = bool(flags & FIXED), 56 + toc_at
    keys, end = toc + toc_size, len(block) - (40 if flags & IS_ROOT else 0)
    key_size, value_size = 16, 16 if flags & IS_LEAF else 8
    out = []
    for k in range(min(count, (len(block) - toc) // (4 if fixed else 8))):
        if fixed:
            ko, vo = struct.unpack_from("<HH", block, toc + 4 * k)
            kn, vn = key_size, value_size
        else:
            ko, kn, vo, vn = struct.unpack_from("<HHHH", block, toc + 8 * k)
        if keys + ko + kn <= len(block) and 0 <= end - vo and end - vo + vn <= len(block):
            out.append((block[keys + ko : keys + ko + kn], block[end - vo : end - vo + vn]))
    return level, bool(flags & IS_LEAF), out


PAIR = pa.schema([("volume_id", pa.string()), ("tree", pa.int64()), ("level", pa.int32()), ("leaf", pa.bool_()), ("child", pa.int64()), ("key", pa.binary()), ("value", pa.binary())])
PAIR_DDL = "volume_id string, tree long, level int, leaf boolean, child long, key binary, value binary"


def pairs(nodes: DataFrame) -> DataFrame:
    """The pairs of nodes (volume_id, tree, above, data) that lie below the level `above`: of inner nodes the child, of leaves key and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for volume, tree, above, data in zip(*(b.column(k).to_pylist() for k in range(4))):
                level, leaf, found = node(data)
                if level < above:
                    rows += [(volume, tree, level, leaf, None if leaf or len(v) < 8 else struct.unpack_from("<q", v)[0], k if leaf else None, v if leaf else None) for k, v in found]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(PAIR), PAIR)], schema=PAIR)

    return nodes.select("volume_id", "tree", "above", "data").mapInArrow(run, PAIR_DDL)


def leaves(roots: DataFrame, nodes: DataFrame, located: Callable[[DataFrame], DataFrame], most_rows: int = FEW) -> DataFrame:
    """The leaf pairs (volume_id, tree, key, value) of trees, level by level. roots: volume_id, tree, child; located adds the address (paddr) of each child.

    A child has to lie on a lower level than its parent, so damaged trees end too; the rounds are the levels of the highest tree.
    A frontier of up to most_rows nodes (counted) is broadcast to the nodes, a larger one meets them in a shuffle.
    """
    trees = nodes.where(F.col("type").isin(TREE_ROOT, TREE_NODE)).select("volume_id", "paddr", "data")
    frontier, found = roots.select("volume_id", "tree", "child", F.lit(1 << 16).alias("above")), []
    n = frontier.count()
    while True:
        sent = F.broadcast if n <= most_rows else dealt
        got = cut(pairs(dealt(trees).join(sent(located(sent(frontier))), ["volume_id", "paddr"])))
        found.append(got.where("leaf").select("volume_id", "tree", "key", "value"))
        frontier = got.where("not leaf and child is not null").groupBy("volume_id", "tree", "child").agg(F.max("level").alias("above"))
        n = frontier.count()
        if not n:
            return reduce(DataFrame.unionByName, found)


def mapped(roots: DataFrame, nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """(volume_id, tree, oid, paddr) of object maps at their checkpoint: of each object the entry of the largest transaction up to the limit.

    roots: volume_id, tree, child (the address of the map's tree); limits: volume_id, xid. An object whose entry is marked as
    deleted has no address.
    """
    pair = leaves(roots, nodes, lambda f: f.withColumn("paddr", F.col("child")))
    rows = pair.mapInArrow(map_entries, "volume_id string, tree long, oid long, xid long, gone boolean, paddr long")
    rows = rows.join(limits.select("volume_id", F.col("xid").alias("_limit")), "volume_id").where("xid <= _limit")
    last = rows.groupBy("volume_id", "tree", "oid").agg(F.max_by(F.struct("gone", "paddr"), "xid").alias("x"))
    return last.where("not x.gone").select("volume_id", "tree", "oid", "x.paddr")


def map_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for volume, tree, key, value in zip(*(b.column(k).to_pylist() for k in range(4))):
            if len(key) >= 16 and len(value) >= 16:
                (oid, xid), (flags, _, paddr) = struct.unpack_from("<qq", key), struct.unpack_from("<IIq", value)
                rows.append((volume, tree, oid, xid, bool(flags & MAP_DELETED), paddr))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["volume_id", "tree", "oid", "xid", "gone", "paddr"])


def checkpoints(nodes: DataFrame, as_of: int | None = None) -> DataFrame:
    """(volume_id, xid, omap, volumes) of the latest superblock of each container, or the latest up to a transaction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(v, x, c["omap"], c["volumes"]) for v, x, d in zip(*(b.column(k).to_pylist() for k in range(3))) if (c := container(d))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())])], names=["volume_id", "xid", "omap", "volumes"])

    rows = nodes.where((F.col("type") == SUPERBLOCK) & (F.lit(True) if as_of is None else F.col("xid") <= as_of)).select("volume_id", "xid", "data")
    rows = rows.mapInArrow(run, "volume_id string, xid long, omap long, volumes array<long>")
    return rows.groupBy("volume_id").agg(F.max_by(F.struct("xid", "omap", "volumes"), "xid").alias("x")).select("volume_id", "x.*")


RECORD = pa.schema([
    ("volume_id", pa.string()), ("tree", pa.int64()), ("kind", pa.int32()), ("oid", pa.int64()), ("parent", pa.int64()), ("name", pa.string()), ("is_directory", pa.bool_()),
    ("stream", pa.int64()), ("created_at", pa.int64()), ("modified_at", pa.int64()), ("size", pa.int64()), ("logical", pa.int64()), ("block", pa.int64()), ("length", pa.int64()),
])
RECORD_DDL = "volume_id string, tree long, kind int, oid long, parent long, name string, is_directory boolean, stream long, created_at long, modified_at long, size long, logical long, block long, length long"


def stream_size(value: bytes) -> int | None:
    """The size in the data-stream field of an inode record."""
    if len(value) < 96:
        return None
    n = struct.unpack_from("<H", value, 92)[0]
    at = 96 + 4 * n
    for k in range(n):
        if 96 + 4 * k + 4 > len(value):
            return None
        kind, _, size = struct.unpack_from("<BBH", value, 96 + 4 * k)
        if kind == STREAM and at + 8 <= len(value):
            return struct.unpack_from("<q", value, at)[0]
        at += size + 7 & ~7
    return None


def record(key: bytes, value: bytes) -> tuple | None:
    """A directory entry, an inode or an extent of a file-system tree, in the order of RECORD after volume and tree."""
    if len(key) < 8:
        return None
    head = struct.unpack_from("<Q", key)[0]
    oid, kind = head & (1 << 60) - 1, head >> 60
    if kind == ENTRY and len(key) >= 12 and len(value) >= 18:
        n = struct.unpack_from("<I", key, 8)[0] & 0x3FF
        return kind, struct.unpack_from("<q", value)[0], oid, key[12 : 12 + n].rstrip(b"\0").decode("utf-8", "replace"), value[16] & 15 == FOLDER, *[None] * 7
    if kind == INODE and len(value) >= 92:
        stream, created, modified = struct.unpack_from("<qqq", value, 8)
        return kind, oid, None, None, None, stream, created // 10**9, modified // 10**9, stream_size(value), None, None, None
    if kind == EXTENT and len(key) >= 16 and len(value) >= 16:
        length, first = struct.unpack_from("<Qq", value)
        return kind, oid, *[None] * 7, struct.unpack_from("<q", key, 8)[0], first, length & (1 << 56) - 1
    return None


def records(pair: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(v, t, *r) for v, t, key, value in zip(*(b.column(k).to_pylist() for k in range(4))) if (r := record(key, value))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(RECORD), RECORD)], schema=RECORD)

    return pair.select("volume_id", "tree", "key", "value").mapInArrow(run, RECORD_DDL)


def volumes_of(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """(volume_id, tree, name, omap, root) of the file-system volumes of containers at their checkpoints; tree is the volume's object id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(v, t, volume_name(d), *struct.unpack_from("<qq", d, 128)) for v, t, d in zip(*(b.column(k).to_pylist() for k in range(3))) if d[32:36] == b"APSB"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["volume_id", "tree", "name", "omap", "root"])

    known = mapped(map_roots(nodes, state.select("volume_id", F.lit(0).cast("long").alias("tree"), "omap")), nodes, state)
    ids = state.select("volume_id", F.explode("volumes").alias("oid"))
    blocks = ids.join(known, ["volume_id", "oid"]).join(dealt(nodes.where(F.col("type") == VOLUME).select("volume_id", "paddr", "data")), ["volume_id", "paddr"])
    return blocks.select("volume_id", F.col("oid").alias("tree"), "data").mapInArrow(run, "volume_id string, tree long, name string, omap long, root long")


def map_roots(nodes: DataFrame, maps: DataFrame) -> DataFrame:
    """(volume_id, tree, child): the address of the tree of each object map (volume_id, tree, omap: the map's address)."""
    found = nodes.where(F.col("type") == MAP).select("volume_id", F.col("paddr").alias("omap"), little("data", 48, 8).alias("child"))
    return maps.join(dealt(found), ["volume_id", "omap"]).select("volume_id", "tree", "child")


def files(chunks: DataFrame, block: int = 4096, as_of: int | None = None, sector: int = 512, start: int = 0) -> DataFrame:
    """File and folder rows of all volumes of all containers at their latest checkpoint, or at the latest up to transaction as_of.

    volume_id, volume (its name), tree (its object id), oid, parent, name, path (of folders, from the volume's root),
    is_directory, size_bytes, created_at, modified_at, runs, start_sector, end_sector, status, confidence, source. Extents
    without a name come as extent_<id>; a name without inode or extents stays, at less confidence.
    """
    nodes = cut(objects(chunks, block, start))
    state = cut(checkpoints(nodes, as_of))
    volumes = cut(volumes_of(nodes, state))
    known = cut(mapped(map_roots(nodes, volumes.select("volume_id", "tree", "omap")), nodes, state))
    address = lambda f: f.join(dealt(known.withColumnRenamed("oid", "child")), ["volume_id", "tree", "child"])
    rows = cut(records(leaves(volumes.select("volume_id", "tree", F.col("root").alias("child")), nodes, address)))

    keys = ["volume_id", "tree"]
    entries = rows.where(F.col("kind") == ENTRY).select(*keys, "oid", "parent", "name", "is_directory").distinct()
    inodes = rows.where(F.col("kind") == INODE).groupBy(*keys, "oid").agg(F.max(F.struct("stream", "created_at", "modified_at", "size")).alias("i")).select(*keys, "oid", "i.*")
    per = block // sector
    spans = rows.where(F.col("kind") == EXTENT).select(*keys, F.col("oid").alias("stream"), (F.col("logical") / sector).cast("long").alias("logical"), F.when(F.col("block") != 0, F.lit(start // sector) + F.col("block") * per).alias("start_sector"), F.ceil(F.col("length") / sector).alias("sector_count"))
    runs = runs_of(spans.distinct(), [*keys, "stream"])
    # one folder entry a node makes its path; a file with two names (hard links) has a row for each
    folders = entries.where("is_directory").groupBy(*keys, F.col("oid").alias("node")).agg(F.min(F.struct("parent", "name")).alias("x")).select(*keys, "node", "x.*")
    paths = rebuild_paths(dealt(cut(folders)), root=ROOT, keys=keys, settle=lambda df: dealt(cut(df))).withColumnRenamed("node", "parent").withColumnRenamed("path", "_above")

    named = entries.join(dealt(inodes), [*keys, "oid"], "left").withColumn("stream", F.coalesce("stream", "oid"))
    all_ = named.join(dealt(paths), [*keys, "parent"], "left").join(dealt(runs), [*keys, "stream"], "full").join(volumes.select(*keys, F.col("name").alias("volume")), keys, "left")
    has, is_named = F.col("runs").isNotNull(), F.col("name").isNotNull()
    sectors = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["sector_count"])
    name = F.coalesce("name", F.concat(F.lit("extent_"), F.col("stream").cast("string")))
    first, last = spanned(F.col("runs"))
    return all_.select(
        "volume_id", "volume", "tree", F.coalesce("oid", "stream").alias("oid"), "parent", name.alias("name"),
        F.when(is_named, F.concat(F.coalesce("_above", F.lit("")), F.lit("/"), name)).otherwise(F.concat(F.lit("/extent/"), F.col("stream").cast("string"))).alias("path"),
        F.coalesce("is_directory", F.lit(False)).alias("is_directory"), F.coalesce("size", F.when(has, sectors * sector), F.lit(0)).cast("long").alias("size_bytes"),
        F.coalesce("created_at", F.lit(0)).cast("long").alias("created_at"), F.coalesce("modified_at", F.lit(0)).cast("long").alias("modified_at"), "runs",
        first.alias("start_sector"), last.alias("end_sector"),
        F.lit(1).alias("status"), F.when(is_named & has, APFS_WITH_EXTENT).when(is_named, APFS_NAME).otherwise(APFS_EXTENT).alias("confidence"),
        F.when(is_named, "apfs_file").otherwise("apfs_extent").alias("source"),
    )
