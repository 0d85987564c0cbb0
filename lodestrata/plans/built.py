"""Volumes written down from rows: small file systems in the published on-disk formats, which queries and tests read back.

Builders are plain functions of a few rows to bytes; queries call them for each group of rows of a given table.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import lfn_checksum
from ..sources import apfs

BLOCK = 4096


def volumes(rows: DataFrame, volume: "F.Column", build: Callable[[pd.DataFrame], bytes], chunk: int) -> DataFrame:
    """Chunks of one volume for each value of `volume`, built of the rows that have it."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        data = build(frame)
        parts = [(str(key[0]), at // chunk, at, data[at : at + chunk]) for at in range(0, len(data), chunk)]
        return pd.DataFrame(parts, columns=["volume_id", "chunk_no", "byte_offset", "data"])

    return rows.withColumn("_volume", volume).groupBy("_volume").applyInPandas(run, "volume_id string, chunk_no long, byte_offset long, data binary")


# APFS.


def sealed(body: bytearray, oid: int, xid: int, kind: int, subtype: int = 0) -> bytes:
    """A block with its object header and checksum."""
    import numpy as np

    struct.pack_into("<qqII", body, 8, oid, xid, kind, subtype)
    struct.pack_into("<Q", body, 0, int(apfs.fletcher(np.frombuffer(bytes(body), "<u4")[None, 2:])[0]))
    return bytes(body)


def tree_node(pairs: list[tuple[bytes, bytes]], oid: int, xid: int, level: int, root: bool, fixed: bool, subtype: int) -> bytes:
    body, keys, values, toc = bytearray(BLOCK), b"", b"", b""
    for k, v in pairs:
        values = v + values
        toc += struct.pack("<HH", len(keys), len(values)) if fixed else struct.pack("<HHHH", len(keys), len(k), len(values), len(v))
        keys += k
    end = BLOCK - (40 if root else 0)
    assert 56 + len(toc) + len(keys) + len(values) <= end
    flags = (apfs.IS_ROOT if root else 0) | (0 if level else apfs.IS_LEAF) | (apfs.FIXED if fixed else 0)
    struct.pack_into("<HHIHH", body, 32, flags, level, len(pairs), 0, len(toc))
    body[56 : 56 + len(toc) + len(keys)] = toc + keys
    body[end - len(values) : end] = values
    return sealed(body, oid, xid, apfs.TREE_ROOT if root else apfs.TREE_NODE, subtype)


def tree(pairs: list[tuple[bytes, bytes]], xid: int, per: int, fixed: bool, subtype: int, oids: Iterator[int]) -> list[tuple[int, bytes]]:
    """(id, block) of the nodes of a tree, leaves first and the root last; ids are what inner nodes point with."""
    level, out, pairs = 0, [], sorted(pairs, key=lambda p: struct.unpack("<qq", p[0]) if fixed else (int.from_bytes(p[0][:8], "little") & (1 << 60) - 1, p[0][7] >> 4, p[0]))
    while True:
        parts = [pairs[k : k + per] for k in range(0, len(pairs), per)] or [[]]
        ids = [next(oids) for _ in parts]
        out += [(i, tree_node(p, i, xid, level, len(parts) == 1, fixed, subtype)) for i, p in zip(ids, parts)]
        if len(parts) == 1:
            return out
        pairs, level = [(p[0][0], struct.pack("<q", i)) for i, p in zip(ids, parts)], level + 1


def apfs_records(files: Iterable[dict]) -> list[tuple[bytes, bytes]]:
    """Entry, inode and extents of files: oid, parent, name, folder, size, created, modified (seconds), extents (logical, block, bytes)."""
    out = []
    for f in files:
        name = f["name"].encode() + b"\0"
        out.append((struct.pack("<QI", 9 << 60 | f["parent"], len(name)) + name, struct.pack("<qqH", f["oid"], 0, 4 if f["folder"] else 8)))
        inode = struct.pack("<qqqqqqqiIIIIIHHQ", f["parent"], f["oid"] + 7, f["created"] * 10**9, f["modified"] * 10**9, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0o100644, 0, 0)
        fields = struct.pack("<HH", 2, 0) + struct.pack("<BBHBBH", 4, 0, len(name), apfs.STREAM, 0, 40) + name.ljust(len(name) + 7 & ~7, b"\0") + struct.pack("<qqqqq", f["size"], 0, 0, 0, 0)
        out.append((struct.pack("<Q", 3 << 60 | f["oid"]), inode + fields))
        out += [(struct.pack("<Qq", 8 << 60 | f["oid"] + 7, logical), struct.pack("<Qqq", length, first, 0)) for logical, first, length in f["extents"]]
    return out


def apfs_container(states: dict[int, list[dict]], names: str = "Data", per: int = 8, future: int | None = None) -> bytes:
    """A container whose one volume held these files at these transactions; every node has a version for each. Map entries of
    transaction `future`, after the last one, are of a checkpoint that was never written."""
    blocks: dict[int, bytes] = {}
    free = iter(range(10, 1 << 20))
    latest, supers = max(states), []
    entries, roots = [], {}
    for xid, files in sorted(states.items()):
        oids = iter(range(1000, 1 << 20))
        for oid, block in tree(apfs_records(files), xid, per, False, 14, oids):
            at = next(free)
            blocks[at] = block
            entries.append((oid, xid, at))
            roots[xid] = oid
    if future:
        entries += [(oid, future, 1) for oid, xid, _ in entries if xid == latest]
    pack = lambda oid, xid, at, flags=0: (struct.pack("<qq", oid, xid), struct.pack("<IIq", flags, BLOCK, at))
    for xid in sorted(states):
        own = [pack(*e) for e in entries if e[1] <= xid or xid == latest]
        nodes = tree(own, xid, 100, True, 11, free)
        blocks |= dict(nodes)
        omap, volume, top, top_map = (next(free) for _ in range(4))
        body = bytearray(BLOCK)
        struct.pack_into("<q", body, 48, nodes[-1][0])
        blocks[omap] = sealed(body, omap, xid, apfs.MAP)
        body = bytearray(BLOCK)
        body[32:36] = b"APSB"
        struct.pack_into("<qq", body, 128, omap, roots[xid])
        body[704 : 704 + len(names)] = names.encode()
        blocks[volume] = sealed(body, 1026, xid, apfs.VOLUME)
        supers.append((1026, xid, volume))
        blocks[top] = tree_node([pack(*e) for e in supers], top, xid, 0, True, True, 11)
        body = bytearray(BLOCK)
        struct.pack_into("<q", body, 48, top)
        blocks[top_map] = sealed(body, top_map, xid, apfs.MAP)
        body = bytearray(BLOCK)
        body[32:36] = b"NXSB"
        struct.pack_into("<IQ", body, 36, BLOCK, 1 << 20)
        struct.pack_into("<q", body, 160, top_map)
        struct.pack_into("<q", body, 184, 1026)
        blocks[0 if xid == min(states) else 1 + xid % 8] = sealed(body, 1, xid, apfs.SUPERBLOCK)
    return b"".join(blocks.get(k, bytes(BLOCK)) for k in range(max(blocks) + 1))


# ext.

EXT_BLOCK, EXT_GROUP = 1024, 256


def ext_volume(files: list[dict]) -> bytes:
    """An ext volume of 1 KiB blocks and 256 inodes a group. Files: inode, parent, name, folder, size, changed, modified, deleted and
    either extents [(first file block, block, blocks)] with depth 0 or 2, or map {file block: block} of direct and indirect pointers.
    A folder's own blocks are laid out here; inode 2 is the root and has to be among the files."""
    groups = -(-max(f["inode"] for f in files) // EXT_GROUP)
    tables = [50 + 32 * g for g in range(groups)]
    free, blocks = iter(range(60 + 32 * groups, 1 << 30)), {}

    def put(data: bytes) -> int:
        at = next(free)
        blocks[at] = data.ljust(EXT_BLOCK, b"\0")
        return at

    def extent_places(extents: list[tuple[int, int, int]], depth: int) -> bytes:
        leaf = lambda part: struct.pack("<HHHHI", 0xF30A, len(part), 84, 0, 0) + b"".join(struct.pack("<IHHI", f, n, b >> 32, b & 0xFFFFFFFF) for f, b, n in part)
        inner = lambda part, d: struct.pack("<HHHHI", 0xF30A, len(part), 84, d, 0) + b"".join(struct.pack("<IIHH", f, b & 0xFFFFFFFF, b >> 32, 0) for f, b in part)
        if not depth:
            return leaf(extents).ljust(60, b"\0")
        level = [(extents[k][0], put(leaf(extents[k : k + 3]))) for k in range(0, len(extents), 3)]
        level = [(level[k][0], put(inner(level[k : k + 40], 1))) for k in range(0, len(level), 40)]
        return inner(level, 2).ljust(60, b"\0")

    def map_places(places: dict[int, int]) -> bytes:
        per = EXT_BLOCK // 4
        heads, first = [places.get(k, 0) for k in range(12)], 12

        def level(base: int, depth: int) -> int:
            own = {k: b for k, b in places.items() if base <= k < base + per**depth}
            if not own:
                return 0
            step = per ** (depth - 1)
            slots = {(k - base) // step for k in own}
            return put(struct.pack(f"<{per}I", *[(0 if k not in slots else own[base + k] if depth == 1 else level(base + k * step, depth - 1)) for k in range(per)]))

        for depth in (1, 2, 3):
            heads.append(level(first, depth))
            first += per**depth
        return struct.pack("<15I", *heads)

    children: dict[int, list[dict]] = {}
    for f in files:
        if f["inode"] != 2:
            children.setdefault(f["parent"], []).append(f)
    raw = {}
    for f in files:
        if f["folder"]:
            body = [b""]
            for c in children.get(f["inode"], []):
                name = c["name"].encode()
                size = 8 + len(name) + 3 & ~3
                # a name whose number is 0 stays in a record of its own
                entry = struct.pack("<IHBB", 0 if c.get("lost") else c["inode"], size, len(name), 2 if c["folder"] else 1) + name
                if len(body[-1]) + size > EXT_BLOCK - 8:
                    body.append(b"")
                body[-1] += entry.ljust(size, b"\0")
            body = [b + (struct.pack("<IHBB", 0, EXT_BLOCK - len(b), 0, 0)) for b in body]
            at = [put(b) for b in body]
            f = f | {"size": len(at) * EXT_BLOCK, "extents": [(k, b, 1) for k, b in enumerate(at)], "depth": 2 if len(at) > 4 else 0}
        if f.get("lost"):
            continue
        flags, places = (0, map_places(f["map"])) if "map" in f else (0x80000, extent_places(f["extents"], f.get("depth", 0)))
        gone = f.get("deleted", False)
        head = struct.pack("<HHIIIIIHHII", 0x41ED if f["folder"] else 0x81A4, 0, f["size"] & 0xFFFFFFFF, 0, f["changed"], f["modified"], 77 if gone else 0, 0, 0 if gone else 1, 0, flags)
        raw[f["inode"]] = (head + bytes(4) + places + bytes(8) + struct.pack("<I", f["size"] >> 32)).ljust(128, b"\0")
    for g, at in enumerate(tables):
        data = b"".join(raw.get(g * EXT_GROUP + k + 1, bytes(128)) for k in range(EXT_GROUP))
        blocks |= {at + k: data[k * EXT_BLOCK : (k + 1) * EXT_BLOCK] for k in range(32)}
    sb = bytearray(EXT_BLOCK)
    struct.pack_into("<II", sb, 0, groups * EXT_GROUP, groups * 8192)
    struct.pack_into("<IIIIII", sb, 20, 1, 0, 0, 8192, 8192, EXT_GROUP)
    sb[56:58] = b"\x53\xef"
    struct.pack_into("<I", sb, 76, 1)
    struct.pack_into("<H", sb, 88, 128)
    blocks[1] = bytes(sb)
    table = b"".join(struct.pack("<III", 3, 4, at).ljust(32, b"\0") for at in tables)
    blocks |= {2 + k: table[k * EXT_BLOCK : (k + 1) * EXT_BLOCK].ljust(EXT_BLOCK, b"\0") for k in range(-(-len(table) // EXT_BLOCK))}
    return b"".join(blocks.get(k, bytes(EXT_BLOCK)) for k in range(max(blocks) + 1))


# FAT and exFAT.


def fat_volume(kind: str, entries: list[dict], spread: int = 3) -> tuple[bytes, dict[int, list[tuple[int, int]]]]:
    """A volume (fat12, fat16, fat32, exfat) of 512-byte sectors, one a cluster, and the (first sector, sectors) of each entry by key.

    Entries: key, name (long names), parent (key of a folder before it, 0: the root), folder, size, deleted, data. A file's clusters lie
    in stretches of `spread`, every other one further on; chains of deleted files are cleared and their files lie in one stretch;
    in exFAT files whose key is even have no chain, but lie in one stretch.
    """
    exfat, bits = kind == "exfat", {"fat12": 12, "fat16": 16, "fat32": 32, "exfat": 32}[kind]
    count = max(sum(-(-e.get("size", 0) // 512) for e in entries) * 2 + 4 * len(entries) + 100, {12: 100, 16: 5000, 32: 100}[bits])
    fat_sectors = -(-(count + 2) * bits // 8 // 512) + 1
    reserved = 32
    root_entries = 0 if bits == 32 else 512
    data_at = reserved + (1 if exfat else 2) * fat_sectors + root_entries * 32 // 512
    table, data, free, where = {0: 1, 1: 1}, {}, iter(range(2, count)), {}

    def taken(n: int, straight: bool) -> list[int]:
        out = []
        while len(out) < n:
            out += [next(free) for _ in range(n if straight else min(spread, n - len(out)))]
            if not straight:
                next(free)  # a gap
        return out

    def chained(clusters: list[int]) -> None:
        table.update(zip(clusters, [*clusters[1:], 0x0FFFFFFF if bits == 32 else (1 << bits) - 1]))

    def merged(clusters: list[int]) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for c in clusters:
            if out and out[-1][0] + out[-1][1] == data_at + c - 2:
                out[-1][1] += 1
            else:
                out.append([data_at + c - 2, 1])
        return [tuple(x) for x in out]

    def entry(e: dict, clusters: list[int], straight: bool) -> bytes:
        first, size, units = clusters[0] if clusters else 0, e.get("size", 0), e["name"].encode("utf-16-le")
        gone = e.get("deleted", False)
        if exfat:
            names = [units[k : k + 30].ljust(30, b"\0") for k in range(0, len(units), 30)]
            kept = lambda b: bytes([b & 0x7F if gone else b])
            length = len(clusters) * 512 if e["folder"] else size
            head = kept(0x85) + bytes([1 + len(names), 0, 0]) + struct.pack("<HHHHHH", 0x10 if e["folder"] else 0x20, 0, 0, 0x21, 0, 0x21) + bytes(16)
            stream = kept(0xC0) + bytes([3 if straight else 1, 0, len(units) // 2]) + bytes(16) + struct.pack("<IQ", first, length)
            return head + stream + b"".join(kept(0xC1) + b"\0" + n for n in names)
        short = f"E{e['key']}".encode().ljust(8)[:8] + b"BIN"
        tail = units + b"\0\0" + b"\xff\xff" * 13
        pieces = [tail[26 * k : 26 * k + 26] for k in range(-(-(len(units)) // 26))]
        mark = lambda k: 0xE5 if gone else k + 1 | (0x40 if k + 1 == len(pieces) else 0)
        out = b"".join(bytes([mark(k)]) + p[:10] + b"\x0f\0" + bytes([lfn_checksum(short)]) + p[10:22] + b"\0\0" + p[22:26] for k, p in reversed(list(enumerate(pieces))))
        shown = b"\xe5" + short[1:] if gone else short
        return out + shown + bytes([0x10 if e["folder"] else 0x20]) + bytes(8) + struct.pack("<HHHHI", first >> 16, 0, 0x21, first & 0xFFFF, 0 if e["folder"] else size)

    listing: dict[int, bytes] = {0: b""}
    own: dict[int, list[int]] = {}
    children = lambda key: sum(1 for e in entries if e["parent"] == key)
    room = lambda key: -(-children(key) * 32 * 8 // 512) + 1
    if bits == 32:
        own[0] = taken(room(0), False)
        chained(own[0])
    for e in entries:
        gone, straight = e.get("deleted", False), e.get("deleted", False) or exfat and not e["folder"] and e["key"] % 2 == 0
        clusters = taken(room(e["key"]) if e["folder"] else -(-e["size"] // 512), straight)
        own[e["key"]] = clusters
        if e["folder"]:
            listing[e["key"]] = b""
        if clusters and not gone and not (exfat and straight):
            chained(clusters)
        where[e["key"]] = merged(clusters)
        data |= {c: e["data"][512 * k : 512 * k + 512].ljust(512, b"\0") for k, c in enumerate(clusters)} if "data" in e else {}
        listing[e["parent"]] += entry(e, clusters, straight)
    for key, raw in listing.items():
        for k, c in enumerate(own.get(key, [])):
            data[c] = raw[512 * k : 512 * k + 512].ljust(512, b"\0")
    boot = bytearray(512)
    total = data_at + count
    if exfat:
        boot[3:11] = b"EXFAT   "
        struct.pack_into("<IIIIII", boot, 80, reserved, fat_sectors, data_at, count, own[0][0], 1)
        boot[108:110] = bytes([9, 0])
    else:
        struct.pack_into("<HBHBHHBH", boot, 11, 512, 1, reserved, 2, root_entries, total if total < 65536 else 0, 0xF8, 0 if bits == 32 else fat_sectors)
        struct.pack_into("<I", boot, 32, total)
        if bits == 32:
            struct.pack_into("<IHHI", boot, 36, fat_sectors, 0, 0, own[0][0])
    boot[510:512] = b"\x55\xaa"
    values = [table.get(k, 0) for k in range(count + 2 + count % 2)]
    if bits == 12:
        raw = b"".join((a | b << 12).to_bytes(3, "little") for a, b in zip(values[::2], values[1::2]))
    else:
        raw = b"".join((v & (1 << bits) - 1).to_bytes(bits // 8, "little") for v in values)
    image = bytearray(total * 512)
    image[:512] = boot
    image[reserved * 512 : reserved * 512 + len(raw)] = raw
    if bits != 32:
        at = (reserved + 2 * fat_sectors) * 512
        image[at : at + len(listing[0])] = listing[0]
    for c, block in data.items():
        image[(data_at + c - 2) * 512 : (data_at + c - 1) * 512] = block
    return bytes(image), where
