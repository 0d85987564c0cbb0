from __future__ import annotations

import struct

from lodestrata.sources import apple, volumes

NOW = 3_700_000_000


def catalog_leaf(rows, size=4096):
    records = []
    for parent, name, kind, node, length, extents in rows:
        raw = name.encode("utf-16-be")
        key = struct.pack(">IH", parent, len(name)) + raw
        head = struct.pack(">h6xIII", kind, node, NOW, NOW)
        body = head.ljust(88, b"\0")
        if kind == 2:
            flat = [x for e in extents for x in e]
            body += struct.pack(">QII", length, 0, 0) + struct.pack(">16I", *flat, *[0] * (16 - len(flat))) + bytes(80)
        records.append(struct.pack(">H", len(key)) + key + body)
    out, offsets = struct.pack(">IIbBHH", 0, 0, -1, 1, len(records), 0), []
    for r in records:
        offsets.append(len(out))
        out += r + b"\0" * (len(r) % 2)
    offsets.append(len(out))
    return out.ljust(size - 2 * len(offsets), b"\0") + struct.pack(f">{len(offsets)}H", *offsets[::-1])


def test_hfs_catalog(spark):
    leaf = catalog_leaf([(2, "note é.txt", 2, 30, 700, [(7, 1)]), (20, "deep.jpg", 2, 31, 9000, [(9, 2), (20, 1)]), (2, "Dir", 1, 20, 0, []), (99, "lost", 2, 32, 1, [])])
    vol = bytearray(40 * 4096)
    header = bytearray(512)
    header[:2] = b"H+"
    struct.pack_into(">II", header, 40, 4096, 40)
    struct.pack_into(">QIIII", header, 272, 8192, 0, 2, 3, 2)
    vol[1024:1536] = header
    struct.pack_into(">H", vol, 3 * 4096 + 32, 4096)
    vol[4 * 4096 : 5 * 4096] = leaf
    nodes = list(apple.hfs_nodes(lambda o, n: bytes(vol[o : o + n])))
    assert len(nodes) == 1
    got = {r.name: r for r in apple.hfs_files(spark.createDataFrame([(bytearray(n),) for n in nodes], "data binary"), 4096).collect()}
    assert {n: r.path for n, r in got.items()} == {"note é.txt": "/note é.txt", "deep.jpg": "/Dir/deep.jpg", "Dir": "/Dir", "lost": "/lost"}
    assert [(r.start_sector, r.sector_count) for r in got["deep.jpg"].runs] == [(72, 16), (160, 8)] and got["note é.txt"].created_at == NOW - 2_082_844_800


def apfs_leaf(records, size=4096):
    block = bytearray(size)
    struct.pack_into("<II", block, 24, 3, 14)
    toc, keys, values = b"", b"", b""
    for k, v in records:
        values = v + values
        toc += struct.pack("<HHHH", len(keys), len(k), len(values), len(v))
        keys += k
    struct.pack_into("<HHIHH", block, 32, 2, 0, len(records), 0, len(toc))
    block[56 : 56 + len(toc) + len(keys)] = toc + keys
    block[size - len(values) :] = values
    return bytes(block)


def test_apfs_leaves(spark):
    entry = lambda parent, name, oid: (struct.pack("<QI", 9 << 60 | parent, len(name) + 1) + name.encode() + b"\0", struct.pack("<QQH", oid, 0, 8))
    extent = lambda oid, at, first, length: (struct.pack("<QQ", 8 << 60 | oid, at), struct.pack("<QQQ", length, first, 0))
    one, two = apfs_leaf([entry(2, "a.txt", 100), entry(2, "gone.txt", 101)]), apfs_leaf([extent(100, 4096, 9, 4096), extent(100, 0, 5, 4096), extent(300, 0, 7, 8192)])
    rows = apple.apfs_files(volumes.from_bytes(spark, {"v": bytes(4096) + one + two + bytes(4096)}, 8192)).collect()
    got = {r.name: r for r in rows}
    assert [(x.start_sector, x.sector_count) for x in got["a.txt"].runs] == [(40, 8), (72, 8)] and (got["a.txt"].confidence, got["a.txt"].size_bytes) == (85, 8192)
    assert (got["gone.txt"].confidence, got["gone.txt"].source) == (70, "apfs_file") and (got["extent_300"].confidence, got["extent_300"].source) == (60, "apfs_extent")
    head = bytearray(4096)
    head[32:36] = b"NXSB"
    struct.pack_into("<IQ", head, 36, 4096, 1000)
    struct.pack_into("<Q", head, 184, 1026)
    assert apple.container(bytes(head)) == {"block": 4096, "blocks": 1000, "omap": 0, "volumes": [1026]}


def test_refs(spark):
    boot = bytearray(512)
    boot[3:11] = b"ReFS\0\0\0\0"
    struct.pack_into("<QII", boot, 24, 1000, 512, 128)
    assert apple.refs_boot(bytes(boot))["cluster"] == 65536 and apple.refs_boot(bytes(512)) is None
    image = bytearray(4 * 16384)
    image[16384:16388], image[49152:49156] = b"SUPB", b"MSB+"
    got = apple.refs_pages(volumes.from_bytes(spark, {"v": bytes(image)}, 32768)).orderBy("byte_offset").collect()
    assert [(r.byte_offset, r.kind) for r in got] == [(16384, "superblock"), (49152, "tree")]
    assert apple.refs_integrity(True) == 95 and apple.refs_integrity(False, False) == 30
