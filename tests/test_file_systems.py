from __future__ import annotations

import contextlib
import io
import random

import pyarrow as pa
import pytest

from lodestrata.plans import built
from lodestrata.sources import apfs, ext, fat, volumes


def plan(df):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    return shown.getvalue()


def apfs_file(oid, parent, name, size=0, extents=(), folder=False, at=1_700_000_000):
    return {"oid": oid, "parent": parent, "name": name, "folder": folder, "size": size, "created": at, "modified": at + 5, "extents": list(extents)}


@pytest.mark.parametrize("chunk", [4096, 3 << 16])
def test_apfs_at_checkpoints(spark, chunk):
    old = [apfs_file(20, 2, "Docs", folder=True), apfs_file(30, 20, "draft.txt", 10, [(0, 500, 4096)]), apfs_file(31, 20, "gone.txt", 9, [(0, 501, 4096)])]
    new = [apfs_file(20, 2, "Papers", folder=True), apfs_file(21, 20, "Sub", folder=True), apfs_file(30, 21, "final é.txt", 40_000, [(0, 500, 4096), (4096, 501, 8192), (16384, 900, 24576)]), apfs_file(32, 2, "empty")]
    new += [apfs_file(100 + k, 20, f"f{k}", k, [(0, 1000 + k, 4096)]) for k in range(300)]  # a tree of three levels
    image = built.apfs_container({3: old, 7: new}, per=8, future=9)
    other = built.apfs_container({2: [apfs_file(20, 2, "Else", folder=True), apfs_file(30, 20, "draft.txt", 1, [(0, 77, 4096)])]})
    chunks = volumes.from_bytes(spark, {"one": image, "two": other, "none": bytes(50_000)}, chunk)
    rows = apfs.files(chunks).collect()
    got = {(r.volume_id, r.path): r for r in rows}
    assert len(got) == len(rows) == 306 and {r.volume for r in rows} == {"Data"}
    final = got["one", "/Papers/Sub/final é.txt"]
    assert [(x.start_sector, x.sector_count, x.is_sparse) for x in final.runs] == [(4000, 24, False), (None, 8, True), (7200, 48, False)]
    assert (final.size_bytes, final.start_sector, final.end_sector, final.confidence, final.created_at, final.modified_at) == (40_000, 4000, 7248, 85, 1_700_000_000, 1_700_000_005)
    assert got["one", "/empty"].confidence == 70 and got["one", "/Papers"].is_directory and got["one", "/Papers/f299"].runs[0].start_sector == 1299 * 8
    assert [(x.start_sector) for x in got["two", "/Else/draft.txt"].runs] == [616]
    then = {(r.volume_id, r.path) for r in apfs.files(chunks, as_of=6).collect()}
    assert then == {("one", "/Docs"), ("one", "/Docs/draft.txt"), ("one", "/Docs/gone.txt"), ("two", "/Else"), ("two", "/Else/draft.txt")}


def test_apfs_damage(spark):
    files = [apfs_file(10 + k, 2, f"f{k}", k, [(0, 50 + k, 4096)]) for k in range(40)]
    image = bytearray(built.apfs_container({1: files}, per=8))
    nodes = {r.oid: r.paddr for r in apfs.objects(volumes.from_bytes(spark, {"v": bytes(image)}, 1 << 16)).where("type = 3").collect()}
    hit = nodes[min(nodes)]
    image[hit * 4096 + 2000] ^= 1  # a leaf whose checksum is wrong isn't read, the others are
    left = {r.name for r in apfs.files(volumes.from_bytes(spark, {"v": bytes(image)}, 1 << 16)).collect() if r.source == "apfs_file"}
    assert 20 < len(left) < 40
    assert apfs.files(volumes.from_bytes(spark, {"v": bytes(8192)}, 4096)).count() == 0
    shifted = volumes.from_bytes(spark, {"v": bytes(4096 * 5) + built.apfs_container({1: files[:1]})}, 4096)
    (row,) = [r for r in apfs.files(shifted, start=4096 * 5).collect()]
    assert row.runs[0].start_sector == 40 + 50 * 8


def test_apfs_tables_are_not_broadcast_whole(spark):
    files = [apfs_file(20 + k, 2, f"f{k}.bin", 9, [(0, 500 + k, 4096)]) for k in range(60)]
    data = built.apfs_container({1: files})

    def made(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pylist([{"volume_id": "v", "chunk_no": k, "byte_offset": 4096 * k, "data": data[4096 * k : 4096 * k + 4096]} for k in range(len(data) // 4096)])

    chunks = spark.range(0, 1, 1, 1).mapInArrow(made, "volume_id string, chunk_no long, byte_offset long, data binary")
    nodes = volumes.cut(apfs.objects(chunks))
    maps = nodes.where(f"type = {apfs.MAP}").select("volume_id", apfs.F.lit(0).cast("long").alias("tree"), apfs.F.col("paddr").alias("omap"))
    assert "Broadcast" not in plan(apfs.map_roots(nodes, maps))
    roots = apfs.map_roots(nodes, maps)
    address = lambda f: f.withColumn("paddr", apfs.F.col("child"))
    sent, dealt = (sorted(apfs.leaves(roots, nodes, address, n).collect()) for n in (100, 0))
    assert sent == dealt and len(sent) > 8
    found = plan(apfs.files(chunks))
    assert found.count("SortMergeJoin") >= 3 and found.count("BroadcastHashJoin") <= 1  # that one is the names of volumes


def test_runs_of(spark):
    rows = [("a", 0, 10, 4), ("a", 4, 14, 2), ("a", 8, 30, 1), ("a", 9, None, 3), ("b", 5, 1, 1), ("c", 0, 7, 1), ("c", 1, 7, 1)]
    got = {r.k: [tuple(x) for x in r.runs] for r in volumes.runs_of(spark.createDataFrame(rows, "k string, logical long, start_sector long, sector_count long"), ["k"]).collect()}
    assert got == {"a": [(10, 6, False), (None, 2, True), (30, 1, False), (None, 3, True)], "b": [(None, 5, True), (1, 1, False)], "c": [(7, 1, False), (7, 1, False)]}


def test_blocks_at(spark):
    data = bytes(range(256)) * 40
    chunks = volumes.from_bytes(spark, {"a": data, "b": data[1000:]}, 512)
    wanted = [("a", at, n, k) for k, (at, n) in enumerate([(0, 512), (500, 24), (511, 2), (3, 512), (10_230, 10), (10_000, 512), (99_999, 5)])] + [("b", 100, 100, 9)]
    for most in (0, 100):
        got = {r.k: bytes(r.data) for r in volumes.blocks_at(spark.createDataFrame(wanted, "volume_id string, byte_offset long, length int, k int"), chunks, 512, most).collect()}
        assert got == {k: (data if v == "a" else data[1000:])[at : at + n] for v, at, n, k in wanted if at < len(data)}
    assert volumes.blocks_at(spark.createDataFrame([], "volume_id string, byte_offset long, length int"), chunks, 512).count() == 0


def test_chunks_that_pass_for_small_are_not_broadcast(spark):
    # rows made by Python from a tiny table, written down: Spark takes them for small
    def made(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pylist([{"volume_id": "a", "chunk_no": k, "byte_offset": 512 * k, "data": c * 512} for k, c in enumerate((b"a", b"b"))])

    chunks = volumes.cut(spark.range(0, 1, 1, 1).mapInArrow(made, "volume_id string, chunk_no long, byte_offset long, data binary"))
    wanted = spark.createDataFrame([("a", 100, 50), ("a", 500, 24)], "volume_id string, byte_offset long, length int")
    assert "Broadcast" not in plan(volumes.blocks_at(wanted, chunks, 512, 0))
    few = volumes.blocks_at(wanted, chunks, 512, 100)
    assert "SortMergeJoin" in plan(few) and "LeftOuter, BuildRight" not in plan(few)
    assert sorted(bytes(r.data) for r in few.collect()) == [b"a" * 50, b"a" * 12 + b"b" * 12]
    assert "SortMergeJoin" not in plan(volumes.blocks_at(wanted.where("byte_offset = 100"), chunks, 512, 100))
    file = spark.createDataFrame([("a", 1, 700, [(0, 2, False)], 0)], "volume_id string, id long, size_bytes long, runs array<struct<start_sector:bigint,sector_count:bigint,is_sparse:boolean>>, start_sector long")
    got = volumes.file_bytes(file, chunks, 512)
    assert "Broadcast" not in plan(got) and [bytes(r.data) for r in got.collect()] == [b"a" * 512 + b"b" * 188]


def ext_file(inode, parent, name, size=0, folder=False, **places):
    return {"inode": inode, "parent": parent, "name": name, "folder": folder, "size": size, "changed": 100, "modified": 200, **(places or {"extents": []})}


@pytest.mark.parametrize("chunk", [1024, 5000, 1 << 18])
def test_ext_volumes(spark, chunk):
    triple = 12 + 256 + 65536
    files = [ext_file(2, 2, "", folder=True), ext_file(12, 2, "a dir", folder=True), ext_file(13, 12, "deep", folder=True)]
    files += [
        ext_file(20, 13, "direct.bin", 12 * 1024, map={k: 9000 + k for k in range(12)}),
        ext_file(21, 13, "levels.bin", (triple + 70_000) * 1024 + 1, map={0: 5, 1: 6, 12: 70, 14: 71, 15: 72, 268: 80, 12 + 256 + 65_535: 81, triple: 90, triple + 65_536: 91, triple + 65_537: 92}),
        ext_file(22, 12, "tree.bin", 2000 * 1024, extents=[(4 * k, 20_000 + 10 * k, 3) for k in range(480)], depth=2),
        ext_file(23, 2, "gone é.txt", 10, extents=[(0, 33, 1)], deleted=True),
        ext_file(24, 2, "lost.txt", lost=True),
        ext_file(25, 2, "empty"),
        ext_file(26, 2, "preallocated", 2048, extents=[(0, 40, 1), (1, 41, 7)]),
    ]
    files += [ext_file(300 + k, 13, f"file number {k}", 5, extents=[(0, 100 + k, 1)]) for k in range(300)]
    image = built.ext_volume(files)
    other = built.ext_volume([ext_file(2, 2, "", folder=True), ext_file(20, 2, "direct.bin", 1024, extents=[(0, 7, 1)])])
    rows = ext.files(volumes.from_bytes(spark, {"one": image, "two": other, "none": bytes(9000), "short": image[:70_000]}, chunk), chunk).collect()
    got = {(r.volume_id, r.path): r for r in rows if r.volume_id != "short"}
    assert len(got) == 309 + 1 and all(r.volume_id != "none" for r in rows)
    runs = lambda *key: [tuple(x) for x in got[key].runs]
    assert runs("one", "/a dir/deep/direct.bin") == [(18_000, 24, False)] and runs("two", "/direct.bin") == [(14, 2, False)]
    assert runs("one", "/a dir/deep/levels.bin") == [
        (10, 4, False), (None, 20, True), (140, 2, False), (None, 2, True), (142, 4, False), (None, 2 * 252, True), (160, 2, False), (None, 2 * 65_534, True),
        (162, 2, False), (180, 2, False), (None, 2 * 65_535, True), (182, 4, False), (None, 2 * (70_001 - 65_538), True),
    ]
    assert runs("one", "/a dir/tree.bin")[:3] == [(40_000, 6, False), (None, 2, True), (40_020, 6, False)] and len(runs("one", "/a dir/tree.bin")) == 960
    assert sum(x[1] for x in runs("one", "/a dir/tree.bin")) == 4000 and runs("one", "/preallocated") == [(80, 4, False)]
    assert (got["one", "/gone é.txt"].status, got["one", "/gone é.txt"].confidence) == (0, 60) and (got["one", "/lost.txt"].status, got["one", "/lost.txt"].confidence) == (0, 45)
    assert got["one", "/empty"].runs is None and got["one", "/a dir/deep"].is_directory and got["one", "/a dir/deep/file number 299"].start_sector == 798
    assert got["one", "/a dir/deep/levels.bin"].size_bytes == (triple + 70_000) * 1024 + 1 and got["one", "/a dir/deep/levels.bin"].created_at == 100


def test_ext_at_a_partition(spark):
    image = bytes(3 * 512) + built.ext_volume([ext_file(2, 2, "", folder=True), ext_file(20, 2, "x", 1024, extents=[(0, 7, 1)])])
    (row,) = ext.files(volumes.from_bytes(spark, {"v": image}, 2048), 2048, start=3 * 512).collect()
    assert [tuple(x) for x in row.runs] == [(3 + 14, 2, False)]
    assert ext.files(volumes.from_bytes(spark, {"v": bytes(4096)}, 2048), 2048).count() == 0


def fat_table(entries, bits):
    """Bytes of a table: {cluster: value}."""
    n = max(entries) + 1
    values = [entries.get(k, 0) for k in range(n)]
    if bits == 12:
        values += [0] * (n % 2)
        return b"".join((a | b << 12).to_bytes(3, "little") for a, b in zip(values[::2], values[1::2]))
    return b"".join(v.to_bytes(bits // 8, "little") for v in values)


def clusters_of(spark, tables, first, piece=12):
    """{(volume, first): clusters} by the plans, for tables {volume: (bits, entries)}."""
    pieces = []
    for v, (bits, entries) in tables.items():
        data = fat_table(entries, bits)
        pieces += [(v, bits, max(entries), at * 8 // bits, bytearray(data[at : at + piece])) for at in range(0, len(data), piece)]
    places, ends = fat.ranked(fat.stretches_of(spark.createDataFrame(pieces, "volume_id string, bits int, last long, first long, data binary")))
    items = [(v, f, None, 1) for v in tables for f in first(v)]
    rows = fat.chain_extents(spark.createDataFrame(items, "volume_id string, first long, want long, guess long"), ["volume_id", "first"], places, ends).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.logical):
        own = out.setdefault((r.volume_id, r.first), [])
        assert r.logical == len(own)
        own += range(r.cluster, r.cluster + r.n)
    return out


def test_fat_chains_like_a_walk(spark):
    rng = random.Random(8)
    tables = {}
    for bits in (12, 16, 32):
        for k in range(4):
            entries = {c: rng.choice([0, c + 1, c + 1, c + 1, rng.randint(2, 60), rng.randint(2, 60), fat.BAD[bits], fat.END_FROM[bits]]) for c in range(2, 61)}
            tables[f"{bits}-{k}"] = (bits, {0: 1, 1: 1} | {c: v if v <= 60 or v >= fat.BAD[bits] else fat.END_FROM[bits] for c, v in entries.items()})
    tables["circle"] = (16, {2: 3, 3: 9, 9: 10, 10: 5, 5: 2, 20: 21, 21: 20, 30: 30, 60: 0xFFFF})
    got = clusters_of(spark, tables, lambda v: range(2, 61))
    for v, (bits, entries) in tables.items():
        for c in range(2, 61):
            assert got[v, c] == fat.chain(lambda x: entries.get(x, 0), bits, c), (v, c)


def test_long_fat_chain(spark):
    n = 100_000
    order = list(range(2, n + 2))
    random.Random(1).shuffle(order)
    entries = dict(zip(order, [*order[1:], 0x0FFFFFFF]))
    assert clusters_of(spark, {"v": (32, entries)}, lambda v: [order[0]], 49_152) == {("v", order[0]): order}


def test_fat_and_exfat_volumes(spark):
    files = [{"name": f"file number {k}.bin", "folder": False, "parent": k % 3, "size": 200 * k, "deleted": k % 7 == 3, "key": 10 + k} for k in range(60)]
    folders = [{"name": "first folder", "folder": True, "parent": 0, "key": 1}, {"name": "second", "folder": True, "parent": 1, "key": 2}]
    images, where = {}, {}
    for kind in ("fat12", "fat16", "fat32", "exfat"):
        images[kind], where[kind] = built.fat_volume(kind, folders + files)
    rows = fat.files(volumes.from_bytes(spark, images, 3 << 12), 3 << 12).collect()
    for kind in images:
        own = {r.path: r for r in rows if r.volume_id == kind}
        above = ["/", "/first folder/", "/first folder/second/"]
        assert len(own) == 62 and own["/first folder"].is_directory
        for f in files:
            r = own[above[f["parent"]] + f["name"]]
            assert (r.size_bytes, r.status, r.source) == (f["size"], 0 if f["deleted"] else 1, "exfat" if kind == "exfat" else "fat")
            assert r.confidence == (95 if not f["deleted"] else 60 if f["size"] else 35)
            assert [(x.start_sector, x.sector_count) for x in r.runs or []] == where[kind][f["key"]], (kind, f)
