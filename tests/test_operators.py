from __future__ import annotations

import hashlib
import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import validators
from lodestrata.operators import aggregates, carve, enrich, graph, intervals, lifecycle, listing, raid, recover, search, windows
from lodestrata.schema import FILES, SCANS, TIMELINE, conform
from lodestrata.session import ForensicSession
from lodestrata.sources import evidence, ntfs, partitions, volumes
from lodestrata.streaming import timeline as stream
from test_bytes import JPEG, fat16, ntfs_record, png


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        (1, 1, "photo.jpg", "/a/photo.jpg", "jpg", 0, "Image", "ntfs_mft", 90), (2, 1, "old.jpg", "/a/b/old.jpg", "jpg", 0, "Image", "carver", 70), (3, 1, "old2.jpg", "/dup", "jpg", 0, "Image", "carver_duplicate", 35),
        (4, 1, "$Ix", "/bin", "", 0, "Other", "ntfs_recycle_meta", 20), (5, 1, "IMG_2024_001.JPG", "/c/IMG_2024_001.JPG", "jpg", 1, "Image", "fat", 95), (6, 1, "fatura_ocak.pdf", "/docs/fatura_ocak.pdf", "pdf", 1, "Document", "fat", 95), (7, 2, "x", "/x", "", 1, "Other", None, 0),
    ]
    return conform(spark.createDataFrame(rows, "id long, scan_id long, name string, path string, extension string, status int, category string, source string, confidence int"), FILES)


ids = lambda df: sorted(r["id"] for r in df.collect())


def test_lists(spark, files):
    assert ids(listing.files(files, 1)) == [1, 2, 5, 6] and ids(listing.files(files, 1, listing.chip_filter("carved"))) == [2]
    assert ids(listing.files(files, 1, listing.chip_filter("carved", show_duplicates=True))) == [2, 3] and ids(listing.files(files, 1, listing.chip_filter("deleted"))) == [1]
    assert ids(listing.files(files, None, listing.FileFilter(include_discovery=True, include_duplicates=True))) == [1, 2, 3, 4, 5, 6, 7]
    events = conform(spark.createDataFrame([(1, 1, 100, "create"), (2, 1, 200, "delete"), (3, 1, 300, "rename_new")], "id long, scan_id long, timestamp long, event_type string"), TIMELINE)
    s = listing.report_remainders(listing.scan_summary(files, events, 1)).first()
    assert (s.total_files, s.deleted_files, s.image_files, s.carved_files, s.timeline_events, s.usn_creates, s.usn_deletes, s.usn_renames, s.other_files) == (5, 1, 4, 1, 3, 1, 1, 1, 0)
    assert listing.scan_summary(files, events, 9).first().total_files == 0
    scans = conform(spark.createDataFrame([(1, 3), (2, 4), (3, 3)], "id long, status int"), SCANS)
    assert listing.latest_scan(scans, True).first().scan_id == 2 and listing.latest_scan(scans.where("id > 9")).first().scan_id == -1
    assert listing.id_list([3, 1, 3]) == [3, 1]
    with pytest.raises(ValueError):
        listing.id_list([0])


def test_search(files):
    assert ids(search.search_files(files, "fatura")) == [6] and ids(search.search_files(files, "atura")) == [6] and ids(search.search_files(files, "atura", "token")) == []
    assert ids(search.search_files(files, r"IMG_\d+", "regex")) == [5] and ids(search.search_files(files, "(", "regex")) == [] and ids(search.search_files(files, "x" * 200, "regex")) == []
    assert ids(search.search_files(files, "jpg photo")) == [1] and ids(search.search_files(files, "")) == [] and search.search_count(files, "jpg", "token").first().n == 4
    assert ids(search.search_files(files, "100%", "substring")) == []


def test_content(spark, files):
    texts = spark.createDataFrame([(1, "a" * 300 + " SECRET_PHRASE end"), (2, ""), (5, "hello lantern recovery content")], "file_id long, body string")
    chunks = search.content_chunks(texts, 256)
    assert chunks.groupBy("file_id").count().orderBy("file_id").collect() == [(1, 2), (5, 1)]
    assert ids(search.search_content(files, chunks, "lant content")) == [5] and ids(search.search_content(files, chunks, "secret_phrase", "substring")) == [1]
    assert search.search_content(files, chunks, "ntern", "substring").first().source == "fat+content" and ids(search.search_content(files, chunks, "ntern")) == []
    assert [r.file_id for r in search.search_postings(search.content_index(chunks), "hello cont").collect()] == [5]
    assert search.content_index_complete(files, chunks).first().complete is False and search.content_sample(chunks).where("file_id = 1").first().body == "a" * 256
    assert search.replace_chunks(chunks, chunks.where("file_id = 5")).count() == chunks.count()


def test_intervals_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(k % 3, s := rng.randrange(200), s + rng.randrange(1, 20)) for k in range(60)]
    got = intervals.merge(spark.createDataFrame(rows, "k int, start int, end int"), ["k"]).collect()
    for k in range(3):
        points = {p for g, s, e in rows if g == k for p in range(s, e + 1)}
        assert sorted(p for r in got if r.k == k for p in range(r.start, r.end + 1)) == sorted(points)
    a = [(k, s := rng.randrange(300), s + rng.randrange(40)) for k in range(40)]
    b = [(k, s := rng.randrange(300), s + rng.randrange(90)) for k in range(40)]
    frame = lambda x, source: spark.createDataFrame([(1, k, f"/p{k}", s, e, source, 80) for k, s, e in x], "v int, id long, path string, start_sector long, end_sector long, source string, confidence int")
    got = {r.id: r for r in intervals.mark_copies(frame(a, "carver"), frame(b, "fat"), ["v"], width=16).collect()}
    for k, s, e in a:
        hits = sorted((s2, i) for i, s2, e2 in b if s <= e2 and s2 <= e and 2 * (min(e, e2) - max(s, s2) + 1) >= min(e - s, e2 - s2) + 1)
        assert (got[k].source, got[k].path) == (("carver_duplicate", f"/dup_of/p{hits[0][1]}") if hits else ("carver", f"/p{k}"))


def test_carved_copies_in_order(spark):
    rows = spark.createDataFrame([(1, 1, "/a", 300, 310, "carver", 70), (1, 2, "/b", 305, 315, "carver", 70), (1, 3, "/c", 900, 910, "carver", 20)], "v int, id long, path string, start_sector long, end_sector long, source string, confidence int")
    got = {r.id: (r.source, r.path, r.confidence) for r in intervals.mark_carved_copies(rows, ["v"]).collect()}
    assert got == {1: ("carver", "/a", 70), 2: ("carver_duplicate", "/dup_of/carve", 30), 3: ("carver", "/c", 20)}


def test_free_runs(spark):
    data = bytearray([0b11110000, 0xFF, 0x00])
    rows = spark.createDataFrame([("v", 0, data), ("v", 24, bytearray([0xFE]))], "volume_id string, first_unit long, data binary")
    got = intervals.free_runs_from_bitmap(rows, ["volume_id"], 8).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0, 32), (128, 200)]


def test_free_runs_of_many_bitmaps_at_once(spark, monkeypatch):
    rng = random.Random(5)
    maps = [bytes(rng.choice([0, 255, rng.randrange(256)]) for _ in range(rng.randrange(4))) if k % 9 else None for k in range(300)]
    want = []
    for k, x in enumerate(maps):
        bits = [b >> i & 1 for b in x or b"" for i in range(8)]
        edges = [i for i in range(len(bits) + 1) if (i < len(bits) and not bits[i]) != (i > 0 and not bits[i - 1])]
        want += [(k, *e) for e in zip(edges[::2], edges[1::2])]
    assert [tuple(int(v) for v in x) for x in zip(*intervals.clear_runs(maps))] == want
    monkeypatch.setattr(intervals, "UNPACKED", 64)
    rows = spark.createDataFrame([(k, 1000 * k, bytearray(x) if x is not None else None) for k, x in enumerate(maps)], "k int, first_unit int, data binary").coalesce(1)
    got = intervals.free_runs_from_bitmap(rows, ["k"])
    assert [f.simpleString() for f in got.schema] == ["k:int", "start:bigint", "end:bigint"]
    assert sorted((r.k, r.start - 1000 * r.k, r.end - 1000 * r.k) for r in got.collect()) == want


def test_paths(spark):
    edges = spark.createDataFrame([(10, 5, "Users", 85, 1), (11, 10, "bar.jpg", 85, 2), (10, 5, "Projects", 55, 3), (48, 5, "boot.ini", 70, 4), (60, 61, "a", 50, 5), (61, 60, "b", 50, 6)], "node long, parent long, name string, confidence int, seq int")
    got = {r.node: r.path for r in graph.rebuild_paths(graph.directory_index(edges)).collect()}
    assert got[11] == "/Users/bar.jpg" and got[48] == "/boot.ini" and got[60].count("/") == 64
    chain = spark.createDataFrame([(k, k - 1 if k > 100 else 5, f"d{k}") for k in range(100, 150)], "node long, parent long, name string")
    assert graph.rebuild_paths(chain).where("node = 149").first().path == "".join(f"/d{k}" for k in range(100, 150))


def test_enrichment(spark):
    f = spark.createDataFrame([("Secret.TXT", 7, "ntfs_mft", 40, 0), ("", 8, "ntfs_mft", 95, 0), ("live", 9, "ntfs_mft", 100, 1)], "name string, mft_record long, source string, confidence int, status int")
    hints = spark.createDataFrame([("secret.txt", None), ("lost.doc", 8)], "name_lower string, mft_ref long")
    got = {r.mft_record: (r.name, r.source, r.confidence) for r in enrich.confirm_by_log(f, hints).collect()}
    assert got == {7: ("Secret.TXT", "ntfs_mft_logfile", 52), 8: ("lost.doc", "ntfs_mft_logfile", 100), 9: ("live", "ntfs_mft", 100)}
    gone = spark.createDataFrame([(7 | 3 << 48,), (9,)], "file_reference long")
    assert {r.mft_record: (r.source, r.confidence) for r in enrich.confirm_by_journal(f, gone).collect()} == {7: ("ntfs_mft_usn", 55), 8: ("ntfs_mft", 95), 9: ("ntfs_mft", 100)}
    rows = spark.createDataFrame([(1, 1, "a", 50, "ntfs_mft"), (2, 1, "b", 50, "ntfs_mft"), (3, 1, "c", 90, "ntfs_ads"), (4, None, "d", 1, "x")], "seq int, mft_record long, name string, confidence int, source string")
    assert sorted(r.name for r in enrich.best_record(rows).collect()) == ["a", "c", "d"]


def test_snapshots_are_counted_and_not_paired(spark, capsys):
    snaps = [(k, k % 3 if k % 11 else None, k % 4 if k % 7 else None) for k in range(60)] + [(1, 1, 1)] * 2
    known = [(k % 4 if k % 13 else None, k % 5 if k % 9 else None) for k in range(150)]
    want = {}
    for i, serial, size in snaps:
        n = sum(1 for s, z in known if s == serial and (z == 0 or size == 0 or (z is not None and z == size))) if serial else 0
        if n:
            want[i, serial, size] = want.get((i, serial, size), 0) + n
    got = enrich.bind_snapshots(spark.createDataFrame(snaps, "id long, serial int, size_bytes long"), spark.createDataFrame(known, "serial int, size_bytes long"))
    got.explain()
    shown = capsys.readouterr().out
    assert {(r.id, r.serial, r.size_bytes): (r.hits, r.collision) for r in got.collect()} == {k: (n, n > 1) for k, n in want.items()}
    # both sides of each join are counts already
    assert shown.count("Join") == 2 and shown.count("HashAggregate") >= 6


def test_recycle_pairs(spark):
    path = "C:\\Photos\\vacation.jpg"
    info = struct.pack("<QQQI", 2, 2048, 132223104000000000, len(path) + 1) + (path + "\0").encode("utf-16-le")
    rows = [(1, "$Iabc123.txt", "/r/$I", 544, 0, 0, "ntfs_mft", 60, bytearray(info)), (2, "$Rabc123.txt", "/r/$R", 5, 0, 0, "ntfs_mft", 50, None), (3, "$Rother", "/r", 1, 0, 1, "ntfs_mft", 50, None), (4, "$Iother", "/r", 1, 0, 1, "ntfs_mft", 50, None)]
    f = spark.createDataFrame(rows, "seq long, name string, path string, size_bytes long, created_at long, status int, source string, confidence int, resident binary")
    got = {r.seq: r for r in enrich.pair_recycle_bin(ntfs.with_recycle_info(f)).collect()}
    assert (got[2].name, got[2].path, got[2].size_bytes, got[2].source, got[2].confidence, got[2].created_at) == ("vacation.jpg", path, 2048, "ntfs_recycle", 65, 1577836800)
    assert got[1].source == "ntfs_recycle_meta" and got[3].source == got[4].source == "ntfs_mft"


def test_lifecycle(spark):
    rows = [(1, 0, 0, 1000, "deep", True), (2, 1, 5, 5, "quick", False), (3, 0, 10, 10, "deep", True), (4, 0, 10, 10, "deep", False), (5, 0, 10, 10, "quick", None)]
    scans = spark.createDataFrame(rows, "id long, status int, scanned_sectors long, total_sectors long, scan_type string, metadata_complete boolean")
    got = lifecycle.reclaim_orphans(scans)
    assert {r.id: r.status for r in got.collect()} == {1: 4, 2: 1, 3: 1, 4: 4, 5: 1} and got.where("changed").count() == 4
    texts = ["", "[[100,4],[200,4]]", "[[18446744073709551615,3]]", "[[oops]]", "[[1,0]]", "[[1,2]", "[[99999999999999999999,1]]", "[[1,2]]x", None, "[]"]
    runs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", lifecycle.decode_runs("t").alias("r")).withColumn("t", lifecycle.encode_runs("r"))
    assert [r.t for r in runs.orderBy("k").collect()] == ["", "[[100,4],[200,4]]", "[[18446744073709551615,3]]", "", "", "", "", "", "", ""]
    ranges = spark.createDataFrame([("v", 0, 10), ("v", 20, 30), ("v", 40, 50)], "v string, start long, end long")
    assert [(r.start, r.end) for r in lifecycle.resume_ranges(ranges, 15, ["v"]).orderBy("start").collect()] == [(25, 30), (40, 50)]
    ends = spark.createDataFrame([(2, False, 5, 10), (2, False, 10, 10), (1, True, 1, 1)], "s int, f boolean, a long, b long")
    assert [r.x for r in ends.select(lifecycle.end_status(F.col("s"), F.col("f"), F.col("a"), F.col("b")).alias("x")).collect()] == [4, 2, 3]


def test_progress(spark):
    rows = [("a", 0, 0, 1000), ("a", 1000, 10, 1000), ("a", 1500, 5, 1000), ("a", 2000, 500, 1000), ("a", 20_000, 500, 1000), ("a", 21_000, 505, 1000), ("a", 22_000, 1000, 1000)]
    got = {r.time_ms: (r.speed, r.eta_seconds, r.stalled) for r in windows.eta(spark.createDataFrame(rows, "k string, t long, w long, n long"), "k", "t", "w", "n").collect()}
    assert got[0] == (0.0, -1.0, False) and got[1000] == (10.0, 99.0, False) and got[20_000] == (0.0, -1.0, True)
    late = 10 * (1 - windows.ALPHA) + 10 / 1.5 * windows.ALPHA
    assert got[1500] == (pytest.approx(late), pytest.approx(990 / late), False) and got[2000][0] == pytest.approx(late)  # a jump has no speed of its own
    assert got[21_000][0] == pytest.approx(5 / 19) and got[21_000][1] == pytest.approx(495 * 19 / 5) and got[22_000][1] == -1.0


def test_progress_of_streams_is_that_of_tables(spark):
    rng, rows = random.Random(6), []
    for k in range(4):
        t = w = 0
        for _ in range(400):
            t, w = t + rng.choice([0, 300, 900, 2500, 9000 if rng.random() < 0.1 else 700]), max(0, w + rng.choice([0, 0, 1, 40, 90, -30, 3000 if rng.random() < 0.05 else 7]))
            rows.append((k, t, w, 100_000))
    rows = list(dict.fromkeys(rows))  # equal ticks have no order
    got = {}
    for r in windows.eta(spark.createDataFrame(rows, "k int, t long, w long, n long"), "k", "t", "w", "n").collect():
        got.setdefault(r.k, []).append((r.time_ms, r.work, r.speed, r.eta_seconds, r.stalled))
    for k in range(4):
        ticks = np.array(sorted(x[1:] for x in rows if x[0] == k))
        state, found, at = None, [], 0
        while at < len(ticks):
            part = ticks[at : at + rng.randrange(1, 30)]
            state, speed, left, stalled = windows.eta_fold(state, part[:, 0], part[:, 1], part[:, 2])
            found += zip(speed, left, stalled)
            at += len(part)
        want = sorted(got[k])
        assert [x[4] for x in want] == [bool(f[2]) for f in found] and any(x[4] for x in want)
        assert np.allclose([x[2:4] for x in want], [f[:2] for f in found])


def test_hash_chain(spark):
    rows = spark.createDataFrame([("l", k, f"m{k}") for k in range(5)], "log string, k int, m string")
    h = "0" * 64
    for k in range(5):
        h = hashlib.sha256(f"{h}m{k}".encode()).hexdigest()
    assert aggregates.hash_chain(rows, ["log"], "k", "m").first().head == h
    data = spark.createDataFrame([(bytearray(b"abab"),), (bytearray(),), (bytearray(range(256)),)], "d binary")
    assert [round(r.x, 9) for r in data.select(aggregates.byte_entropy("d").alias("x")).collect()] == [1, 0, 8]


def test_audit_log_goes_on(spark, tmp_path):
    path = str(tmp_path / "audit.log")
    evidence.AuditLog(path).append("one")
    evidence.AuditLog(path).append("two words")
    rows = aggregates.verify_chain(evidence.AuditLog.rows(spark, path).withColumn("log", F.lit(1)), ["log"], "line_no", "message", "digest")
    assert [(r.message, r.valid) for r in rows.orderBy("line_no").collect()] == [("one", True), ("two words", True)]


def test_hash_lists(spark, tmp_path):
    p = tmp_path / "set.csv"
    p.write_text('# comment d41d8cd98f00b204e9800998ecf8427e\n"DA39A3EE5E6B4B0D3255BFEF95601890AFD80709","D41D8CD98F00B204E9800998ECF8427E","0"\nd41d8cd98f00b204e9800998ecf8427e\n0CC175B9C0F1B6A831C399E269772661\n')
    hashes = evidence.hash_set(spark, str(p))
    assert sorted(r.md5 for r in hashes.collect()) == ["0cc175b9c0f1b6a831c399e269772661", "d41d8cd98f00b204e9800998ecf8427e"]
    rows = spark.createDataFrame([(1, "D41D8CD98F00B204E9800998ECF8427E"), (2, "x"), (3, None)], "id int, md5 string")
    assert [r.known for r in enrich.flag_known(rows, hashes).orderBy("id").collect()] == [True, False, False]


@pytest.mark.parametrize("level,lose", [(0, []), (1, [0]), (5, [2]), (6, [1, 4]), (6, [0]), (10, [1, 2])])
def test_arrays(spark, level, lose):
    size, n, rows = 32, {0: 3, 1: 2, 5: 4, 6: 5, 10: 4}[level], 6
    rng, data = random.Random(level), []
    disks = {k: [] for k in range(n)}
    for row in range(rows):
        p = n - 1 - row % n
        q = (p - 1) % n if level == 6 else None
        order = [k for k in range(n) if k not in (p, q)] if level in (5, 6) else list(range(n)) if level == 0 else [0] if level == 1 else [0, 2]
        blocks = [rng.randbytes(size) for _ in order]
        data += blocks
        full = {k: b for k, b in zip(order, blocks)}
        if level in (1, 10):
            full |= {k + 1: b for k, b in full.items()}
        if level in (5, 6):
            full[p] = bytes(size)
            full[q] = bytes(size)
            for k, b in zip(range(len(order)), blocks):
                full[p] = bytes(x ^ y for x, y in zip(full[p], b))
                full[q] = bytes(x ^ int(raid.gf_mul(raid.gf_pow2(k), y)) for x, y in zip(full[q], b))
        for k in range(n):
            disks[k].append(full[k])
    members = volumes.from_bytes(spark, {f"d{k}": b"".join(v) for k, v in disks.items()}, size).where(~F.col("volume_id").isin(*[f"d{k}" for k in lose], ""))
    got = raid.assemble(members, [f"d{k}" for k in range(n)], level).orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data) for r in got) == b"".join(data) and not any(r.lost for r in got)


@pytest.mark.parametrize("level,disks", [(5, 4), (6, 5)])
def test_alike_stripes_are_rebuilt_in_few_calls(spark, level, disks):
    rng = random.Random(level)
    # stripes lack no block, one, two or three, or have one of another size, row by row; one row is unreadable
    rows = [(f"d{k}", row, None if row == 77 else rng.randbytes(8 if (row + k) % 13 else 4)) for row in range(200) for k in range(disks) if (row * 7 + k * 3) % 10 > row % 4 - 1]
    got = raid.assemble(spark.createDataFrame(rows, "volume_id string, chunk_no long, data binary").where("chunk_no <> 77"), [f"d{k}" for k in range(disks)], level)
    want = []
    for row in range(200):
        have = {int(v[1:]): d for v, r, d in rows if r == row and d is not None}
        if have:
            size = max(map(len, have.values()))
            blocks = raid.rebuilt(level, {k: have[k] if len(have.get(k, b"")) == size else None for k in range(disks)}, row, disks, size)
            want += [(row * len(blocks) + k, (row * len(blocks) + k) * size, bytes(size) if d is None else d, d is None) for k, d in enumerate(blocks)]
    assert sorted((r.chunk_no, r.byte_offset, bytes(r.data), r.lost) for r in got.collect()) == sorted(want)
    assert any(lost for *_, lost in want)


def test_a_long_stripe_is_rebuilt_like_its_parts():
    rng, calls = random.Random(1), []
    stripes = [{k: rng.randbytes(8) if k not in (2, 4) else None for k in range(5)} for _ in range(1000)]
    whole, real = pa.record_batch({"row": [5 * k for k in range(1000)], "size": pa.array([8] * 1000, pa.int32()), **{f"_d{k}": pa.array([s[k] for s in stripes], pa.binary()) for k in range(5)}}), raid.rebuilt
    raid.rebuilt = lambda *a: calls.append(1) or real(*a)
    try:
        out = pa.Table.from_batches(raid.stripes_rebuilt(iter([whole]), 5, 6, "array"))
    finally:
        raid.rebuilt = real
    assert len(calls) == 1
    assert sorted(zip(out["chunk_no"].to_pylist(), out["data"].to_pylist())) == [(15 * k + j, d) for k, s in enumerate(stripes) for j, d in enumerate(real(6, s, 5 * k, 5, 8))]


def test_carves_of_many_small_volumes_are_folded_batch_by_batch(spark, capsys):
    known = carve.SIGNATURES[:2]
    body = b"\x89PNG\r\n\x1a\n" + bytes(5000) + b"IEND\xaeB`\x82" + bytes(600) + b"\xff\xd8\xff" + bytes(300)
    chunks = volumes.from_bytes(spark, {f"v{k}": bytes(512 * (k % 5)) + body for k in range(40)}, 2048)
    got = carve.carves(carve.hits(chunks, known), volumes.sector_count(chunks), known)
    end = lambda k: 512 * (k % 5) + len(body)
    want = [(f"v{k}", 512 * (k % 5), 512 * (k % 5) + 5016, 1, True) for k in range(40)] + [(f"v{k}", 512 * (k % 5) + 5616, end(k), 0, False) for k in range(40)]
    assert sorted((r.volume_id, r.start, r.end, r.sig, r.closed) for r in got.collect()) == sorted(want)
    got.explain()
    assert "InPandas" not in capsys.readouterr().out


def test_volume_reading_and_carving(spark, tmp_path):
    image = bytearray(64 * 1024)
    image[4096 : 4096 + len(png())] = png()
    image[20_000 : 20_000 + len(JPEG)] = JPEG
    picture = png(random.Random(3).randbytes(6000))
    image[30_000 : 30_000 + len(picture)] = picture
    path = tmp_path / "disk.dd"
    path.write_bytes(image)
    found = []
    for size in (1000, 4096, 65536):
        chunks = volumes.read_images(spark, str(path), chunk=size)
        rows = carve.carves(carve.hits(chunks, carve.SIGNATURES[:2]), volumes.sector_count(chunks), carve.SIGNATURES[:2])
        found.append(sorted((r.start, r.end, r.sig, r.closed) for r in rows.collect()))
    assert found[0] == found[1] == found[2] == [(4096, 4096 + len(png()), 1, True), (20_000, 20_000 + len(JPEG), 0, True), (30_000, 30_000 + len(picture), 1, True)]
    scored = {r.id: r for r in carve.scored(rows, chunks, carve.SIGNATURES[:2], chunk=65536).collect()}
    assert (scored[30_000].confidence, scored[30_000].extension, scored[30_000].start_sector) == (98, "png", 58) and scored[4096].confidence == 70


def test_recovery(spark, tmp_path):
    body = png(random.Random(4).randbytes(3000))
    image = bytearray(40 * 512)
    image[5 * 512 : 9 * 512] = body[: 4 * 512].ljust(2048, b"\0")
    image[20 * 512 : 20 * 512 + len(body) - 2048] = body[2048:]
    run = lambda s, n, sparse=False: {"start_sector": s, "sector_count": n, "is_sparse": sparse}
    rows = [
        (1, "two.png", len(body), 0, "ntfs_mft", [run(5, 4), run(20, 4)], None), (2, "sparse.bin", 1024, 1, "ntfs_mft", [run(None, 1, True), run(5, 1)], None), (3, "small.txt", 5, 0, "ntfs_mft", [], bytearray(b"hello")),
        (4, "off.bin", 1024, 0, "ntfs_mft", [run(39, 2)], None), (5, "note", 5, 0, "usn_journal", [], None), (6, "two.png", 512, 1, "fat", [run(6, 1)], None),
    ]
    kinds = "id long, name string, size_bytes long, status int, source string, runs array<struct<start_sector:long,sector_count:long,is_sparse:boolean>>, resident binary"
    f = spark.createDataFrame(rows, kinds).withColumns({"volume_id": F.lit("v"), "start_sector": F.lit(0)})
    out = recover.recover(f, volumes.from_bytes(spark, {"v": bytes(image)}, 1536), chunk=1536)
    got = {r.id: r for r in out.collect()}
    assert bytes(got[1].data) == body and got[1].success and got[1].score == 98 and got[1].md5 == hashlib.md5(body).hexdigest()
    assert bytes(got[2].data) == bytes(512) + body[:512] and bytes(got[3].data) == b"hello" and got[3].success
    assert got[4].zero_filled and not got[4].success and got[4].bytes_recovered == 1024 and not got[5].success and got[5].data is None and not got[6].success
    written = recover.write_files(out, str(tmp_path / "out")).collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["off.bin", "small.txt", "sparse.bin", "two.png", "two_1.png"] and len(written) == 5
    assert aggregates.outcome_totals(out, ["volume_id"]).first().succeeded == 3


def test_empty_texts_are_not_packed(spark, tmp_path, capsys):
    from lodestrata.plans import evidence as queries

    texts = ["", None, "x", "é" * 2048, "a" * 4096, "b" * 4097, "", "long text " * 9000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.recover_compressed(spark, str(tmp_path))
    want = [(k, hashlib.md5(t.encode()).hexdigest(), True, len(t.encode())) for k, t in enumerate(texts) if t]
    assert sorted(tuple(r) for r in found.collect()) == want
    # resident bytes meet no volume
    found.explain()
    assert "Join" not in capsys.readouterr().out


def test_partitions(spark):
    disk = bytearray(2048 * 512) + fat16()
    struct.pack_into("<B3xB3xII", disk, 446, 0x80, 6, 2048, 4120)
    disk[510:512] = b"\x55\xaa"
    chunks = volumes.from_bytes(spark, {"d": bytes(disk)}, 1 << 18)
    assert [tuple(r) for r in partitions.partitions(chunks, chunk=1 << 18).collect()] == [("d", "mbr", 1, 2048, 4120, "0x06", True)]
    assert [tuple(r) for r in partitions.scan_boot_sectors(chunks).collect()] == [("d", 2048, "FAT16")]
    assert partitions.gpt(bytes(512) + b"EFI PART" + bytes(64) + struct.pack("<QII", 2, 1, 128) + bytes(424) + bytes(range(16)) + bytes(16) + struct.pack("<QQ", 34, 133) + bytes(80))[0][:3] == (1, 34, 100)


def test_file_records_from_chunks(spark):
    mft = b"".join(ntfs_record(k, f"f{k}.jpg", b"x" * k, in_use=k % 2 == 0) for k in range(6))
    chunks = volumes.from_bytes(spark, {"v": bytes(4096) + mft}, 2048)
    rows = ntfs.file_rows(ntfs.records_in(chunks, 4096, 6, 1024), 4096).where("source = 'ntfs_mft'").orderBy("mft_record").collect()
    assert [(r.name, r.status, r.confidence, r.category) for r in rows][1:3] == [("f1.jpg", 0, 70, "Image"), ("f2.jpg", 1, 100, "Image")]
    assert ntfs.orphan_records(chunks).count() == 6


def test_ewf_round_trip(spark, tmp_path):
    data = random.Random(5).randbytes(150_000)
    size = evidence.SECTORS * 512
    digest, n = evidence.write_ewf(str(tmp_path / "img.E01"), (data[k : k + size] for k in range(0, len(data), size)), len(data))
    assert (digest, n) == (hashlib.md5(data).hexdigest(), len(data))
    got = evidence.read_ewf(spark, str(tmp_path / "img.E01")).orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data) for r in got) == data and [r.byte_offset for r in got] == [k * size for k in range(5)]


def test_streams(spark, tmp_path, files):
    source = tmp_path / "in"
    rows = spark.createDataFrame([(1, "a", 0x2, "usn_journal", 50, 5), (1, "b", 1, "fat", 60, 5), (1, "c", 1, "ntfs_logfile", 70, 5)], "scan_id long, name string, status int, source string, modified_at long, parent_id long")
    rows.write.parquet(str(source))
    read = spark.readStream.schema(rows.schema).parquet(str(source))
    stream.route(read, str(tmp_path / "files"), str(tmp_path / "timeline"), str(tmp_path / "ck")).processAllAvailable()
    assert [r.name for r in spark.read.parquet(str(tmp_path / "files")).collect()] == ["b"]
    assert [(r.event_type, r.file_name) for r in spark.read.parquet(str(tmp_path / "timeline")).collect()] == [("delete", "a")]
    ticks = spark.createDataFrame([("s", 0, 0, 1000), ("s", 1000, 10, 1000)], "scan string, time_ms long, work long, total long")
    ticks.write.parquet(str(tmp_path / "ticks"))
    q = stream.eta_stream(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")), "scan").writeStream.format("memory").queryName("eta").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.speed, r.eta_seconds) for r in spark.table("eta").orderBy("time_ms").collect()] == [(0.0, -1.0), (10.0, 99.0)]


def test_eta_of_a_stream_whose_ticks_come_in_any_order(spark, tmp_path):
    rng = random.Random(11)
    rows = [(k, 700 * j, 40 * j + k, 100_000) for k in range(3) for j in range(400)]
    rng.shuffle(rows)
    ticks = spark.createDataFrame(rows, "scan long, time_ms long, work long, total long")
    ticks.repartition(5).write.parquet(str(tmp_path / "ticks"))
    frames = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        q = stream.eta_stream(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")), "scan").writeStream.format("memory").queryName("eta_shuffled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", frames)
    in_order = ["scan", "time_ms", "work"]
    got, want = spark.table("eta_shuffled").orderBy(in_order).collect(), windows.eta(ticks, "scan", "time_ms", "work", "total").orderBy(in_order).collect()
    assert [tuple(r)[:3] + (r.stalled,) for r in got] == [tuple(r)[:3] + (r.stalled,) for r in want]
    assert np.allclose([r[3:5] for r in got], [r[3:5] for r in want])


def test_eta_fold_takes_late_ticks():
    state, *_ = windows.eta_fold(None, np.array([0, 50_000, 100_000]), np.array([1, 2, 3]), np.array([1000] * 3))
    state, speed, left, stalled = windows.eta_fold(state, np.array([5, 101_000]), np.array([2, 13]), np.array([1000] * 2))
    assert state[0][-1] == 101_000 and len(speed) == len(left) == 2 and speed[-1] == pytest.approx(10.0)


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    from lodestrata.plans import evidence as plans

    spark.range(10).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "tmp"))
    os.rename(next((tmp_path / "tmp").glob("part-*.parquet")), tmp_path / "one.parquet")
    for table in ("many", "one"):
        assert ids(plans._drained(spark, plans._stream(spark, str(tmp_path), table))) == list(range(10))


@pytest.mark.parametrize("stretch", [500, 1 << 24])
def test_copies_of_a_stream_that_is_stopped_and_goes_on(spark, tmp_path, stretch):
    rng, big = random.Random(12), 1 << 60
    rows = [(j % 2, big + j, "/a", at, at + rng.randrange(0, 60), "carver", 70 if j % 7 else None) for j in range(600) for at in (rng.randrange(0, 2000),)]
    rng.shuffle(rows)
    carved = spark.createDataFrame(rows, "volume_id long, id long, path string, start_sector long, end_sector long, source string, confidence int")
    one_go = intervals.mark_carved_copies(carved, ["volume_id"]).orderBy("id").collect()
    for part, which in enumerate((f"id < {big + 300}", f"id >= {big + 300}")):
        carved.where(which).repartition(5).write.parquet(str(tmp_path / f"in/{part}"))
    at = {k: str(tmp_path / k) for k in ("rows", "kept", "checkpoint")}

    def go():
        read = spark.readStream.schema(carved.schema).parquet(str(tmp_path / "come"))
        stream.write_copies(read, ["volume_id"], at["rows"], at["kept"], at["checkpoint"], stretch, {"availableNow": True}).awaitTermination()

    def marked():
        return spark.read.schema(carved.schema).parquet(at["rows"]).select(*carved.columns).orderBy("id").collect()

    os.makedirs(tmp_path / "come")
    for part in (0, 1):
        for f in (tmp_path / f"in/{part}").glob("part-*.parquet"):
            os.rename(f, tmp_path / "come" / f.name)
        go()
    assert marked() == one_go and 0 < sum(r.path == "/dup_of/carve" for r in one_go) < 600
    # the second batch failed after it had written: it comes again and overwrites itself
    (tmp_path / "checkpoint/commits/1").unlink()
    (tmp_path / "checkpoint/commits/.1.crc").unlink(missing_ok=True)
    go()
    assert marked() == one_go
    kept = spark.read.parquet(at["kept"])
    assert kept.select("volume_id", "start_sector", "end_sector").distinct().count() <= sum(r.path != "/dup_of/carve" for r in one_go)
    assert kept.where(f"start_sector >= (stretch + 1) * {stretch} or end_sector < stretch * {stretch}").count() == 0


def test_copies_of_a_stream_of_nothing(spark, tmp_path):
    schema = "volume_id long, id long, path string, start_sector long, end_sector long, source string, confidence int"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "come"))
    read = spark.readStream.schema(schema).parquet(str(tmp_path / "come"))
    stream.write_copies(read, ["volume_id"], *(str(tmp_path / k) for k in ("rows", "kept", "checkpoint")), trigger={"availableNow": True}).awaitTermination()
    assert not (tmp_path / "rows").exists() or spark.read.schema(schema).parquet(str(tmp_path / "rows")).count() == 0


def test_scores_of_pages_with_large_ids(spark, tmp_path):
    from lodestrata.plans import evidence as plans

    numbers = [11 * k + 9 for k in (0, 1, 5957, 5958, 40_000, 10**8, 10**9)] + [7, 65_536 * 11]
    spark.createDataFrame([(i, "http://a.b/", "<html>page</html>") for i in numbers], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.id: (r.kind, r.score) for r in plans.structure_scores(spark, str(tmp_path)).collect()}
    assert got == {i: ("bmp", 90) for i in numbers[:-2]} | {7: ("jpg", 95), 65_536 * 11: ("png", 98)}


def test_session(spark, tmp_path, files):
    s = ForensicSession(spark, str(tmp_path / "case"))
    assert s.files().count() == 0
    s.append("files", files)
    assert ids(s.files_page(1, 1, 2)) == [2, 5] and s.file_count(1, query="jpg").first().n == 3 and s.latest_scan().first().scan_id == -1
    assert s.scan_summary(1).first().total_files == 5 and ids(s.search_files(1, "fatura")) == [6]
    first = spark.createDataFrame([(1, "C-1", "Ann", 10, 10)], "id int, case_number string, investigator string, created_at long, updated_at long")
    s.append("case_info", s.update_case(first))
    s.append("case_info", s.update_case(first.withColumns({"investigator": F.lit("Bo"), "created_at": F.lit(99).cast("long"), "updated_at": F.lit(20).cast("long")})))
    assert tuple(s.case().select("investigator", "created_at").first()) == ("Bo", 10)


def test_csv_and_report(spark, tmp_path, files):
    recover.write_csv(files.where("id = 1"), str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfid;name") and b"\r\n1;photo.jpg;" in (tmp_path / "x.csv").read_bytes()
    html, digest = recover.html_report(files.agg(F.count("*").alias("n")), {"case": "<x>"})
    assert "&lt;x&gt;" in html and digest in html


def test_images(spark, tmp_path):
    data = random.Random(7).randbytes(10_000)
    chunks = volumes.from_bytes(spark, {"v": data}, 1024)
    digest, missing = recover.write_image(chunks, str(tmp_path / "a.dd"), len(data), 1024)
    assert (digest, missing) == (hashlib.md5(data).hexdigest(), 0) and (tmp_path / "a.dd").read_bytes() == data
    _, missing = recover.write_image(chunks.where("chunk_no not in (2, 9)"), str(tmp_path / "b.dd"), len(data), 1024)
    assert missing == 2 and (tmp_path / "b.dd").read_bytes() == data[:2048] + bytes(1024) + data[3072:9216] + bytes(784)
    recover.write_image(chunks, str(tmp_path / "c.E01"), len(data), 1024, "ewf")
    assert b"".join(evidence.ewf_chunks(str(tmp_path / "c.E01"))) == data
    with pytest.raises(ValueError):
        recover.write_image(chunks, str(tmp_path / "d.dd"), len(data), 1024, allowed=("/nowhere",))


def test_catalogues(spark, tmp_path):
    import json

    entry = {"format": "X", "extension": ".x", "category": "Image", "header": "ff d8", "footer": "", "max_size": 10}
    (tmp_path / "a.json").write_text(json.dumps([entry, {**entry, "header": ""}, {k: v for k, v in entry.items() if k != "max_size"} | {"maxSize": 20, "extension": "y"}]))
    assert [(s.extension, s.header, s.max_size) for s in carve.catalogue(spark, f"file://{tmp_path}/a.json")] == [("x", b"\xff\xd8", 10), ("y", b"\xff\xd8", 20)]
    (tmp_path / "b.json").write_text(json.dumps([{**entry, "max_size": None}]))
    with pytest.raises(ValueError):
        carve.catalogue(spark, f"file://{tmp_path}/b.json")
    known = carve.known_signatures(spark)
    assert len(known) > 130 and known[: len(carve.SIGNATURES)] == list(carve.SIGNATURES) and len({(s.header, s.header_at, s.extension) for s in known}) == len(known)


def test_hits_equal_a_plain_search(spark):
    rng = random.Random(12)
    signatures = [carve.Signature("A", "a", "Image", b"ab", b"ba", 40), carve.Signature("B", "b", "Image", b"aba", b"", 25, 1), carve.Signature("C", "c", "Image", b"b", b"ab", 9)]
    data = bytes(rng.choice(b"ab....") for _ in range(3000))
    want = sorted((at, kind, k, len(p)) for k, s in enumerate(signatures) for kind, p in (("header", s.header), ("footer", s.footer)) if p for at in range(len(data)) if data.startswith(p, at))
    for size in (7, 512):
        chunks = volumes.from_bytes(spark, {"v": data}, size)
        found = carve.hits(chunks, signatures)
        assert sorted((r.offset, r.kind, r.sig, r.length) for r in found.collect()) == want
        got = carve.carves(found, volumes.sector_count(chunks), signatures)
        assert sorted((r.start, r.end, r.sig, r.closed) for r in got.collect()) == carve.fold(want, signatures, len(data))
    gone = chunks.withColumn("data", F.when(F.col("chunk_no") == 2, None).otherwise(F.col("data")))
    assert sorted((r.offset, r.kind, r.sig, r.length) for r in carve.hits(gone, signatures).collect()) == [x for x in want if x[0] + x[3] <= 1024 or x[0] >= 1536]


def test_carving_reads_chunks_once_for_each_need(spark, capsys):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    known = carve.SIGNATURES[1:2]
    rng = random.Random(4)
    # footers end at 2048 to 2059, so those of k = 1 to 7 cross the edge of two chunks; the last chunk holds k bytes
    disks = {f"v{k}": b"\x89PNG\r\n\x1a\n" + rng.randbytes(2032 + k) + b"IEND\xaeB`\x82" for k in range(12)}
    chunks = volumes.from_bytes(spark, disks, 2048).mapInArrow(counted, "volume_id string, chunk_no long, byte_offset long, data binary")
    n = sum(-(-len(data) // 2048) for data in disks.values())
    found = carve.hits(chunks, known)
    got = carve.scored(carve.carves(found, volumes.sector_count(chunks), known), chunks, known, chunk=2048)
    assert sorted((r.volume_id, r.id, r.size_bytes, r.confidence) for r in got.collect()) == sorted((v, 0, len(data), carve.PAIR) for v, data in disks.items())
    # whole, heads, tails, sizes, bytes of the carves
    assert read.value <= 5 * n
    found.explain("extended")
    assert "hex(data" not in capsys.readouterr().out


def test_small_carves_are_checked_and_two_gaps_are_searched_whole(spark, tmp_path):
    from lodestrata.plans import evidence as queries

    html = ["", "a", "b" * 4038, "c" * 4039, "d" * 4040, "e" * 9000]
    spark.createDataFrame([(k, h) for k, h in enumerate(html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r.volume, r.size_bytes, r.confidence) for r in queries.scored_carves(spark, str(tmp_path)).collect()) == [(k, len(h) + 57, 98) for k, h in enumerate(html)]

    rng = random.Random(5)
    picture = png(rng.randbytes(12_000))
    # the gaps that explain it lie past the first thousands of pairs, and the larger one is past 256 KiB
    torn = picture[:4096] + rng.randbytes(1024) + picture[4096:7168] + rng.randbytes(1536) + picture[7168:]
    large = png(rng.randbytes(300_000))
    late = large[:299_008] + rng.randbytes(512) + large[299_008:299_520] + rng.randbytes(512) + large[299_520:]
    wrong = png(b"x" * 900)[:-20] + b"wrong!!!" + b"IEND\xaeB`\x82"
    known = carve.SIGNATURES[1:2]
    chunks = volumes.from_bytes(spark, {"torn": torn, "wrong": wrong}, 4096)
    rows = carve.carves(carve.hits(chunks, known), volumes.sector_count(chunks), known)
    got = {r.volume_id: r for r in carve.scored(rows, chunks, known, chunk=4096, checked_from=-1).collect()}
    assert (got["torn"].confidence, got["torn"].source) == (carve.RESCUED, "carver_bgc") and got["wrong"].confidence == 40
    assert (got["torn"].gap_start, got["torn"].gap_length, got["torn"].gap2_start, got["torn"].gap2_length) == (4096, 1024, 8192, 1536)
    assert carve.bifragment_gap(late, validators.png, gaps=validators.png_gaps) is None
    held = late[:299_008] + late[299_008 + 512 :]
    assert list(validators.png_gaps(held, 299_008 + 512, 512, 65536)) == [(299_520, 512)]


def test_names_past_the_last_number(spark, tmp_path):
    rows = spark.createDataFrame([("v", k, "a.txt", bytearray(b"x")) for k in range(4)], "volume_id string, id long, name string, data binary")
    assert [r.dest for r in recover.unique_names(rows, 2).orderBy("id").collect()] == ["a.txt", "a_1.txt", "a_2.txt", None]


def test_patterns_are_read_by_the_engine_that_runs_them(files):
    assert ids(search.search_files(files, r"(?P<x>a)", "regex")) == [] and ids(search.search_files(files, r"(?<x>IMG)_\d++", "regex")) == [5]


def test_carved_copies_equal_plain_marks(spark):
    rng = random.Random(8)
    rows = [(k % 2, k, f"/{k}", s := rng.randrange(4000), s + rng.randrange(60), "carver", 70) for k in range(500)]
    frame = spark.createDataFrame(rows, "v int, id long, path string, start_sector long, end_sector long, source string, confidence int")
    kept, want = {0: [], 1: []}, {}
    for v, k, _, s, e, *_ in rows:
        want[k] = any(2 * (min(e, b) - max(s, a) + 1) >= min(e - s, b - a) + 1 for a, b in kept[v] if s <= b and a <= e)
        kept[v] += [] if want[k] else [(s, e)]
    for width in (64, 1 << 20):
        assert {r.id: r.source == "carver_duplicate" for r in intervals.mark_carved_copies(frame, ["v"], width).collect()} == want


def test_log_lines_keep_their_order(spark, tmp_path):
    lines = [f"{k} line" for k in range(3000)]
    (tmp_path / "long.log").write_text("\n".join(lines) + "\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = [r.value for r in evidence.log_tail(spark, str(tmp_path / "long.log"), 700).collect()]
        assert evidence.log_lines(spark, str(tmp_path / "long.log")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got == lines[-700:]


def test_session_carves_and_clears(spark, tmp_path, files):
    s = ForensicSession(spark, str(tmp_path / "case"))
    picture = png(random.Random(3).randbytes(6000))
    chunks = volumes.from_bytes(spark, {"v": bytes(5120) + picture + bytes(9000)}, volumes.CHUNK)
    s.append("files", s.carve(3, chunks))
    got = s.files(3).where("extension = 'png'").first()
    assert (got.start_sector, got.size_bytes, got.confidence, got.path) == (10, len(picture), 98, "/carved/carved_5120.png")
    assert not s.catalogue_truncated(3).first().truncated and s.report(3, {"case": "C-1"})[0].startswith("<!DOCTYPE html>")
    s.clear()
    assert s.files(3).count() == 0


def test_order_of_a_language(spark):
    rows = spark.createDataFrame([("d",), ("ç",), ("c",), ("i",), ("ı",)], "name string")
    assert [r.name for r in listing.page_by_name(rows, 1, 3).collect()] == ["ç", "d", "ı"]


def test_record_joins_tell_volumes_apart(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    keys = ["volume_id"]
    rows = make([("v1", 1, "a", 50, "ntfs_mft", 0), ("v2", 1, "b", 40, "ntfs_mft", 1), ("v1", 1, "c", 60, "ntfs_mft", 2)], "volume_id string, mft_record long, name string, confidence int, source string, seq long")
    assert sorted(r.name for r in enrich.best_record(rows, keys=keys).collect()) == ["b", "c"]
    entries = make([("v1", 7, 5, "x", 85, 0), ("v2", 7, 8, "y", 85, 1), ("v2", 8, 5, "top", 85, 2)], "volume_id string, node long, parent long, name string, confidence int, seq long")
    index = graph.directory_index(entries, keys)
    assert {(r.volume_id, r.node): r.path for r in graph.rebuild_paths(index, keys=keys).collect()} == {("v1", 7): "/x", ("v2", 7): "/top/y", ("v2", 8): "/top"}
    assert {(r.volume_id, r.node): r.path for r in graph.rebuild_paths(index, keys=keys, settle=lambda df: df.cache()).collect()} == {("v1", 7): "/x", ("v2", 7): "/top/y", ("v2", 8): "/top"}
    files = make([("v1", 3, "f", 40, "ntfs_mft", 0), ("v2", 3, "g", 40, "ntfs_mft", 0)], "volume_id string, mft_record long, name string, confidence int, source string, status int")
    hints = make([("v1", "f", 9), ("v2", "zz", 3)], "volume_id string, name_lower string, mft_ref long")
    assert {r.name: (r.confidence, r.source) for r in enrich.confirm_by_log(files, hints, keys).collect()} == {"f": (52, "ntfs_mft_logfile"), "g": (52, "ntfs_mft_logfile")}
    assert {r.name: r.confidence for r in enrich.confirm_by_log(files, hints.where("volume_id = 'v1'"), keys).collect()} == {"f": 52, "g": 40}
    gone = make([("v2", 3 | 5 << 48)], "volume_id string, file_reference long")
    assert {r.name: r.confidence for r in enrich.confirm_by_journal(files, gone, keys).collect()} == {"f": 40, "g": 55}
    slack = make([("v1", 7, 5, "x"), ("v2", 7, 5, "x")], "volume_id string, child long, parent long, name string")
    assert [(r.volume_id, r.name) for r in enrich.slack_names(slack, index, keys).collect()] == [("v2", "x")]


def test_chains_of_many_lines_are_folded_as_they_come(spark):
    rows = [(k % 3 or None, k, f"line {k % 40}") for k in range(3000)] + [(1, 7, "line 7")] * 2 + [(8, 1, "a"), (8, 2, None), (8, 3, "b")]
    lines = spark.createDataFrame(rows, "log int, at long, m string").repartition(5)
    want = {}
    for log, _, m in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2] or "")):
        head, n = want.get(log, ("0" * 64, 0))
        want[log] = (head and m and hashlib.sha256((head + m).encode()).hexdigest(), n + 1)
    frames = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        assert {r.log: (r.head, r.links) for r in aggregates.hash_chain(lines, ["log"], "at", "m").collect()} == want
        written = aggregates.chained(lines.where("log = 2"), ["log"], "at", "m").withColumn("digest", F.when(F.col("at") == 500, "x").otherwise(F.col("digest")))
        assert [r["at"] for r in aggregates.verify_chain(written, ["log"], "at", "m", "digest").where("not valid").orderBy("at").collect()] == [500, 503]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", frames)
