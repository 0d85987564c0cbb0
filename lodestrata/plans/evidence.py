"""The byte-level operators over volumes made from the driver's tables, each with the SQL that says what has to come out.

A row of a table is written down as the bytes of an on-disk structure, by column expressions, and the operator reads them
back: pages are volumes of 512-byte chunks, orders fill disk arrays, customers are records, journals, directories.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binary, classify, crypto, text, times
from ..operators import aggregates, carve, enrich, graph, intervals, lifecycle, listing, raid, recover, search, windows
from ..sources import evidence, fat, ntfs, partitions, volumes
from ..streaming import timeline as streams
from .driver import FILES_SQL, files, query, read

SECTOR = 512


def le(value: Column, size: int) -> Column:
    """A whole number as little-endian bytes."""
    x = value.cast("long")
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)]))


def be8(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def raw(data: bytes) -> Column:
    return F.lit(bytearray(data))


def padded(data: Column, size: Column | int) -> Column:
    """Bytes with zeros up to a size."""
    return F.concat(data, volumes.zeros((F.lit(size) if isinstance(size, int) else size) - F.octet_length(data)))


def utf16(value: Column) -> Column:
    return F.encode(value, "UTF-16LE")


def apply(rows: DataFrame, each, schema: str) -> DataFrame:
    """each(id, bytes) gives tuples, for the rows (id, data)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for frame in frames:
            yield pd.DataFrame([out for i, data in zip(frame["id"], frame["data"]) for out in each(i, bytes(data))], columns=names)

    return rows.select("id", "data").mapInPandas(run, schema)


# Disk arrays: a stripe row of each order; disks that are left out are rebuilt.


def array_query(name: str, level: int, disks: int, lost: tuple[int, ...] = ()):
    per_row = {0: disks, 1: 1, 5: disks - 1, 6: disks - 2, 10: disks // 2}[level]
    values = ["o_orderkey", "o_custkey * 65537 + 7", "o_orderkey + o_custkey"][:per_row]

    def run(spark, sf_dir) -> DataFrame:
        row = F.col("o_orderkey")
        blocks = [F.expr(v).cast("long") for v in values]
        p = F.lit(disks - 1) - row % disks if level in (5, 6) else F.lit(-1)
        q = F.pmod(p - 1, F.lit(disks)) if level == 6 else F.lit(-1)
        parity = blocks[0]
        for b in blocks[1:]:
            parity = parity.bitwiseXOR(b)

        @F.pandas_udf("binary")
        def syndrome(*columns: pd.Series) -> pd.Series:
            out = np.zeros((len(columns[0]), 8), "uint8")
            for k, x in enumerate(columns):
                out ^= binary.gf_mul(binary.gf_pow2(k), x.to_numpy(">i8").view("uint8").reshape(-1, 8)).astype("uint8")
            return pd.Series([x.tobytes() for x in out])

        members = []
        for k in range(disks):
            nth = {0: F.lit(k), 1: F.lit(0), 10: F.lit(k // 2)}.get(level, F.lit(k) - F.when(p < k, 1).otherwise(0) - F.when((q >= 0) & (q < k), 1).otherwise(0))
            data = be8(F.element_at(F.array(*blocks), F.greatest(F.least(nth, F.lit(per_row - 1)), F.lit(0)).cast("int") + 1))
            if level in (5, 6):
                data = F.when(p == k, be8(parity)).otherwise(data)
            if level == 6:
                data = F.when(q == k, syndrome(*blocks)).otherwise(data)
            if k not in lost:
                members.append(F.struct(F.lit(f"d{k}").alias("volume_id"), data.alias("data")))
        rows = read(spark, sf_dir, "orders").select(row.alias("chunk_no"), (row * 8).alias("byte_offset"), F.explode(F.array(*members)).alias("x")).select("x.volume_id", "chunk_no", "byte_offset", "x.data")
        return raid.assemble(rows, [f"d{k}" for k in range(disks)], level).select("chunk_no", "byte_offset", F.hex("data").alias("data"), "lost")

    run.__name__ = name
    parts = ", ".join(f"{{'k': {k}, 'v': {v}}}" for k, v in enumerate(values))
    query(f"SELECT o_orderkey * {per_row} + x.k AS chunk_no, (o_orderkey * {per_row} + x.k) * 8 AS byte_offset, lpad(to_hex(CAST(x.v AS BIGINT)), 16, '0') AS data, false AS lost FROM (SELECT o_orderkey, unnest([{parts}]) AS x FROM orders)")(run)


array_query("raid0_read", 0, 3)
array_query("raid1_read", 1, 2, (0,))
array_query("raid5_rebuilt", 5, 4, (1,))
array_query("raid6_rebuilt_two", 6, 5, (0, 3))
array_query("raid6_rebuilt_from_q", 6, 5, (2, 4))
array_query("raid10_read", 10, 6, (0, 3))


# Volumes of pages.


def page_volumes(spark, sf_dir) -> DataFrame:
    """Chunks of a sector, the last one filled with zeros."""
    body = F.encode("html", "UTF-8")
    whole = read(spark, sf_dir, "pages").select("page_id", padded(body, (F.ceil(F.octet_length(body) / SECTOR) * SECTOR)).alias("b"))
    rows = whole.where(F.octet_length("b") > 0).select(F.col("page_id").cast("string").alias("volume_id"), "b", F.explode(F.sequence(F.lit(0), (F.octet_length("b") / SECTOR).cast("int") - 1)).alias("k"))
    return rows.select("volume_id", F.col("k").cast("long").alias("chunk_no"), (F.col("k") * SECTOR).cast("long").alias("byte_offset"), F.expr(f"substring(b, k * {SECTOR} + 1, {SECTOR})").alias("data"))


PAGES_SQL = f"p AS (SELECT page_id, strlen(html) AS n, CAST(ceil(strlen(html) / {SECTOR}.0) AS BIGINT) AS s, rpad(hex(encode(html)), CAST(ceil(strlen(html) / {SECTOR}.0) AS INTEGER) * {2 * SECTOR}, '0') AS h FROM pages WHERE html <> '')"


def page_files(spark, sf_dir) -> DataFrame:
    """A file a page: the volume's last two thirds, then its first; every fifth one also has a run past the volume's end."""
    n = F.octet_length("html")
    s = F.ceil(n / SECTOR)
    a = F.floor(s / 3)
    run = lambda at, count: F.struct(at.cast("long").alias("start_sector"), count.cast("long").alias("sector_count"), F.lit(False).alias("is_sparse"))
    beyond = F.when(F.col("page_id") % 5 == 0, F.array(run(s + 100, F.lit(1)))).otherwise(F.array().cast("array<struct<start_sector:bigint,sector_count:bigint,is_sparse:boolean>>"))
    runs = F.filter(F.concat(F.array(run(a, s - a), run(F.lit(0), a)), beyond), lambda r: r["sector_count"] > 0)
    size = F.when(F.col("page_id") % 5 == 0, (s + 1) * SECTOR).otherwise(n)
    rows = read(spark, sf_dir, "pages").where("html <> ''").select(F.col("page_id").alias("id"), F.col("page_id").cast("string").alias("volume_id"), F.lit("page.bin").alias("name"), size.cast("long").alias("size_bytes"), (F.col("page_id") % 2).cast("int").alias("status"), runs.alias("runs"))
    return rows.withColumns({"source": F.lit("ntfs_mft"), "start_sector": F.lit(0).cast("long"), "resident": F.lit(None).cast("binary")})


_MOVED = "f AS (SELECT page_id, n, s, substr(h, s // 3 * 1024 + 1) || substr(h, 1, s // 3 * 1024) || CASE WHEN page_id % 5 = 0 THEN repeat('0', 1024) ELSE '' END AS m, CASE WHEN page_id % 5 = 0 THEN (s + 1) * 512 ELSE n END AS size FROM p)"


@query(f"WITH {PAGES_SQL}, {_MOVED} SELECT page_id AS id, md5(unhex(substr(m, 1, size * 2))) AS md5, page_id % 5 <> 0 AS success, page_id % 5 = 0 AS zero_filled, size AS bytes_recovered FROM f")
def recover_runs(spark, sf_dir):
    return recover.recover(page_files(spark, sf_dir), page_volumes(spark, sf_dir), chunk=SECTOR).select("id", "md5", "success", "zero_filled", "bytes_recovered")


@query(f"WITH {PAGES_SQL} SELECT page_id % 3 AS part, count(*) FILTER (WHERE page_id % 5 <> 0) AS succeeded, count(*) FILTER (WHERE page_id % 5 = 0) AS failed FROM p GROUP BY ALL")
def recovery_outcomes(spark, sf_dir):
    done = recover.recover(page_files(spark, sf_dir), page_volumes(spark, sf_dir), chunk=SECTOR)
    return aggregates.outcome_totals(done.withColumn("part", F.col("id") % 3), ["part"])


@query(f"WITH {PAGES_SQL}, {_MOVED} SELECT page_id AS id, md5(unhex(substr(m, 1, least(size, 700) * 2))) AS md5 FROM f")
def record_prefix(spark, sf_dir):
    found = volumes.file_bytes(page_files(spark, sf_dir), page_volumes(spark, sf_dir), SECTOR, SECTOR, most=700)
    return found.select("id", F.md5("data").alias("md5"))


@query(f"WITH {PAGES_SQL} SELECT page_id AS id, md5(unhex(substr(h, 601, 2000))) AS md5 FROM p")
def volume_slice(spark, sf_dir):
    return volumes.slice_at(page_volumes(spark, sf_dir), 300, 1000, SECTOR).select(F.col("volume_id").cast("long").alias("id"), F.md5("data").alias("md5"))


@query(f"WITH {PAGES_SQL} SELECT page_id AS id, s * {SECTOR} AS bytes FROM p")
def volume_sizes(spark, sf_dir):
    return volumes.sector_count(page_volumes(spark, sf_dir)).select(F.col("volume_id").cast("long").alias("id"), "bytes")


@query(f"""WITH {PAGES_SQL}, b AS (SELECT page_id, unnest(range(n)) AS k, h FROM p), c AS (SELECT page_id, k, CAST('0x' || substr(h, 2 * k + 1, 2) AS INTEGER) AS x FROM b)
SELECT page_id AS id, md5(string_agg(chr(CASE WHEN x IN (9, 10, 13) OR x BETWEEN 32 AND 126 OR x >= 128 THEN x ELSE 32 END), '' ORDER BY k)) AS md5 FROM c GROUP BY page_id""")
def sanitised_content(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").where("html <> ''")
    return rows.select(F.col("page_id").alias("id"), F.md5(F.encode(text.sanitize_content(F.encode("html", "UTF-8"), 1 << 30), "UTF-8")).alias("md5"))


@query(f"""WITH {PAGES_SQL}, c AS (SELECT page_id, substr(h, 2 * k + 1, 2) AS x FROM (SELECT page_id, h, unnest(range(n)) AS k FROM p)), n AS (SELECT page_id, x, count(*) AS n FROM c GROUP BY ALL)
SELECT page_id AS id, round(log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n), 6) AS entropy,
  CASE WHEN log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n) > 7 THEN 'high' WHEN log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n) > 4.5 THEN 'mid' ELSE 'low' END AS band FROM n GROUP BY page_id""")
def page_byte_entropy(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").where("html <> ''").select(F.col("page_id").alias("id"), aggregates.byte_entropy(F.encode("html", "UTF-8")).alias("e"))
    return rows.select("id", F.round("e", 6).alias("entropy"), classify.entropy_class("e").alias("band"))


# Carving in texts: signatures that stand in prose, chunks of 1000 bytes, so hits cross edges.

PROSE = tuple(carve.Signature(x, x, "Document", x.encode(), y.encode(), 4000) for x, y in (("license", "\n"), ("tion ", "the "), ("<p>", "</p>")))


def document_chunks(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").cast("string").alias("volume_id"), F.encode("text", "UTF-8").alias("b"))
    rows = rows.select("volume_id", "b", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / 1000).cast("int"))).alias("k"))
    return rows.select("volume_id", F.col("k").cast("long").alias("chunk_no"), (F.col("k") * 1000).cast("long").alias("byte_offset"), F.expr("substring(b, k * 1000 + 1, 1000)").alias("data"))


def _count_of(pattern: str) -> str:
    return f"(strlen(text) - strlen(replace(text, '{pattern}', ''))) // {len(pattern.encode())}"


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id AS id, '{kind}' AS kind, CAST({k} AS INTEGER) AS sig, {_count_of(p)} AS n FROM documents" for k, s in enumerate(PROSE) for kind, p in (("header", s.header.decode()), ("footer", s.footer.decode()))) + ") WHERE n > 0")
def carve_hits(spark, sf_dir):
    found = carve.hits(document_chunks(spark, sf_dir), PROSE)
    return found.groupBy(F.col("volume_id").cast("long").alias("id"), "kind", "sig").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE x AS (SELECT doc_id, encode(text) AS b, strlen(text) AS n, instr(text, 'license') AS c FROM documents WHERE contains(text, 'license')),
s AS (SELECT doc_id, n, strlen(substr(text, 1, instr(text, 'license') - 1)) AS start, strlen(substr(text, 1, instr(text, 'license') + 6)) AS after, substr(text, instr(text, 'license') + 7) AS rest FROM x JOIN documents d USING (doc_id)),
e AS (SELECT doc_id, n, start, CASE WHEN contains(rest, chr(10)) THEN after + strlen(substr(rest, 1, instr(rest, chr(10)))) END AS stop FROM s)
SELECT doc_id AS id, start, CASE WHEN stop IS NOT NULL AND stop - start <= 4000 THEN stop ELSE least(n, start + 4000) END AS "end", stop IS NOT NULL AND stop - start <= 4000 AS closed FROM e""")
def first_carve(spark, sf_dir):
    # the first carve of a text: from the first header to the first footer behind it, or as far as the signature reaches
    chunks = document_chunks(spark, sf_dir)
    found = carve.carves(carve.hits(chunks, PROSE[:1]), volumes.sector_count(chunks), PROSE[:1])
    first = found.groupBy("volume_id").agg(F.min_by(F.struct("start", "end", "closed"), "start").alias("x"))
    return first.select(F.col("volume_id").cast("long").alias("id"), "x.start", "x.end", "x.closed")


@query("SELECT doc_id AS id, count(*) AS n FROM (SELECT doc_id, unnest(range(strlen(text) // 2000 + 1)) AS k, text FROM documents) WHERE " + " + ".join(f"CASE WHEN prefix(hex(encode(text))[4000 * k + 1:], hex(encode('{s.header.decode()}'))) THEN 1 ELSE 0 END" for s in PROSE) + " > 0 GROUP BY doc_id")
def carve_hits_allowed(spark, sf_dir):
    # only places at multiples of 2000 bytes may be searched
    chunks = document_chunks(spark, sf_dir)
    ends = volumes.sector_count(chunks)
    allowed = ends.select("volume_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("bytes") / 2000))).alias("k")).select("volume_id", (F.col("k") * 2000).alias("start"), (F.col("k") * 2000 + 1).alias("end"))
    found = carve.hits(chunks, PROSE, allowed).where("kind = 'header'")
    return found.groupBy(F.col("volume_id").cast("long").alias("id")).agg(F.count_distinct("offset").alias("n"))


COPIES_SQL = """WITH RECURSIVE o AS (SELECT scan_id, id, path, start_sector AS s, end_sector AS e, source, confidence, row_number() OVER (PARTITION BY scan_id ORDER BY id) AS k FROM files WHERE source LIKE 'carver%'),
r AS (SELECT scan_id, id, k, false AS copy, [{'s': s, 'e': e}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.scan_id, o.id, o.k, len(list_filter(r.kept, lambda x: x.s <= o.e AND o.s <= x.e AND 2 * (least(o.e, x.e) - greatest(o.s, x.s) + 1) >= least(o.e - o.s, x.e - x.s) + 1)) > 0,
    CASE WHEN len(list_filter(r.kept, lambda x: x.s <= o.e AND o.s <= x.e AND 2 * (least(o.e, x.e) - greatest(o.s, x.s) + 1) >= least(o.e - o.s, x.e - x.s) + 1)) > 0 THEN r.kept ELSE list_append(r.kept, {'s': o.s, 'e': o.e}) END
  FROM r JOIN o ON o.scan_id = r.scan_id AND o.k = r.k + 1)
SELECT o.scan_id, o.id, CASE WHEN copy THEN '/dup_of/carve' ELSE path END AS path, o.s AS start_sector, o.e AS end_sector, CASE WHEN copy THEN 'carver_duplicate' ELSE source END AS source, CASE WHEN copy THEN least(confidence, 30) ELSE confidence END AS confidence
FROM o JOIN r ON o.scan_id = r.scan_id AND o.id = r.id""".replace("WITH RECURSIVE o", f"WITH RECURSIVE {FILES_SQL}, o", 1)


@query(COPIES_SQL)
def near_duplicate_carve(spark, sf_dir):
    rows = files(spark, sf_dir).where(classify.is_carved("source")).select("scan_id", "id", "path", "start_sector", "end_sector", "source", "confidence")
    return intervals.mark_carved_copies(rows, ["scan_id"], width=4096)


_EARLIER = "list_filter(r.h, lambda x: x.t >= o.t - 30000)"
ETA_SQL = """WITH RECURSIVE o AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) * 10 AS t, event_id AS w, 1000000::BIGINT AS n, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) * 10, event_id) AS k FROM events),
m AS (SELECT *, max(w) OVER (PARTITION BY user_id ORDER BY k) AS m FROM o),
d AS (SELECT *, m - lag(m) OVER (PARTITION BY user_id ORDER BY k) AS rise FROM m),
e AS (SELECT *, sum(CASE WHEN rise > greatest(1.0, n * 0.02) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k) AS episode, t - max(CASE WHEN rise IS NULL OR rise > 0 THEN t END) OVER (PARTITION BY user_id ORDER BY k) >= 8000 AS stalled FROM d),
f AS (SELECT *, min({'t': t, 'm': m}) OVER (PARTITION BY user_id, episode ORDER BY t RANGE BETWEEN 30000 PRECEDING AND CURRENT ROW) AS a FROM e),
g AS (SELECT *, CASE WHEN t > a.t THEN (m - a.m) / ((t - a.t) / 1000.0::DOUBLE) END AS own FROM f),
r AS (SELECT user_id, k, CASE WHEN stalled OR own IS NULL THEN 0.0::DOUBLE ELSE own END AS speed FROM g WHERE k = 1
  UNION ALL SELECT g.user_id, g.k, CASE WHEN g.stalled THEN 0.0 WHEN g.own IS NULL THEN r.speed WHEN r.speed > 0 THEN r.speed * 0.85 + g.own * 0.15 ELSE g.own END FROM g JOIN r ON g.user_id = r.user_id AND g.k = r.k + 1)
SELECT g.user_id, g.t AS time_ms, g.w AS work, round(speed, 6) AS speed, CASE WHEN NOT stalled AND speed > 0 AND n > m THEN round(least((n - m) / speed, 129600.0), 3) ELSE -1.0 END AS eta_seconds, stalled FROM g JOIN r ON g.user_id = r.user_id AND g.k = r.k"""


@query(ETA_SQL)
def eta_ema(spark, sf_dir):
    ticks = read(spark, sf_dir, "events").select("user_id", (F.unix_timestamp("ts") * 10).alias("t"), F.col("event_id").alias("work"), F.lit(10**6).cast("long").alias("total"))
    return windows.eta(ticks, "user_id", "t", "work", "total").withColumns({"speed": F.round("speed", 6), "eta_seconds": F.round("eta_seconds", 3)})


# File-system structures.


@query("""SELECT 's' || s_suppkey AS volume_id, 'mbr' AS scheme, CAST(x.k AS INTEGER) AS number, CAST(x.s AS BIGINT) AS start_sector, CAST(x.n AS BIGINT) AS size_sectors, x.t AS type, x.a AS active
FROM (SELECT s_suppkey, unnest([{'k': 1, 's': 2048 + s_suppkey, 'n': 100 + s_nationkey, 't': '0x07', 'a': true}, {'k': 3, 's': 90000, 'n': s_suppkey + 1, 't': '0x83', 'a': false}]) AS x FROM supplier)""")
def mbr_partitions(spark, sf_dir):
    entry = lambda flag, kind, start, size: F.concat(raw(bytes([flag, 0, 0, 0, kind, 0, 0, 0])), le(start, 4), le(size, 4))
    k = F.col("s_suppkey")
    sector = F.concat(raw(bytes(446)), entry(0x80, 7, 2048 + k, 100 + F.col("s_nationkey")), raw(bytes(16)), entry(0, 0x83, F.lit(90000), k + 1), raw(bytes(16)), raw(b"\x55\xaa"))
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("volume_id"), F.lit(0).cast("long").alias("chunk_no"), F.lit(0).cast("long").alias("byte_offset"), sector.alias("data"))
    return partitions.partitions(rows, chunk=SECTOR)


@query("""SELECT 's' || s_suppkey AS volume_id, 'gpt' AS scheme, CAST(1 AS INTEGER) AS number, s_suppkey + 34 AS start_sector, CAST(s_nationkey + 1 AS BIGINT) AS size_sectors, '01010101-0101-0101-0101-010101010101' AS type, false AS active FROM supplier""")
def gpt_partitions(spark, sf_dir):
    k = F.col("s_suppkey")
    entry = F.concat(raw(bytes([1] * 16)), raw(bytes(16)), le(k + 34, 8), le(k + 34 + F.col("s_nationkey"), 8), raw(bytes(80)))
    mbr = raw(bytes(446) + bytes([0, 0, 0, 0, 0xEE, 0, 0, 0, 1, 0, 0, 0, 255, 0, 0, 0]) + bytes(48) + b"\x55\xaa")
    header = padded(F.concat(raw(b"EFI PART" + bytes(64)), le(F.lit(2), 8), le(F.lit(4), 4), le(F.lit(128), 4)), SECTOR)
    disk = F.concat(mbr, header, padded(entry, 32 * SECTOR))
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("volume_id"), F.lit(0).cast("long").alias("chunk_no"), F.lit(0).cast("long").alias("byte_offset"), disk.alias("data"))
    return partitions.partitions(rows, chunk=34 * SECTOR)


@query("SELECT c_custkey AS id, (['NTFS', 'exFAT', 'FAT32', 'FAT16', 'FAT12', 'unknown'])[c_custkey % 6 + 1] AS type, CASE c_custkey % 6 WHEN 5 THEN 0 WHEN 0 THEN c_custkey * 4294967296 + 17 ELSE c_custkey + 17 END AS serial FROM customer")
def boot_probe(spark, sf_dir):
    k = F.col("c_custkey")
    serial, wide = le(k + 17, 4), F.concat(le(F.lit(17), 4), le(k, 4))
    end = raw(b"\x55\xaa")
    ntfs_boot = F.concat(raw(bytes(3) + b"NTFS    " + bytes(61)), wide, raw(bytes(430)), end)
    exfat = F.concat(raw(bytes(3) + b"EXFAT   " + bytes(89)), serial, raw(bytes(406)), end)
    fat32 = F.concat(raw(bytes(67)), serial, raw(bytes(11) + b"FAT32   " + bytes(420)), end)
    fat16, fat12 = (F.concat(raw(bytes(39)), serial, raw(bytes(11) + name + bytes(448)), end) for name in (b"FAT16   ", b"FAT12   "))
    data = F.element_at(F.array(ntfs_boot, exfat, fat32, fat16, fat12, F.concat(raw(bytes(510)), end)), (k % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "customer").select(k.alias("id"), data.alias("d"))
    return rows.select("id", partitions.filesystem("d").alias("type"), partitions.volume_serial("d").cast("long").alias("serial"))


@query("SELECT 'all' AS volume_id, c_custkey * 8 AS start_sector, (['NTFS', 'exFAT', 'FAT16'])[c_custkey % 4] AS type FROM customer WHERE c_custkey % 4 <> 0")
def boot_sector_search(spark, sf_dir):
    k = F.col("c_custkey")
    boots = [raw(bytes(3) + b"NTFS    " + bytes(499) + b"\x55\xaa"), raw(bytes(3) + b"EXFAT   " + bytes(501)), raw(bytes(54) + b"FAT16   " + bytes(448) + b"\x55\xaa"), raw(bytes(512))]
    data = padded(F.element_at(F.array(boots[3], *boots[:3]), (k % 4 + 1).cast("int")), 4096)
    chunks = read(spark, sf_dir, "customer").select(F.lit("all").alias("volume_id"), k.alias("chunk_no"), (k * 4096).alias("byte_offset"), data.alias("data"))
    return partitions.scan_boot_sectors(chunks, step=8)


@query("SELECT c_custkey AS id, c_custkey % 2 = 0 AS found, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 512 END AS metadata_offset FROM customer")
def bitlocker_headers(spark, sf_dir):
    k = F.col("c_custkey")
    boot = F.concat(raw(bytes(3)), F.when(k % 2 == 0, raw(b"-FVE-FS-")).otherwise(raw(b"NTFS    ")), raw(bytes(165)), le(k * 512, 8), raw(bytes(328)))
    rows = read(spark, sf_dir, "customer").select(k.alias("id"), partitions.bitlocker(boot).alias("x"))
    return rows.select("id", "x.found", F.col("x.metadata_offset").cast("long").alias("metadata_offset"))


@query("SELECT event_id AS usn, user_id AS file_reference, CAST(5 AS BIGINT) AS parent_reference, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, CASE event_type WHEN 'error' THEN 2 ELSE 1 END AS reason, 'é' || event_type || event_id AS name, CASE event_type WHEN 'error' THEN 'delete' ELSE 'create' END AS kind FROM events")
def journal_records(spark, sf_dir):
    name = F.concat(F.lit("é"), "event_type", F.col("event_id").cast("string"))
    length = F.octet_length(utf16(name))
    size = F.ceil((60 + length) / 8) * 8
    reason = F.when(F.col("event_type") == "error", 2).otherwise(1)
    filetime = F.unix_timestamp("ts") * times.STEPS + times.EPOCH_1601
    record = F.concat(le(size, 4), le(F.lit(2), 2), le(F.lit(0), 2), le(F.col("user_id"), 8), le(F.lit(5), 8), le(F.col("event_id"), 8), le(filetime, 8), le(reason, 4), raw(bytes(8)), le(F.lit(32), 4), le(length, 2), le(F.lit(60), 2), utf16(name))
    rows = read(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("g"), "event_id", padded(record, size).alias("r"))
    # torn bytes between records are passed over
    pieces = rows.withColumn("r", F.when(F.col("event_id") % 7 == 0, F.concat(raw(b"\xff" * 16), "r")).otherwise(F.col("r"))).groupBy("g").agg(F.expr("listagg(r) WITHIN GROUP (ORDER BY event_id)").alias("data"))
    found = ntfs.journal(pieces.select(F.col("g").cast("string").alias("volume_id"), "data"))
    return found.select("usn", "file_reference", "parent_reference", "timestamp", F.col("reason").cast("int").alias("reason"), "name", classify.usn_event_type("reason").alias("kind"))


@query("SELECT event_id AS usn, event_type || event_id AS name FROM events")
def journal_across_edges(spark, sf_dir):
    # one stream in chunks of 1000 bytes, which no record fits to
    name = F.concat("event_type", F.col("event_id").cast("string"))
    length = F.octet_length(utf16(name))
    record = F.concat(le(F.ceil((60 + length) / 8) * 8, 4), le(F.lit(2), 2), le(F.lit(0), 2), raw(bytes(16)), le(F.col("event_id"), 8), raw(bytes(24)), le(length, 2), le(F.lit(60), 2), utf16(name))
    rows = read(spark, sf_dir, "events").select((F.col("event_id") % 20).cast("string").alias("volume_id"), "event_id", padded(record, F.ceil((60 + length) / 8) * 8).alias("r"))
    whole = rows.groupBy("volume_id").agg(F.expr("listagg(r) WITHIN GROUP (ORDER BY event_id)").alias("b"))
    chunks = whole.select("volume_id", "b", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / 1000).cast("int"))).alias("chunk_no")).select("volume_id", "chunk_no", F.expr("substring(b, chunk_no * 1000 + 1, 1000)").alias("data"))
    return ntfs.journal(ntfs.journal_pieces(chunks)).select("usn", "name")


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'n' || c_custkey || '.txt' ELSE 'loose' || c_custkey || '.doc' END AS name, CASE WHEN c_custkey % 3 = 1 THEN c_custkey END AS mft_ref, CAST(CASE c_custkey % 3 WHEN 0 THEN 20 WHEN 1 THEN 58 ELSE 35 END AS INTEGER) AS confidence, CASE c_custkey % 3 WHEN 0 THEN 'ntfs_logfile_restart' ELSE 'ntfs_logfile' END AS source FROM customer")
def log_page_rows(spark, sf_dir):
    k = F.col("c_custkey")
    t = k.cast("string")
    name = F.concat(F.lit("N"), t, F.lit(".txt"))
    inside = F.concat(raw(b"RCRD" + bytes(60)), le(k, 8), raw(bytes(56)), le(F.length(name), 1), raw(b"\x01"), utf16(name))
    loose = F.concat(raw(b"RCRD" + bytes(200)), utf16(F.concat(F.lit("Loose"), t, F.lit(".doc"))))
    page = F.when(k % 3 == 0, raw(b"RSTR")).when(k % 3 == 1, inside).otherwise(loose)
    found = ntfs.log_rows(read(spark, sf_dir, "customer").select(t.alias("volume_id"), padded(page, ntfs.LOG_PAGE).alias("data")))
    return found.select(F.col("volume_id").cast("long").alias("id"), F.col("name_lower").alias("name"), "mft_ref", "confidence", "source")


@query("SELECT page_id AS id, CASE WHEN page_id % 3 = 2 THEN 'note' ELSE 'image' END AS kind, CAST(CASE page_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 18 + 2 * (page_id % 30) ELSE 0 END AS BIGINT) AS size FROM pages")
def video_previews(spark, sf_dir):
    # a cover in the metadata, a picture in the data, or neither
    i = F.col("page_id")
    atom = lambda kind, body: F.concat(F.unhex(F.lpad(F.hex((8 + F.octet_length(body)).cast("long")), 8, "0")), raw(kind), body)
    head = atom(b"ftyp", raw(b"isom"))
    cover = atom(b"moov", atom(b"udta", atom(b"ilst", atom(b"covr", atom(b"data", raw(bytes(8) + b"\xff\xd8\xffpict"))))))
    picture = F.concat(raw(b"\xff\xd8\xff\xe0\x00\x04JF\xff\xda\x00\x04ab"), F.unhex(F.repeat(F.lit("4142"), (i % 30).cast("int"))), raw(b"dd\xff\xd9"))
    body = F.when(i % 3 == 0, F.concat(cover, atom(b"mdat", F.encode("url", "UTF-8")))).when(i % 3 == 1, atom(b"mdat", F.concat(F.encode("url", "UTF-8"), picture))).otherwise(atom(b"mdat", F.encode("url", "UTF-8")))
    each = lambda i, data: [(i, kind, len(p or b"")) for kind, p, _ in [binary.video_preview(data)]]
    return apply(read(spark, sf_dir, "pages").select(i.alias("id"), F.concat(head, body).alias("data")), each, "id long, kind string, size long")


@query(f"""WITH {FILES_SQL}, s AS (SELECT DISTINCT o_orderkey % 7 AS id, o_orderkey % 7 * 10 AS from_sector FROM orders WHERE o_orderkey % 7 % 2 = 1) SELECT s.id AS scan_id, from_sector, f.id, f.start_sector FROM s LEFT JOIN files f ON f.scan_id = s.id""")
def resumed_scans(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    scans = read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 2 == 1, 4).otherwise(1).alias("status"), F.lit("deep").alias("scan_type"), (k * 10).alias("carve_resume_sector"), F.lit(0).cast("long").alias("scanned_sectors")).distinct()
    return lifecycle.resumed(scans, files(spark, sf_dir)).select("scan_id", "from_sector", "id", "start_sector")


@query("SELECT count(*) FILTER (WHERE source = 'src1' AND contains(lower(lang), 'fr')) > 0 AS truncated FROM documents")
def truncation_mark(spark, sf_dir):
    return listing.truncated(read(spark, sf_dir, "documents").select("source", F.upper("lang").alias("name")), "src1", "fr")


def resident(kind: int, body: Column, size: Column) -> Column:
    """A resident attribute without a name."""
    full = 24 + F.ceil(size / 8) * 8
    return padded(F.concat(le(F.lit(kind), 4), le(full, 4), raw(bytes(8)), le(size, 4), le(F.lit(24), 2), raw(bytes(2)), body), full)


def mft_records(spark, sf_dir) -> DataFrame:
    """A record of 1024 bytes for each customer; odd ones are deleted, every third has runs instead of a body."""
    k = F.col("c_custkey")
    stamp = le(times.EPOCH_1601 + (1_500_000_000 + k) * times.STEPS, 8)
    name = F.concat(F.lit("c"), k.cast("string"), F.lit(".jpg"))
    body = F.encode(F.concat("c_mktsegment", k.cast("string")), "UTF-8")
    file_name = F.concat(le(F.lit(5 | 1 << 48), 8), stamp, stamp, stamp, stamp, raw(bytes(24)), le(F.length(name), 1), raw(b"\x01"), utf16(name))
    runs = F.concat(raw(b"\x12"), le(k % 200 + 1, 2), raw(b"\x07\x00"))
    far = padded(F.concat(le(F.lit(0x80), 4), le(F.lit(72), 4), raw(b"\x01\x00\x40\x00" + bytes(4)), raw(bytes(16)), le(F.lit(64), 2), raw(bytes(6)), le(F.lit(1 << 20), 8), le(k + 5000, 8), le(k + 5000, 8), runs), 72)
    data = F.when(k % 3 == 0, far).otherwise(resident(0x80, body, F.octet_length(body)))
    attributes = F.concat(resident(0x10, F.concat(stamp, stamp, stamp, stamp, raw(bytes(16))), F.lit(48)), resident(0x30, file_name, F.lit(66) + 2 * F.length(name)), data, raw(b"\xff\xff\xff\xff"))
    head = F.concat(raw(b"FILE"), le(F.lit(48), 2), le(F.lit(3), 2), raw(bytes(8)), raw(b"\x01\x00\x01\x00"), le(F.lit(56), 2), le((k + 1) % 2, 2), raw(bytes(4)), le(F.lit(1024), 4), raw(bytes(12)), le(k, 4), raw(b"\x07\x00"), raw(bytes(6)))
    whole = padded(F.concat(head, attributes), 1024)
    # the last two bytes of both sectors go to the head, and the mark takes their place
    cut = lambda at, n: F.substring("w", at + 1, n)
    rows = read(spark, sf_dir, "customer").select(k.alias("number"), whole.alias("w"))
    fixed = F.concat(cut(0, 50), cut(510, 2), cut(1022, 2), cut(54, 456), raw(b"\x07\x00"), cut(512, 510), F.when(F.col("number") % 11 == 0, raw(b"\x08\x00")).otherwise(raw(b"\x07\x00")))
    return rows.select(F.lit("v").alias("volume_id"), "number", fixed.alias("data"))


@query("""SELECT c_custkey AS mft_record, 'c' || c_custkey || '.jpg' AS name, CAST(5 AS BIGINT) AS parent_id, CAST((c_custkey + 1) % 2 AS INTEGER) AS status, 'Image' AS category, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 5000 ELSE strlen(c_mktsegment || c_custkey) END AS size_bytes,
CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || c_custkey END AS body, CASE WHEN c_custkey % 3 = 0 THEN 7 * 8 END AS start_sector, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 200 + 1) * 8 END AS sectors, 1500000000 + c_custkey AS created_at,
CAST(CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 11 = 0 THEN 75 ELSE 100 END ELSE 45 + CASE WHEN c_custkey % 3 = 0 THEN 35 ELSE 25 END - CASE WHEN c_custkey % 11 = 0 THEN 20 ELSE 0 END END AS INTEGER) AS confidence FROM customer""")
def mft_file_rows(spark, sf_dir):
    rows = ntfs.file_rows(mft_records(spark, sf_dir), cluster=4096)
    return rows.select("mft_record", "name", "parent_id", "status", "category", "size_bytes", F.col("resident").cast("string").alias("body"), "start_sector", F.try_element_at("runs", F.lit(1))["sector_count"].alias("sectors"), "created_at", "confidence")


@query("SELECT c_custkey AS number, c_custkey AS found FROM customer")
def orphan_mft_records(spark, sf_dir):
    records = mft_records(spark, sf_dir)
    chunks = records.select(F.col("number").cast("string").alias("volume_id"), F.lit(0).cast("long").alias("chunk_no"), F.lit(0).cast("long").alias("byte_offset"), F.concat(raw(bytes(1536)), "data", raw(bytes(512))).alias("data"))
    return ntfs.orphan_records(chunks).select(F.col("volume_id").cast("long").alias("number"), F.col("number").alias("found"))


@query(r"""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '$R' || c_custkey || '.txt' ELSE c_name || '.txt' END AS name, CASE WHEN c_custkey % 4 = 0 THEN '/r' ELSE 'C:\Docs\' || c_name || '.txt' END AS path,
CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE c_custkey + 10 END AS size_bytes, CASE WHEN c_custkey % 4 = 0 THEN 'ntfs_mft' ELSE 'ntfs_recycle' END AS source, CASE WHEN c_custkey % 4 = 0 THEN 70 ELSE 85 END AS confidence, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1500000000 + c_custkey END AS created_at FROM customer""")
def recycle_pairs(spark, sf_dir):
    k = F.col("c_custkey")
    path = F.concat(F.lit("C:\\Docs\\"), "c_name", F.lit(".txt"))
    info = F.concat(le(F.lit(2), 8), le(k + 10, 8), le(times.EPOCH_1601 + (1_500_000_000 + k) * times.STEPS, 8), le(F.length(path) + 1, 4), utf16(path), raw(b"\0\0"))
    info = F.when(k % 4 == 0, F.substring(info, 1, 20)).otherwise(info)  # every fourth is cut
    row = lambda letter, seq, data: F.struct((k * 2 + seq).alias("seq"), F.concat(F.lit(f"${letter}"), k.cast("string"), F.lit(".txt")).alias("name"), F.lit("/r").alias("path"), F.lit(1).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("created_at"), F.lit(0).alias("status"), F.lit("ntfs_mft").alias("source"), F.lit(70).alias("confidence"), data.alias("resident"), k.alias("key"))
    rows = read(spark, sf_dir, "customer").select(F.explode(F.array(row("I", 0, info), row("R", 1, F.lit(None).cast("binary")))).alias("x")).select("x.*")
    found = enrich.pair_recycle_bin(ntfs.with_recycle_info(rows)).where("seq % 2 = 1")
    return found.select(F.col("key").alias("id"), "name", "path", "size_bytes", "source", "confidence", "created_at")


@query("SELECT doc_id AS id, 'F' || doc_id || '.TXT' AS name, doc_id % 5 = 0 AS deleted, n_chars AS size_bytes, doc_id + 2 AS first_cluster, 946684800 + 86400 * (doc_id % 28) AS modified_at FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, '_' || doc_id || '.TXT', true, n_chars, doc_id + 2, 946684800 + 86400 * (doc_id % 28) FROM documents WHERE doc_id % 5 = 0")
def fat_directory(spark, sf_dir):
    i = F.col("doc_id")
    short = F.concat(F.rpad(F.concat(F.lit("F"), i.cast("string")), 8, " "), F.lit("TXT")).cast("binary")
    short = F.when(i % 5 == 0, F.concat(raw(b"\xe5"), F.substring(short, 2, 10))).otherwise(short)
    date = F.lit(20 << 9 | 1 << 5) + i % 28 + 1
    entry = F.concat(short, raw(b"\x20" + bytes(8)), le(F.floor((i + 2) / 65536), 2), le(F.lit(0), 2), le(date, 2), le((i + 2) % 65536, 2), le(F.col("n_chars"), 4))
    label = raw(b"VOLUME     \x08" + bytes(20))
    each = lambda i, data: [(i, e["name"], e["deleted"], e["size_bytes"], e["first_cluster"], e["modified_at"]) for e in fat.directory(data)]
    return apply(read(spark, sf_dir, "documents").select(i.alias("id"), F.concat(label, entry).alias("data")), each, "id long, name string, deleted boolean, size_bytes long, first_cluster long, modified_at long")


@query("SELECT doc_id AS id, 'é long name ' || doc_id || '.dat' AS name, doc_id % 3 = 0 AS deleted, n_chars AS size_bytes, doc_id + 2 AS first_cluster, doc_id % 2 = 0 AS contiguous FROM documents")
def exfat_directory(spark, sf_dir):
    i = F.col("doc_id")
    name = F.concat(F.lit("é long name "), i.cast("string"), F.lit(".dat"))
    mark = lambda b: F.when(i % 3 == 0, raw(bytes([b & 0x7F]))).otherwise(raw(bytes([b])))
    entry = F.concat(mark(0x85), raw(b"\x03\0\0\x20" + bytes(27)))
    stream = F.concat(mark(0xC0), F.when(i % 2 == 0, raw(b"\x03")).otherwise(raw(b"\x01")), raw(b"\0"), le(F.length(name), 1), raw(bytes(16)), le(i + 2, 4), le(F.col("n_chars"), 8))
    units = padded(utf16(name), 60)
    data = F.concat(raw(b"\x83" + bytes(31)), entry, stream, mark(0xC1), raw(b"\0"), F.substring(units, 1, 30), mark(0xC1), raw(b"\0"), F.substring(units, 31, 30))
    each = lambda i, data: [(i, e["name"], e["deleted"], e["size_bytes"], e["first_cluster"], e["contiguous"]) for e in fat.exfat_directory(data)]
    return apply(read(spark, sf_dir, "documents").select(i.alias("id"), data.alias("data")), each, "id long, name string, deleted boolean, size_bytes long, first_cluster long, contiguous boolean")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN [2, 3, o_orderkey % 40 + 10] WHEN 1 THEN [2, 3] ELSE [2] END AS clusters FROM orders")
def cluster_chains(spark, sf_dir):
    # FAT16 tables: 2 -> 3 -> k -> end; 2 -> 3 -> 2, a circle; 2 -> a bad cluster
    k = F.col("o_orderkey")
    third = k % 40 + 10
    entry = lambda n: F.when((k % 3 == 0) & (F.lit(n) == third), 0xFFFF).when(F.lit(n) == 2, F.when(k % 3 == 2, 0xFFF7).otherwise(3)).when(F.lit(n) == 3, F.when(k % 3 == 0, third).otherwise(2)).otherwise(0)
    table = F.concat(*[le(entry(n), 2) for n in range(52)])
    pieces = read(spark, sf_dir, "orders").select(k.cast("string").alias("volume_id"), F.lit(16).alias("bits"), F.lit(51).cast("long").alias("last"), F.lit(0).cast("long").alias("first"), table.alias("data"))
    pieces = volumes.cut(pieces)
    places, ends = fat.ranked(fat.stretches_of(pieces))
    heads = pieces.select("volume_id", F.lit(2).cast("long").alias("first"), F.lit(None).cast("long").alias("want"), F.lit(1).cast("long").alias("guess"))
    found = fat.chain_extents(heads, ["volume_id"], places, ends).groupBy("volume_id").agg(F.array_sort(F.collect_list(F.struct("logical", "cluster", "n"))).alias("x"))
    return found.select(F.col("volume_id").cast("long").alias("id"), F.flatten(F.transform("x", lambda e: F.sequence(e["cluster"], e["cluster"] + e["n"] - 1))).alias("clusters"))


@query("""WITH u AS (SELECT DISTINCT o_custkey % 50 AS b, o_orderkey // 64 AS blk FROM orders), free AS (SELECT b, blk * 64 + i AS unit FROM (SELECT b, blk, unnest(range(64)) AS i FROM u) x WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey % 50 = x.b AND o.o_orderkey = x.blk * 64 + x.i)),
g AS (SELECT b, unit, unit - row_number() OVER (PARTITION BY b ORDER BY unit) AS k FROM free) SELECT b, min(unit) * 8 AS start, (max(unit) + 1) * 8 AS "end" FROM g GROUP BY b, k""")
def bitmap_free_runs(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("b"), F.floor(k / 64).alias("blk")).agg(F.bit_or(F.expr("shiftleft(1L, cast(o_orderkey % 64 AS int))")).alias("bits"))
    return intervals.free_runs_from_bitmap(rows.select("b", (F.col("blk") * 64).alias("first_unit"), le(F.col("bits"), 8).alias("data")), ["b"], 8)


@query("""WITH h AS (SELECT o_custkey AS child, o_orderkey % 90 AS parent, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'known' ELSE 'n' || o_orderkey % 7 END AS name FROM orders), k AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 2 = 0 THEN 'known' ELSE 'other' END AS name FROM customer WHERE c_custkey % 3 <> 0)
SELECT DISTINCT child, h.name, 'ntfs_i30' AS source, 35 AS confidence FROM h LEFT JOIN k ON child = node WHERE h.name <> '' AND child <> 0 AND (k.name IS NULL OR k.name <> h.name)""")
def slack_names(spark, sf_dir):
    k = F.col("o_orderkey")
    hints = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("child"), (k % 90).alias("parent"), F.when(k % 4 == 0, "").when(k % 4 == 1, "known").otherwise(F.concat(F.lit("n"), (k % 7).cast("string"))).alias("name"))
    index = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 2 == 0, "known").otherwise("other").alias("name"))
    return enrich.slack_names(hints, index).select("child", "name", "source", "confidence")


@query("SELECT o_orderstatus AS volume_id, o_custkey AS node, arg_max(o_orderkey % 90, (o_orderkey % 10, -o_orderkey)) AS parent, arg_max('n' || o_orderkey, (o_orderkey % 10, -o_orderkey)) AS name FROM orders GROUP BY o_orderstatus, o_custkey")
def directory_index(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("volume_id"), F.col("o_custkey").alias("node"), (k % 90).alias("parent"), F.concat(F.lit("n"), k.cast("string")).alias("name"), (k % 10).alias("confidence"), k.alias("seq"))
    return graph.directory_index(rows, ["volume_id"])


@query("SELECT doc_id AS id, md5(text) AS md5, true AS success, strlen(text) AS bytes_recovered FROM documents WHERE text <> ''")
def recover_compressed(spark, sf_dir):
    # texts as chunks of up to 4096 bytes that the compression stores as they are
    body = F.encode("text", "UTF-8")
    # Spark may take the chunks apart before it looks whether the text is empty, and 0 to -1 by 4096 is an error
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("b") - 1, F.lit(0)), F.lit(4096))
    part = lambda at: F.substring(F.col("b"), at + 1, F.lit(4096))
    packed = F.transform(starts, lambda at: F.hex(F.concat(le(F.lit(0x3000) + F.octet_length(part(at)) - 1, 2), part(at))))
    rows = read(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("id"), body.alias("b")).select("id", F.octet_length("b").cast("long").alias("size_bytes"), F.unhex(F.array_join(packed, "")).alias("resident"))
    rows = rows.withColumns({"volume_id": F.lit("v"), "name": F.lit("x.bin"), "status": F.lit(1), "source": F.lit("ntfs_mft"), "compressed": F.lit(True), "start_sector": F.lit(0).cast("long"), "runs": F.array().cast("array<struct<start_sector:bigint,sector_count:bigint,is_sparse:boolean>>")})
    return recover.recover(rows, None).select("id", "md5", "success", "bytes_recovered")


@query("SELECT n_nationkey AS id, md5(rpad(n_name, 512, '.')) AS md5 FROM nation")
def decrypted_volume(spark, sf_dir):
    key = bytes(range(32))
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.rpad("n_name", 512, ".").cast("binary").alias("data"))
    each = lambda i, data: [("v", i, i * 512, crypto.xts_encrypt(key, data, i))]
    locked = apply(rows, each, "volume_id string, chunk_no long, byte_offset long, data binary")
    return volumes.decrypted(locked, key).select(F.col("chunk_no").alias("id"), F.md5("data").alias("md5"))


@query("SELECT page_id AS id, CAST(strlen(url) AS BIGINT) AS offset, CAST(18 + 2 * (page_id % 30) AS BIGINT) AS length FROM pages")
def embedded_pictures(spark, sf_dir):
    i = F.col("page_id")
    n = (i % 30).cast("int")
    picture = F.concat(raw(b"\xff\xd8\xff\xe0\x00\x04JF\xff\xda\x00\x04ab"), F.unhex(F.repeat(F.lit("4142"), n)), raw(b"dd\xff\xd9"))
    each = lambda i, data: [(i, at, size) for at, size in binary.embedded_jpegs(data)]
    return apply(read(spark, sf_dir, "pages").select(i.alias("id"), F.concat(F.encode("url", "UTF-8"), picture, F.encode("url", "UTF-8")).alias("data")), each, "id long, offset long, length long")


def png_of(body: Column, wrong: Column | None = None) -> Column:
    """A picture file with a body; its checksum is off by one where wrong."""
    def part(kind: bytes, data: Column, off: Column | None = None) -> Column:
        named = F.concat(raw(kind), data)
        crc = F.crc32(named) + (F.lit(0) if off is None else F.when(off, 1).otherwise(0))
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 8, "0")), named, F.unhex(F.substring(F.lpad(F.hex(crc), 16, "0"), 9, 8)))

    return F.concat(raw(b"\x89PNG\r\n\x1a\n"), part(b"IHDR", raw(bytes(13))), part(b"IDAT", body, wrong), part(b"IEND", raw(b"")))


@query("""SELECT page_id AS id, (['png', 'png', 'png', 'pdf', 'pdf', 'gz', 'zip', 'jpg', 'jpg', 'bmp', 'exe'])[page_id % 11 + 1] AS kind, CAST(([98, 40, 60, 90, 55, 85, 95, 95, 75, 90, NULL])[page_id % 11 + 1] AS INTEGER) AS score FROM pages""")
def structure_scores(spark, sf_dir):
    from ..functions import validators

    i, html = F.col("page_id"), F.encode("html", "UTF-8")
    good = png_of(html)
    jpeg = F.concat(raw(b"\xff\xd8\xff\xe0\x00\x04JF\xff\xda\x00\x04ab"), html)
    # a picture's extent is 1 to EXTENT_TO, whatever the page_id
    width = F.pmod(i, F.lit(validators.EXTENT_TO)) + 1
    bmp = F.concat(raw(b"BM"), le(F.octet_length(html) + 54, 4), raw(bytes(4)), le(F.lit(54), 4), le(F.lit(40), 4), le(width, 4), le(F.lit(9), 4), raw(bytes(28)), html)
    pdf = F.concat(raw(b"%PDF-1.7\n1 0 obj\n"), html, raw(b"\nendobj\n"))
    kinds = ("png", "png", "png", "pdf", "pdf", "gz", "zip", "jpg", "jpg", "bmp", "exe")
    bodies = F.array(good, png_of(html, F.lit(True)), F.expr("substring(b, 1, octet_length(b) - 20)"), F.concat(pdf, raw(b"%%EOF\n")), pdf, F.concat(raw(b"\x1f\x8b\x08\x08" + bytes(6)), F.encode("url", "UTF-8"), raw(b"\0"), html), F.concat(raw(b"PK\x03\x04"), html, raw(b"PK\x01\x02PK\x05\x06" + bytes(18))), F.concat(jpeg, raw(b"\xff\xd9")), jpeg, bmp, F.concat(raw(b"MZ"), html))
    rows = read(spark, sf_dir, "pages").withColumn("b", good).select(i.alias("id"), F.element_at(bodies, (i % 11 + 1).cast("int")).alias("data"))
    each = lambda i, data: [(i, kinds[i % 11], validators.score(kinds[i % 11], data))]
    return apply(rows, each, "id long, kind string, score int")


@query("SELECT page_id AS id, CAST(CASE page_id % 3 WHEN 0 THEN 98 WHEN 1 THEN 40 ELSE -1 END AS INTEGER) AS score, page_id % 3 <> 1 AS success, CASE WHEN page_id % 3 = 1 THEN 'structure check failed' ELSE '' END AS error, strlen(html) + 57 AS bytes_recovered FROM pages")
def recover_checked(spark, sf_dir):
    i = F.col("page_id")
    rows = read(spark, sf_dir, "pages").select(i.alias("id"), F.lit("v").alias("volume_id"), F.when(i % 3 == 2, "a.dat").otherwise("a.png").alias("name"), png_of(F.encode("html", "UTF-8"), i % 3 == 1).alias("resident"))
    rows = rows.withColumns({"size_bytes": F.octet_length("resident").cast("long"), "status": F.lit(1), "source": F.lit("ntfs_mft"), "start_sector": F.lit(0).cast("long"), "runs": F.array().cast("array<struct<start_sector:bigint,sector_count:bigint,is_sparse:boolean>>")})
    return recover.recover(rows, None).select("id", "score", "success", "error", "bytes_recovered")


@query("SELECT page_id AS volume, CAST(1536 AS BIGINT) AS id, 'carved_1536.png' AS name, strlen(html) + 57 AS size_bytes, CAST(3 AS BIGINT) AS start_sector, CAST(98 AS INTEGER) AS confidence, 'carver' AS source, 'Image' AS category FROM pages")
def scored_carves(spark, sf_dir):
    picture = png_of(F.encode("html", "UTF-8"))
    disk = F.concat(raw(bytes(1536)), picture, raw(bytes(700)))
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("volume_id"), disk.alias("b"))
    chunks = rows.select("volume_id", "b", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / 2048).cast("int"))).alias("k"))
    chunks = chunks.select("volume_id", F.col("k").cast("long").alias("chunk_no"), (F.col("k") * 2048).cast("long").alias("byte_offset"), F.expr("substring(b, k * 2048 + 1, 2048)").alias("data"))
    known = carve.SIGNATURES[1:2]
    found = carve.scored(carve.carves(carve.hits(chunks, known), volumes.sector_count(chunks), known), chunks, known, chunk=2048, checked_to=known[0].max_size, checked_from=-1)
    return found.select(F.col("volume_id").cast("long").alias("volume"), "id", "name", "size_bytes", "start_sector", "confidence", "source", "category")


@query("SELECT doc_id AS id, x.n AS name, x.i AS inode, CAST(x.t AS INTEGER) AS file_type FROM (SELECT doc_id, unnest([{'n': 'live' || doc_id, 'i': doc_id + 12, 't': 1}, {'n': 'gone.txt', 'i': 0, 't': 1}]) AS x FROM documents)")
def ext_directory(spark, sf_dir):
    from ..sources import ext

    i = F.col("doc_id")
    live = F.concat(F.lit("live"), i.cast("string"))
    entry = padded(F.concat(le(i + 12, 4), le(F.lit(1024), 2), le(F.length(live), 1), raw(b"\x01"), F.encode(live, "UTF-8")), F.ceil((8 + F.length(live)) / 4) * 4)
    gone = F.concat(le(F.lit(15), 4), le(F.lit(16), 2), raw(b"\x08\x01gone.txt"))
    each = lambda i, data: [(i, name, inode, kind) for inode, kind, name in ext.directory_entries(data)]
    return apply(read(spark, sf_dir, "documents").select(i.alias("id"), padded(F.concat(entry, gone), 1024).alias("data")), each, "id long, name string, inode long, file_type int")


# Rules over rows.


@query("SELECT l_suppkey % 7 AS volume_id, count(*) AS bad FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'F' GROUP BY ALL")
def bad_sector_counts(spark, sf_dir):
    reads = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("volume_id"), F.col("l_orderkey").alias("byte_offset"), (F.col("l_returnflag") != "R").alias("success"), (F.col("l_linestatus") == "F").alias("padded_zeros"))
    return volumes.bad_sectors(reads)[0]


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 3 WHEN o_orderkey % 3 = 2 AND o_custkey > 0 AND o_custkey < 700 THEN 4 ELSE o_orderkey % 3 END AS INTEGER) AS status FROM orders")
def end_status(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("id"), lifecycle.end_status((k % 3).cast("int"), k % 9 == 0, F.col("o_custkey"), F.lit(700)).alias("status"))


@query("""WITH r AS (SELECT o_custkey % 40 AS v, o_orderkey * 100 AS s, o_orderkey * 100 + o_custkey % 90 + 1 AS e FROM orders), c AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY v ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r)
SELECT v, CAST(s + greatest(0, 5000 - b) AS BIGINT) AS start, e AS "end" FROM c WHERE greatest(0, 5000 - b) < e - s""")
def resume_ranges(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("v"), (k * 100).alias("start"), (k * 100 + F.col("o_custkey") % 90 + 1).alias("end"))
    return lifecycle.resume_ranges(rows, 5000, ["v"])


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 4 AND o_orderkey % 2 = 1")
def resumable_scans(spark, sf_dir):
    k = F.col("o_orderkey")
    return lifecycle.resumable(read(spark, sf_dir, "orders").select(k.alias("id"), (k % 5).cast("int").alias("status"), F.when(k % 2 == 0, "quick").otherwise("deep").alias("scan_type"))).select("id")


@query("SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0) AS recovered_files FROM customer")
def recovered_counts(spark, sf_dir):
    scans = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("recovered_files"))
    return lifecycle.recovered_counts(scans, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scan_id"), (F.col("o_orderkey") % 2 == 0).alias("success")))


@query("SELECT doc_id AS file_id, 0::BIGINT AS chunk_no, md5(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new ' || text ELSE text END) AS md5 FROM documents")
def replaced_chunks(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.lit(0).cast("long").alias("chunk_no"), F.col("text").alias("body"))
    new = old.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id")).distinct(), "file_id", "left_semi").withColumn("body", F.concat(F.lit("new "), "body"))
    return search.replace_chunks(old, new).select("file_id", "chunk_no", F.md5(F.encode("body", "UTF-8")).alias("md5"))


@query("SELECT user_id, CAST(count(DISTINCT s) AS BIGINT) AS length FROM (SELECT user_id, unnest(range(event_id * 3, event_id * 3 + CAST(floor(value) AS BIGINT) % 50 + 1)) AS s FROM events) GROUP BY user_id")
def covered_length(spark, sf_dir):
    start = F.col("event_id") * 3
    rows = read(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + F.floor("value") % 50 + 1).alias("end"))
    return intervals.total_length(rows, ["user_id"])


@query("SELECT count(*) FILTER (WHERE doc_id * 7 % 101 >= 60) AS good, count(*) FILTER (WHERE doc_id * 7 % 101 < 60) AS bad FROM documents")
def quality_tally(spark, sf_dir):
    return aggregates.quality_tally(files(spark, sf_dir).select(F.col("confidence").alias("score")))


@query("SELECT (SELECT count(*) FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) >= (SELECT count(*) FROM documents) AS complete")
def content_index_complete(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return search.content_index_complete(rows, read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_id"))


_FOUND = "SELECT doc_id AS id FROM documents WHERE len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: starts_with(t, 'ment'))) > 0"


@query(f"{_FOUND} ORDER BY id LIMIT 25 OFFSET 10")
def content_search_page(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    chunks = search.content_chunks(rows.select(F.col("doc_id").alias("file_id"), F.col("text").alias("body")))
    return search.search_content_page(rows.select(F.col("doc_id").alias("id")), chunks, "MENT", 10, 25)


@query(f"SELECT count(*) AS n FROM ({_FOUND})")
def content_search_count(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    chunks = search.content_chunks(rows.select(F.col("doc_id").alias("file_id"), F.col("text").alias("body")))
    return search.search_content_count(rows.select(F.col("doc_id").alias("id")), chunks, "MENT")


@query("SELECT doc_id AS id, 'raid_' || source AS source, true AS known FROM documents")
def raid_tagged(spark, sf_dir):
    return enrich.tag_raid(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")).select("id", "source", F.col("is_raid").alias("known"))


@query("SELECT s_suppkey AS id, NOT (chr(CAST(65 + s_suppkey % 26 AS INTEGER)) IN ('C', 'K')) AS allowed FROM supplier")
def destinations_allowed(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lower(F.chr(F.lit(65) + F.col("s_suppkey") % 26)).alias("drive"))
    return enrich.destination_allowed(rows, ["c", "K"]).select("id", "allowed")


@query("SELECT o_orderkey AS id, CASE WHEN m = '' THEN NULL ELSE lower(m) END AS md5 FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN md5(CAST(o_custkey AS VARCHAR)) WHEN 1 THEN upper(md5(CAST(o_custkey AS VARCHAR))) ELSE '' END AS m FROM orders)")
def normalised_hashes(spark, sf_dir):
    k, h = F.col("o_orderkey"), F.md5(F.col("o_custkey").cast("string").cast("binary"))
    shown = F.when(k % 3 == 0, F.concat(F.lit(" "), h)).when(k % 3 == 1, F.concat(F.upper(h), F.lit(" "))).otherwise(F.substring(h, 1, 31))
    return read(spark, sf_dir, "orders").select(k.alias("id"), text.md5_text(shown).alias("md5"))


# Text and time as they are shown.


@query("""SELECT doc_id AS id, CASE WHEN t <= 0 THEN CASE WHEN c THEN 'no file system time' ELSE '-' END ELSE CASE WHEN c THEN 'EXIF ' ELSE '' END || strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS shown,
CASE WHEN doc_id % 4 = 0 THEN '-' ELSE printf('%02d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) END AS clock FROM (SELECT doc_id, doc_id % 3 * (doc_id * 86399 + 5) AS t, doc_id % 2 = 0 AS c FROM documents)""")
def shown_times(spark, sf_dir):
    i = F.col("doc_id")
    t = i % 3 * (i * 86399 + 5)
    source = F.when(i % 2 == 0, "carver").otherwise("ntfs_mft")
    return read(spark, sf_dir, "documents").select(i.alias("id"), text.format_time(t, source).alias("shown"), text.eta_clock(F.when(i % 4 == 0, -1.0).otherwise(t + 0.7)).alias("clock"))


@query(r"""SELECT event_id AS id, regexp_replace(n, '[\x00-\x1f/\\:*?"<>|]', '_', 'g') AS strict, regexp_replace(n, '[\x00-\x1f\x7f]', '_', 'g') AS light, regexp_replace(regexp_extract(n, '([^/\\]*)$', 1), '[\x00-\x1f/\\:*?"<>|]', '_', 'g') AS base
FROM (SELECT event_id, event_type || ':' || props || '\' || chr(9) || event_id || '?*.txt' AS n FROM events)""")
def sanitised_names(spark, sf_dir):
    n = F.concat("event_type", F.lit(":"), "props", F.lit("\\\t"), F.col("event_id").cast("string"), F.lit("?*.txt"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.sanitize_name(n).alias("strict"), text.sanitize_name_light(n).alias("light"), text.safe_basename(n).alias("base"))


@query(r"""SELECT s_suppkey AS id, 'c:\data\' || s_suppkey AS path, 'C' AS drive, (['C:', 'C:', ''])[s_suppkey % 3 + 1] AS letter, s_suppkey % 2 = 0 AS same, CASE WHEN s_suppkey % 4 = 0 THEN '\\?\GLOBALROOT\Device\HarddiskVolumeShadowCopy' || s_suppkey ELSE '' END AS shadow FROM supplier""")
def windows_paths(spark, sf_dir):
    k = F.col("s_suppkey")
    t = k.cast("string")
    path = F.when(k % 2 == 0, F.concat(F.lit("C:/Data//"), t, F.lit("/"))).otherwise(F.concat(F.lit("c:\\DATA\\"), t))
    volume = F.element_at(F.array(F.lit("c"), F.lit("\\\\.\\C:"), F.lit("data")), (k % 3 + 1).cast("int"))
    serial = F.when(k % 2 == 0, F.concat(F.lit(" ab "), t)).otherwise(F.concat(F.lit("x"), t))
    tagged = F.when(k % 4 == 0, F.concat(F.lit("/VSS"), t, F.lit("/a.txt"))).otherwise("/a.txt")
    return read(spark, sf_dir, "supplier").select(k.alias("id"), text.windows_path(path).alias("path"), text.drive_letter(path).alias("drive"), text.volume_letter(volume).alias("letter"), text.serial_matches(serial, F.concat(F.lit("AB"), t)).alias("same"), text.vss_device(tagged).alias("shadow"))


@query("SELECT o_orderkey AS id, CASE WHEN n < 100 THEN printf('E%02d', n) ELSE chr(CAST(69 + (n - 100) // 676 AS INTEGER)) || chr(CAST(65 + (n - 100) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (n - 100) % 26 AS INTEGER)) END AS segment FROM (SELECT o_orderkey, o_orderkey % 5000 + 1 AS n FROM orders)")
def image_segments(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.ewf_segment(F.col("o_orderkey") % 5000 + 1).alias("segment"))


@query("SELECT doc_id AS id, lower(hex(encode(text))) AS hex, replace(text, 'é', '?') AS repaired FROM documents")
def hex_and_repaired(spark, sf_dir):
    body = F.encode("text", "UTF-8")
    broken = F.unhex(F.array_join(F.transform(F.split("text", "é"), lambda part: F.hex(F.encode(part, "UTF-8"))), "FF"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.hex_text(body).alias("hex"), text.repaired_utf8(broken).alias("repaired"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'Archive' WHEN e >= 7.6 THEN 'Encrypted' WHEN x IN ('jpg', 'png') THEN 'Image' WHEN x = 'mp3' THEN 'Audio' WHEN e <= 4.2 AND p >= 85 THEN 'Text' WHEN doc_id % 4 = 1 THEN 'Unknown' ELSE 'Other' END AS category
FROM (SELECT doc_id, doc_id % 80 / 10.0 AS e, 60 + doc_id % 40 AS p, (['jpg', 'dat', 'mp3', 'png', 'bin'])[doc_id % 5 + 1] AS x FROM documents)""")
def refined_categories(spark, sf_dir):
    i = F.col("doc_id")
    now = F.when(i % 4 == 0, "Archive").when(i % 4 == 1, "").otherwise("Other")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".jpg", "dat", "MP3", "png", "bin")]), (i % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(i.alias("id"), classify.refined_category(now, ext, i % 80 / 10.0, 60 + i % 40).alias("category"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'Bad' WHEN o_orderkey % 100 <= 10 OR o_custkey % 120 > 100 THEN 'Warning' ELSE 'Good' END AS nvme, o_orderkey * 512000 AS bytes, CAST(CASE WHEN o_custkey > 0 THEN least(100, o_orderkey * 100 // o_custkey) ELSE 0 END AS INTEGER) AS percent,
CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN '2/2' ELSE '1/2' END ELSE '1/1' END AS step, CAST(CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN least(o_orderkey % 101, 35) ELSE o_orderkey % 101 END AS INTEGER) AS capped FROM orders""")
def device_and_progress(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    nvme = classify.nvme_health(F.when(k % 6 == 0, 1).otherwise(0), k % 100, F.lit(10), c % 120)
    step = classify.phase_step(F.when(k % 3 == 0, "carve").otherwise("metadata"), F.when(k % 2 == 0, "deep").otherwise("quick"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), nvme.alias("nvme"), classify.nvme_bytes(k).alias("bytes"), classify.progress_percent(k, c).alias("percent"), step.alias("step"), classify.fat_deleted_cap((k % 101).cast("int"), k % 2 == 0, k % 3 == 0).alias("capped"))


_MAGIC = (("ffd8ffe0", "image", "image/jpeg"), ("89504e470d0a1a0a", "image", "image/png"), ("474946383961", "image", "image/gif"), ("255044462d312e34", "pdf", "application/pdf"), ("4d5a0001", "binary", ""), ("", "text", "text/plain"), ("00000018667479706d703432", "binary", ""))


@query(
    "WITH p AS (SELECT page_id, regexp_extract_all(substr(hex(encode(html)), 1, 1024), '..') AS b FROM pages), s AS (SELECT *, len(list_filter(b, lambda c: c IN ('09', '0A', '0D') OR c BETWEEN '20' AND '7E')) * 100 // len(b) >= 85 AS shown FROM p) "
    "SELECT page_id, CASE WHEN page_id % 7 = 5 AND NOT coalesce(shown, false) THEN 'binary' ELSE x[page_id % 7 + 1].k END AS kind, CASE WHEN page_id % 7 = 5 AND NOT coalesce(shown, false) THEN '' ELSE x[page_id % 7 + 1].m END AS mime FROM s, (SELECT ["
    + ", ".join(f"{{'k': '{k}', 'm': '{m}'}}" for _, k, m in _MAGIC) + "] AS x)"
)
def preview_kind(spark, sf_dir):
    heads = F.array(*[raw(bytes.fromhex(h)) for h, _, _ in _MAGIC])
    data = F.concat(F.element_at(heads, (F.col("page_id") % len(_MAGIC) + 1).cast("int")), F.encode("html", "UTF-8"))
    return read(spark, sf_dir, "pages").select("page_id", classify.preview_kind(F.lit("p"), data).alias("x")).select("page_id", "x.kind", "x.mime")


_MEDIA = (("00000018667479706d703432", "mp4"), ("524946460000000057415645", "wave"), ("1a45dfa3", "matroska"), ("4f676753", "ogg"), ("664c6143", "flac"), ("494433", "mp3"), ("", ""))


@query("SELECT page_id AS id, (['mp4', 'wave', 'matroska', 'ogg', 'flac', 'mp3', ''])[page_id % 7 + 1] AS media, CASE WHEN page_id % 2 = 0 THEN url ELSE '' END AS title FROM pages")
def media_hints(spark, sf_dir):
    head = F.element_at(F.array(*[raw(bytes.fromhex(h)) for h, _ in _MEDIA]), (F.col("page_id") % len(_MEDIA) + 1).cast("int"))
    pdf = F.encode(F.concat(F.lit("%PDF-1.4 1 0 obj <</"), F.when(F.col("page_id") % 2 == 0, "Title").otherwise("Author"), F.lit(" ("), "url", F.lit(")>>")), "UTF-8")
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), classify.media_container(F.concat(head, F.encode("html", "UTF-8"))).alias("media"), classify.pdf_info(pdf, "Title").alias("title"))


@query("""SELECT doc_id AS id, doc_id || ';' || c || ';"a;' || c || '";' || n_chars || ';' || doc_id % 3 || ';Other;' || source || ';' || 50 || ';' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE strftime(to_timestamp(doc_id * 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END || ';' AS line
FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN '''=' || lang ELSE lang END AS c FROM (SELECT doc_id, lang, n_chars, source FROM documents) x) y""".replace(""";"a;' || c || '";'""", """;"a;' || lang || '";'"""))
def csv_export(spark, sf_dir):
    i = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(i.alias("id"), F.when(i % 4 == 0, F.concat(F.lit("="), "lang")).otherwise(F.col("lang")).alias("name"), F.concat(F.lit("a;"), "lang").alias("path"), F.col("n_chars").alias("size_bytes"), (i % 3).alias("status"), F.lit("Other").alias("category"), "source", F.lit(50).alias("confidence"), F.when(i % 2 == 1, i * 1000).otherwise(0).alias("created_at"), F.lit(0).alias("modified_at"))
    return recover.csv_lines(rows)


@query("SELECT page_id AS id, page_id % 5 = 0 AS allowed FROM pages")
def guarded_addresses(spark, sf_dir):
    i = F.col("page_id")
    url = F.element_at(F.array(F.lit("https://fda.gov/"), F.lit("http://10.1.2.3/"), F.lit("http://localhost:80/"), F.lit("http://[fe80::1]/"), F.lit("http://printer.local/")), (i % 5 + 1).cast("int"))
    each = lambda i, data: [(i, evidence.url_allowed(data.decode()))]
    return apply(read(spark, sf_dir, "pages").select(i.alias("id"), F.concat(url, i.cast("string")).cast("binary").alias("data")), each, "id long, allowed boolean")


@query("SELECT kind, max(event_id) AS line_no FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type LIKE '%i%' THEN 'look' ELSE '' END AS kind FROM events) WHERE kind <> '' GROUP BY kind")
def log_kinds(spark, sf_dir):
    lines = read(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("event_type").alias("value"))
    return evidence.log_summary(lines, {"fail": "^error$", "look": "i"}).select("kind", "line_no")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, event_type || event_id AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
h AS (SELECT user_id, event_id, k, m, sha256(repeat('0', 64) || m) AS head FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, o.m, sha256(h.head || o.m) FROM o JOIN h ON o.user_id = h.user_id AND o.k = h.k + 1),
w AS (SELECT *, CASE WHEN event_id % 50 = 3 THEN sha256('forged') ELSE head END AS digest FROM h)
SELECT event_id, sha256(coalesce(lag(digest) OVER (PARTITION BY user_id ORDER BY k), repeat('0', 64)) || m) = digest AS valid FROM w""")
def chain_check(spark, sf_dir):
    # the log of each user, with forged lines in its midst: they and the lines after them don't fit
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", F.col("event_id").cast("string")).alias("m"))
    forged = F.when(F.col("event_id") % 50 == 3, F.sha2(F.lit("forged"), 256)).otherwise(F.col("digest"))
    written = aggregates.chained(rows, ["user_id"], "event_id", "m").withColumn("digest", forged)
    return aggregates.verify_chain(written, ["user_id"], "event_id", "m", "digest").select("event_id", "valid")


@query("SELECT c_custkey, c_name AS name FROM customer ORDER BY (CASE c_custkey % 4 WHEN 0 THEN 'ı' WHEN 1 THEN 'i' WHEN 2 THEN 'ç' ELSE 'd' END || c_name) COLLATE tr LIMIT 900")
def names_by_locale(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.concat(F.element_at(F.array(F.lit("ı"), F.lit("i"), F.lit("ç"), F.lit("d")), (k % 4 + 1).cast("int")), "c_name")
    return listing.page_by_name(read(spark, sf_dir, "customer").withColumn("shown", name), 0, 900, "shown", "tr").select("c_custkey", F.col("c_name").alias("name"))


# Streams, run until what there is has been read.


def _stream(spark, sf_dir, table: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files; a pattern may name either, a plain path only a folder."""
    schema = read(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}[.]parquet")


def _stream_folder(spark) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return f"{shared or 'file://' + tempfile.gettempdir() + '/lodestrata-streams'}/stream-{uuid.uuid4().hex}"


def _drained(spark, out: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream writes, once it has read all there is."""
    at = _stream_folder(spark)
    started = out.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


@query(ETA_SQL)
def eta_of_a_stream(spark, sf_dir):
    ticks = _stream(spark, sf_dir, "events").select("user_id", (F.unix_timestamp("ts") * 10).alias("time_ms"), F.col("event_id").alias("work"), F.lit(10**6).cast("long").alias("total"))
    # halves as the SQL rounds them, by the product of doubles and not by decimal digits
    places = lambda x, n: F.floor(F.col(x) * F.lit(10.0**n) + 0.5) / F.lit(10.0**n)
    return _drained(spark, streams.eta_stream(ticks, "user_id")).withColumns({"speed": places("speed", 6), "eta_seconds": places("eta_seconds", 3)})


@query("SELECT user_id % 2 + 1 AS scan_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, CASE event_type WHEN 'error' THEN 'delete' ELSE 'create' END AS event_type, event_type || event_id AS file_name FROM events WHERE event_id % 3 <> 0")
def routed_journal(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").select((F.col("user_id") % 2 + 1).alias("scan_id"), F.concat("event_type", F.col("event_id").cast("string")).alias("name"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status"), F.when(F.col("event_id") % 3 == 0, "fat").otherwise("usn_journal").alias("source"), F.unix_timestamp("ts").alias("modified_at"), F.col("user_id").alias("parent_id"))
    return _drained(spark, streams.timeline_events(rows)).select("scan_id", "timestamp", "event_type", "file_name")


@query("SELECT event_id AS id FROM events WHERE event_id % 3 = 0")
def routed_files(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "fat").when(F.col("event_id") % 3 == 1, "usn_journal").otherwise("ntfs_logfile").alias("source"))
    return _drained(spark, streams.file_rows(rows)).select("id")


@query(COPIES_SQL)
def copies_of_a_stream(spark, sf_dir):
    rows = files(spark, sf_dir, _stream(spark, sf_dir, "documents")).where(classify.is_carved("source")).select("scan_id", "id", "path", "start_sector", "end_sector", "source", "confidence")
    at = _stream_folder(spark)
    streams.write_copies(rows, ["scan_id"], f"{at}/rows", f"{at}/kept", f"{at}/checkpoint", trigger={"availableNow": True}).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows").select(*rows.columns)
