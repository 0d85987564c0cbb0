"""Image containers, hash sets, logs and url guards."""

from __future__ import annotations

import hashlib
import ipaddress
import os
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import md5_text
from ..operators.aggregates import GENESIS
from ..schema import CHUNKS

#: Signature of a segment file, and sectors of a chunk.
MAGIC, SECTORS = b"EVF\x09\x0d\x0a\xff\x00", 64


def segment_name(base: str, n: int) -> str:
    """base.E01 to base.E99, then base.EAA on."""
    if n < 100:
        return f"{base}.E{n:02d}"
    k = n - 100
    return f"{base}.{chr(69 + k // 676)}{chr(65 + k // 26 % 26)}{chr(65 + k % 26)}"


def _section(kind: bytes, at: int, body: bytes, last: bool = False) -> bytes:
    size = 76 + len(body)
    head = kind.ljust(16, b"\0") + struct.pack("<QQ", at if last else at + size, size) + bytes(40)
    return head + struct.pack("<I", zlib.adler32(head)) + body


def write_ewf(path: str, chunks: Iterator[bytes], size: int, sector: int = 512) -> tuple[str, int]:
    """Writes one uncompressed segment at path; (MD5, bytes). Each chunk but the last has SECTORS sectors."""
    digest, offsets, done = hashlib.md5(), [], 0
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<BHH", 1, 1, 0))
        count = -(-size // (SECTORS * sector))
        f.write(_section(b"volume", f.tell(), struct.pack("<IIIIQ", 1, count, SECTORS, sector, -(-size // sector)) + bytes(94 - 24 + 4)))
        body_at = f.tell()
        f.write(_section(b"sectors", body_at, b""))
        for c in chunks:
            offsets.append(f.tell())
            f.write(c + struct.pack("<I", zlib.adler32(c)))
            digest.update(c)
            done += len(c)
        end = f.tell()
        head = b"sectors".ljust(16, b"\0") + struct.pack("<QQ", end, end - body_at) + bytes(40)
        f.seek(body_at)
        f.write(head + struct.pack("<I", zlib.adler32(head)))
        f.seek(end)
        base = struct.pack("<IIQI", len(offsets), 0, offsets[0] if offsets else 0, 0)
        entries = b"".join(struct.pack("<I", o - (offsets[0] if offsets else 0)) for o in offsets)
        f.write(_section(b"table", f.tell(), base + struct.pack("<I", zlib.adler32(base)) + entries + struct.pack("<I", zlib.adler32(entries))))
        f.write(_section(b"hash", f.tell(), digest.digest() + bytes(16) + struct.pack("<I", zlib.adler32(digest.digest() + bytes(16)))))
        f.write(_section(b"done", f.tell(), b"", last=True))
    return digest.hexdigest(), done


def ewf_chunks(path: str) -> Iterator[bytes]:
    """The chunks of one segment, in order; compressed ones are inflated."""
    with open(path, "rb") as f:
        if f.read(8) != MAGIC:
            raise ValueError("not an image segment")
        at, end_of_sectors, per, sector = 13, 0, SECTORS, 512
        while True:
            f.seek(at)
            head = f.read(76)
            if len(head) < 76:
                return
            kind, (following, size) = head[:16].rstrip(b"\0"), struct.unpack_from("<QQ", head, 16)
            if kind in (b"volume", b"disk"):
                per, sector = struct.unpack_from("<II", f.read(24), 8)
            elif kind == b"sectors":
                end_of_sectors = at + size
            elif kind == b"table":
                n, _, base, _ = struct.unpack_from("<IIQI", f.read(24))
                offsets = struct.unpack(f"<{n}I", f.read(4 * n))
                for k, o in enumerate(offsets):
                    start = base + (o & 0x7FFFFFFF)
                    stop = base + (offsets[k + 1] & 0x7FFFFFFF) if k + 1 < n else end_of_sectors
                    f.seek(start)
                    raw = f.read(stop - start)
                    yield zlib.decompress(raw) if o >> 31 else raw[:-4]
            if kind in (b"done", b"next") or following <= at:
                return
            at = following


def read_ewf(spark: SparkSession, first: str, chunk: int = SECTORS * 512) -> DataFrame:
    """Chunks of a segmented image; one task a segment. first: the path of the .E01 file on storage that executors share."""
    base, paths = first[:-4], []
    while os.path.exists(p := segment_name(base, len(paths) + 1)):
        paths.append(p)

    def run(frames):
        import pandas as pd

        for frame in frames:
            for n, path, start in zip(frame["n"], frame["path"], frame["start"]):
                for k, data in enumerate(ewf_chunks(path)):
                    yield pd.DataFrame({"volume_id": [base], "chunk_no": [start + k], "byte_offset": [(start + k) * chunk], "data": [data]})

    counts, start, rows = [sum(1 for _ in _table_sizes(p)) and sum(_table_sizes(p)) for p in paths], 0, []
    for n, (p, c) in enumerate(zip(paths, counts)):
        rows.append((n, p, start))
        start += c
    return spark.createDataFrame(rows, "n long, path string, start long").repartition(max(1, len(rows)), "n").mapInPandas(run, CHUNKS)


def _table_sizes(path: str) -> list[int]:
    out, at = [], 13
    with open(path, "rb") as f:
        while True:
            f.seek(at)
            head = f.read(80)
            if len(head) < 76:
                return out
            kind, (following, _) = head[:16].rstrip(b"\0"), struct.unpack_from("<QQ", head, 16)
            if kind == b"table" and len(head) == 80:
                out.append(struct.unpack_from("<I", head, 76)[0])
            if kind in (b"done", b"next") or following <= at:
                return out
            at = following


def rotate_segment(written: int, limit: int, chunk: int) -> bool:
    """Whether the next chunk belongs into a new segment."""
    return limit > 0 and written > 0 and written + chunk > limit


def hash_set(spark: SparkSession, *paths: str) -> DataFrame:
    """The MD5 values (md5) of hash-list files: any comma-separated field of 32 hexadecimal digits; # starts a comment line."""
    lines = spark.read.text(list(paths)).where(~F.trim("value").startswith("#"))
    fields = lines.select(F.explode(F.split("value", ",")).alias("x")).select(md5_text(F.regexp_replace("x", r'["\s]', "")).alias("md5"))
    return fields.where("md5 is not null").distinct()


def log_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(line_no, value): the lines of logs. line_no sorts them by file and by place in it, however files are split among tasks."""
    # rows of a split are read one after the other, so their running number orders them; splits are ordered by where they start
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(list(paths)).select(place.alias("line_no"), "value")


def log_tail(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """(line_no, value): the last lines of a log, in order."""
    lines = log_lines(spark, path)
    return lines.orderBy(F.desc("line_no")).limit(most).orderBy("line_no").select("line_no", "value")


def log_summary(lines: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The last line of each kind. kinds: name to pattern."""
    kind = F.lit("")
    for name, pattern in reversed(kinds.items()):
        kind = F.when(F.col("value").rlike(pattern), name).otherwise(kind)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("line_no")))
    return lines.withColumn("kind", kind).where("kind <> ''").withColumn("_k", rank).where("_k = 1").drop("_k")


class AuditLog:
    """An append-only log whose lines carry the chain h = sha256(previous || message); a new writer goes on from the last line."""

    def __init__(self, path: str) -> None:
        self.path, self.last = path, GENESIS
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    self.last = line.split(" ", 1)[0]

    def append(self, message: str) -> str:
        self.last = hashlib.sha256((self.last + message).encode()).hexdigest()
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(f"{self.last} {message}\n")
        return self.last

    @staticmethod
    def rows(spark: SparkSession, path: str) -> DataFrame:
        """(line_no, digest, message) for verify_chain."""
        return log_lines(spark, path).select("line_no", F.substring_index("value", " ", 1).alias("digest"), F.expr("substring(value, 66)").alias("message"))


def url_allowed(url: str) -> bool:
    """Whether an image may be read from a url: http or https, and no local, private or link-local host."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or host == "localhost" or host.endswith((".localhost", ".local")):
        return False
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return not host.replace(".", "").isdigit()
    return address.is_global
