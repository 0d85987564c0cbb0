"""Recovery: bytes of files from a volume, checked; and the sinks they go to."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import validators
from ..functions.binary import crc64_ecma, lznt1
from ..functions.classify import is_carved, is_recoverable
from ..functions.text import csv_cell, extension_of, format_time, html_escape, safe_basename
from ..sources.volumes import CHUNK, SECTOR, file_bytes

# Percent under which a deleted file counts as failed, and the structure score under which any does.
DELETED_LEAST, STRUCTURE_LEAST = 90, 60
#: Larger compressed files are recovered as they lie, and that is an error.
COMPRESSED_MOST = 64 << 20

RESULT = "volume_id string, id long, name string, success boolean, zero_filled boolean, bytes_recovered long, md5 string, score int, error string, data binary"


def recover(files: DataFrame, chunks: DataFrame | None, chunk: int = CHUNK, sector: int = SECTOR) -> DataFrame:
    """A row for each file: its bytes and how well they hold up. Discovery rows are refused.

    chunks: None if no file lies on a volume; then bytes are resident or lacking, and nothing is joined.
    """
    able = is_recoverable("source", F.size("runs") > 0)
    resident = F.col("resident").isNotNull() & (F.octet_length("resident") > 0)
    rows = files.withColumns({"_able": able, "_resident": resident})
    if chunks is None:
        joined = rows.withColumns({"_data": F.lit(None).cast("binary"), "missing": F.lit(None).cast("long")})
    else:
        extents = rows.where("_able and not _resident and size_bytes > 0")
        found = file_bytes(extents, chunks, chunk, sector).select("volume_id", "id", F.col("data").alias("_data"), "missing")
        joined = rows.join(found, ["volume_id", "id"], "left")
    data = F.when(F.col("_resident"), F.substring(F.col("resident"), F.lit(1), F.greatest(F.col("size_bytes"), F.octet_length("resident")).cast("int"))).otherwise(F.col("_data"))
    checksum = F.col("integrity_checksum") if "integrity_checksum" in files.columns else F.lit(None).cast("decimal(20,0)")
    compressed = F.coalesce("compressed", F.lit(False)) if "compressed" in files.columns else F.lit(False)
    base = joined.select("volume_id", "id", "name", extension_of("name").alias("ext"), "size_bytes", "status", "source", "_able", F.coalesce(data, F.lit(b"")).alias("data"), F.coalesce("missing", F.lit(0)).alias("missing"), compressed.alias("compressed"), checksum.cast("string").alias("checksum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out = []
            for r in b.to_pylist():
                body, error, score = r["data"], "", -1
                if not r["_able"]:
                    out.append((r["volume_id"], r["id"], r["name"], False, False, 0, None, -1, "a discovery row has no bytes", None))
                    continue
                packed = r["compressed"] and len(body) > COMPRESSED_MOST
                if r["compressed"] and not packed:
                    plain = lznt1(body, r["size_bytes"])
                    body = plain if plain is not None else body
                good = bool(body) and not r["missing"] and not packed
                error = "" if good else "still compressed" if packed else "parts could not be read and are zeros" if body else "empty"
                if r["size_bytes"] and len(body) - r["missing"] < r["size_bytes"]:
                    score = (len(body) - r["missing"]) * 100 // r["size_bytes"]
                    if r["status"] == 0 and not r["source"].startswith("carver") and score < DELETED_LEAST:
                        good = False
                if r["source"] == "refs" and r["checksum"] not in (None, "0"):
                    right = crc64_ecma(body) == int(r["checksum"])
                    score, good, error = (90, good, error) if right else (15, False, "checksum mismatch")
                elif body and (structure := validators.score(r["ext"], body)) is not None:
                    score = structure
                    if structure < STRUCTURE_LEAST:
                        good, error = False, "; ".join(filter(None, [error, "structure check failed"]))
                out.append((r["volume_id"], r["id"], r["name"], good, bool(r["missing"]), len(body), hashlib.md5(body).hexdigest(), score, error, body))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return base.mapInArrow(run, RESULT)


def unique_names(results: DataFrame, most: int = 9999) -> DataFrame:
    """results with dest: safe names; files of one name get _1, _2 and so on, up to most; past that dest is null."""
    safe = results.withColumn("_base", safe_basename("name"))
    k = F.row_number().over(Window.partitionBy("_base").orderBy("volume_id", "id")) - 1
    stem, ext = F.regexp_extract("_base", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_base", r"(\.[^.]*)$", 1)
    named = safe.withColumn("_k", k)
    return named.withColumn("dest", F.when(F.col("_k") == 0, F.col("_base")).when(F.col("_k") <= most,F.concat(stem, F.lit("_"), F.col("_k").cast("string"), ext))).drop("_base", "_k")


def write_files(results: DataFrame, folder: str) -> DataFrame:
    """Writes the bytes of recovered rows below a folder that all executors share; (id, path, bytes), path null for what got no name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            out = []
            for i, dest, data in zip(*(b.column(c).to_pylist() for c in ("id", "dest", "data"))):
                if dest is None:
                    out.append((i, None, 0))
                    continue
                part = os.path.join(folder, f".{dest}.part")  # renamed when whole, so a repeated task leaves no torn file
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, dest))
                out.append((i, os.path.join(folder, dest), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["id", "path", "bytes"])

    return unique_names(results.where(F.col("data").isNotNull())).select("id", "dest", "data").mapInArrow(run, "id long, path string, bytes long")


CSV_COLUMNS = ("id", "name", "path", "size_bytes", "status", "category", "source", "confidence", "created_at", "modified_at")


def csv_lines(files: DataFrame) -> DataFrame:
    """(id, line): ;-separated lines without a head, formula-safe. Write them in order of id behind a byte-order mark and CRLF."""
    iso = lambda c: F.when(F.col(c) > 0, F.date_format(F.timestamp_seconds(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("")
    cells = [csv_cell(iso(c) if c.endswith("_at") else F.col(c)) for c in CSV_COLUMNS]
    return files.select("id", F.concat_ws(";", *cells).alias("line"))


def write_csv(files: DataFrame, path: str) -> None:
    """One CSV file with a byte-order mark, ; and CRLF, streamed through the driver partition by partition."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write(";".join(CSV_COLUMNS) + "\r\n")
        for r in csv_lines(files).orderBy("id").toLocalIterator():
            f.write(r["line"] + "\r\n")


def html_report(summary: DataFrame, case: dict[str, str]) -> tuple[str, str]:
    """(html, SHA-256 of its body) of a one-row summary."""
    import hashlib

    row = summary.first().asDict()
    esc = summary.sparkSession.range(1).select(*[html_escape(F.lit(str(v))).alias(k) for k, v in case.items()]).first().asDict() if case else {}
    lines = [f"<p>{k}: {v}</p>" for k, v in esc.items()] + ["<table>", *(f"<tr><td>{k}</td><td>{v}</td></tr>" for k, v in row.items()), "</table>"]
    body = "\n".join(lines)
    digest = hashlib.sha256(body.encode()).hexdigest()
    return f"<!DOCTYPE html><html><body>\n{body}\n<footer>{digest}</footer></body></html>", digest


def listed(files: DataFrame) -> DataFrame:
    """files as lists show them."""
    return files.withColumns({"shown_at": format_time("modified_at", "source"), "is_carved": is_carved("source")})


def write_image(chunks: DataFrame, path: str, size: int, chunk: int = CHUNK, container: str = "raw", allowed: tuple[str, ...] = ()) -> tuple[str, int]:
    """Writes one volume as a raw image or one container segment; (MD5, chunks that were missing and are zeros).

    An image has one order and one digest, so it streams through one writer, chunk by chunk. allowed: folders that may be
    written to, if there is such a list.
    """
    import hashlib

    from ..sources.evidence import SECTORS, write_ewf

    if allowed and not any(os.path.realpath(path).startswith(os.path.realpath(a) + os.sep) for a in allowed):
        raise ValueError("the destination is not on the list")
    missing = 0

    def stream() -> Iterator[bytes]:
        nonlocal missing
        at = 0
        for row in chunks.select("chunk_no", "data").orderBy("chunk_no").toLocalIterator(prefetchPartitions=True):
            while at < row["chunk_no"]:
                missing, at = missing + 1, at + 1
                yield bytes(min(chunk, size - (at - 1) * chunk))
            data = bytes(row["data"] or b"")[: size - at * chunk]
            yield data.ljust(min(chunk, size - at * chunk), b"\0")
            at += 1
        while at * chunk < size:
            missing, at = missing + 1, at + 1
            yield bytes(min(chunk, size - (at - 1) * chunk))

    if container == "ewf":
        def cut() -> Iterator[bytes]:
            unit, held = SECTORS * SECTOR, b""
            for data in stream():
                held += data
                while len(held) >= unit:
                    yield held[:unit]
                    held = held[unit:]
            if held:
                yield held

        return write_ewf(path, cut(), size)[0], missing
    digest = hashlib.md5()
    with open(path, "wb") as f:
        for data in stream():
            f.write(data)
            digest.update(data)
    return digest.hexdigest(), missing
