"""NTFS: boot sector, file records, change journal, log hints, index roots, recycle bin. Records are parsed where they lie."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import data_runs, fixup, utf16
from ..functions.classify import category_for_name, mft_confidence
from ..functions.times import EPOCH_1601, STEPS

REFERENCE = (1 << 48) - 1
#: Attribute types.
STANDARD, NAME, DATA, INDEX_ROOT, END = 0x10, 0x30, 0x80, 0x90, 0xFFFFFFFF


def unix(filetime: int) -> int:
    return (filetime - EPOCH_1601) // STEPS if filetime > EPOCH_1601 else 0


@dataclass(frozen=True)
class Boot:
    sector: int
    cluster: int
    mft_cluster: int
    record: int
    sectors: int
    serial: int


def boot(data: bytes) -> Boot | None:
    """Geometry of an NTFS boot sector; None if it is none or can't be."""
    if data[3:11] != b"NTFS    " or len(data) < 512:
        return None
    sector, per = struct.unpack_from("<HB", data, 11)
    per = per if per < 0x80 else 1 << (256 - per)
    sectors, mft = struct.unpack_from("<QQ", data, 40)
    size = struct.unpack_from("<b", data, 64)[0]
    serial = struct.unpack_from("<Q", data, 72)[0]
    if sector not in (512, 1024, 2048, 4096) or not per:
        return None
    record = 1 << -size if size < 0 else size * per * sector
    return Boot(sector, per * sector, mft, record, sectors, serial) if 256 <= record <= 65536 else None


def attributes(record: bytes) -> Iterator[tuple[int, str, bool, bytes, dict]]:
    """(type, name, resident, content or mapping pairs, sizes and flags) of a record's attributes."""
    at = struct.unpack_from("<H", record, 20)[0]
    while at + 16 <= len(record):
        kind, size, remote, n, name_at, flags = struct.unpack_from("<IIBBHH", record, at)
        if kind == END or size < 16 or at + size > len(record):
            return
        body = record[at : at + size]
        name = utf16(body[name_at : name_at + 2 * n]) if n else ""
        if remote:
            if size < 64:
                return
            runs_at, = struct.unpack_from("<H", body, 32)
            allocated, real, _ = struct.unpack_from("<QQQ", body, 40)
            yield kind, name, False, body[runs_at:], {"size": real, "allocated": allocated, "compressed": bool(flags & 1)}
        else:
            length, offset = struct.unpack_from("<IH", body, 16)
            yield kind, name, True, body[offset : offset + length], {"size": length, "compressed": bool(flags & 1)}
        at += size


def index_names(root: bytes) -> list[tuple[int, int, str]]:
    """(child, parent, name) of an index root's entries and of what its slack still shows."""
    out, at = [], 32
    while at + 16 + 66 <= len(root):
        ref, size, key = struct.unpack_from("<QHH", root, at)
        n = root[at + 16 + 64] if at + 81 <= len(root) else 0
        if size >= 16 + 66 + 2 * n and n and at + 82 + 2 * n <= len(root) and key >= 66:
            out.append((ref & REFERENCE, struct.unpack_from("<Q", root, at + 16)[0] & REFERENCE, utf16(root[at + 82 : at + 82 + 2 * n])))
            at += size
        else:
            at += 8
    return out


def file_record(raw: bytes, number: int, cluster: int, sector: int = 512, volume_sector: int = 0) -> list[dict]:
    """Rows of a FILE record: the file, and each named stream; none for empty or foreign records."""
    if raw[:4] != b"FILE":
        return []
    record, fixed = fixup(raw, sector)
    flags = struct.unpack_from("<H", record, 22)[0]
    in_use, directory = bool(flags & 1), bool(flags & 2)
    name, parent, times, rank, streams, hints = "", 0, (0, 0), -1, {}, []
    for kind, label, resident, body, info in attributes(record):
        if kind == STANDARD and len(body) >= 16:
            times = tuple(unix(x) for x in struct.unpack_from("<QQ", body))
        elif kind == NAME and len(body) >= 66:
            space = body[65]
            if (r := {1: 3, 3: 2, 0: 1}.get(space, 0)) > rank:
                name, parent, rank = utf16(body[66 : 66 + 2 * body[64]]), struct.unpack_from("<Q", body)[0] & REFERENCE, r
        elif kind == DATA:
            per = cluster // sector
            runs = [] if resident else [{"start_sector": None if c is None else volume_sector + c * per, "sector_count": n * per, "is_sparse": c is None} for c, n in data_runs(body)]
            streams.setdefault(label, {"size_bytes": info["size"], "compressed": info["compressed"], "runs": runs, "resident": body if resident and body else None})
        elif kind == INDEX_ROOT:
            hints += index_names(body)
    base = {"mft_record": number, "parent_id": parent, "in_use": in_use, "fixup_ok": fixed, "is_directory": directory, "created_at": times[0], "modified_at": times[1], "hints": [{"child": c, "parent": p, "name": n} for c, p, n in hints]}
    none = {"size_bytes": 0, "compressed": False, "runs": [], "resident": None}
    rows = [base | {"name": name, "source": "ntfs_mft"} | streams.get("", none)]
    rows += [base | {"name": f"{name}:{label}", "source": "ntfs_ads", "hints": []} | s for label, s in streams.items() if label]
    return rows


_RUN = pa.struct([("start_sector", pa.int64()), ("sector_count", pa.int64()), ("is_sparse", pa.bool_())])
_HINT = pa.struct([("child", pa.int64()), ("parent", pa.int64()), ("name", pa.string())])
_ROWS = pa.schema([
    ("volume_id", pa.string()), ("mft_record", pa.int64()), ("parent_id", pa.int64()), ("name", pa.string()), ("source", pa.string()), ("in_use", pa.bool_()), ("fixup_ok", pa.bool_()), ("is_directory", pa.bool_()),
    ("size_bytes", pa.int64()), ("compressed", pa.bool_()), ("runs", pa.list_(_RUN)), ("resident", pa.binary()), ("created_at", pa.int64()), ("modified_at", pa.int64()), ("hints", pa.list_(_HINT)),
])
_DDL = "volume_id string, mft_record long, parent_id long, name string, source string, in_use boolean, fixup_ok boolean, is_directory boolean, size_bytes long, compressed boolean, runs array<struct<start_sector:bigint,sector_count:bigint,is_sparse:boolean>>, resident binary, created_at long, modified_at long, hints array<struct<child:bigint,parent:bigint,name:string>>"


def file_rows(records: DataFrame, cluster: int, sector: int = 512, volume_sector: int = 0) -> DataFrame:
    """File rows of raw records (volume_id, number, data), with status, category and confidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r | {"volume_id": v} for v, n, raw in zip(*(b.column(c).to_pylist() for c in ("volume_id", "number", "data"))) for r in file_record(raw, n, cluster, sector, volume_sector)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)

    rows = records.select("volume_id", "number", "data").mapInArrow(run, _DDL)
    score = mft_confidence(F.col("in_use"), F.col("fixup_ok"), F.col("is_directory"), F.col("size_bytes"), F.size("runs") > 0, F.col("resident").isNotNull())
    return rows.withColumns({
        "status": F.when(F.col("in_use"), 1).otherwise(0),
        "confidence": F.when(F.col("source") == "ntfs_ads", F.greatest(F.lit(0), score - 5)).otherwise(score),
        "category": F.when(F.col("is_directory"), "Folder").otherwise(category_for_name("name")),
        "start_sector": F.try_element_at("runs", F.lit(1))["start_sector"],
    })


def records_in(chunks: DataFrame, start: int, count: int, size: int) -> DataFrame:
    """(volume_id, number, data) of count records from a byte offset. Records that chunks hold whole are cut where they lie."""
    rows = chunks.where((F.col("byte_offset") + F.octet_length("data") > start) & (F.col("byte_offset") < start + count * size))
    first = F.greatest(F.lit(0), F.ceil((F.col("byte_offset") - start) / size)).cast("long")
    last = F.least(F.lit(count - 1), F.floor((F.col("byte_offset") + F.octet_length("data") - start) / size) - 1).cast("long")
    rows = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    rows = rows.select("volume_id", "byte_offset", "data", F.explode(F.sequence("_first", "_last")).alias("number"))
    return rows.select("volume_id", "number", F.substring("data", (F.lit(start) + F.col("number") * size - F.col("byte_offset") + 1).cast("int"), F.lit(size)).alias("data"))


def orphan_records(chunks: DataFrame, size: int = 1024, step: int = 512) -> DataFrame:
    """(volume_id, number, data) of FILE records at any sector of a chunk, numbered by what they say themselves."""
    at = F.sequence(F.lit(0), F.octet_length("data") - size, F.lit(step))
    rows = chunks.where(F.octet_length("data") >= size).select("volume_id", F.explode(F.transform(at, lambda k: F.substring(F.col("data"), k + 1, F.lit(size)))).alias("data"))
    number = F.conv(F.concat(*[F.hex(F.substring("data", 45 + k, 1)) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    return rows.where(F.substring("data", 1, 4) == F.lit(b"FILE")).select("volume_id", number.alias("number"), "data")


# Change journal.


def usn_records(data: bytes, resync: int = 8, stop: int | None = None) -> Iterator[dict]:
    """Journal records of version 2 and 3 that start before stop; where none starts, the next place is tried."""
    at, stop = 0, len(data) if stop is None else stop
    while at < stop and at + 60 <= len(data):
        size, major, minor = struct.unpack_from("<IHH", data, at)
        head = {2: 60, 3: 76}.get(major)
        if head is None or minor or size < head or size % 8 or at + size > len(data):
            at += resync
            continue
        wide = 16 if major == 3 else 8
        ref, parent = (int.from_bytes(data[at + 8 + k * wide : at + 8 + k * wide + 8], "little") for k in (0, 1))
        usn, time, reason, _, _, attrs, n, name_at = struct.unpack_from("<qQIIIIHH", data, at + 8 + 2 * wide)
        if name_at + n > size or not n:
            at += resync
            continue
        yield {"file_reference": ref, "parent_reference": parent, "usn": usn, "timestamp": unix(time), "reason": reason, "attributes": attrs, "name": utf16(data[at + name_at : at + name_at + n]), "length": size}
        at += size


#: Journal rows that a task holds.
ROWS_AT_ONCE = 10_000


JOURNAL = pa.schema([("volume_id", pa.string()), ("file_reference", pa.int64()), ("parent_reference", pa.int64()), ("usn", pa.int64()), ("timestamp", pa.int64()), ("reason", pa.int64()), ("attributes", pa.int64()), ("name", pa.string())])


def journal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pieces (volume_id, data, stop); a piece and ROWS_AT_ONCE of its rows are held at a time."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows: list[dict] = []
    for b in batches:
        for k in range(b.num_rows):
            v, data, stop = (b.column(c)[k].as_py() for c in ("volume_id", "data", "stop"))
            for r in usn_records(data, stop=stop):
                del r["length"]
                rows.append(r | {"volume_id": v, "file_reference": signed(r["file_reference"]), "parent_reference": signed(r["parent_reference"])})
                if len(rows) == ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, schema=JOURNAL)
                    rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=JOURNAL)


def journal(streams: DataFrame) -> DataFrame:
    """Journal rows of (volume_id, data) pieces; records that start before a piece's stop count, if it has that column."""
    stop = F.col("stop") if "stop" in streams.columns else F.lit(None)
    return streams.select("volume_id", "data", stop.cast("int").alias("stop")).mapInArrow(journal_rows, "volume_id string, file_reference long, parent_reference long, usn long, timestamp long, reason long, attributes long, name string")


#: The longest journal record: its header and a name of 255 characters, rounded up.
LONGEST_RECORD = 1024


def journal_pieces(chunks: DataFrame) -> DataFrame:
    """(volume_id, data, stop) for journal: chunks with what the next one begins with, so that records may cross an edge.

    A piece that starts inside a record finds the next one by trying places.
    """
    following = chunks.select("volume_id", (F.col("chunk_no") - 1).alias("chunk_no"), F.substring("data", 1, LONGEST_RECORD).alias("_more"))
    rows = chunks.where("data is not null").join(following, ["volume_id", "chunk_no"], "left")
    return rows.select("volume_id", F.concat("data", F.coalesce("_more", F.lit(b""))).alias("data"), F.octet_length("data").alias("stop"))


# Recycle bin.


def recycle_info(data: bytes) -> dict | None:
    """original_path, file_size, deleted_unix of a $I file of version 1 or 2; None if it is malformed."""
    if len(data) < 24:
        return None
    version, size, time = struct.unpack_from("<QQQ", data)
    if version == 1:
        path = utf16(data[24 : 24 + 520])
    elif version == 2 and len(data) >= 28:
        n = struct.unpack_from("<I", data, 24)[0]
        if n > 32768 or 28 + 2 * n > len(data) + 2:
            return None
        path = utf16(data[28 : 28 + 2 * n])
    else:
        return None
    return {"original_path": path, "file_size": size, "deleted_unix": unix(time)} if path else None


RECYCLE = "struct<original_path:string,file_size:bigint,deleted_unix:bigint>"


def with_recycle_info(files: DataFrame) -> DataFrame:
    """files with info of those whose name starts with $I and whose bytes are resident."""
    @F.pandas_udf(RECYCLE)
    def parse(data: pd.Series) -> pd.DataFrame:
        none = {"original_path": None, "file_size": None, "deleted_unix": None}
        return pd.DataFrame([(recycle_info(bytes(x)) if x is not None else None) or none for x in data])

    info = parse(F.when(F.upper(F.substring("name", 1, 2)) == "$I", F.col("resident")))
    return files.withColumn("info", info).withColumn("info", F.when(F.col("info.original_path").isNotNull(), F.col("info")))


# Log file.


#: Bytes of a log page, and confidence of a name in an attribute, of a loose name and of a restart page.
LOG_PAGE, IN_ATTRIBUTE, LOOSE, RESTART = 4096, 58, 35, 20
_LOOSE_NAME = re.compile(rb"(?:[\x20-\x7e]\x00){4,255}")


def log_page_hints(page: bytes) -> Iterator[tuple[str, int | None, int]]:
    """(lower-case name, record number or None, confidence) of one log page.

    Names in file-name attributes come with their parent's record number; other runs of printable UTF-16 with a dot in them
    are loose names.
    """
    k, taken = 64, []
    while k + 66 <= len(page):
        n, space = page[k + 64], page[k + 65]
        if n and space in (0, 1, 2, 3) and k + 66 + 2 * n <= len(page):
            name = utf16(page[k + 66 : k + 66 + 2 * n])
            if len(name) == n and "." in name and name.isprintable() and name.isascii():
                yield name.lower(), struct.unpack_from("<Q", page, k)[0] & REFERENCE, IN_ATTRIBUTE
                taken.append((k + 66, k + 66 + 2 * n))
                k += 66 + 2 * n
                continue
        k += 8
    for m in _LOOSE_NAME.finditer(page, 64):
        name = m[0].decode("utf-16-le")
        if "." in name.strip(". ") and not any(s < m.end() and m.start() < e for s, e in taken):
            yield name.lower(), None, LOOSE


def log_hints(data: bytes, most: int | None = None) -> list[tuple[str, int | None]]:
    """(lower-case name, record number or None) of the record pages of a log, wherever they start; most: no more than these."""
    out: list[tuple[str, int | None]] = []
    at = data.find(b"RCRD")
    while at >= 0 and (most is None or len(out) < most):
        out += [(name, ref) for name, ref, _ in log_page_hints(data[at : at + LOG_PAGE])]
        at = data.find(b"RCRD", at + LOG_PAGE)
    return out[:most]


def log_rows(chunks: DataFrame) -> DataFrame:
    """(volume_id, name_lower, mft_ref, confidence, source) of the log pages in chunks of whole pages; a restart page is a row without a name."""
    schema = pa.schema([("volume_id", pa.string()), ("name_lower", pa.string()), ("mft_ref", pa.int64()), ("confidence", pa.int32()), ("source", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for v, data in zip(b.column("volume_id").to_pylist(), b.column("data").to_pylist()):
                for at in range(0, len(data or b""), LOG_PAGE):
                    page = data[at : at + LOG_PAGE]
                    if page[:4] == b"RSTR":
                        rows.append((v, None, None, RESTART, "ntfs_logfile_restart"))
                    elif page[:4] == b"RCRD":
                        rows += [(v, *hint, "ntfs_logfile") for hint in log_page_hints(page)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return chunks.select("volume_id", "data").mapInArrow(run, "volume_id string, name_lower string, mft_ref long, confidence int, source string")
