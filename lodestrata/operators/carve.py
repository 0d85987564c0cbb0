"""Signature carving: find headers and footers in chunks, fold them into carves, check what they hold.

1. Hits: an automaton over all headers and footers reads each chunk once, where it lies; only what crosses an edge (a few
   bytes of each chunk) is joined. A chunk that could not be read (null data) is a boundary: nothing crosses it.
2. Fold: hits in order open and close carves. Hits that no carve can span stand apart, so a volume is folded in as many
   parts as it has such places. A footer can be any number of chunks away.
3. Scores: the bytes of a carve come from a join and are checked by their kind.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import validators
from ..functions.binary import entropy, exif_time
from ..functions.times import exif_to_unix
from ..sources.volumes import CHUNK, SECTOR, cut, file_bytes
from .intervals import components, earlier_max, overlap_join

# Distances (bytes) under which a header opens no carve: of the same signature, and of any.
SAME_WITHIN, ANY_WITHIN = 4096, 512
# Confidence of a carve with header and footer, with header only, and of one that lost a gap; spans that are checked by default.
PAIR, HEADER_ONLY, RESCUED, CHECKED_FROM, CHECKED_TO = 70, 55, 88, 4096, 16 << 20
#: Fixed value: a gap is accepted from this score on.
GAP_SCORE = 85


@dataclass(frozen=True)
class Signature:
    format: str
    extension: str
    category: str
    header: bytes
    footer: bytes
    max_size: int
    header_at: int = 0


# Common signatures; more come from a catalogue file.
SIGNATURES = (
    Signature("JPEG", "jpg", "Image", b"\xff\xd8\xff", b"\xff\xd9", 20 << 20),
    Signature("PNG", "png", "Image", b"\x89PNG\r\n\x1a\n", b"IEND\xaeB`\x82", 20 << 20),
    Signature("GIF87", "gif", "Image", b"GIF87a", b"\x00;", 10 << 20),
    Signature("GIF89", "gif", "Image", b"GIF89a", b"\x00;", 10 << 20),
    Signature("BMP", "bmp", "Image", b"BM", b"", 20 << 20),
    Signature("TIFF-LE", "tif", "Image", b"II*\x00", b"", 50 << 20),
    Signature("TIFF-BE", "tif", "Image", b"MM\x00*", b"", 50 << 20),
    Signature("PDF", "pdf", "Document", b"%PDF-", b"%%EOF", 100 << 20),
    Signature("OLE", "doc", "Document", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"", 50 << 20),
    Signature("RTF", "rtf", "Document", b"{\\rtf", b"}", 20 << 20),
    Signature("ZIP", "zip", "Archive", b"PK\x03\x04", b"PK\x05\x06", 100 << 20),
    Signature("RAR", "rar", "Archive", b"Rar!\x1a\x07", b"", 100 << 20),
    Signature("7Z", "7z", "Archive", b"7z\xbc\xaf\x27\x1c", b"", 100 << 20),
    Signature("GZIP", "gz", "Archive", b"\x1f\x8b\x08", b"", 50 << 20),
    Signature("RIFF", "riff", "Video", b"RIFF", b"", 100 << 20),
    Signature("MP4", "mp4", "Video", b"ftyp", b"", 500 << 20, 4),
    Signature("MKV", "mkv", "Video", b"\x1a\x45\xdf\xa3", b"", 500 << 20),
    Signature("OGG", "ogg", "Audio", b"OggS", b"", 50 << 20),
    Signature("FLAC", "flac", "Audio", b"fLaC", b"", 100 << 20),
    Signature("MP3", "mp3", "Audio", b"ID3", b"", 20 << 20),
    Signature("SQLite", "sqlite", "Other", b"SQLite format 3\x00", b"", 100 << 20),
    Signature("EXE", "exe", "Executable", b"MZ", b"", 50 << 20),
    Signature("ELF", "elf", "Executable", b"\x7fELF", b"", 50 << 20),
)


def catalogue(spark: SparkSession, path: str) -> list[Signature]:
    """Signatures from JSON lists of format, extension, category, header, footer (hexadecimal), max_size (or maxSize) and header_at; bounded by nature.

    An entry without a header is left out; one without a size is an error.
    """
    rows = spark.read.json(path, schema="format string, extension string, category string, header string, footer string, max_size long, maxSize long, header_at int", multiLine=True)
    unhex, out = lambda x: bytes.fromhex("".join((x or "").split())), []
    for r in rows.collect():
        size = r["max_size"] if r["max_size"] is not None else r["maxSize"]
        if not r["header"]:
            continue
        if not size or size < 0:
            raise ValueError(f"a signature without a size: {r['format']}")
        out.append(Signature(r["format"], (r["extension"] or "").lstrip("."), r["category"] or "Other", unhex(r["header"]), unhex(r["footer"]), size, r["header_at"] or 0))
    return out


def known_signatures(spark: SparkSession) -> list[Signature]:
    """The signatures above and those of the library's catalogue; of equal headers and extensions the first counts."""
    more = catalogue(spark, "file://" + os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "data", "signatures.json"))
    return list({(x.header, x.header_at, x.extension): x for x in reversed([*SIGNATURES, *more])}.values())[::-1]


#: Bytes of a volume that one window sees when hits are parted.
FOLD_STRETCH = 1 << 30

HITS = "volume_id string, offset long, kind string, sig int, length int"


def automaton(signatures):
    """All headers and footers in one automaton; bytes are characters of the same number."""
    import ahocorasick

    by_pattern: dict[bytes, list[tuple[str, int]]] = {}
    for k, s in enumerate(signatures):
        by_pattern.setdefault(s.header, []).append(("header", k))
        if s.footer:
            by_pattern.setdefault(s.footer, []).append(("footer", k))
    out = ahocorasick.Automaton()
    for p, means in by_pattern.items():
        out.add_word(p.decode("latin-1"), (len(p), means))
    out.make_automaton()
    return out


def _found(data: bytes, patterns) -> Iterator[tuple[int, str, int, int]]:
    """(offset, kind, signature, length) of each pattern in data."""
    for last, (n, means) in patterns.iter(data.decode("latin-1")):
        for kind, k in means:
            yield last + 1 - n, kind, k, n


def hits(chunks: DataFrame, signatures=SIGNATURES, allowed: DataFrame | None = None) -> DataFrame:
    """(volume_id, offset, kind, sig, length) of every header and footer. allowed: (volume_id, start, end) bytes that may be searched."""
    halo = max(len(p) for s in signatures for p in (s.header, s.footer)) - 1

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = automaton(signatures)
        for b in batches:
            rows = [(v, off + at, kind, k, n) for v, off, data in zip(*(b.column(c).to_pylist() for c in ("volume_id", "byte_offset", "data"))) for at, kind, k, n in _found(data or b"", patterns)]
            yield _batch(rows)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = automaton(signatures)
        for b in batches:
            rows = []
            for v, off, tail, head in zip(*(b.column(c).to_pylist() for c in ("volume_id", "byte_offset", "tail", "head"))):
                cut = len(tail)
                rows += [(v, off - cut + at, kind, k, n) for at, kind, k, n in _found(tail + head, patterns) if at < cut < at + n]
            yield _batch(rows)

    edges = chunks.where("data is not null").select("volume_id", "chunk_no", "byte_offset", F.substring("data", 1, halo).alias("head"), F.substring("data", -halo, halo).alias("tail"))
    left = edges.select("volume_id", (F.col("chunk_no") + 1).alias("chunk_no"), "tail")
    crossing = edges.select("volume_id", "chunk_no", "byte_offset", "head").join(left, ["volume_id", "chunk_no"])
    found = chunks.select("volume_id", "byte_offset", "data").mapInArrow(inside, HITS).unionByName(crossing.select("volume_id", "byte_offset", "tail", "head").mapInArrow(over, HITS))
    if allowed is None:
        return found
    spans = found.withColumn("_end", F.col("offset") + 1)
    return overlap_join(spans, allowed, ["volume_id"], ("offset", "_end"), ("start", "end"), None, 1 << 26).select(found.columns).distinct()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["volume_id", "offset", "kind", "sig", "length"])


def fold(rows: list[tuple[int, str, int, int]], signatures=SIGNATURES, volume_end: int | None = None) -> list[tuple[int, int, int, bool]]:
    """(start, end, signature, closed by a footer) of carves from hits (offset, kind, signature, length)."""
    active: list[tuple[int, int]] = []
    out = []
    for offset, kind, k, n in sorted(rows, key=lambda h: (h[0] + h[3], h[1] == "footer", h[2])):
        for start, s in [a for a in active if offset + n > a[0] + signatures[a[1]].max_size]:
            out.append((start, start + signatures[s].max_size, s, False))
            active.remove((start, s))
        if kind == "header":
            start = offset - signatures[k].header_at
            near = any((s == k and offset - a < SAME_WITHIN) or 0 <= start - a < ANY_WITHIN for a, s in active)
            if start >= 0 and not near:
                active.append((start, k))
        else:
            for a in [a for a in active if a[1] == k and offset > a[0]]:
                out.append((a[0], offset + n, k, True))
                active.remove(a)
    for start, s in active:
        end = start + signatures[s].max_size
        out.append((start, end if volume_end is None else min(end, volume_end), s, False))
    return sorted(out)


CARVES = "volume_id string, id long, start long, end long, sig int, closed boolean"


def carves(found: DataFrame, ends: DataFrame, signatures=SIGNATURES) -> DataFrame:
    """(volume_id, id, start, end, sig, closed). ends: (volume_id, bytes). Ids follow from the start, so they don't depend on partitions.

    Hits are written down once: they are parted in several steps, each of which would search all chunks again.
    """
    most, at = (F.array(*[F.lit(x) for x in values])[F.col("sig")] for values in ([s.max_size for s in signatures], [s.header_at for s in signatures]))
    header = F.col("kind") == "header"
    rows = cut(found).withColumns({"_from": F.when(header, F.col("offset") - at).otherwise(F.col("offset")), "_to": F.when(header, F.col("offset") - at + most)})
    order = ["_from", "offset", "kind", "sig"]
    # a footer that no header reaches closes nothing
    rows = earlier_max(rows, ["volume_id"], "_from", order, "_to", "_open", FOLD_STRETCH).where(header | (F.col("offset") <= F.col("_open")))
    rows = rows.withColumn("_to", F.greatest("_to", F.col("offset") + F.col("length")))
    rows = components(rows, ["volume_id"], "_from", "_to", order, "_part", FOLD_STRETCH)

    parts = rows.groupBy("volume_id", "_part").agg(F.collect_list(F.struct("offset", "kind", "sig", "length")).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, out = b.column("hits"), []
            for k, (v, end) in enumerate(zip(b.column("volume_id").to_pylist(), b.column("bytes").to_pylist())):
                out += [(v, start, *x) for start, *x in ((c[0], *c) for c in fold(list(zip(*(f.to_pylist() for f in hits[k].values.flatten()))), signatures, end))]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["volume_id", "id", "start", "end", "sig", "closed"])

    return parts.join(ends, "volume_id").select("volume_id", "hits", "bytes").mapInArrow(run, CARVES)


def bifragment_gap(data: bytes, check: Callable[[bytes], int], step: int = SECTOR, most_gap: int = 64 * 1024, gaps: Callable[..., Iterator[tuple[int, int]]] = validators.all_gaps) -> tuple[int, int] | None:
    """(fragment length, gap length) of the first gap, in steps, without which data passes. gaps: those that come into question, in order."""
    for start, gap in gaps(data, step, step, most_gap):
        if check(data[:start] + data[start + gap :]) >= GAP_SCORE:
            return start, gap
    return None


def trifragment_gap(data: bytes, check: Callable[[bytes], int], step: int = SECTOR, most_gap: int = 64 * 1024, budget: int | None = 8192, settled: Callable[[bytes], int] = len, gaps: Callable[..., Iterator[tuple[int, int]]] = validators.all_gaps) -> tuple[int, int, int, int] | None:
    """(first fragment, gap, second fragment, gap) with two gaps; the budget of checks is strict, None is a whole search.

    settled: so many first bytes settle that data fail, so a first gap starts before their end. gaps: as for one gap, for the second.
    """
    for first, gap in validators.all_gaps(data, step, step, most_gap, settled):
        one = data[:first] + data[first + gap :]
        for at, gap2 in gaps(one, first + step, step, most_gap):
            if budget is not None:
                if budget <= 0:
                    return None
                budget -= 1
            if check(one[:at] + one[at + gap2 :]) >= GAP_SCORE:
                return first, gap, at - first, gap2
    return None


SCORED = "volume_id string, id long, name string, extension string, size_bytes long, start_sector long, end_sector long, confidence int, category string, source string, gap_start long, gap_length long, gap2_start long, gap2_length long, modified_text string"


def scored(found: DataFrame, chunks: DataFrame, signatures=SIGNATURES, chunk: int = CHUNK, sector: int = SECTOR, gap_limit: int = 64 * 1024, checked_to: int = CHECKED_TO, checked_from: int = CHECKED_FROM, two_gap_checks: int | None = None) -> DataFrame:
    """Carves as file rows: checked by kind, demoted or dropped if they don't hold up, rescued if a gap, or two, explain it.

    checked_to: bytes of a carve that are read; carves of more keep the confidence of their signature, as do those of
    checked_from or less (-1: all are checked). gap_limit: the longest gap that is tried. two_gap_checks: None tries all pairs
    of gaps. The gap columns hold offsets in the carve. Carves are written down once: they ask for bytes and meet them again.
    """
    rows = cut(found).select("volume_id", "id", F.col("start").alias("start_b"), (F.least(F.col("end") - F.col("start"), F.lit(checked_to))).alias("size_bytes"), "end", "sig", "closed")
    spans = rows.select("volume_id", "id", F.floor(F.col("start_b") / sector).alias("start_sector"), (F.col("size_bytes") + F.col("start_b") % sector).alias("size_bytes"), F.lit(None).cast("array<struct<start_sector:bigint,sector_count:bigint,is_sparse:boolean>>").alias("runs"))
    data = file_bytes(spans, chunks, chunk, sector)
    rows = rows.join(data, ["volume_id", "id"]).select("volume_id", "id", "start_b", "end", "sig", "closed", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v, i, start, end, k, closed, raw in zip(*(b.column(c).to_pylist() for c in b.schema.names)):
                s, body = signatures[k], (raw or b"")[start % sector :]
                ext, size, conf, gap, second = s.extension, end - start, PAIR if closed else HEADER_ONLY, None, None
                if ext == "riff":
                    ext = validators.RIFF_KINDS.get(body[8:12], "bin")
                elif ext == "zip":
                    ext = validators.office_kind(body)
                if ext in ("mp4", "sqlite"):
                    conf, known = validators.mp4(body) if ext == "mp4" else validators.sqlite(body)
                    if not conf:
                        continue
                    size = known or size
                check = validators.BY_EXTENSION.get(ext)
                if check and ext not in ("mp4", "sqlite") and checked_from < size <= checked_to:
                    conf = check(body)
                    if conf < GAP_SCORE and closed:
                        settled = validators.SETTLED.get(ext, len)
                        gaps = validators.GAPS.get(ext, partial(validators.all_gaps, settled=settled))
                        gap = bifragment_gap(body, check, sector, gap_limit, gaps)
                        if not gap and (two := trifragment_gap(body, check, sector, gap_limit, two_gap_checks, settled, gaps)):
                            gap, second = two[:2], (sum(two[:3]), two[3])
                        conf = RESCUED if gap else conf
                if ext == "bmp":
                    score = validators.bmp(body)
                    if score < 50:
                        continue
                    ext = "bin" if score < 70 else ext
                category = s.category if s.category not in ("", "Unknown", "Other") else "Encrypted" if entropy(body[:4096]) >= 7.6 else s.category
                out.append((v, i, f"carved_{start}.{ext}", ext, size, start // sector, (start + size - 1) // sector, conf, category, "carver_bgc" if gap else "carver", *(gap or (None, None)), *(second or (None, None)), exif_time(body[: 1 << 16]) if ext == "jpg" else ""))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = [x.split()[0] for x in SCORED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)

    out = rows.mapInArrow(run, SCORED)
    # a carved file's only time is the one that its own metadata holds
    return out.withColumn("modified_at", exif_to_unix("modified_text")).drop("modified_text")


def first_per_start(found: DataFrame) -> DataFrame:
    """One carve a start offset: a closed one before others, then the shorter."""
    order = Window.partitionBy("volume_id", "start").orderBy(F.desc("closed"), "end", "sig")
    return found.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
