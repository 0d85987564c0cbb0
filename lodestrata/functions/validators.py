"""How well bytes hold up as a file of a kind: scores of 0 to 100.

A reader for each format takes the bytes apart as the published format says and tells what it met; SCORES says what that is
worth. So what is read and how it is judged stay apart, and other functions can use the readers.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

# What is worth how much, for each format. Of the listed lines the first one whose findings were all made counts.
SCORES: dict[str, tuple[tuple[int, str], ...]] = {
    "jpeg": ((95, "image end, scan"), (70, "image end, segment"), (30, "image end"), (20, "bad length"), (75, "scan"), (50, "segment"), (20, "")),
    "png": ((30, "bad name"), (10, "no header chunk"), (98, "end chunk, good sum"), (80, "end chunk"), (60, "cut"), (40, "bad sum"), (70, "good sum"), (0, "")),
    "bmp": ((5, "bad offset"), (25, "no information"), (10, "unknown information"), (20, "no extent"), (15, "large extent"), (90, "whole"), (70, "")),
    "zip": ((95, "directory, directory end"), (70, "directory end"), (60, "directory"), (30, "")),
    "pdf": ((20, "no version"), (90, "object, trailer"), (55, "object"), (50, "trailer"), (25, "")),
    "gzip": ((20, "unknown method"), (30, "cut header"), (40, "no room for a trailer"), (85, "")),
    "sqlite": ((0, "bad page size"), (90, "page count"), (60, "")),
    "mp4": ((0, "no ftyp"), (95, "moov, mdat"), (75, "moov"), (75, "mdat"), (50, "")),
}
# What a RIFF file holds, by its form; scores of a known and of another form, and of a transport stream.
RIFF_KINDS = {b"WEBP": "webp", b"AVI ": "avi", b"WAVE": "wav"}
RIFF_KNOWN, RIFF_OTHER, STREAM = 90, 15, 92
# The largest plausible place of a bitmap's pixels and its largest extent; packets that are looked at.
PIXELS_TO, EXTENT_TO, PACKETS = 1 << 20, 65535, 5


def worth(kind: str, seen: set[str]) -> int:
    return next(score for score, needed in SCORES[kind] if seen.issuperset(filter(None, needed.split(", "))))


# JPEG (ITU-T T.81, annex B): markers are FF and a byte that is neither 00 nor fill; most carry a length.
_MARKER = re.compile(rb"\xff+([^\x00\xff\xd0-\xd7])")
SOI, EOI, SOS = 0xD8, 0xD9, 0xDA


def jpeg_segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end of its parameters) after the image's start, up to its end; what follows a scan's header is skipped as data.

    The end is 0 for a length that cannot be. A marker without room for a length ends it.
    """
    at = 2
    while found := _MARKER.search(data, at):
        marker, here = found[1][0], found.end()
        if marker == EOI:
            yield marker, found.start(), here
            return
        if here + 2 > len(data):
            return
        n = int.from_bytes(data[here : here + 2], "big")
        yield marker, found.start(), here + n if n >= 2 else 0
        if n < 2:
            return
        at = here + n


def jpeg(data: bytes) -> int:
    if len(data) < 4 or data[:2] != bytes([0xFF, SOI]):
        return 0
    seen = set()
    for marker, _, end in jpeg_segments(data):
        seen.add("image end" if marker == EOI else "segment" if end else "bad length")
        if marker == SOS and end:
            seen.add("scan")
    return worth("jpeg", seen)


PNG_HEAD = b"\x89PNG\r\n\x1a\n"


def png_chunks(data: bytes) -> Iterator[tuple[bytes, int, int, bool | None]]:
    """(kind, start and end of the payload, whether its sum is right); None if the bytes end before the sum."""
    at = len(PNG_HEAD)
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        start, end = at + 8, at + 8 + n
        whole = end + 4 <= len(data)
        yield kind, start, end, zlib.crc32(data[at + 4 : end]) == int.from_bytes(data[end : end + 4], "big") if whole else None
        if not whole:
            return
        at = end + 4


def png(data: bytes) -> int:
    if not data.startswith(PNG_HEAD):
        return 0
    seen = set()
    for k, (kind, _, _, right) in enumerate(png_chunks(data)):
        if not (kind.isascii() and kind.isalpha()):
            seen.add("bad name")
        elif not k and kind != b"IHDR":
            seen.add("no header chunk")
        elif kind == b"IEND":
            seen.add("end chunk")
        else:
            seen.add({True: "good sum", False: "bad sum", None: "cut"}[right])
        if seen - {"good sum"}:
            break
    return worth("png", seen)


def bmp_fields(data: bytes) -> dict[str, int]:
    """size, pixels, and as far as the bytes go, information (bytes of that header), width and height."""
    out = dict(zip(("size", "pixels"), struct.unpack_from("<I4xI", data, 2)))
    if len(data) >= 18:
        out["information"] = int.from_bytes(data[14:18], "little")
    if len(data) >= 26 and out["information"] >= 40:
        out["width"], out["height"] = (abs(x) for x in struct.unpack_from("<ii", data, 18))
    return out


def bmp(data: bytes) -> int:
    if len(data) < 14 or not data.startswith(b"BM"):
        return 0
    x = bmp_fields(data)
    extents = [x[k] for k in ("width", "height") if k in x]
    findings = {
        "bad offset": not 14 <= x["pixels"] <= PIXELS_TO or 0 < x["size"] < x["pixels"],
        "no information": "information" not in x,
        "unknown information": x.get("information") not in (12, 40, 108, 124),
        "no extent": 0 in extents,
        "large extent": max(extents, default=0) > EXTENT_TO,
        "whole": 0 < x["size"] <= len(data),
    }
    return worth("bmp", {name for name, made in findings.items() if made})


def zip_(data: bytes) -> int:
    """By the records in the last bytes, as far as a comment may push the end record forward."""
    if not data.startswith(b"PK\x03\x04"):
        return 0
    tail = data[-(0xFFFF + 22) :]
    return worth("zip", {name for name, mark in (("directory", b"PK\x01\x02"), ("directory end", b"PK\x05\x06")) if mark in tail})


def pdf(data: bytes) -> int:
    if len(data) < 8 or not data.startswith(b"%PDF-"):
        return 0
    findings = {"no version": not data[5:6].isdigit(), "object": b"obj" in data, "trailer": b"%%EOF" in data[-1024:]}
    return worth("pdf", {name for name, made in findings.items() if made})


def riff(data: bytes) -> int:
    if len(data) < 12 or not data.startswith(b"RIFF"):
        return 0
    return RIFF_KNOWN if data[8:12] in RIFF_KINDS else RIFF_OTHER


# gzip (RFC 1952): bits of the flags that announce a field after the fixed header, in the order of the fields.
_EXTRA, _NAME, _COMMENT, _RESERVED = 4, 8, 16, 0xE0


def gzip_body(data: bytes) -> int | None:
    """Where the compressed data of a member begin; None if the header is cut."""
    at, flags = 10, data[3]
    if flags & _EXTRA:
        at += 2 + int.from_bytes(data[at : at + 2], "little") if at + 2 <= len(data) else len(data)
    for bit in (_NAME, _COMMENT):
        if flags & bit:
            at = data.find(b"\0", at) + 1 or len(data) + 1
    return at if at <= len(data) else None


def gzip(data: bytes) -> int:
    if len(data) < 10 or not data.startswith(b"\x1f\x8b"):
        return 0
    if data[2] != 8 or data[3] & _RESERVED:
        return worth("gzip", {"unknown method"})
    body = gzip_body(data)
    return worth("gzip", {"cut header"} if body is None else {"no room for a trailer"} if body + 8 > len(data) else set())


def mpeg_ts(data: bytes) -> int:
    """A transport stream: the first packets of 188 bytes start with the sync byte."""
    return STREAM if len(data) >= 188 * PACKETS and data[: 188 * PACKETS : 188] == b"\x47" * PACKETS else 0


def sqlite(data: bytes) -> tuple[int, int]:
    """(score, size) from the header's page size and page count."""
    if len(data) < 32 or not data.startswith(b"SQLite format 3\0"):
        return 0, 0
    page, pages = struct.unpack_from(">H10xI", data, 16)
    page = 1 << 16 if page == 1 else page  # the one value that two bytes can't hold
    if page < 512 or page.bit_count() != 1:
        return worth("sqlite", {"bad page size"}), 0
    return worth("sqlite", {"page count"} if pages else set()), page * pages


def mp4(data: bytes) -> tuple[int, int]:
    """(score, size) of the atoms from ftyp on."""
    from .binary import atoms

    kinds, end = [], 0
    for kind, _, stop in atoms(data):
        if not re.fullmatch(rb"[A-Za-z0-9 \xa9]{4}", kind):
            break
        kinds.append(kind.decode("latin-1"))
        end = stop
    first = kinds[:1] == ["ftyp"]
    return worth("mp4", {*kinds, *([] if first else ["no ftyp"])}), end if first else 0


def office_kind(data: bytes) -> str:
    """What a ZIP's member names show: docx, xlsx, pptx, odt, ods, odp, epub, apk, jar or zip."""
    # Member names by kind.
    for name, kind in ((b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx"), (b"opendocument.text", "odt"), (b"opendocument.spreadsheet", "ods"), (b"opendocument.presentation", "odp"), (b"application/epub+zip", "epub"), (b"AndroidManifest.xml", "apk"), (b"META-INF/MANIFEST.MF", "jar")):
        if name in data:
            return kind
    return "zip"


BY_EXTENSION = {
    "jpg": jpeg, "jpeg": jpeg, "png": png, "bmp": bmp, "zip": zip_, "docx": zip_, "xlsx": zip_, "pptx": zip_, "pdf": pdf,
    "webp": riff, "avi": riff, "wav": riff, "gz": gzip, "ts": mpeg_ts, "sqlite": lambda d: sqlite(d)[0], "db": lambda d: sqlite(d)[0],
    "mp4": lambda d: mp4(d)[0], "mov": lambda d: mp4(d)[0],
}


def png_settled(data: bytes) -> int:
    """So many first bytes settle that a picture fails, whatever follows; all of them if its end decides."""
    for k, (kind, start, end, right) in enumerate(png_chunks(data)):
        if not (kind.isascii() and kind.isalpha()) or (not k and kind != b"IHDR"):
            return start
        if kind == b"IEND":
            break
        if right is False:
            return end + 4
    return len(data)


def jpeg_settled(data: bytes) -> int:
    """As for PNG: a segment's length that cannot be settles it."""
    for _, start, end in jpeg_segments(data):
        if not end:
            # fill bytes, the marker and its length
            return _MARKER.match(data, start).end() + 2
    return len(data)


def all_gaps(data: bytes, first: int, step: int, most_gap: int, settled: Callable[[bytes], int] = len) -> Iterator[tuple[int, int]]:
    """(start, length) of the gaps from a first start on, in steps; settled: so many first bytes settle that data fail, so a gap starts before their end."""
    for start in range(first, min(len(data), settled(data)), step):
        for gap in range(step, min(most_gap, len(data) - start) + 1, step):
            yield start, gap


def png_gaps(data: bytes, first: int, step: int, most_gap: int) -> Iterator[tuple[int, int]]:
    """The gaps, in the order of all_gaps, without which a picture that fails may pass.

    A gap inside a chunk's payload has to leave it a right sum, which is looked up for all starts and lengths at once; gaps
    that start in the other bytes of a chunk are all given.
    """
    def given(starts: range) -> Iterator[tuple[int, int]]:
        for s in starts:
            for gap in range(step, min(most_gap, len(data) - s) + 1, step):
                yield s, gap

    up = lambda x: max(first, -(-x // step) * step)
    yield from given(range(first, len(PNG_HEAD), step))
    for k, (kind, start, end, right) in enumerate(png_chunks(data)):
        yield from given(range(up(start - 8), min(start, len(data)), step))
        if not (kind.isascii() and kind.isalpha()) or (not k and kind != b"IHDR"):
            return
        if kind == b"IEND":
            yield from given(range(up(start), len(data), step))
            return
        # with the gap the sum ends so far on; a first chunk that is cut has no such gap
        last = min(most_gap, len(data) - end - 4)
        starts, gaps = np.arange(up(start), end if last >= step else 0, step), np.arange(step, last + 1, step)
        if len(starts):
            yield from zip(*(x.tolist() for x in _right_sums(data, start - 4, end, starts, gaps, step)))
        yield from given(range(up(end), min(end + 4, len(data)), step))
        if not right:
            return


def _right_sums(data: bytes, begin: int, end: int, starts: np.ndarray, gaps: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the gaps without which the bytes from begin to end have the sum behind them.

    A register of the sum is linear in what it has read: after a gap it differs from the register of all bytes by the difference
    at the gap's two ends, moved on by the bytes that follow. All is moved back to the first start, so each is moved once.
    """
    view, whole = memoryview(data), 0xFFFFFFFF
    places = np.arange(starts[0], starts[-1] + gaps[-1] + 1, step)
    sums, x, at = [], 0, begin
    for p in places.tolist():
        x, at = zlib.crc32(view[at:p], x), p
        sums.append(x)
    back = np.array(sums, np.uint32) ^ np.uint32(whole)
    order = np.arange(len(places))
    for bit in range(len(places).bit_length()):
        moved = (order >> bit & 1).astype(bool)
        back[moved] = moved_by(-(step << bit), back[moved])
    ends, x, at = [], 0, begin
    for e in (end + gaps).tolist():
        x, at = zlib.crc32(view[at:e], x), e
        # both are sums, so their difference is that of the registers
        ends.append(x ^ int.from_bytes(view[e : e + 4], "big"))
    ends = moved_by(int(starts[0]) - end, np.array(ends, np.uint32))
    n = len(starts)
    found = np.stack([back[:n] ^ moved_by(int(g), back[k + 1 : k + 1 + n]) == ends[k] for k, g in enumerate(gaps)], axis=1)
    a, b = np.nonzero(found)
    return starts[a], gaps[b]


@lru_cache
def _zero_bytes(power: int) -> np.ndarray:
    """What each bit of a CRC-32 register becomes by 2 to the power zero bytes."""
    if not power:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        # the sum's own table: from a register of one byte, without the inversions
        return np.array([int(b) >> 8 ^ zlib.crc32(bytes([int(b) & 255]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in bits], np.uint32)
    return _through(_tables(_zero_bytes(power - 1)), _zero_bytes(power - 1))


def _tables(columns: np.ndarray) -> np.ndarray:
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k, 1 << bit : 2 << bit] = out[k, : 1 << bit] ^ columns[8 * k + bit]
    return out


def _through(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


@lru_cache(1 << 12)
def _moved_tables(n: int) -> np.ndarray:
    columns, power = np.uint32(1) << np.arange(32, dtype=np.uint32), 0
    while n:
        if n & 1:
            columns = _through(_tables(_zero_bytes(power)), columns)
        n, power = n >> 1, power + 1
    return _tables(columns)


def moved_by(n: int, registers: np.ndarray) -> np.ndarray:
    """CRC-32 registers n zero bytes later, or earlier if n is below 0; 2 ** 32 - 1 zero bytes change none."""
    return _through(_moved_tables(n % 0xFFFFFFFF), registers)


#: By extension: what settles that data fail, and the gaps without which they may pass; the first by itself bounds the second.
SETTLED = {"png": png_settled, "jpg": jpeg_settled, "jpeg": jpeg_settled}
GAPS = {"png": png_gaps}


def score(extension: str, data: bytes) -> int | None:
    """None for kinds without a check."""
    check = BY_EXTENSION.get(extension.lower().lstrip("."))
    return None if check is None else check(data)
