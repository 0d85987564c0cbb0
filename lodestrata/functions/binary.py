"""Byte-level functions: checksums, names, compression, field arithmetic, embedded media. Plain Python on bytes.

The column forms (ending in _udf) take and give Arrow batches.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


# Checksums.


@lru_cache
def _table(poly: int, width: int, reflected: bool) -> list[int]:
    out, mask, top = [], (1 << width) - 1, 1 << (width - 1)
    for n in range(256):
        r = n if reflected else n << (width - 8)
        for _ in range(8):
            if reflected:
                r = (r >> 1) ^ (poly if r & 1 else 0)
            else:
                r = ((r << 1) ^ (poly if r & top else 0)) & mask
        out.append(r)
    return out


def crc32c(data: bytes) -> int:
    """Castagnoli, reflected."""
    table, r = _table(0x82F63B78, 32, True), 0xFFFFFFFF
    for b in data:
        r = table[(r ^ b) & 255] ^ (r >> 8)
    return r ^ 0xFFFFFFFF


def crc64_ecma(data: bytes) -> int:
    """ECMA-182, not reflected, from 0."""
    table, r = _table(0x42F0E1EBA9EA3693, 64, False), 0
    for b in data:
        r = table[(r >> 56) ^ b] ^ ((r << 8) & 0xFFFFFFFFFFFFFFFF)
    return r


def lfn_checksum(short: bytes) -> int:
    """Of the 11 bytes of an 8.3 name."""
    total = 0
    for b in short[:11]:
        total = ((total >> 1) + ((total & 1) << 7) + b) & 255
    return total


# Names and text.


def utf16(data: bytes, big: bool = False) -> str:
    """UTF-16 up to the first NUL; lone surrogates become U+FFFD."""
    units = np.frombuffer(data[: len(data) // 2 * 2], dtype=">u2" if big else "<u2")
    end = np.flatnonzero(units == 0)
    raw = units[: end[0]] if len(end) else units
    return raw.tobytes().decode("utf-16-be" if big else "utf-16-le", "replace")


def short_name(entry: bytes) -> str:
    """The 8.3 name of a FAT directory entry; a deleted entry's first character is unknown and shown as _."""
    raw = bytearray(entry[:11])
    if raw[0] == 0xE5:
        raw[0] = ord("_")
    elif raw[0] == 0x05:
        raw[0] = 0xE5
    name = lambda part: "".join(chr(b) if b < 128 else "?" for b in part).rstrip()
    base, ext = name(raw[:8]), name(raw[8:])
    return f"{base}.{ext}" if ext else base


def hexdump(data: bytes, width: int = 16) -> list[str]:
    """Lines of offset, bytes and printable characters."""
    out = []
    for at in range(0, len(data), width):
        row = data[at : at + width]
        out.append(f"{at:08x}  {row.hex(' '):<{3 * width - 1}}  {''.join(chr(b) if 32 <= b < 127 else '.' for b in row)}")
    return out


def repaired_utf8(data: bytes) -> str:
    """UTF-8 with each bad byte as ?."""
    return data.decode("utf-8", "replace").replace("�", "?")


def entropy(data: bytes) -> float:
    """Bits per byte."""
    if not data:
        return 0.0
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / len(data)
    return float(-(p * np.log2(p)).sum()) + 0.0


# NTFS.


def fixup(record: bytes, sector: int = 512) -> tuple[bytes, bool]:
    """A multi-sector record with the last two bytes of each sector restored; whether all of them carried the mark."""
    at, n = struct.unpack_from("<HH", record, 4)
    if n < 2 or at + 2 * n > len(record) or (n - 1) * sector > len(record):
        return record, False
    out, good, mark = bytearray(record), True, record[at : at + 2]
    for k in range(1, n):
        end = k * sector
        good &= record[end - 2 : end] == mark
        out[end - 2 : end] = record[at + 2 * k : at + 2 * k + 2]
    return bytes(out), good


def data_runs(raw: bytes) -> list[tuple[int | None, int]]:
    """(first cluster, clusters) of a mapping-pairs list; None marks a sparse run. Stops at malformed pairs."""
    out, at, cluster = [], 0, 0
    while at < len(raw) and raw[at]:
        n_len, n_off = raw[at] & 15, raw[at] >> 4
        end = at + 1 + n_len + n_off
        if not n_len or n_len > 8 or n_off > 8 or end > len(raw):
            break
        length = int.from_bytes(raw[at + 1 : at + 1 + n_len], "little")
        if n_off:
            cluster += int.from_bytes(raw[at + 1 + n_len : end], "little", signed=True)
            if cluster < 0:
                break
        out.append((cluster if n_off else None, length))
        at = end
    return out


def lznt1(data: bytes, size: int | None = None) -> bytes | None:
    """Decompressed data; None if it is malformed. Chunks hold 4096 bytes; the split of a back reference grows with the place."""
    out, at = bytearray(), 0
    while at + 2 <= len(data):
        header = int.from_bytes(data[at : at + 2], "little")
        if not header:
            break
        end = at + 3 + (header & 0xFFF)
        if end > len(data):
            return None
        at += 2
        if not header & 0x8000:
            out += data[at:end]
            at = end
            continue
        start = len(out)
        while at < end:
            flags, at = data[at], at + 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > end or len(out) == start:
                    return None
                pair, at = int.from_bytes(data[at : at + 2], "little"), at + 2
                shift = 12 - max(0, (len(out) - start - 1).bit_length() - 4)
                back, n = (pair >> shift) + 1, (pair & (1 << shift) - 1) + 3
                if back > len(out) - start:
                    return None
                for _ in range(n):
                    out.append(out[-back])
    return bytes(out if size is None else out[:size])


# Arithmetic in GF(2^8) with the polynomial x^8 + x^4 + x^3 + x^2 + 1.


@lru_cache
def _gf() -> tuple[np.ndarray, np.ndarray]:
    power, log, x = np.zeros(512, np.uint8), np.zeros(256, np.int64), 1
    for k in range(255):
        power[k], log[x] = x, k
        x = x << 1 ^ (0x11D if x & 0x80 else 0)
    power[255:510] = power[:255]
    return power, log


def gf_mul(a, b):
    power, log = _gf()
    a, b = np.asarray(a, np.uint8), np.asarray(b, np.uint8)
    return np.where((a == 0) | (b == 0), np.uint8(0), power[log[a] + log[b]])


def gf_div(a, b):
    power, log = _gf()
    a, b = np.asarray(a, np.uint8), np.asarray(b, np.uint8)
    if (b == 0).any():
        raise ZeroDivisionError("division by 0 in GF(2^8)")
    return np.where(a == 0, np.uint8(0), power[log[a] - log[b] + 255])


def gf_pow2(n: int) -> int:
    """2 to the n."""
    return int(_gf()[0][n % 255])


# Embedded media.


def embedded_jpeg(data: bytes, most: int = 512 * 1024) -> tuple[int, int] | None:
    """(offset, length) of the first JPEG inside the first bytes that passes its check."""
    from .validators import jpeg

    at = data.find(b"\xff\xd8\xff", 0, most)
    while at >= 0:
        end = data.find(b"\xff\xd9", at + 2, most)
        if end >= 0 and jpeg(data[at : end + 2]) >= 50:
            return at, end + 2 - at
        at = data.find(b"\xff\xd8\xff", at + 1, most)
    return None


def embedded_jpegs(data: bytes, most_hits: int = 24, prefix: int = 2 << 20, most_size: int = 512 * 1024) -> list[tuple[int, int]]:
    """(offset, length) of the JPEGs of a thumbnail cache."""
    out, at = [], data.find(b"\xff\xd8\xff", 0, prefix)
    while at >= 0 and len(out) < most_hits:
        end = data.find(b"\xff\xd9", at + 2, min(prefix, at + most_size))
        if end < 0:
            at = data.find(b"\xff\xd8\xff", at + 1, prefix)
            continue
        out.append((at, end + 2 - at))
        at = data.find(b"\xff\xd8\xff", end + 2, prefix)
    return out


def exif_time(data: bytes) -> str:
    """The original time of a JPEG's first image directory, else its modification time; empty without one."""
    at = data.find(b"Exif\0\0")
    if at < 0 or at + 14 > len(data):
        return ""
    base = at + 6
    order = {b"II": "<", b"MM": ">"}.get(data[base : base + 2])
    if not order:
        return ""
    ifd = base + struct.unpack_from(f"{order}I", data, base + 4)[0]
    if ifd + 2 > len(data):
        return ""
    found = {}
    for k in range(struct.unpack_from(f"{order}H", data, ifd)[0]):
        entry = ifd + 2 + 12 * k
        if entry + 12 > len(data):
            break
        tag, kind, n, value = struct.unpack_from(f"{order}HHII", data, entry)
        if tag in (0x9003, 0x0132) and kind == 2 and n >= 19:
            found[tag] = data[base + value : base + value + 19].decode("latin-1")
    return found.get(0x9003, found.get(0x0132, ""))


def atoms(data: bytes, start: int = 0, end: int | None = None):
    """(kind, start of payload, end) of each MP4 atom."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def mp4_cover(data: bytes) -> bytes | None:
    """The cover picture in an MP4's metadata, JPEG or PNG."""
    todo = [(0, len(data))]
    while todo:
        start, end = todo.pop()
        for kind, s, e in atoms(data, start, end):
            if kind in (b"moov", b"udta", b"ilst", b"trak", b"covr", b"thmb"):
                todo.append((s, e))
            elif kind == b"meta":
                todo.append((s + 4, e))
            if kind in (b"data", b"covr", b"thmb"):
                for skip in (0, 8, 12, 16):
                    if data[s + skip : s + skip + 3] == b"\xff\xd8\xff" or data[s + skip : s + skip + 4] == b"\x89PNG":
                        return data[s + skip : e]
    return None


def sps_size(sps: bytes) -> tuple[int, int] | None:
    """(width, height) in whole macroblocks of an H.264 sequence parameter set, without cropping."""
    raw = sps.replace(b"\0\0\3", b"\0\0")
    bits = "".join(f"{b:08b}" for b in raw[1:])
    at = 24

    def ue() -> int:
        nonlocal at
        zeros = 0
        while bits[at + zeros] == "0":
            zeros += 1
        value = int(bits[at + zeros : at + 2 * zeros + 1], 2) - 1
        at += 2 * zeros + 1
        return value

    def se() -> int:
        value = ue()
        return (value + 1) // 2 if value & 1 else -(value // 2)

    try:
        profile = raw[1]
        ue()
        if profile in (100, 110, 122, 244, 44, 83, 86, 118, 128, 134, 135, 138, 139):
            chroma = ue()
            at += chroma == 3
            ue(), ue()
            at += 1
            matrix, at = bits[at], at + 1
            if matrix == "1":
                for k in range(8 if chroma != 3 else 12):
                    present, at = bits[at], at + 1
                    last = after = 8
                    for _ in range((16 if k < 6 else 64) if present == "1" else 0):
                        if after:
                            after = (last + se()) % 256
                        last = after or last
        ue()
        order = ue()
        if order == 0:
            ue()
        elif order == 1:
            at += 1
            se(), se()
            for _ in range(ue()):
                se()
        ue()
        at += 1
        width, height = ue() + 1, ue() + 1
        return width * 16, height * 16 * (2 - int(bits[at]))
    except (IndexError, ValueError):
        return None


def video_preview(data: bytes) -> tuple[str, bytes | None, str]:
    """(kind, picture, note) of a video: its cover, else a picture inside it, else a note on its frames; kind is image or note."""
    picture = mp4_cover(data)
    if picture is None and (found := embedded_jpeg(data)):
        picture = data[found[0] : sum(found)]
    if picture is not None:
        return "image", picture, ""
    at = next((m.start() for m in _SPS.finditer(data)), None)
    size = sps_size(data[at + 4 : at + 260]) if at is not None else None
    return "note", None, f"{size[0]}x{size[1]}" if size else "no picture"


#: A start code and a sequence parameter set of H.264.
_SPS = re.compile(rb"\x00\x00\x00\x01[\x27\x47\x67]")


def _binary_udf(f, kind: str):
    @F.pandas_udf(kind)
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else f(bytes(x)))

    return run


def register(spark) -> None:
    """Makes the byte functions SQL functions."""
    from . import validators

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for name, f, kind in (
        ("byte_entropy", entropy, "double"), ("crc32c", crc32c, "long"), ("crc64_ecma", lambda x: signed(crc64_ecma(x)), "long"), ("lznt1", lznt1, "binary"),
        ("utf16_text", utf16, "string"), ("exif_time", exif_time, "string"), ("mp4_cover", mp4_cover, "binary"), ("hexdump", lambda x: "\n".join(hexdump(x)), "string"),
    ):
        spark.udf.register(name, _binary_udf(f, kind))
    for name, f in validators.BY_EXTENSION.items():
        spark.udf.register(f"score_{name}", _binary_udf(f, "int"))
