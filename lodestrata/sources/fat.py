"""FAT12, FAT16, FAT32 and exFAT: geometry, directories with long names, cluster chains.

Whole volumes are read as plans. The allocation table becomes stretches of clusters that follow one another, stretches become
chains by list ranking, and directories are read level by level, those of all volumes at once.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import lfn_checksum, short_name, utf16
from .volumes import CHUNK, blocks_at, cut, dealt, first_sectors, runs_of, spanned, table

# End-of-chain and bad-cluster marks by width.
END_FROM = {12: 0xFF8, 16: 0xFFF8, 32: 0x0FFFFFF8}
BAD = {12: 0xFF7, 16: 0xFFF7, 32: 0x0FFFFFF7}
CONFIDENCE, DELETED_CONFIDENCE, NO_CHAIN = 95, 60, 35


@dataclass(frozen=True)
class Volume:
    bits: int
    sector: int
    per_cluster: int
    fat_at: int
    root_at: int
    root_entries: int
    root_cluster: int
    data_at: int
    serial: int
    exfat: bool = False


def dos_unix(date: int, time: int) -> int:
    """As times.dos_to_unix, for rows in Python."""
    import datetime

    month, day = date >> 5 & 15, date & 31
    if not 1 <= month <= 12 or not 1 <= day <= 31:
        return 0
    first = datetime.date(1980 + (date >> 9), month, 1).toordinal() - datetime.date(1970, 1, 1).toordinal()
    return (first + day - 1) * 86400 + (time >> 11) * 3600 + (time >> 5 & 63) * 60 + (time & 31) * 2


def volume(boot: bytes) -> Volume | None:
    """Sectors are relative to the volume."""
    if boot[3:11] == b"EXFAT   ":
        fat, _, heap, _, root, serial = struct.unpack_from("<IIIIII", boot, 80)
        return Volume(32, 1 << boot[108], 1 << boot[109], fat, 0, 0, root, heap, serial, True)
    sector, per, reserved, fats, entries, small, _, size16 = struct.unpack_from("<HBHBHHBH", boot, 11)
    if sector not in (512, 1024, 2048, 4096) or not per or not fats:
        return None
    size = size16 or struct.unpack_from("<I", boot, 36)[0]
    total = small or struct.unpack_from("<I", boot, 32)[0]
    root_at = reserved + fats * size
    data_at = root_at + -(-entries * 32 // sector)
    clusters = (total - data_at) // per
    bits = 32 if not size16 else 12 if clusters < 4085 else 16
    serial = struct.unpack_from("<I", boot, 67 if bits == 32 else 39)[0]
    return Volume(bits, sector, per, reserved, root_at, entries, struct.unpack_from("<I", boot, 44)[0] if bits == 32 else 0, data_at, serial)


def fat_entry(table: bytes, bits: int, cluster: int) -> int:
    if bits == 12:
        at = cluster * 3 // 2
        pair = int.from_bytes(table[at : at + 2], "little")
        return pair >> 4 if cluster & 1 else pair & 0xFFF
    width = bits // 8
    return int.from_bytes(table[cluster * width : (cluster + 1) * width], "little") & (0x0FFFFFFF if bits == 32 else 0xFFFF)


def chain(entry: Callable[[int], int], bits: int, first: int, most: int = 1 << 20) -> list[int]:
    """The clusters of a chain, up to its end, a bad or free cluster, or the first repetition."""
    out, seen, at = [], set(), first
    while at >= 2 and at < BAD[bits] and at not in seen and len(out) < most:
        out.append(at)
        seen.add(at)
        at = entry(at)
    return out


def chain_runs(clusters: list[int], v: Volume, volume_sector: int = 0) -> list[tuple[int, int]]:
    """(first sector, sectors), neighbours merged."""
    out: list[list[int]] = []
    for c in clusters:
        at = volume_sector + v.data_at + (c - 2) * v.per_cluster
        if out and out[-1][0] + out[-1][1] == at:
            out[-1][1] += v.per_cluster
        else:
            out.append([at, v.per_cluster])
    return [tuple(x) for x in out]


def directory(data: bytes) -> Iterator[dict]:
    """Entries of a FAT directory: live and deleted files and folders with their long names, if these belong to them."""
    parts: list[tuple[int, int, str]] = []
    for at in range(0, len(data) - 31, 32):
        e = data[at : at + 32]
        if e[0] == 0:
            return
        if e[11] == 0x0F:
            parts.append((e[0] & 0x1F, e[13], utf16(e[1:11] + e[14:26] + e[28:32]).rstrip("￿")))
            continue
        deleted, pieces, parts = e[0] == 0xE5, parts, []
        if e[11] & 0x08 or e[:2] in (b". ", b".."):
            continue
        fits = pieces and (deleted or all(c == lfn_checksum(e) for _, c, _ in pieces))
        # deleted pieces have lost their number but stand in order, last part first
        name = "".join(p for _, _, p in (reversed(pieces) if deleted else sorted(pieces))) if fits else short_name(e)
        time, date = struct.unpack_from("<HH", e, 22)
        ctime, cdate = struct.unpack_from("<HH", e, 14)
        yield {
            "name": name, "deleted": deleted, "is_directory": bool(e[11] & 0x10), "first_cluster": struct.unpack_from("<H", e, 20)[0] << 16 | struct.unpack_from("<H", e, 26)[0],
            "size_bytes": struct.unpack_from("<I", e, 28)[0], "created_at": dos_unix(cdate, ctime), "modified_at": dos_unix(date, time), "contiguous": False,
        }


def exfat_directory(data: bytes) -> Iterator[dict]:
    """Entry sets of an exFAT directory: a file entry, its stream entry and names; cleared in-use bits mark deleted sets."""
    at = 0
    while at + 32 <= len(data):
        kind = data[at]
        if kind == 0:
            return
        if kind & 0x7F != 0x05:
            at += 32
            continue
        n, attrs = data[at + 1], struct.unpack_from("<H", data, at + 4)[0]
        ctime, cdate, mtime, mdate = struct.unpack_from("<HHHH", data, at + 8)
        stream = data[at + 32 : at + 64]
        if n < 2 or len(stream) < 32 or stream[0] & 0x7F != 0x40:
            at += 32
            continue
        names = b"".join(data[at + 32 * k + 2 : at + 32 * k + 32] for k in range(2, n + 1) if data[at + 32 * k : at + 32 * k + 1] and data[at + 32 * k] & 0x7F == 0x41)
        first, size = struct.unpack_from("<IQ", stream, 20)
        yield {
            "name": utf16(names)[: stream[3]], "deleted": not kind & 0x80, "is_directory": bool(attrs & 0x10), "first_cluster": first, "size_bytes": size,
            "created_at": dos_unix(cdate, ctime), "modified_at": dos_unix(mdate, mtime), "contiguous": bool(stream[1] & 2),
        }
        at += 32 * (n + 1)


# Volumes as tables.

#: Bytes of a table that are read as one piece; a multiple of 12, so that entries of 12, 16 and 32 bits end with it.
PIECE = (1 << 16) // 12 * 12
#: Clusters of a block in which a cluster looks for its stretch.
BUCKET = 4096
#: The most bytes of a FAT and of an exFAT directory.
MOST = 65_536 * 32, 256 << 20
GEOMETRY = "volume_id string, bits int, sector long, per long, fat_at long, fat_bytes long, root_at long, root_entries long, root_cluster long, data_at long, exfat boolean, last long"


def geometry(chunks: DataFrame, chunk: int = CHUNK, start: int = 0) -> DataFrame:
    """Geometry of each volume with a boot sector; last is the number of the last cluster."""

    def parse(volume_id: str, boot: bytes) -> Iterator[tuple]:
        v = volume(boot) if len(boot) >= 512 and (boot[510:512] == b"\x55\xaa" or boot[3:11] == b"EXFAT   ") else None
        if v and v.exfat:
            size, clusters = struct.unpack_from("<I", boot, 84)[0], struct.unpack_from("<I", boot, 92)[0]
            yield volume_id, 32, v.sector, v.per_cluster, v.fat_at, size * v.sector, 0, 0, v.root_cluster, v.data_at, True, clusters + 1
        elif v:
            size = struct.unpack_from("<H", boot, 22)[0] or struct.unpack_from("<I", boot, 36)[0]
            total = struct.unpack_from("<H", boot, 19)[0] or struct.unpack_from("<I", boot, 32)[0]
            yield volume_id, v.bits, v.sector, v.per_cluster, v.fat_at, size * v.sector, v.root_at, v.root_entries, v.root_cluster, v.data_at, False, (total - v.data_at) // v.per_cluster + 1

    return table(first_sectors(chunks, start, 512, chunk), ["volume_id", "data"], parse, GEOMETRY)


def table_pieces(chunks: DataFrame, volumes: DataFrame, chunk: int = CHUNK, start: int = 0) -> DataFrame:
    """(volume_id, bits, last, piece, data): the first allocation table of each volume."""
    size = min(PIECE, chunk // 12 * 12)
    used = F.least("fat_bytes", F.ceil((F.col("last") + 1) * F.col("bits") / 8))
    rows = volumes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((used - 1) / size))))
    at = F.lit(start) + F.col("fat_at") * F.col("sector") + F.col("piece") * size
    wanted = rows.select("volume_id", "bits", "last", "piece", at.alias("byte_offset"), F.least(F.lit(size), used - F.col("piece") * size).cast("long").alias("length"))
    return blocks_at(wanted, chunks, chunk).select("volume_id", "bits", "last", (F.col("piece") * size * 8 / F.col("bits")).cast("long").alias("first"), "data")


def entries_of(data: bytes, bits: int) -> np.ndarray:
    """The entries of a piece of a table."""
    if bits == 12:
        x = np.frombuffer(data[: len(data) // 3 * 3] + (data[len(data) // 3 * 3 :] + bytes(3))[: 3 * bool(len(data) % 3)], np.uint8).astype(np.int64).reshape(-1, 3)
        return np.stack([x[:, 0] | (x[:, 1] & 15) << 8, x[:, 1] >> 4 | x[:, 2] << 4], axis=1).ravel()[: len(data) * 2 // 3]
    return np.frombuffer(data[: len(data) // (bits // 8) * (bits // 8)], f"<u{bits // 8}").astype(np.int64) & (0x0FFFFFFF if bits == 32 else 0xFFFF)


def stretches(volume_id: str, bits: int, last: int, first: int, data: bytes) -> Iterator[tuple]:
    """(volume_id, piece's first entry, start, n, next): the stretches of clusters of a piece that follow one another; next is the
    cluster that the last one names, or null at an end, a bad or an impossible number."""
    value = entries_of(data, bits)
    number = first + np.arange(len(value))
    used = (value != 0) & (number >= 2) & (number <= last)
    goes_on = used[1:] & used[:-1] & (value[:-1] == number[1:]) if len(value) else np.zeros(0, bool)
    begins = np.flatnonzero(used & ~np.concatenate([[False], goes_on])[: len(used)])
    ends = np.flatnonzero(used & ~np.concatenate([goes_on, [False]])[: len(used)])
    for a, b in zip(begins.tolist(), ends.tolist()):
        to = int(value[b])
        yield volume_id, first, first + a, b - a + 1, to if 2 <= to <= last and to < BAD[bits] else None


def stretches_of(pieces: DataFrame) -> DataFrame:
    """(volume_id, start, n, next) of tables, cut where a chain enters the middle of a stretch; a free cluster that a chain names is one too.

    Stretches don't cross pieces, so what a target lies in is found by a window over its piece.
    """
    rows = cut(table(pieces, ["volume_id", "bits", "last", "first", "data"], stretches, "volume_id string, piece long, start long, n long, next long"))
    spans = pieces.select("volume_id", F.col("first").alias("piece"), F.floor(F.octet_length("data") * 8 / F.col("bits")).alias("entries")).distinct()
    size = spans.groupBy("volume_id").agg(F.max("entries").alias("entries"))  # all pieces of a table but the last have one size
    named = rows.where("next is not null").select("volume_id", F.col("next").alias("start")).distinct().join(size, "volume_id").select("volume_id", (F.floor(F.col("start") / F.col("entries")) * F.col("entries")).alias("piece"), "start")
    w = Window.partitionBy("volume_id", "piece").orderBy("start", F.col("n").isNull())
    both = rows.withColumn("own", F.struct("start", "n", "next")).unionByName(named, allowMissingColumns=True).withColumn("own", F.last("own", ignorenulls=True).over(w))
    inside = F.col("start") < F.col("own.start") + F.col("own.n")
    both = both.where(F.col("n").isNotNull() | F.col("own").isNull() | (F.col("start") > F.col("own.start")))
    after = F.lead("start").over(Window.partitionBy("volume_id", "piece").orderBy("start"))
    both = both.withColumn("_after", after)
    end = F.col("own.start") + F.col("own.n")
    stop = F.when(F.col("_after") < end, F.col("_after")).otherwise(end)
    known = F.col("own").isNotNull() & inside
    return both.select("volume_id", "start", F.when(known, stop - F.col("start")).otherwise(1).alias("n"), F.when(known, F.when(stop < end, stop).otherwise(F.col("own.next"))).alias("next"))


def ranked(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of stretches: (volume_id, start, n, chain, pos) and (volume_id, chain, length, to_chain, to_pos).

    A stretch follows the smallest one that names it; a chain that is named besides is where other chains go on (to_chain,
    to_pos), and so is a circle's first stretch. List ranking by pointer doubling: each round every stretch takes over what
    the one it points at has seen, so a chain of millions takes a logarithm of rounds. What is left once the rounds have passed
    the stretches of the largest volume runs in a circle, which is opened at its smallest stretch, and ranked again.
    """
    key = ["volume_id", "start"]
    before = runs.where("next is not null").groupBy("volume_id", F.col("next").alias("start")).agg(F.min("start").alias("up"))
    rows = runs.join(before, key, "left").join(runs.select("volume_id", F.col("start").alias("up"), F.col("n").alias("_n")), ["volume_id", "up"], "left")
    # seen: what lies before a stretch, in clusters; least: the smallest stretch met
    state = cut(rows.select(*key, "n", "next", "up", F.coalesce("_n", F.lit(0)).alias("pos"), F.coalesce("up", "start").alias("chain"), F.least("start", F.coalesce("up", "start")).alias("least")))
    most, done, passed = state.groupBy("volume_id").count().agg(F.max("count")).first()[0] or 0, None, 1

    def doubled(state: DataFrame) -> DataFrame:
        open_ = state.where("up is not null").withColumnRenamed("up", "_at")
        there = state.select("volume_id", F.col("start").alias("_at"), F.col("up").alias("_up"), F.col("pos").alias("_pos"), F.col("chain").alias("_chain"), F.col("least").alias("_least"))
        moved = open_.join(there, ["volume_id", "_at"]).select(*key, "n", "next", F.col("_up").alias("up"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_chain").alias("chain"), F.least("least", "_least").alias("least"))
        return cut(state.where("up is null").unionByName(moved))

    while state.where("up is not null").limit(1).count():
        if passed > most and done is None:
            # all that is open now lies in circles, and has seen its whole circle
            circle = state.where("up is not null").select(*key, "n", "next", "least")
            prior = circle.select("volume_id", F.col("next").alias("start"), F.col("start").alias("_up"), F.col("n").alias("_n"))
            again = circle.join(prior, key).withColumn("_up", F.when(F.col("start") != F.col("least"), F.col("_up")))
            again = again.select(*key, "n", "next", F.col("_up").alias("up"), F.when(F.col("_up").isNotNull(), F.col("_n")).otherwise(0).alias("pos"), F.coalesce("_up", "start").alias("chain"), "least")
            done, state = state.where("up is null"), cut(again)
            continue
        state, passed = doubled(state), passed * 2
    state = state if done is None else done.unionByName(state)
    places = cut(state.select(*key, "n", "next", "chain", "pos"))
    last = places.groupBy("volume_id", "chain").agg(F.max_by(F.struct("n", "pos", "next"), "pos").alias("x")).select("volume_id", "chain", (F.col("x.pos") + F.col("x.n")).alias("length"), F.col("x.next").alias("_next"))
    to = places.select("volume_id", F.col("start").alias("_next"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    return places.drop("next"), cut(last.join(to, ["volume_id", "_next"], "left").drop("_next"))


def chain_extents(items: DataFrame, key: list[str], places: DataFrame, ends: DataFrame) -> DataFrame:
    """(key, logical, cluster, n): the clusters of items (key, volume_id, first, want: clusters or null for all, guess), in order.

    A chain goes on where its end points, until it has what is wanted or meets a cluster that it had; each such leap is a round.
    A first cluster without an entry stands for guess clusters.
    """
    names = [*dict.fromkeys([*key, "volume_id"])]
    exact = items.join(places.select("volume_id", F.col("start").alias("first"), "chain", "pos"), ["volume_id", "first"], "left")
    lost = exact.where("chain is null").drop("chain", "pos")
    # a first cluster in the middle of a stretch: both meet in blocks of BUCKET clusters
    long = places.where("n > 1").select("volume_id", "start", "n", "chain", F.col("pos").alias("_pos"), F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("start") + F.col("n") - 1) / BUCKET))).alias("_bucket"))
    inner = lost.withColumn("_bucket", F.floor(F.col("first") / BUCKET)).join(long, ["volume_id", "_bucket"]).where("first > start and first < start + n")
    inner = inner.select(*lost.columns, "chain", (F.col("_pos") + F.col("first") - F.col("start")).alias("pos"))
    visits = cut(exact.where("chain is not null").unionByName(inner).join(ends, ["volume_id", "chain"]))
    alone = lost.join(visits.select(*key), key, "left_anti").select(*names, "want", F.lit(0).cast("long").alias("logical"), F.col("first").alias("cluster"), F.col("guess").alias("n"))
    visits = visits.select(*names, "want", "chain", F.col("pos").alias("a"), F.col("length").alias("b"), F.lit(0).cast("long").alias("base"), "to_chain", "to_pos", F.array(F.struct("chain", "pos")).alias("seen"))
    out = []
    while True:
        out.append(visits.select(*names, "want", "chain", "a", "b", "base"))
        more = visits.withColumn("base", F.col("base") + F.col("b") - F.col("a")).where("to_chain is not null and (want is null or base < want)")
        met = F.array_min(F.transform(F.filter("seen", lambda x: x["chain"] == F.col("to_chain")), lambda x: x["pos"]))
        more = more.withColumn("_met", met).where("_met is null or to_pos < _met")
        if not more.limit(1).count():
            break
        more = more.select(*names, "want", F.col("to_chain").alias("chain"), F.col("to_pos").alias("a"), "base", "seen", "_met")
        more = more.join(ends, ["volume_id", "chain"])
        # a part that was met before ends the chain
        visits = cut(more.select(*names, "want", "chain", "a", F.coalesce("_met", "length").alias("b"), "base", F.when(F.col("_met").isNull(), F.col("to_chain")).alias("to_chain"), "to_pos", F.concat("seen", F.array(F.struct("chain", F.col("a").alias("pos")))).alias("seen")))
    all_ = reduce(DataFrame.unionByName, out)
    rows = all_.join(places.select("volume_id", "chain", "start", "n", "pos"), ["volume_id", "chain"]).where("pos < b and pos + n > a")
    s = F.greatest("pos", "a")
    rows = rows.select(*names, "want", (F.col("base") + s - F.col("a")).alias("logical"), (F.col("start") + s - F.col("pos")).alias("cluster"), (F.least(F.col("pos") + F.col("n"), F.col("b")) - s).alias("n"))
    rows = rows.unionByName(alone)
    rows = rows.withColumn("n", F.when(F.col("want").isNotNull(), F.least("n", F.col("want") - F.col("logical"))).otherwise(F.col("n"))).where("n > 0")
    return rows.select(*names, "logical", "cluster", "n")


FOUND = "volume_id string, dir long, above string, depth int, nth int, name string, deleted boolean, is_directory boolean, first long, size_bytes long, created_at long, modified_at long, contiguous boolean"


def files(chunks: DataFrame, chunk: int = CHUNK, sector: int = 512, start: int = 0, most_depth: int = 64) -> DataFrame:
    """File and folder rows of all FAT12, FAT16, FAT32 and exFAT volumes; a volume's file system begins at byte `start`.

    volume_id, name, path, is_directory, size_bytes, created_at, modified_at, runs, start_sector, end_sector, status, confidence,
    source. Directories are read level by level, all of one level at once. A deleted file whose chain is cleared is taken to lie
    in one piece from its first cluster.
    """
    volumes = cut(geometry(chunks, chunk, start))
    places, ends = ranked(stretches_of(table_pieces(chunks, volumes, chunk, start)))
    size = 1 << min(chunk, CHUNK).bit_length() - 1
    unit = F.col("sector") * F.col("per")
    shape = volumes.select("volume_id", "bits", "exfat", "sector", "per", "data_at", "last")

    def extents(items: DataFrame, key: list[str]) -> DataFrame:
        """Clusters of entries, by chain or straight on."""
        known = items.where(F.col("first").between(2, F.col("last")))
        n = F.ceil(F.col("size_bytes") / unit)
        known = known.withColumn("want", F.when((F.col("size_bytes") > 0) & (~F.col("is_directory") | F.col("exfat")), n))
        straight = known.where("contiguous")
        # a deleted file whose chain is cleared
        chained = known.where("not contiguous").withColumn("guess", F.when(F.col("deleted"), F.coalesce("want", F.lit(0))).otherwise(1).cast("long"))
        ahead = straight.where("want > 0").select(*dict.fromkeys([*key, "volume_id"]), F.lit(0).cast("long").alias("logical"), F.col("first").alias("cluster"), F.col("want").alias("n"))
        rows = chain_extents(chained.select(*dict.fromkeys([*key, "volume_id"]), "first", "want", "guess"), key, places, ends)
        return rows.unionByName(ahead.select(*rows.columns))

    def parse(v: str, dir_: int, path: str, depth: int, exfat: bool, data: bytes) -> Iterator[tuple]:
        for k, e in enumerate(exfat_directory(data) if exfat else directory(data)):
            yield v, dir_, path, depth, k, e["name"], e["deleted"], e["is_directory"], e["first_cluster"], e["size_bytes"], e["created_at"], e["modified_at"], e["contiguous"]

    # the fixed root directories, and the first clusters of the others
    fixed = volumes.where("root_cluster = 0").select("volume_id", F.lit(0).cast("long").alias("dir"), F.lit("").alias("path"), F.lit(0).alias("depth"), "exfat", (F.lit(start) + F.col("root_at") * F.col("sector")).alias("at"), (F.col("root_entries") * 32).alias("bytes"), F.lit(0).cast("long").alias("place"))
    roots = volumes.where("root_cluster > 0").select("volume_id", F.col("root_cluster").alias("dir"), F.lit("").alias("path"), F.lit(0).alias("depth"), F.col("root_cluster").alias("first"), F.lit(0).cast("long").alias("size_bytes"), F.lit(True).alias("is_directory"), F.lit(False).alias("deleted"), F.lit(False).alias("contiguous"))
    todo, seen, levels = cut(roots), None, []
    while True:
        own = extents(todo.join(shape, "volume_id"), ["volume_id", "dir"]).join(todo.select("volume_id", "dir", "path", "depth"), ["volume_id", "dir"]).join(shape, "volume_id")
        at = F.lit(start) + (F.col("data_at") + (F.col("cluster") - 2) * F.col("per")) * F.col("sector")
        spans = own.select("volume_id", "dir", "path", "depth", "exfat", at.alias("at"), (F.col("n") * unit).alias("bytes"), (F.col("logical") * unit).alias("place"))
        spans = spans.unionByName(fixed) if not levels else spans
        spans = spans.where("bytes > 0").where(F.col("place") < F.when(F.col("exfat"), MOST[1]).otherwise(MOST[0]))
        parts = spans.withColumn("skip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))))
        wanted = parts.select("volume_id", "dir", "path", "depth", "exfat", (F.col("place") + F.col("skip")).alias("place"), (F.col("at") + F.col("skip")).alias("byte_offset"), F.least(F.lit(size), F.col("bytes") - F.col("skip")).alias("length"))
        whole = blocks_at(wanted, chunks, chunk).groupBy("volume_id", "dir", "path", "depth", "exfat").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY place)").alias("data"))
        found = cut(table(whole, ["volume_id", "dir", "path", "depth", "exfat", "data"], parse, FOUND))
        levels.append(found)
        seen = todo.select("volume_id", "dir") if seen is None else seen.unionByName(todo.select("volume_id", "dir"))
        below = found.where((F.col("depth") < most_depth) & F.col("is_directory") & ~F.col("deleted") & (F.col("first") >= 2))
        below = below.select("volume_id", F.col("first").alias("dir"), F.concat("above", F.lit("/"), "name").alias("path"), (F.col("depth") + 1).alias("depth"), "first", "size_bytes", "is_directory", "deleted", "contiguous")
        below = below.groupBy("volume_id", "dir").agg(F.min(F.struct(*[c for c in below.columns if c not in ("volume_id", "dir")])).alias("x")).select("volume_id", "dir", "x.*")
        todo = cut(below.join(seen, ["volume_id", "dir"], "left_anti"))
        if not todo.limit(1).count():
            break

    key = ["volume_id", "dir", "nth"]
    rows = reduce(DataFrame.unionByName, levels).join(shape, "volume_id")
    per = F.col("per") * F.col("sector") / sector
    spans = extents(rows, key).join(shape, "volume_id")
    runs = runs_of(spans.select(*key, (F.col("logical") * per).cast("long").alias("logical"), (F.lit(start // sector) + F.col("data_at") * F.col("sector") / sector + (F.col("cluster") - 2) * per).cast("long").alias("start_sector"), (F.col("n") * per).cast("long").alias("sector_count")), key)
    first, last = spanned(F.col("runs"))
    return rows.join(dealt(runs), key, "left").select(
        "volume_id", "name", F.concat("above", F.lit("/"), "name").alias("path"), "is_directory", "size_bytes", "created_at", "modified_at", "runs", first.alias("start_sector"), last.alias("end_sector"),
        F.when(F.col("deleted"), 0).otherwise(1).alias("status"), F.when(~F.col("deleted"), CONFIDENCE).when(F.col("runs").isNull(), NO_CHAIN).otherwise(DELETED_CONFIDENCE).alias("confidence"),
        F.when(F.col("exfat"), "exfat").otherwise("fat").alias("source"),
    )


def free_clusters(table: bytes, bits: int, clusters: int) -> list[int]:
    return [c for c in range(2, clusters + 2) if fat_entry(table, bits, c) == 0]
