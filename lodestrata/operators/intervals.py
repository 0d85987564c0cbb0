"""Sector intervals: merging, gaps, overlap joins. Intervals are half open, [start, end)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..schema import DUPLICATE

#: Confidence of a carved copy of a known file, and of a carved copy of a carved file.
COPY_CONFIDENCE, CARVE_COPY_CONFIDENCE = 35, 30
#: Sectors of a bucket of the overlap join, and of a stretch that one window sees.
BUCKET, STRETCH = 1 << 14, 1 << 20


def _in_stretches(df: DataFrame, at: str, width: int) -> DataFrame:
    return df.withColumn("_stretch", F.floor(F.col(at) / F.lit(width)))


def _earlier(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str, own: bool) -> DataFrame:
    """earlier_max of rows that have _stretch; the rows stay dealt by keys and _stretch."""
    tops = rows.groupBy(*keys, "_stretch").agg(F.max(value).alias("_top"))
    tops = tops.withColumn("_top", F.max("_top").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.max(value).over(Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    return rows.withColumn("_inside", inside).join(tops.where("_top is not null"), [*keys, "_stretch"], "left").withColumn(out, F.greatest("_inside", "_top")).drop("_inside", "_top")


def earlier_max(df: DataFrame, keys: list[str], at: str, order: list[str], value: Column | str, out: str, width: int) -> DataFrame:
    """df with the largest value of the rows before a row in order, within keys.

    order starts with at. Rows are dealt by stretches of `width` of at: windows see one stretch, and one number of each
    stretch goes on to later ones. So a key with any number of rows is shared by many tasks. Keys are not null.
    """
    return _earlier(_in_stretches(df, at, width), keys, order, value if isinstance(value, Column) else F.col(value), out, False).drop("_stretch")


def components(df: DataFrame, keys: list[str], start: str, reach: Column | str, order: list[str], out: str, width: int, touching: bool = True) -> DataFrame:
    """df with the start of the group of overlapping (or touching) spans that a row belongs to, as out."""
    rows = _earlier(_in_stretches(df, start, width), keys, order, reach if isinstance(reach, Column) else F.col(reach), "_reached", False)
    apart = F.col(start) > F.col("_reached") if touching else F.col(start) >= F.col("_reached")
    return _earlier(rows, keys, order, F.when(F.col("_reached").isNull() | apart, F.col(start)), out, True).drop("_reached", "_stretch")


def merge(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = STRETCH) -> DataFrame:
    """The unions of intervals that overlap or touch, within keys."""
    grouped = components(df.where(F.col(start) < F.col(end)).select(*keys, start, end), keys, start, end, [start, end], "_group", width)
    return grouped.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_group")


def total_length(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    return merge(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("length"))


def islands(df: DataFrame, keys: list[str], value: str, width: int = STRETCH) -> DataFrame:
    """Runs of consecutive values as [start, end), within keys; repeated values count once."""
    grouped = components(df.select(*keys, value).distinct(), keys, value, F.col(value) + 1, [value], "_group", width)
    return grouped.groupBy(*keys, "_group").agg(F.min(value).cast("long").alias("start"), (F.max(value) + 1).cast("long").alias("end")).drop("_group")


def gaps(df: DataFrame, keys: list[str], value: str, width: int = STRETCH) -> DataFrame:
    """The missing values between the smallest and the largest one, as [start, end)."""
    found = earlier_max(df.select(*keys, value).distinct(), keys, value, [value], value, "_last", width).where(F.col(value) > F.col("_last") + 1)
    return found.select(*keys, (F.col("_last") + 1).cast("long").alias("start"), F.col(value).cast("long").alias("end"))


def bucketed(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """df with a row for each bucket that [start, end) touches, as _bucket."""
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l_span: tuple[str, str], r_span: tuple[str, str], condition: Column | None = None, width: int = BUCKET) -> DataFrame:
    """Pairs whose intervals overlap: an equi join on buckets; each pair is made in the first bucket they share."""
    a, b = bucketed(left, *l_span, width), bucketed(right, *r_span, width)
    (ls, le), (rs, re) = ([F.col(x) for x in l_span], [F.col(x) for x in r_span])
    first = F.greatest(F.floor(ls / width), F.floor(rs / width))
    joined = a.join(b, [*keys, "_bucket"]).where((ls < re) & (rs < le) & (F.col("_bucket") == first))
    return (joined if condition is None else joined.where(condition)).drop("_bucket")


def mark_copies(carved: DataFrame, known: DataFrame, keys: list[str], width: int = BUCKET) -> DataFrame:
    """Carved files that overlap a known file by at least half of the shorter one become copies of the first such file.

    Both have id, path, start_sector, end_sector (inclusive), source, confidence. All overlaps count, also with a long
    file that starts before others.
    """
    spans = lambda df, p: df.select(*keys, F.col("id").alias(f"{p}id"), F.col("path").alias(f"{p}path"), F.col("start_sector").alias(f"{p}s"), (F.col("end_sector") + 1).alias(f"{p}e"))
    shared = F.least("le", "re") - F.greatest("ls", "rs")
    enough = shared * 2 >= F.least(F.col("le") - F.col("ls"), F.col("re") - F.col("rs"))
    pairs = overlap_join(spans(carved, "l"), spans(known, "r"), keys, ("ls", "le"), ("rs", "re"), enough, width)
    first = pairs.groupBy(*keys, F.col("lid").alias("id")).agg(F.min_by("rpath", F.struct("rs", "rid")).alias("_of"))
    rows = carved.join(first, [*keys, "id"], "left")
    hit = F.col("_of").isNotNull()
    return rows.withColumns({
        "source": F.when(hit, DUPLICATE).otherwise(F.col("source")),
        "path": F.when(hit, F.concat(F.lit("/dup_of"), "_of")).otherwise(F.col("path")),
        "confidence": F.when(hit, F.least("confidence", F.lit(COPY_CONFIDENCE))).otherwise(F.col("confidence")),
    }).drop("_of").select(*carved.columns)


class Kept:
    """Spans [first, last] that were kept, found by the stretches that they touch."""

    def __init__(self, width: int) -> None:
        self.width, self.at = max(1, width), {}

    def keep(self, first: int, last: int) -> None:
        for k in range(first // self.width, last // self.width + 1):
            self.at.setdefault(k, []).append((first, last))

    def covers(self, first: int, last: int) -> bool:
        """Whether a kept span shares half of the shorter one with this; if not, this is kept too."""
        for k in range(first // self.width, last // self.width + 1):
            for a, b in self.at.get(k, ()):
                if 2 * (min(last, b) - max(first, a) + 1) >= min(last - first, b - a) + 1:
                    return True
        self.keep(first, last)
        return False


def carved_copies(carved: DataFrame, keys: list[str], width: int = STRETCH, kept: DataFrame | None = None) -> DataFrame:
    """carved with _copy: whether, in order of id, a file overlaps an earlier one that was kept by half of the shorter.

    kept: spans (keys, start_sector, end_sector) that were kept before all of carved. The order matters, so each group of
    files that touch each other (an interval component) is folded by itself, in Arrow, so no column changes its type.
    """
    columns = carved.columns
    rows = carved.withColumn("_held", F.lit(False))
    if kept is not None:
        rows = rows.unionByName(kept.select(*keys, "start_sector", "end_sector", F.lit(True).alias("_held")), allowMissingColumns=True)
    parts = components(rows, keys, "start_sector", "end_sector", ["start_sector", "end_sector", "id"], "_part", width)

    def fold(table: pa.Table) -> pa.Table:
        i, first, last, held = (table.column(c).to_pylist() for c in ("id", "start_sector", "end_sector", "_held"))
        spans = Kept(sum(b - a for a, b in zip(first, last)) // len(first) + 1)
        copy = [False] * len(first)
        for k in sorted(range(len(first)), key=lambda k: (not held[k], i[k] is None, i[k] or 0)):
            if held[k]:
                spans.keep(first[k], last[k])
            else:
                copy[k] = spans.covers(first[k], last[k])
        out = table.append_column("_copy", pa.array(copy, pa.bool_()))
        return out.filter(pa.array([not x for x in held], pa.bool_())).select([*columns, "_copy"])

    return parts.groupBy(*keys, "_part").applyInArrow(fold, StructType([*carved.schema.fields, StructField("_copy", BooleanType())]))


def marked_by_copy(rows: DataFrame) -> DataFrame:
    """rows of carved_copies as file rows: copies have their source, path and a low confidence."""
    copy = F.col("_copy")
    return rows.withColumns({
        "source": F.when(copy, DUPLICATE).otherwise(F.col("source")),
        "path": F.when(copy, "/dup_of/carve").otherwise(F.col("path")),
        "confidence": F.when(copy & F.col("confidence").isNotNull(), F.least("confidence", F.lit(CARVE_COPY_CONFIDENCE))).otherwise(F.col("confidence")),
    }).drop("_copy")


def mark_carved_copies(carved: DataFrame, keys: list[str], width: int = STRETCH) -> DataFrame:
    """In order of id, a carved file that overlaps an earlier kept one by half of the shorter becomes a copy of it."""
    return marked_by_copy(carved_copies(carved, keys, width)).select(*carved.columns)


#: Bytes of bitmaps that are unpacked at once.
UNPACKED = 1 << 22


def clear_runs(maps: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(map, start, end) of the runs of clear bits of each map, lowest bit first; all maps are unpacked at once."""
    sizes = np.fromiter((len(x or b"") for x in maps), np.int64, len(maps)) * 8
    ends = np.cumsum(sizes)
    starts = ends - sizes
    free = np.unpackbits(np.frombuffer(b"".join(x or b"" for x in maps), np.uint8), bitorder="little") == 0
    edges = np.zeros(len(free) + 1, bool)
    edges[starts] = edges[ends] = True
    first = np.flatnonzero(free & (edges[:-1] | ~np.append(False, free)[:-1]))
    last = np.flatnonzero(free & (edges[1:] | ~np.append(free, False)[1:]))
    at = np.searchsorted(starts, first, side="right") - 1
    return at, first - starts[at], last + 1 - starts[at]


def free_runs_from_bitmap(bitmaps: DataFrame, keys: list[str], sectors_per_unit: int = 1) -> DataFrame:
    """[start, end) in sectors of clear bits. bitmaps: keys, first_unit, data (binary, lowest bit first; null: none)."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps, held, done = b.column("data").to_pylist(), 0, 0
            for k, x in enumerate(maps, 1):
                held += len(x or b"")
                if held >= UNPACKED or k == len(maps):
                    part = b.slice(done, k - done)
                    at, start, end = clear_runs(maps[done:k])
                    first = part.column("first_unit").to_numpy(zero_copy_only=False)[at]
                    named = [part.column(c).take(pa.array(at)) for c in keys]
                    yield pa.RecordBatch.from_arrays([*named, pa.array(start + first, pa.int64()), pa.array(end + first, pa.int64())], names=[*keys, "start", "end"])
                    held, done = 0, k

    rows = bitmaps.select(*keys, F.col("first_unit").cast("long").alias("first_unit"), "data")
    schema = StructType([*(bitmaps.schema[k] for k in keys), StructField("start", LongType()), StructField("end", LongType())])
    runs = merge(rows.mapInArrow(bits, schema), keys)
    return runs.withColumns({"start": F.col("start") * sectors_per_unit, "end": F.col("end") * sectors_per_unit})
