"""Byte volumes as rows of chunks: (volume_id, chunk_no, byte_offset, data).

Chunks of a volume have one size but for the last. Nothing here gathers a volume: files are read by ranges, bytes of files
come from an equi join on chunk numbers, and what crosses a chunk's edge travels as a few bytes.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import CHUNKS

CHUNK = 1 << 20
#: Rows, counted, up to which a table is broadcast.
FEW = 100_000
#: Chunks that one partition of a raw image reads.
CHUNKS_A_PARTITION = 64
SECTOR = 512


def from_bytes(spark: SparkSession, volumes: dict[str, bytes], chunk: int = CHUNK) -> DataFrame:
    """Small volumes from memory."""
    rows = [(v, k, k * chunk, bytearray(data[k * chunk : (k + 1) * chunk])) for v, data in volumes.items() for k in range(-(-len(data) // chunk))]
    return spark.createDataFrame(rows, CHUNKS)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int) -> None:
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


class RawImages(DataSource):
    """format("rawimage"): raw image files that all executors can open, read by ranges. Options: path, chunk."""

    @classmethod
    def name(cls) -> str:
        return "rawimage"

    def schema(self):
        return CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return _RawReader(self.options)


class _RawReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths, self.chunk = options["path"].split(","), int(options.get("chunk", CHUNK))

    def partitions(self):
        out = []
        for path in self.paths:
            n = -(-os.path.getsize(path) // self.chunk)
            out += [_Range(path, k, min(CHUNKS_A_PARTITION, n - k)) for k in range(0, n, CHUNKS_A_PARTITION)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if part.count:
            with open(part.path, "rb") as f:
                f.seek(part.first * self.chunk)
                for k in range(part.first, part.first + part.count):
                    yield part.path, k, k * self.chunk, f.read(self.chunk)


def read_images(spark: SparkSession, *paths: str, chunk: int = CHUNK) -> DataFrame:
    """Raw image files as chunks."""
    spark.dataSource.register(RawImages)
    return spark.read.format("rawimage").options(path=",".join(paths), chunk=str(chunk)).load()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Chunks kept as Parquet in any store that Spark reads; the way to hold large evidence."""
    return spark.read.schema(CHUNKS).parquet(path)


def sector_count(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("volume_id").agg(F.max(F.col("byte_offset") + F.octet_length("data")).alias("bytes"))


def slice_at(chunks: DataFrame, offset: int, size: int, chunk: int = CHUNK) -> DataFrame:
    """(volume_id, data): size bytes at an offset of each volume; only the chunks that hold them are read."""
    first, last = offset // chunk, (offset + size - 1) // chunk
    part = chunks.where(F.col("chunk_no").between(first, last)).groupBy("volume_id").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY chunk_no)").alias("x"))
    return part.select("volume_id", F.substring("x", offset - first * chunk + 1, size).alias("data"))


def check_range(offset: int, size: int, sector: int = SECTOR) -> None:
    """Reads are in whole sectors."""
    if offset % sector or size % sector or offset < 0 or size <= 0:
        raise ValueError("offset and size must be whole sectors")


def bad_sectors(reads: DataFrame, sample: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Count of failed or zero-padded reads a volume, and a sample of their offsets, spread over all of them."""
    bad = reads.where(~F.col("success") | F.coalesce("padded_zeros", F.lit(False)))
    return bad.groupBy("volume_id").agg(F.count("*").alias("bad")), bad.orderBy(F.xxhash64("volume_id", "byte_offset")).limit(sample)


def file_extents(files: DataFrame, sector: int = SECTOR) -> DataFrame:
    """(volume_id, id, part_no, file_offset, byte_offset, length, is_sparse) of files with runs; without runs, of their sector span."""
    whole = F.array(F.struct(F.col("start_sector").alias("start_sector"), (F.ceil(F.col("size_bytes") / sector)).alias("sector_count"), F.lit(False).alias("is_sparse")))
    runs = F.when(F.size("runs") > 0, F.col("runs")).otherwise(whole)
    rows = files.select("volume_id", "id", "size_bytes", F.posexplode(runs).alias("part_no", "r"), runs.alias("_runs"))
    before = F.aggregate(F.slice("_runs", F.lit(1), F.col("part_no")), F.lit(0).cast("long"), lambda a, r: a + r["sector_count"])
    length = F.col("r.sector_count") * sector
    rows = rows.select("volume_id", "id", "size_bytes", "part_no", (before * sector).alias("file_offset"), (F.col("r.start_sector") * sector).alias("byte_offset"), length.alias("length"), F.coalesce("r.is_sparse", F.lit(False)).alias("is_sparse"))
    return rows.withColumn("length", F.least("length", F.col("size_bytes") - F.col("file_offset"))).where("length > 0")


def file_parts(files: DataFrame, chunks: DataFrame, chunk: int = CHUNK, sector: int = SECTOR) -> DataFrame:
    """(volume_id, id, file_offset, data, missing): the bytes of files in pieces of at most a chunk.

    Sparse pieces are zeros; pieces that the volume lacks are zeros too and count as missing.
    """
    ext = file_extents(files, sector)
    spans = F.sequence(F.floor(F.col("byte_offset") / chunk), F.floor((F.col("byte_offset") + F.col("length") - 1) / chunk))
    real = ext.where("not is_sparse").withColumn("chunk_no", F.explode(spans))
    start = F.greatest(F.col("byte_offset"), F.col("chunk_no") * chunk)
    n = F.least(F.col("byte_offset") + F.col("length"), (F.col("chunk_no") + 1) * chunk) - start
    real = real.select("volume_id", "id", "chunk_no", (F.col("file_offset") + start - F.col("byte_offset")).alias("file_offset"), (start - F.col("chunk_no") * chunk).cast("int").alias("_at"), n.cast("int").alias("_n"))
    found = real.join(dealt(chunks.select("volume_id", "chunk_no", "data")), ["volume_id", "chunk_no"], "left")
    got = F.coalesce(F.substring("data", F.col("_at") + 1, F.col("_n")), F.lit(b""))
    lack = F.col("_n") - F.octet_length(got)
    real = found.select("volume_id", "id", "file_offset", F.concat(got, zeros(lack)).alias("data"), lack.cast("long").alias("missing"))
    sparse = ext.where("is_sparse").withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / chunk))))
    sparse = sparse.select("volume_id", "id", (F.col("file_offset") + F.col("_k") * chunk).alias("file_offset"), zeros(F.least(F.lit(chunk), F.col("length") - F.col("_k") * chunk)).alias("data"), F.lit(0).cast("long").alias("missing"))
    return real.unionByName(sparse)


def blocks_at(wanted: DataFrame, chunks: DataFrame, chunk: int = CHUNK, most_rows: int = FEW) -> DataFrame:
    """wanted (volume_id, byte_offset, length, ...) with data: these bytes of the volumes, as far as they are there; length is a chunk at most.

    Only chunk numbers in the wanted range are read. Up to most_rows wanted pieces (counted) are broadcast to the chunks, so
    the evidence stays where it lies; more of them meet their chunks in a shuffle. A piece may cross one chunk's edge; of the
    next chunk only so many bytes as the longest piece has are sent on.
    """
    rows = wanted.withColumns({"_chunk": F.floor(F.col("byte_offset") / chunk), "_last": F.floor((F.col("byte_offset") + F.col("length") - 1) / chunk)})
    n, edges, longest, low, high = rows.agg(F.count("*"), F.count_if(F.col("_chunk") < F.col("_last")), F.max("length"), F.min("_chunk"), F.max("_last")).first()
    near = chunks.where(F.col("chunk_no").between(low or 0, high or 0)) if n else chunks.limit(0)
    few = n <= most_rows
    at = (F.col("byte_offset") - F.col("_chunk") * chunk + 1).cast("int")

    def joined(part: DataFrame, number: Column, name: str) -> DataFrame:
        # an inner join broadcasts the small side whichever it is; pieces that lie past a volume's end are dropped here
        held = near.select(F.col("volume_id").alias("_volume"), F.col("chunk_no").alias("_number"), F.col("data").alias(name))
        return dealt(held).join(F.broadcast(part) if few else part, (F.col("_volume") == F.col("volume_id")) & (F.col("_number") == number)).drop("_volume", "_number")

    inside = joined(rows.where("_chunk = _last"), F.col("_chunk"), "_a").withColumn("data", F.substring("_a", at, F.col("length").cast("int"))).drop("_a")
    if not edges:
        return inside.drop("_chunk", "_last")
    across = rows.where("_chunk < _last")
    first = joined(across, F.col("_chunk"), "_a").withColumn("_a", F.substring("_a", at, F.col("length").cast("int")))
    rest = near.select(F.col("volume_id"), (F.col("chunk_no") - 1).alias("_chunk"), F.substring("data", 1, longest).alias("_b"))
    if few:
        rest = rest.join(F.broadcast(across.select("volume_id", "_chunk").distinct()), ["volume_id", "_chunk"], "left_semi")
    both = first.join(dealt(rest), ["volume_id", "_chunk"], "left").withColumn("data", F.substring(F.concat("_a", F.coalesce("_b", F.lit(b""))), F.lit(1), F.col("length").cast("int")))
    return inside.unionByName(both.drop("_a", "_b")).drop("_chunk", "_last")


def runs_of(extents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, runs): extents (keys, logical, start_sector, sector_count), in sectors, in logical order, as runs of a file.

    Neighbours are merged, a gap between two extents and an extent without start_sector is a sparse run; so is what the runs
    lack of a column total (a file's sectors), if there is one. Islands are found with windows over a file's extents, so a
    file of very many fragments costs no more than it has.
    """
    if "total" not in extents.columns:
        extents = extents.withColumn("total", F.lit(0).cast("long"))
    w = Window.partitionBy(*keys).orderBy("logical")
    extents = extents.withColumn("_before", F.lag(F.col("logical") + F.col("sector_count"), 1, 0).over(w))
    hole = F.struct(F.col("_before").alias("logical"), F.lit(None).cast("long").alias("start_sector"), (F.col("logical") - F.col("_before")).alias("sector_count"))
    own = F.struct("logical", F.col("start_sector").cast("long").alias("start_sector"), F.col("sector_count").cast("long").alias("sector_count"))
    rows = extents.select(*keys, F.explode(F.when(F.col("logical") > F.col("_before"), F.array(hole, own)).otherwise(F.array(own))).alias("x"), "total").select(*keys, "x.*", "total")
    joins = F.lag("start_sector").over(w) + F.lag("sector_count").over(w) == F.col("start_sector")
    both_holes = F.lag(F.col("start_sector").isNull()).over(w) & F.col("start_sector").isNull()
    joined = F.coalesce(joins, F.lit(False)) | F.coalesce(both_holes, F.lit(False))
    rows = rows.withColumn("_new", (~joined).cast("int")).withColumn("_run", F.sum("_new").over(w))
    rows = rows.groupBy(*keys, "_run").agg(F.min("start_sector").alias("start_sector"), F.sum("sector_count").alias("sector_count"), F.max("total").alias("total"))
    run = F.struct("_run", F.struct("start_sector", "sector_count", F.col("start_sector").isNull().alias("is_sparse")).alias("r"))
    rows = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(run)), lambda x: x["r"]).alias("runs"), F.sum("sector_count").alias("_has"), F.max("total").alias("total"))
    rest = F.array(F.struct(F.lit(None).cast("long").alias("start_sector"), (F.col("total") - F.col("_has")).alias("sector_count"), F.lit(True).alias("is_sparse")))
    return rows.select(*keys, F.when(F.col("_has") < F.col("total"), F.concat("runs", rest)).otherwise(F.col("runs")).alias("runs"))


def first_sectors(volume_chunks: DataFrame, at: int, size: int, chunk: int = CHUNK) -> DataFrame:
    """(volume_id, data): size bytes at one offset of every volume, for headers."""
    here = volume_chunks.where(F.col("chunk_no") == at // chunk).select("volume_id", F.lit(at).cast("long").alias("byte_offset"), F.lit(size).alias("length"))
    return blocks_at(here, volume_chunks, chunk).select("volume_id", "data")


def little(column: str, at: int, size: int) -> Column:
    """A little-endian whole number at a place of binary data, as a long."""
    return F.conv(F.concat(*[F.hex(F.substring(column, at + k + 1, 1)) for k in range(size - 1, -1, -1)]), 16, 10).cast("long")


def spanned(runs: Column) -> tuple[Column, Column]:
    """(start_sector, end_sector) of the first and last run that is not sparse."""
    real = F.filter(runs, lambda r: ~r["is_sparse"])
    return F.try_element_at(real, F.lit(1))["start_sector"], F.try_element_at(F.transform(real, lambda r: r["start_sector"] + r["sector_count"]), F.lit(-1))

def cut(df: DataFrame) -> DataFrame:
    """df, written once to the reliable checkpoint folder, so that rounds don't repeat each other and a lost executor costs little."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(at or f"file://{tempfile.gettempdir()}/lodestrata-{os.getpid()}")
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """df, for a join that deals both sides out.

    Rows that Python made from a small table pass for small themselves in Spark's estimate (300 KB for 300 MB), even if they
    were written down since, so joins would send all of them through the driver.
    """
    return df.hint("merge")


def each(rows: DataFrame, columns: list[str], make: Callable[..., Iterator[tuple]], kinds: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """What make(*columns) yields for each row, Arrow batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for row in zip(*(c.to_pylist() for c in b.columns)) for x in make(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds.values())], names=list(kinds))

    return rows.select(*columns).mapInArrow(run, ddl)


def table(rows: DataFrame, columns: list[str], make: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """each() with the column types read from a schema like "a long, b string"."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return each(rows, columns, make, {n: types[t] for n, t in (x.split() for x in schema.split(", "))}, schema)


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def file_bytes(files: DataFrame, chunks: DataFrame, chunk: int = CHUNK, sector: int = SECTOR, most: int | None = None) -> DataFrame:
    """(volume_id, id, data, missing): the bytes of each file, or the first most of them, in one value.

    One value holds 2 GB at most; larger files are read with file_parts, whose pieces are of a chunk's size.
    """
    limited = files if most is None else files.withColumn("size_bytes", F.least("size_bytes", F.lit(most)))
    parts = file_parts(limited, chunks, chunk, sector)
    rows = parts.groupBy("volume_id", "id").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY file_offset)").alias("data"), F.sum("missing").alias("missing"))
    return rows.select("volume_id", "id", "data", "missing")


def decrypted(chunks: DataFrame, key: bytes, sector: int = SECTOR) -> DataFrame:
    """Chunks of an AES-XTS volume in plain; the tweak is the sector number."""
    from ..functions.crypto import xts_decrypt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("data")
            data = [xts_decrypt(key, bytes(d), off // sector, sector) for d, off in zip(b.column("data").to_pylist(), b.column("byte_offset").to_pylist())]
            yield b.set_column(at, "data", pa.array(data, pa.binary()))

    return chunks.mapInArrow(run, chunks.schema)
