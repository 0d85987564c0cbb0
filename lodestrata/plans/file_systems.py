"""File systems made from the driver's tables and read back as plans, each with the SQL that says what has to come out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..sources import apfs, ext, fat, volumes
from ..sources.volumes import cut, dealt
from . import built
from .driver import query, read

#: Rows of a table that share a volume.
A_VOLUME = 512


def apfs_volume(frame: pd.DataFrame) -> bytes:
    """Customers as files of a container that has two transactions: at the first one all, with other names and places; at the second
    one those whose key isn't a multiple of five, in folders by nation."""
    old, new = [], [{"oid": 3, "parent": 2, "name": "Nations", "folder": True, "size": 0, "created": 1, "modified": 1, "extents": []}]
    for k, n in sorted(zip(frame["c_custkey"].tolist(), frame["c_nationkey"].tolist())):
        file = {"oid": 5000 + k, "parent": 2, "name": f"old{k}", "folder": False, "size": 1, "created": k, "modified": k, "extents": [(0, 9, 4096)]}
        old.append(file)
        if k % 5:
            extents = [(0, 3 * k, 8192), (16384, 3 * k + 7, 4096)][: k % 3]
            new.append(file | {"parent": 10 + n, "name": f"c{k}.dat", "size": k * 37 % 100_000, "modified": k + 60, "extents": extents})
    new += [{"oid": 10 + n, "parent": 3, "name": f"N{n}", "folder": True, "size": 0, "created": 1, "modified": 1, "extents": []} for n in sorted({f["parent"] - 10 for f in new[1:]})]
    return built.apfs_container({1: old, 2: new}, per=8, future=3)


@query(f"""WITH c AS (SELECT *, c_custkey // {A_VOLUME} AS v, c_custkey AS k FROM customer)
SELECT CAST(v AS VARCHAR) AS volume_id, '/Nations/N' || c_nationkey || '/c' || k || '.dat' AS path, false AS is_directory, k * 37 % 100000 AS size_bytes, k + 60 AS modified_at,
  CASE WHEN k % 3 > 0 THEN k * 24 END AS start_sector, CASE k % 3 WHEN 1 THEN k * 24 + 16 WHEN 2 THEN k * 24 + 64 END AS end_sector,
  CAST(CASE k % 3 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS INTEGER) AS runs, CAST(CASE WHEN k % 3 > 0 THEN 85 ELSE 70 END AS INTEGER) AS confidence FROM c WHERE k % 5 <> 0
UNION ALL SELECT DISTINCT CAST(v AS VARCHAR), '/Nations/N' || c_nationkey, true, 0, 1, NULL, NULL, 0, 70 FROM c WHERE k % 5 <> 0
UNION ALL SELECT DISTINCT CAST(v AS VARCHAR), '/Nations', true, 0, 1, NULL, NULL, 0, 70 FROM c""")
def apfs_tree_files(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    chunks = built.volumes(rows, F.floor(F.col("c_custkey") / A_VOLUME), apfs_volume, 1 << 16)
    found = apfs.files(chunks)
    return found.select("volume_id", "path", "is_directory", "size_bytes", "modified_at", "start_sector", "end_sector", F.coalesce(F.size("runs"), F.lit(0)).alias("runs"), "confidence")


def ext_volume(frame: pd.DataFrame) -> bytes:
    """Parts as files in folders by size: extents, a deep extent tree, a block map of three levels, or a deleted file."""
    file = lambda inode, parent, name, folder=False, size=0, **more: {"inode": inode, "parent": parent, "name": name, "folder": folder, "size": size, "changed": 5, "modified": 7, "extents": [], **more}
    files, sizes = [file(2, 2, "", True), file(12, 2, "parts", True)], sorted(set(frame["p_size"] % 10))
    files += [file(13 + n, 12, f"s{n}", True) for n in sizes]
    for k, size in sorted(zip(frame["p_partkey"].tolist(), frame["p_size"].tolist())):
        own = file(30 + k % A_VOLUME, 13 + size % 10, f"p{k}.bin", size=(k % 50 + 1) * 1024)
        if k % 4 == 1:
            own |= {"size": 300 * 1024, "extents": [(3 * j, 1000 + 5 * j, 2) for j in range(100)], "depth": 2}
        elif k % 4 == 2:
            own |= {"size": (70_000 + k % 9) * 1024, "map": {0: k, 1: k + 1, 13: k + 90, 300: k + 7, 66_000: k + 8}}
        else:
            own |= {"extents": [(0, 10 * k, k % 50 + 1)], "deleted": k % 4 == 3}
        files.append(own)
    return built.ext_volume(files)


@query(f"""WITH p AS (SELECT *, p_partkey // {A_VOLUME} AS v, p_partkey AS k, p_partkey % 4 AS kind FROM part)
SELECT CAST(v AS VARCHAR) AS volume_id, '/parts/s' || p_size % 10 || '/p' || k || '.bin' AS path, false AS is_directory,
  CASE kind WHEN 1 THEN 300 * 1024 WHEN 2 THEN (70000 + k % 9) * 1024 ELSE (k % 50 + 1) * 1024 END AS size_bytes,
  CASE kind WHEN 1 THEN 2000 WHEN 2 THEN 2 * k ELSE 20 * k END AS start_sector,
  CASE kind WHEN 1 THEN 2 * (1000 + 5 * 99 + 2) WHEN 2 THEN 2 * (k + 9) ELSE 2 * (10 * k + k % 50 + 1) END AS end_sector,
  CAST(CASE kind WHEN 1 THEN 200 WHEN 2 THEN 8 ELSE 1 END AS INTEGER) AS runs, CASE kind WHEN 1 THEN 600 WHEN 2 THEN 2 * (70000 + k % 9) ELSE 2 * (k % 50 + 1) END AS sectors,
  CAST(CASE WHEN kind = 3 THEN 0 ELSE 1 END AS INTEGER) AS status, CAST(CASE WHEN kind = 3 THEN 60 ELSE 95 END AS INTEGER) AS confidence FROM p""")
def ext_tree_files(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    chunks = cut(built.volumes(rows, F.floor(F.col("p_partkey") / A_VOLUME), ext_volume, 1 << 16))
    found = ext.files(chunks, 1 << 16).where("not is_directory")
    sectors = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["sector_count"]).alias("sectors")
    return found.select("volume_id", "path", "is_directory", "size_bytes", "start_sector", "end_sector", F.size("runs").alias("runs"), sectors, "status", "confidence")


FAT_KINDS = ("fat12", "fat16", "fat32", "exfat")


def fat_volume(frame: pd.DataFrame) -> bytes:
    """256 customers as files of a FAT12, FAT16, FAT32 or exFAT volume, in folders by nation; every seventh one is deleted."""
    rows = sorted(zip(frame["c_custkey"].tolist(), frame["c_name"].tolist(), frame["c_nationkey"].tolist()))
    entries = [{"key": 1, "parent": 0, "name": "nations", "folder": True}]
    entries += [{"key": 10 + n, "parent": 1, "name": f"nation number {n}", "folder": True} for n in sorted({n for _, _, n in rows})]
    for k, name, n in rows:
        size = k % 9 * 180
        entries.append({"key": 100 + k, "parent": 10 + n, "name": f"{name}.dat", "folder": False, "size": size, "deleted": k % 7 == 0, "data": (name * 100).encode()[:size]})
    return built.fat_volume(FAT_KINDS[rows[0][0] // 256 % 4], entries)[0]


@query("""WITH c AS (SELECT *, c_custkey AS k, c_custkey // 256 AS v, c_custkey % 9 * 180 AS size, CAST(ceil(c_custkey % 9 * 180 / 512) AS INTEGER) AS n FROM customer)
SELECT CAST(v AS VARCHAR) AS volume_id, '/nations/nation number ' || c_nationkey || '/' || c_name || '.dat' AS path, size AS size_bytes, n AS sectors,
  CAST(CASE WHEN n = 0 THEN 0 WHEN k % 7 = 0 OR v % 4 = 3 AND k % 2 = 0 THEN 1 ELSE ceil(n / 3) END AS INTEGER) AS runs, CAST(CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END AS INTEGER) AS status,
  CAST(CASE WHEN k % 7 > 0 THEN 95 WHEN n = 0 THEN 35 ELSE 60 END AS INTEGER) AS confidence, CASE WHEN v % 4 = 3 THEN 'exfat' ELSE 'fat' END AS source,
  CASE WHEN size > 0 THEN md5(substr(repeat(c_name, 100), 1, size)) END AS md5 FROM c""")
def fat_tree_files(spark, sf_dir):
    # every file's bytes are read back by its runs
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    chunks = cut(built.volumes(rows, F.floor(F.col("c_custkey") / 256), fat_volume, 3 << 14))
    found = cut(fat.files(chunks, 3 << 14).where("not is_directory").withColumn("id", F.xxhash64("volume_id", "path")))
    bytes_ = volumes.file_bytes(found, chunks, 3 << 14).select("volume_id", "id", F.md5("data").alias("md5"))
    sectors = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["sector_count"]), F.lit(0)).cast("int").alias("sectors")
    return found.join(dealt(bytes_), ["volume_id", "id"], "left").select("volume_id", "path", "size_bytes", sectors, F.coalesce(F.size("runs"), F.lit(0)).alias("runs"), "status", "confidence", "source", "md5")
