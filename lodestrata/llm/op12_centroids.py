"""Centroid clustering by weighted deduplication.

Vectors are quantised to integers; identical ones become one row with a multiplicity. Lloyd's rounds run on these distinct
vectors: each task assigns its own ones and adds up, for each cluster, multiplicity times vector in exact integers, so what
a round shuffles is one row of sums a task and cluster, however many vectors there are. Assignments are joined back to the
rows by the quantised vector; vectors of more than HOT_SHARE of all rows are joined by broadcast there, as is right for at
most 1 / HOT_SHARE of them.

The k centroids (k times `dims` integers) are the only thing that the driver holds and tasks get; neither k nor `dims` grows
with the rows. The distinct vectors are written once (checkpoint), so a round reads them from there and a lost executor
costs a round no recomputation. Every sum is one of integers, so no result depends on the order of tasks.

Defined results: a vector takes part if it has exactly `dims` components, none null or non-finite; other rows give no row.
Component x becomes floor(scale * x), held within +-2**27, so that every squared distance is a long; sums of distances
over a cluster or all rows stop at the largest long. A centroid moves to floor(sum / count) of its vectors; an empty one
stays. Ties of distance go to the smaller number. First centroids are the k rows that have the smallest SHA-256 of
`seed:vec_id` (ties of repeated ids: by vector); rows without vec_id are clustered, but start no centroid. With fewer than
k such rows there are fewer centroids; with none, no rows come back. Repeated rows count and come back each. Columns other
than vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, look_up, read

LIMIT = 2**27
LONG = 2**63 - 1
#: Distinct vectors whose distances are taken at once.
ROWS = 8192
#: Distinct vectors that a task remembers while it counts.
HELD = 50_000
WIDE = pa.decimal128(38, 0)


def quantised(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[pa.RecordBatch]:
    """(vec_id, vec: the components as 32-bit integers) of the rows that take part."""
    for batch in batches:
        x = batch.column(1)
        fit = np.flatnonzero((np.diff(x.offsets.to_numpy()) == dims) & x.is_valid().to_numpy(zero_copy_only=False))
        rows = x.take(pa.array(fit))
        flat = rows.flatten()
        nulls = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dims)
        v = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        good = np.isfinite(v).all(axis=1) & ~nulls.any(axis=1)
        with np.errstate(over="ignore"):
            ints = np.clip(np.floor(v[good] * scale), -LIMIT, LIMIT).astype("<i4")
        vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(ints), [None, pa.py_buffer(ints.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fit[good])), vec.cast(pa.binary())], names=["vec_id", "vec"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec, n) of a task's rows, so that a vector shared by very many rows is shuffled a few times a task."""
    held: dict[bytes, int] = {}
    for batch in batches:
        found = batch.column(0).value_counts()
        for v, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
            held[v] = held.get(v, 0) + n
        if len(held) > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["vec", "n"])
            held = {}
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["vec", "n"])


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(-1, dims)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the squared distance, exactly; ties to the smaller number."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 2**52:  # then doubles hold every partial sum
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best]


def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cluster, n, total: the weighted sum of its vectors) of a task, a row for each cluster that it met."""
    k, dims = centroids.shape
    n, total = [0] * k, np.zeros((k, dims), object)
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            part = batch.slice(s, ROWS)
            x, w = matrix(part.column(0), dims), part.column(1).to_numpy()
            best, _ = nearest(x, centroids)
            whole = float(w.sum()) * float(np.abs(x).max(initial=0)) < 2**62
            x, w = (x, w) if whole else (x.astype(object), w.astype(object))
            for c in np.unique(best).tolist():
                own = best == c
                n[c] += int(w[own].sum())
                total[c] += (x[own] * w[own, None]).sum(axis=0)
    met = [c for c in range(k) if n[c]]
    rows = [[int(v) for v in total[c]] for c in met]
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([n[c] for c in met], pa.int64()), pa.array(rows, pa.list_(WIDE))], names=["cluster", "n", "total"])


def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(vec, n, cluster, distance)."""
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            part = batch.slice(s, ROWS)
            best, d = nearest(matrix(part.column(0), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best.astype(np.int32)), pa.array(d)], names=["vec", "n", "cluster", "distance"])


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over the distinct vectors."""
    parts = distinct.mapInArrow(lambda it: sums(it, centroids), "cluster int, n long, total array<decimal(38,0)>")
    parts = parts.select("cluster", "n", F.posexplode("total").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in parts.collect():  # k * dims rows at most
        out[r.cluster, r.dim] = int(r.x) // r.n
    return out


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: float = 64.0, dims: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids (k rows of dims integers)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(lambda it: quantised(it, dims, scale), "vec_id long, vec binary")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(order.alias("h"), "vec").orderBy("h", "vec").limit(k).collect()
    centroids = np.array([np.frombuffer(r.vec, "<i4") for r in sorted(first, key=lambda r: (r.h, bytes(r.vec)))], np.int64).reshape(-1, dims)
    if not len(centroids):
        return rows.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    distinct = cut(rows.select("vec").mapInArrow(counted, "vec binary, n long").groupBy("vec").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    last = cut(distinct.mapInArrow(lambda it: assigned(it, centroids), "vec binary, n long, cluster int, distance long"))
    total = last.agg(F.sum("n")).first()[0]
    hot = last.where(F.col("n") > total * HOT_SHARE)
    return look_up(rows, last.drop("n"), "vec", hot).select("vec_id", "cluster", "distance"), centroids


def with_inertia(rows: DataFrame) -> DataFrame:
    """rows with cluster_inertia and inertia; sums that no long holds become the largest long."""
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_sum")).select(F.col("cluster").alias("_cluster"), "_sum")
    held = {r["_cluster"]: int(r["_sum"]) for r in per.collect()}  # a row a cluster
    each = F.create_map(*[F.lit(v) for c, s in sorted(held.items()) for v in (c, min(s, LONG))]) if held else F.create_map().cast("map<int,bigint>")
    return rows.withColumn("cluster_inertia", each[F.col("cluster")].cast("long")).withColumn("inertia", F.lit(min(sum(held.values()), LONG)).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(read(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64.0, dims=64, seed=1)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return with_inertia(rows).withColumn("centroid_sha256", F.element_at(F.array(*map(F.lit, shas or [""])), F.col("cluster") + 1))


def _round(at: int) -> str:
    """SQL of the vectors' nearest centroids (a) and of the next centroids (c) of round at."""
    return f"""
a{at} AS (
  SELECT id, vec_id, e, c, d FROM (
    SELECT v.*, c, list_sum(list_transform(list_zip(e, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{at})
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1),
c{at + 1} AS (
  SELECT c, coalesce(list(CAST(floor(s / n) AS BIGINT) ORDER BY i), any_value(old)) AS m
  FROM (SELECT c{at}.c, any_value(c{at}.m) AS old, g.i, CAST(sum(a{at}.e[g.i]) AS DOUBLE) AS s, count(*) AS n
        FROM c{at} JOIN a{at} USING (c) CROSS JOIN range(1, 65) g(i) GROUP BY c{at}.c, g.i) GROUP BY c
  UNION ALL SELECT c, m FROM c{at} WHERE c NOT IN (SELECT c FROM a{at}))"""


ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS INTEGER) AS c, e AS m FROM v WHERE vec_id IS NOT NULL QUALIFY c < 16),
{_round(0)},{_round(1)},{_round(2)},
a3 AS (
  SELECT id, vec_id, c, m, d FROM (
    SELECT v.*, c, m, list_sum(list_transform(list_zip(e, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c3)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3
"""
