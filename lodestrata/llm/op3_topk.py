"""Exact top-k inner products by a three-phase uniform threshold (TPUT).

Vectors are cut into `slices` runs of dimensions; a node holds one slice of a block of vectors, and a score is the sum of
its slices' scores.

1. Gather: each node sends the `gather` best entries of its local score list for every query. These are scored in full, and
   the k-th best of a query is a safe cutoff c: the k-th best of all is no smaller.
2. Collect: the cutoff goes to all nodes, and each sends every entry whose local score is at least c / slices, with that
   score. An entry that no node sends has a score under c.
3. Resolve: a block adds up what its nodes sent and raises the cutoff to the k-th best score that is fully known by then.
   For a slice that did not send an entry, its score is under c / slices and no larger than the product of the norms; an
   entry that stays under the cutoff with that goes. For the others the missing slices are looked up in the block, which
   makes their scores exact, and the block sends its k best on.

What a node sends is packed into one row, and entries are resolved in the block that holds them, so no vector travels with
a pair. Nodes work on blocks of vectors against blocks of queries, both of bounded size, so a node sends BLOCK_VECTORS *
BLOCK_QUERIES entries at most, whatever the cutoff. Equal vectors are one entry that carries its k + 1 smallest ids, so a
vector that a third of all rows share costs no more than any other. Nothing is broadcast or collected but the largest
number of dimensions.

Defined results: components x become floor(scale * x) and saturate at 2**62; a vector that is null or holds a null or
non-finite component, or whose id is null, takes no part; missing components of shorter vectors count as 0; scores saturate
at the range of a long; ties go to the smaller id; a query never finds its own id; rows that repeat id and vector count
once, and rows of one id with different vectors are queries each; fewer than k candidates give fewer rows; an empty table
gives no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

BLOCK_VECTORS, BLOCK_QUERIES = 4096, 2048
#: Entries of each local list that make the cutoff.
GATHER = 32
#: Pairs that are looked up at once.
PAIRS = 1 << 16
#: Partial groups of equal vectors meet in so many groups first.
SALTS = 512
#: Distinct vectors that a task remembers.
HELD = 50_000
LONG = 2**63 - 1


def integers(x: pa.ListScalar, scale: float) -> bytes | None:
    """A vector as 64-bit integers; None if it takes no part."""
    if not x.is_valid or x.values.null_count:
        return None
    v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(v).all():
        return None
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * scale), -(2.0**62), 2.0**62).astype(np.int64).tobytes()


def asking(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """(query_id, vector as 64-bit integers) of the rows that take part."""
    for batch in batches:
        rows = [(i, v) for i, x in zip(batch.column(0).to_pylist(), batch.column(1)) if (v := integers(x, scale)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["query_id", "vec"])


def quantised(batches: Iterator[pa.RecordBatch], scale: float, most_ids: int) -> Iterator[pa.RecordBatch]:
    """(vector as 64-bit integers, its smallest ids, salt) of a task's rows."""
    held: dict[bytes, list[int]] = {}
    salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % SALTS

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64())), pa.array([salt] * len(held), pa.int32())], names=["vec", "ids", "salt"])

    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            key = integers(x, scale)
            if key is None:
                continue
            ids = held.setdefault(key, [])
            if i not in ids:
                ids.append(i)
                if len(ids) > most_ids:
                    ids.remove(max(ids))
        if len(held) > HELD:
            yield flush()
            held = {}
    if held:
        yield flush()


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, x in enumerate(column):
        v = np.frombuffer(x.as_buffer(), np.int64)
        out[k, : len(v)] = v
    return out


def products(q: np.ndarray, x: np.ndarray, pairwise: bool = False) -> np.ndarray:
    """Exact integer inner products of all rows of q and x, or of their rows one by one."""
    q, x = (q, x) if q.size and x.size else (np.zeros((len(q), 1), np.int64), np.zeros((len(x), 1), np.int64))
    norms = [float(np.sqrt((a.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for a in (q, x)]
    bound = norms[0] * norms[1]  # of the sum of absolute products
    if bound < 2**52:
        kind = np.float32 if bound < 2**23 else np.float64
        a, b = q.astype(kind), x.astype(kind)
        return (np.einsum("ij,ij->i", a, b) if pairwise else a @ b.T).astype(np.int64)
    a, b = q.astype(object), x.astype(object)
    return np.clip((a * b).sum(axis=1) if pairwise else a @ b.T, -LONG, LONG).astype(np.int64)


SENT = pa.schema([("block", pa.int32()), ("q_block", pa.int32()), ("slice", pa.int32()), ("at_q", pa.binary()), ("at_x", pa.binary()), ("part", pa.binary())])
SENT_DDL = "block int, q_block int, slice int, at_q binary, at_x binary, part binary"


def sent(key: tuple, at_q: np.ndarray, at_x: np.ndarray, part: np.ndarray) -> pa.Table:
    """What a node sends: places of queries and vectors in its cell, by rising ids, and their local scores."""
    row = [*(k.as_py() for k in key), at_q.astype(np.int32).tobytes(), at_x.astype(np.int32).tobytes(), part.astype(np.int64).tobytes()]
    return pa.Table.from_arrays([pa.array([v] if len(at_q) else [], f.type) for v, f in zip(row, SENT)], schema=SENT)


def sides(vectors: pa.Table, width: int) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """The queries and the vectors of a cell, by rising ids, and their matrices."""
    q, x = (vectors.filter(pc.equal(vectors.column("asks"), asks)).sort_by("id") for asks in (True, False))
    return q, x, matrix(q.column("vec"), width), matrix(x.column("vec"), width)


def gathered(key: tuple, vectors: pa.Table, most: int, width: int) -> pa.Table:
    """The best entries of a node's score list for each query."""
    q, x, a, b = sides(vectors, width)
    if not len(a) or not len(b):
        return sent(key, *[np.empty(0, np.int64)] * 3)
    s = products(a, b)
    k = min(most, s.shape[1])
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return sent(key, np.repeat(np.arange(len(a)), k), best.ravel(), np.take_along_axis(s, best, axis=1).ravel())


def collected(key: tuple, vectors: pa.Table, slices: int, width: int) -> pa.Table:
    """The entries of a node whose local score reaches a query's threshold. Without a cutoff, all of them."""
    q, x, a, b = sides(vectors, width)
    if not len(a) or not len(b):
        return sent(key, *[np.empty(0, np.int64)] * 3)
    s = products(a, b)
    least = np.array([-LONG if c is None else -(-c // slices) for c in q.column("cutoff").to_pylist()], np.int64)
    at_q, at_x = np.nonzero(s >= least[:, None])
    return sent(key, at_q, at_x, s[at_q, at_x])


def norms(a: np.ndarray, slices: int, part: int) -> np.ndarray:
    """The lengths of the slices of each row, rounded up."""
    wide = np.pad(a.astype(np.float64), ((0, 0), (0, slices * part - a.shape[1]))).reshape(len(a), slices, part)
    return np.sqrt((wide**2).sum(axis=2)) * (1 + 1e-9)


RESOLVED = pa.schema([("q", pa.int64()), ("x", pa.int64()), ("total", pa.int64())])
RESOLVED_DDL = "q long, x long, total long"


def resolved(vectors: pa.Table, lists: pa.Table, k: int, slices: int, part: int, width: int) -> pa.Table:
    """The k best entries of a block for each query, among those that its nodes sent, with exact scores."""
    q, x, a, b = sides(vectors, width)
    if not lists.num_rows or not len(a) or not len(b):
        return RESOLVED.empty_table()
    total, seen = np.zeros(len(a) * len(b), np.int64), np.zeros(len(a) * len(b), np.int32)
    for n, at_q, at_x, p in zip(lists.column("slice").to_pylist(), *(lists.column(c) for c in ("at_q", "at_x", "part"))):
        at = np.frombuffer(at_q.as_buffer(), np.int32).astype(np.int64) * len(b) + np.frombuffer(at_x.as_buffer(), np.int32)
        total[at] += np.frombuffer(p.as_buffer(), np.int64)
        seen[at] |= 1 << n
    at = np.flatnonzero(seen)
    total, seen, at_q, at_x = total[at], seen[at], at // len(b), at % len(b)
    cutoff = np.array([-LONG if c is None else c for c in q.column("cutoff").to_pylist()], np.int64)
    na, nb = norms(a, slices, part), norms(b, slices, part)
    whole = seen == (1 << slices) - 1
    if na.max() * nb.max() * slices >= 2**52:  # sums may be inexact or saturated, so nothing is known yet
        whole[:] = False
    else:
        order = np.flatnonzero(whole)
        order = order[np.lexsort((-total[order], at_q[order]))]
        first = np.searchsorted(at_q[order], np.arange(len(a)))
        kth = first + k - 1
        full = np.searchsorted(at_q[order], np.arange(len(a)), side="right") > kth
        cutoff[full] = np.maximum(cutoff[full], total[order[kth[full]]])
        most = total.astype(np.float64)
        for n in range(slices):
            local = np.minimum(na[at_q, n] * nb[at_x, n], np.ceil(cutoff_of(q, slices))[at_q])
            most += np.where(seen >> n & 1, 0.0, local)
        stay = most * (1 + np.sign(most) * 1e-12) >= cutoff[at_q]
        total, at_q, at_x, whole = total[stay], at_q[stay], at_x[stay], whole[stay]
    rest = np.flatnonzero(~whole)
    for s in range(0, len(rest), PAIRS):
        some = rest[s : s + PAIRS]
        total[some] = products(a[at_q[some]], b[at_x[some]], pairwise=True)
    good = np.flatnonzero(total >= cutoff[at_q])
    order = good[np.lexsort((at_x[good], -total[good], at_q[good]))]
    rank = np.arange(len(order)) - np.searchsorted(at_q[order], at_q[order])
    order = order[rank < k]
    return pa.Table.from_arrays([pa.array(q.column("id").to_numpy()[at_q[order]]), pa.array(x.column("id").to_numpy()[at_x[order]]), pa.array(total[order])], schema=RESOLVED)


def cutoff_of(q: pa.Table, slices: int) -> np.ndarray:
    """What a slice that did not send an entry stays under, for each query."""
    return np.array([math.inf if c is None else c / slices for c in q.column("cutoff").to_pylist()])


def best_of(totals: DataFrame, n: int) -> DataFrame:
    """The n best entries of each query, ties to the smaller entry."""
    return totals.withColumn("_k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total"), "x"))).where(F.col("_k") <= n).drop("_k")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, slices: int = 2, gather: int = GATHER) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by every."""
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    partial = valid.mapInArrow(lambda it: quantised(it, scale, k + 1), "vec binary, ids array<long>, salt int")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    entries = cut(partial.groupBy("vec", "salt").agg(smallest).groupBy("vec").agg(smallest).select(F.col("ids")[0].alias("id"), "ids", "vec"))
    n, size = entries.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vec")), F.lit(0))).first()
    width = max(1, math.ceil(size / 8))
    part = math.ceil(width / slices)

    asked = valid.where(F.col("vec_id") % every == 0).mapInArrow(lambda it: asking(it, scale), "query_id long, vec binary").distinct()
    asked = cut(asked.join(entries.select("vec", "id"), "vec").select("query_id", "id"))
    queries = cut(entries.join(asked.select("id").distinct(), "id", "left_semi"))
    n_queries = queries.count()

    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, q_blocks = max(1, min(n, max(math.ceil(n / BLOCK_VECTORS), tasks // slices))), max(1, math.ceil(n_queries / BLOCK_QUERIES))
    block = lambda many: F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
    spread = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    cell, node = ["block", "q_block"], ["block", "q_block", "slice"]

    def cells(asks: DataFrame) -> DataFrame:
        """The vectors and queries of each cell. asks: id, vec, cutoff."""
        held = entries.select("id", "vec", F.lit(None).cast("long").alias("cutoff"), F.lit(False).alias("asks"), block(blocks).alias("block")).withColumn("q_block", spread(q_blocks))
        return held.unionByName(asks.select("id", "vec", "cutoff", F.lit(True).alias("asks"), block(q_blocks).alias("q_block")).withColumn("block", spread(blocks)))

    def nodes(asks: DataFrame) -> DataFrame:
        rows = cells(asks).withColumn("slice", spread(slices))
        return rows.withColumn("vec", F.substring("vec", F.col("slice") * (8 * part) + 1, F.lit(8 * part))).groupBy(*node)

    def scores(asks: DataFrame, lists: DataFrame) -> DataFrame:
        return best_of(cells(asks).groupBy(*cell).cogroup(lists.groupBy(*cell)).applyInArrow(lambda v, t: resolved(v, t, k + 1, slices, part, width), RESOLVED_DDL), k + 1)

    open_ = queries.withColumn("cutoff", F.lit(None).cast("long"))
    lists = nodes(open_).applyInArrow(lambda key, v: gathered(key, v, max(gather, k + 1), part), SENT_DDL)
    known = scores(open_, lists)
    # an entry stands for its ids, but the query itself doesn't count
    copies = known.join(entries.select(F.col("id").alias("x"), F.size("ids").alias("_n")), "x").withColumn("_n", F.col("_n") - F.when(F.col("q") == F.col("x"), 1).otherwise(0))
    reach = copies.withColumn("_sum", F.sum("_n").over(Window.partitionBy("q").orderBy(F.desc("total"), "x").rowsBetween(Window.unboundedPreceding, 0)))
    cutoffs = reach.where(F.col("_sum") >= k).groupBy(F.col("q").alias("id")).agg(F.max("total").alias("cutoff"))
    queries = cut(queries.join(cutoffs, "id", "left"))

    lists = nodes(queries).applyInArrow(lambda key, v: collected(key, v, slices, part), SENT_DDL)
    best = scores(queries, lists).join(entries.select(F.col("id").alias("x"), "ids"), "x")
    rows = asked.withColumnRenamed("id", "q").join(best, "q").select("query_id", "q", "total", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("total"), "vec_id"))).where(F.col("rank") <= k)
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("total").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
