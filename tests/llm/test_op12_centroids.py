from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from lodestrata.llm import op12_centroids as m

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType()), StructField("cluster", IntegerType())])
LONG = 2**63 - 1


def brute(rows, k=16, rounds=3, scale=64, dims=64, seed=1):
    """Lloyd over every single row, in plain integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(max(-(2**27), min(2**27, math.floor(scale * float(np.float32(x))))) for x in v)))
    packed = lambda v: np.array(v, "<i4").tobytes()
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), packed(v), v) for i, v in kept if i is not None)
    cs = [list(v) for _, _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(cs)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own)]
    if not cs:
        return []
    at = assign()
    each = [sum(d for d, c in at if c == j) for j in range(len(cs))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, c, d, min(each[c], LONG), min(sum(each), LONG), shas[c]) for (i, _), (d, c) in zip(kept, at)]


def run(spark, rows, parts=5, **how):
    got, centroids = m.clustered(spark.createDataFrame([(i, v, 0, 7) for i, v in rows], SCHEMA).repartition(parts), **how)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, shas[r.cluster]) for r in m.with_inertia(got).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    base = rng.normal(size=(9, 64)) * 0.2
    out = [(k, [float(x) for x in base[k % 9] + rng.normal(size=64) * 0.05]) for k in range(500)]
    hot = [float(x) for x in base[0]]
    out += [(1000 + k, hot) for k in range(300)] + [(2000 + k, [0.0] * 64) for k in range(20)]  # copies, a third of all rows
    out += [(3000, None), (3001, [1.0] * 63), (3002, [1.0] * 65), (3003, [float("nan")] * 64), (3004, [float("inf")] + [0.0] * 63), (3005, [None] + [0.0] * 63), (3006, [])]
    return out + [(None, hot), (5, out[5][1]), (6, out[9][1]), (-4, [-0.0] * 64)]


def test_equals_brute_force(spark, rows):
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_parameters_small_batches(spark, rows, monkeypatch):
    monkeypatch.setattr(m, "ROWS", 7)
    monkeypatch.setattr(m, "HELD", 10)
    assert run(spark, rows, 9, k=5, rounds=6, scale=16.0, seed=3) == sorted(brute(rows, 5, 6, 16, seed=3), key=str)


def test_huge_components_and_ties(spark):
    rng = np.random.default_rng(1)
    far = [(k, [float(x) for x in rng.choice([3e38, -3e38, 1e6, -2e6, 0.5], 64)]) for k in range(60)]
    assert run(spark, far) == sorted(brute(far), key=str)
    ties = [(k, [float(k % 2)] + [0.0] * 63) for k in range(40)]  # equal first centroids: all but one of a kind stay empty
    assert run(spark, ties) == sorted(brute(ties), key=str)


def test_few_rows_and_empty(spark):
    assert run(spark, [(3, [0.25] * 64)]) == sorted(brute([(3, [0.25] * 64)]), key=str)
    assert run(spark, []) == [] and run(spark, [(None, [0.1] * 64), (1, None)]) == []


def test_sums_past_a_long():
    import pyarrow as pa

    x = np.full((2, 64), 2**27, "<i4")
    batch = pa.record_batch({"vec": pa.array([r.tobytes() for r in x], pa.binary()), "n": pa.array([2**40, 2**41], pa.int64())})
    (got,) = m.sums(iter([batch]), np.zeros((1, 64), np.int64))
    assert got.to_pylist()[0]["n"] == 3 * 2**40 and int(got.to_pylist()[0]["total"][5]) == 3 * 2**67


def test_query_and_sql(spark, rows, tmp_path):
    import duckdb

    spark.createDataFrame([(i, v, 0, 7) for i, v in rows], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = sorted((tuple(r) for r in m.query(spark, f"file://{tmp_path}").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = con.sql(m.ORACLE)
    order = [found.columns.index(c) for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")]
    assert sorted((tuple(r[j] for j in order) for r in found.fetchall()), key=str) == got
