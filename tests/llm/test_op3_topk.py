from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from lodestrata.llm import op3_topk as m

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType())])


def brute(rows, k=5, every=50):
    most = 2**63 - 1
    good = {}
    for i, v, _ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.setdefault(i, set()).add(tuple(math.floor(256 * float(np.float32(x))) for x in v))
    flat = [(i, v) for i, vs in good.items() for v in vs]
    out = []
    for q, a in flat:
        if q % every == 0:
            scores = sorted((-max(-most, min(most, sum(x * y for x, y in zip(a, b)))), i) for i, b in flat if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, parts=4, **how):
    return sorted(tuple(r) for r in m.top_k(spark.createDataFrame(rows, SCHEMA).repartition(parts), **how).select("query_id", "rank", "vec_id", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 16))
    out = [(k, [float(x) for x in centers[k % 6] + rng.normal(size=16) * 0.3], k % 6) for k in range(700)]
    hot = [float(x) for x in rng.normal(size=16)]
    out += [(1000 + k, hot, 0) for k in range(220)]  # equal vectors, queries among them
    out += [(2000 + k, [0.0] * 16, 0) for k in range(20)] + [(3000, None, 0), (3050, [1.0, None] + [0.0] * 14, 0), (3100, [float("nan")] * 16, 0), (3150, [float("inf")] * 16, 0)]
    return out + [(None, hot, 0), (4000, [0.5] * 8, 0), (4050, [], 0), (4100, [-1.0] * 16, 0), (60, out[60][1], 0)]


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_equals_brute_force(spark, rows, slices):
    assert run(spark, rows, slices=slices) == brute(rows)


def test_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(m, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(m, "HELD", 10)
    assert run(spark, rows, 7, k=3) == brute(rows, 3)


def test_large_components(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([1e7, -1e7, 3e6, 0.001]) for _ in range(6)], 0) for k in range(120)]
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_empty(spark):
    assert run(spark, [(0, [1.0], 0)]) == [] and run(spark, [(0, [1.0], 0), (1, [1.0], 0)]) == [(0, 1, 1, 65536)]
    assert m.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
