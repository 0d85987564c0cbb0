from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from lodestrata.llm import op13_lattice as m

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType()), StructField("n", IntegerType()), StructField("id", IntegerType())])


def brute(rows, cosine=0.95):
    """All rows against all rows."""
    dims = max([len(v) for _, v in rows if v] or [1])
    unit = []
    for i, v in rows:
        good = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.zeros(dims)
        if good:
            x[: len(v)] = np.array(v, np.float32).astype(float)
            x /= np.abs(x).max()
            x /= np.linalg.norm(x)
        unit.append(x)
    near = np.array(unit).reshape(-1, dims) @ np.array(unit).reshape(-1, dims).T >= cosine
    np.fill_diagonal(near, False)
    label = list(range(len(rows)))
    for k in range(len(rows)):
        if label[k] == k:
            todo = [k]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if label[j] != k:
                        label[j] = k
                        todo.append(int(j))
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = i if least.get(c) is None else min(i, least[c])
    return sorted(((i, int(near[k].sum()), least[label[k]], i == least[label[k]]) for k, (i, _) in enumerate(rows)), key=str)


def run(spark, rows, parts=5, **how):
    df = spark.createDataFrame([(i, v, 0, 3, 4) for i, v in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in m.near_duplicates(df, **how).collect()), key=str)


def around(rng, base, cosine):
    """A vector at exactly this cosine of base."""
    w = rng.normal(size=len(base))
    w -= w @ base / (base @ base) * base
    return cosine * base / np.linalg.norm(base) + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    floats = lambda v: [float(x) for x in np.asarray(v, np.float32)]
    out = [(k, floats(rng.normal(size=24) * 10 ** float(rng.integers(-3, 4)))) for k in range(400)]
    for k in range(60):  # pairs far over and far under the threshold, and chains
        base = np.array(out[k][1])
        out += [(1000 + 3 * k, floats(around(rng, base, 0.985) * 5)), (1001 + 3 * k, floats(around(rng, base, 0.93))), (1002 + 3 * k, floats(around(rng, around(rng, base, 0.97), 0.97)))]
    heart = rng.normal(size=24)
    out += [(2000 + k, floats(around(rng, heart, 0.985))) for k in range(150)]  # a large group without equal vectors
    hot = floats(rng.normal(size=24))
    out += [(3000 + k, hot) for k in range(300)] + [(3300, floats(around(rng, np.array(hot), 0.98)))]  # a third of all rows alike
    out += [(4000, None), (4001, []), (4002, [0.0] * 24), (4003, [float("nan")] * 24), (4004, [float("inf")] + [1.0] * 23), (4005, [None] + [1.0] * 23), (4006, hot[:23]), (4007, [-0.0] * 24)]
    return out + [(None, hot), (None, None), (5, out[5][1]), (5, out[9][1]), (-7, hot), (4008, [3e38] * 24), (4009, [1e-38] * 24), (4010, [1e-44] * 3), (4011, [1e-44] * 3 + [-0.0])]


def test_equals_brute_force(spark, rows):
    assert run(spark, rows, miss=1e-6) == brute(rows)


@pytest.mark.parametrize("blocks,probes", [(1, 3), (2, 1)])
def test_small_parts_and_blocks(spark, rows, blocks, probes, monkeypatch):
    monkeypatch.setattr(m, "PART", 20)
    monkeypatch.setattr(m, "GROUP", 50)
    monkeypatch.setattr(m, "PAIRS", 64)
    monkeypatch.setattr(m, "SMALL", 6)
    monkeypatch.setattr(m, "blocks_for", lambda n: blocks)
    assert run(spark, rows, 7, miss=1e-4, probes=probes) == brute(rows)


def test_recall_at_the_threshold_itself():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3000, 64))
    near = np.array([around(rng, b, 0.9501) for b in base])
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    for blocks in (1, 2, 3):
        tables = m.Tables(64, m.tables_for(0.95, 0.002, blocks, 2), blocks, 2)
        met = m.meeting(tables.cells(unit(base)), tables.cells(unit(near)))[0].any(axis=1)
        assert met.mean() > 0.99


def test_lattice():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    at, near = m.decode(x), m.minimal()
    assert len(near) == 240 and ((near**2).sum(axis=1) == 2).all()
    assert (((x - at) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - at[:, None] - near[None]) ** 2).sum(axis=2) + 1e-12).all()
    unit = x.repeat(3, axis=1)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    tables = m.Tables(24, 3, 2, 4)
    whole = tables.cells(unit)
    assert all((tables.cells(unit[k : k + 7]) == whole[k : k + 7]).all() for k in range(0, 390, 13))  # alike in any batch


def test_few_rows_and_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, [1.0, 2.0])]) == [(4, 0, 4, True)]
    assert run(spark, [(4, [1.0, 2.0]), (2, [2.0, 4.0]), (9, None)]) == sorted([(4, 1, 2, False), (2, 1, 2, True), (9, 0, 9, True)], key=str)
    assert run(spark, [(None, [1.0]), (1, [0.0])]) == sorted([(None, 0, None, True), (1, 0, 1, True)], key=str)
