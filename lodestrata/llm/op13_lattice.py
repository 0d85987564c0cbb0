"""Embedding near-dedup by lattice hashing.

A table projects every unit vector at random to 8 dimensions a block, and decodes each block to its nearest point of the E8
lattice; the points of a table's blocks make a cell. A vector is at home in one cell of each table and also probes the cells
that differ in one block by the neighbouring lattice points (minimal vectors of E8) nearest to it. Two vectors meet if one
probes, or lives in, the other's home. As projections are Gaussian, the chance to meet depends on the cosine alone and not
on the data: `tables_for` estimates it at the least cosine that links and takes as many tables as keep the misses there
under `miss`. Vectors that meet are compared by their cosine in double precision, so no pair below the threshold is linked.
Blocks are added as the table grows (`blocks_for`), so cells get finer and unlike vectors seldom meet.

Identical vectors are one entry with a multiplicity. Cells are first counted by key alone (partial counts, so a hot cell is
a few rows a task), and only vectors of cells in which somebody meets somebody travel. Such cells are dealt to groups of
about GROUP rows; a cell of more than PART rows is cut into parts that meet two by two, each in its own group, so no task
gets a large cell whole. A group writes one row for each vector that has links: their number and the smallest vector of its
component there; pairs are never written. A pair that meets in several cells counts in the first one only: all tasks
compute the same cells from the vectors, in integers, so nothing about the other tables has to travel.

A cell of m vectors that link all with all is compared in m * m / 2 products, exactly, in (m / PART)**2 / 2 groups of
bounded size; that is the price of exact counts of links, and no cap replaces it.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, and a row without vec_id, link
with nothing; missing components of shorter vectors count as 0. n_links counts rows: rows of equal vectors link with each
other, repeated rows too, and rows of one vec_id with different vectors are told apart. component_id is the smallest vec_id
that links reach (null for a row without vec_id, which is kept). An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, look_up, read
from .components import components

#: Width of the projections: components of a projected unit vector have a deviation of 1 / WIDTH lattice units.
WIDTH = 2.0
#: Rows of a part of a large cell, and of a group of small ones.
PART, GROUP = 2048, 16_384
#: Vectors hashed, and pairs compared, at once.
ROWS, PAIRS = 4096, 1 << 17
#: Rows of a cell above which it is compared by matrix products.
SMALL = 48
#: Vectors and matrices are rounded to so many binary places, so their products are exact in any order.
PLACES, MATRIX_PLACES, POINT_PLACES = 20, 12, 16


@lru_cache(maxsize=1)
def minimal() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or halves with an even number of minus signs."""
    ones = [[s * (i == a) + t * (i == b) for i in range(8)] for a, b in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    halves = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(ones + halves)


def even_sum(x: np.ndarray) -> np.ndarray:
    """The nearest points of D8: whole numbers of even sum. If the rounded sum is odd, the worst place is rounded the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 shifted by a half everywhere."""
    whole, half = even_sum(x), even_sum(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


class Tables:
    """Seeded projections of `tables` tables of `blocks` blocks each, and the cells of vectors under them."""

    def __init__(self, dims: int, tables: int, blocks: int, probes: int, width: float = WIDTH, seed: int = 13) -> None:
        rng = np.random.Generator(np.random.Philox(seed))
        self.blocks, self.probes, self.tables = blocks, min(probes, 240 * blocks), tables
        self.matrix = np.rint(rng.standard_normal((tables, dims, 8 * blocks)) / width * 2**MATRIX_PLACES)
        self.shift = np.rint(rng.random((tables, 8 * blocks)) * 2**POINT_PLACES) / 2**POINT_PLACES
        self.factors = rng.integers(0, 2**64, (tables, 8 * blocks), np.uint64, endpoint=False) | np.uint64(1)
        self.salts = rng.integers(0, 2**64, tables, np.uint64, endpoint=False)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes) cell keys as signed 64-bit numbers, home first."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), np.int64)
        near = minimal()
        for s in range(0, len(unit), ROWS):
            x = np.rint(unit[s : s + ROWS] * 2**PLACES)
            n = len(x)
            for t in range(self.tables):
                at = np.rint((x @ self.matrix[t]) / 2 ** (PLACES + MATRIX_PLACES - POINT_PLACES)) / 2**POINT_PLACES + self.shift[t]
                at = at.reshape(n * self.blocks, 8)
                home = decode(at)
                factors = self.factors[t]
                doubled = (2 * home).astype(np.int64).reshape(n, -1).view(np.uint64)
                key = (doubled * factors).sum(axis=1, dtype=np.uint64) + self.salts[t]
                out[s : s + n, t, 0] = key.view(np.int64)
                if self.probes:
                    gain = ((at - home) @ near.T).reshape(n, -1)  # the larger, the nearer is that neighbour
                    best = np.argsort(-gain, axis=1, kind="stable")[:, : self.probes] if self.probes > 2 else np.stack(_top_two(gain), axis=1)[:, : self.probes]
                    steps = ((2 * near).astype(np.int64).view(np.uint64)[None] * factors.reshape(self.blocks, 1, 8)).sum(axis=2, dtype=np.uint64).ravel()
                    out[s : s + n, t, 1:] = (key[:, None] + steps[best]).view(np.int64)
        return out


def _top_two(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the two largest of each row, ties to the first."""
    first = gain.argmax(axis=1)
    rest = gain.copy()
    rest[np.arange(len(gain)), first] = -np.inf
    return first, rest.argmax(axis=1)


def meeting(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """(pairs, tables): the cell where two rows of cells meet in each table, and whether they do. Both at home there goes first,
    then the second one's home, then the first one's."""
    home, at, back = one[:, :, 0] == two[:, :, 0], (one[:, :, 1:] == two[:, :, :1]).any(axis=2), (two[:, :, 1:] == one[:, :, :1]).any(axis=2)
    return home | at | back, np.where(home | at, two[:, :, 0], one[:, :, 0])


@lru_cache(maxsize=64)
def tables_for(cosine: float, miss: float, blocks: int, probes: int, width: float = WIDTH, trials: int = 4000) -> int:
    """Tables after which two vectors of this cosine have not met with a chance of miss at most; estimated on seeded random pairs."""
    rng = np.random.default_rng(99)
    a = rng.standard_normal((trials, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((trials, 64))
    b -= (a * b).sum(axis=1)[:, None] * a
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b / np.linalg.norm(b, axis=1)[:, None]
    drawn = Tables(64, 4, blocks, probes, width, seed=98)
    met = meeting(drawn.cells(a), drawn.cells(b))[0].mean()
    return 1 if met >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - met)))


def blocks_for(vectors: int) -> int:
    """Blocks of a cell: one up to 5,000 vectors, and one more for each thousand times as many."""
    return 1 + max(0, math.ceil(math.log(max(1, vectors) / 5000, 1000)))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vec) with vec null for rows that link with nothing; equal vectors have equal bytes: no trailing zeros, no minus zero."""
    for batch in batches:
        out = []
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = None if i is None or not x.is_valid or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
            if v is not None:
                last = np.flatnonzero(v)
                v = v[: last[-1] + 1].tobytes() if len(last) and np.isfinite(v).all() else None
            out.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])


def units(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of length 1 from packed ones."""
    out = np.zeros((len(column), dims))
    for k, x in enumerate(column):
        v = np.frombuffer(x.as_buffer(), "<f8")
        out[k, : len(v)] = v
    out /= np.abs(out).max(axis=1, initial=0)[:, None]  # so that no square is too large or too small
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def placed(batches: Iterator[pa.RecordBatch], tables: Tables, dims: int) -> Iterator[pa.RecordBatch]:
    """(cell, home, id, tag) for every cell that an entry lives in or probes."""
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            part = batch.slice(s, ROWS)
            cells = tables.cells(units(part.column(2), dims))
            each = cells.shape[1] * cells.shape[2]
            home = np.zeros(cells.shape, bool)
            home[:, :, 0] = True
            ids = [pa.array(np.repeat(part.column(k).to_numpy(), each)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(home.ravel()), *ids], names=["cell", "home", "id", "tag"])


def near_pairs(cell: np.ndarray, part: np.ndarray, home: np.ndarray, entry: np.ndarray, unit: np.ndarray, apart: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of rows of one cell that reach the cosine and of which one is at home; apart: of different parts only.

    Rows are sorted by cell. In a small cell row i meets the rows after it up to its cell's end, so the pairs of many cells
    are compared at once, about PAIRS; a cell of more than SMALL rows is compared by matrix products.
    """
    n = len(cell)
    end = np.searchsorted(cell, cell, side="right")
    size = end - np.searchsorted(cell, cell)

    def good(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = (home[i] | home[j]) & ((part[i] != part[j]) if apart else True)
        return i[keep], j[keep]

    for s in np.flatnonzero((size > SMALL) & (np.arange(n) == end - size)).tolist():
        for i in range(s, end[s], PART // 4):
            near = unit[entry[i : min(i + PART // 4, end[s])]] @ unit[entry[i : end[s]]].T >= cosine
            a, b = np.nonzero(np.triu(near, 1))
            yield good(a + i, b + i)
    runs = np.where(size > SMALL, 0, end - np.arange(n) - 1)
    total = np.concatenate([[0], np.cumsum(runs)])
    s = 0
    while s < n:
        e = max(s + 1, int(np.searchsorted(total, total[s] + PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(s, e), runs[s:e])
        i, j = good(i, i + 1 + np.arange(len(i)) - np.repeat(total[s:e] - total[s], runs[s:e]))
        near = np.einsum("ij,ij->i", unit[entry[i]], unit[entry[j]]) >= cosine
        yield i[near], j[near]
        s = e


def roots(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """root (the smallest place of each place's component) after the links a - b."""
    while len(a):
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


FOUND = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("links", pa.int64()), ("root_id", pa.int64()), ("root_tag", pa.int64())])
FOUND_DDL = "id long, tag long, links long, root_id long, root_tag long"


def linked(key: tuple, rows: pa.Table, tables: Tables, dims: int, cosine: float) -> pa.Table:
    """What a group finds: for each entry with links their number, as rows of the table, and the smallest entry of its component."""
    rows = rows.combine_chunks()
    ids, tags = (rows.column(c).to_numpy() for c in ("id", "tag"))
    order = np.lexsort((tags, ids))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (tags[order][1:] != tags[order][:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(fresh) - 1  # places of entries, by id and tag
    one = order[fresh]
    ids, tags, n = ids[one], tags[one], rows.column("n").to_numpy()[one]
    unit = units(rows.column("vec").combine_chunks().take(pa.array(one)), dims)

    cell, part, home = (rows.column(c).to_numpy() for c in ("cell", "part", "home"))
    # an entry may come to a cell twice (two probes with one key): its home counts
    order = np.lexsort((~home, entry, cell))
    first = np.ones(len(order), bool)
    first[1:] = (cell[order][1:] != cell[order][:-1]) | (entry[order][1:] != entry[order][:-1])
    order = order[first]
    cell, part, home, entry = cell[order], part[order], home[order], entry[order]
    links, root, cells = np.zeros(len(ids), np.int64), np.arange(len(ids)), None
    for i, j in near_pairs(cell, part, home, entry, unit, key[1].as_py() != key[2].as_py(), cosine):
        if len(i) and cells is None:
            cells = tables.cells(unit)
        for s in range(0, len(i), PAIRS):
            x, y = entry[i[s : s + PAIRS]], entry[j[s : s + PAIRS]]  # x < y, as a cell's rows are sorted by entry
            met, where = meeting(cells[x], cells[y])
            own = where[np.arange(len(x)), met.argmax(axis=1)] == cell[i[s : s + PAIRS]]
            x, y = x[own], y[own]
            np.add.at(links, x, n[y])
            np.add.at(links, y, n[x])
            root = roots(x, y, root)
    has = np.flatnonzero(links)
    return pa.Table.from_arrays([pa.array(v) for v in (ids[has], tags[has], links[has], ids[root[has]], tags[root[has]])], schema=FOUND)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, miss: float = 0.002, probes: int = 2, seed: int = 13) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(packed, "vec_id long, vec binary")
    some = rows.where("vec is not null")
    entries = some.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    # tag tells entries of one id apart
    entries = cut(entries.select("id", F.xxhash64("vec").alias("tag"), "vec", "n"))
    count, total, size = entries.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.octet_length("vec")), F.lit(0))).first()
    dims, blocks = max(1, size // 8), blocks_for(count)
    tables = Tables(dims, tables_for(cosine, miss, blocks, probes), blocks, probes, seed=seed)

    visits = entries.mapInArrow(lambda it: placed(it, tables, dims), "cell long, home boolean, id long, tag long")
    crowds = cut(visits.groupBy("cell").agg(F.count("*").alias("rows"), F.max("home").alias("lived_in")).where("rows > 1 and lived_in").select("cell", "rows"))
    met, largest = crowds.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.max("rows")).first()
    hot = crowds.where(F.col("rows") > max(PART, HOT_SHARE * met))
    live = look_up(visits, crowds, "cell", hot).where("rows is not null")
    groups = max(1, math.ceil(met / GROUP))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(PART))).cast("int")
    live = live.select("cell", "home", "id", "tag", parts.alias("parts"), F.when(parts > 1, F.pmod(F.xxhash64("id", "tag"), parts)).otherwise(0).cast("int").alias("part"))
    live = live.join(entries, ["id", "tag"])
    # a cell of one part goes to a group of such cells; of a larger one each two parts make a group
    dealt = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("group", F.when(F.col("parts") > 1, F.col("cell")).otherwise(F.pmod("cell", F.lit(groups))))
    dealt = dealt.withColumn("one", F.when(F.col("parts") > 1, F.least("part", "other")).otherwise(-1)).withColumn("two", F.when(F.col("parts") > 1, F.greatest("part", "other")).otherwise(-1))
    found = dealt.select("group", "one", "two", "cell", "part", "home", "id", "tag", "n", "vec").groupBy("group", "one", "two")
    found = cut(found.applyInArrow(lambda key, t: linked(key, t, tables, dims, cosine), FOUND_DDL))

    node = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("tag"))
    links = found.groupBy("id", "tag").agg(F.sum("links").alias("links"))
    ends = found.where("id <> root_id or tag <> root_tag").select(node("id", "tag").alias("a"), node("root_id", "root_tag").alias("b")).distinct()
    labels = components(ends).select(F.col("node.id").alias("id"), F.col("node.tag").alias("tag"), F.col("label.id").alias("component_id"))
    known = entries.join(links, ["id", "tag"], "left").join(labels, ["id", "tag"], "left")
    known = known.select("vec", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    all_ = look_up(rows, known, "vec", known.where(F.col("n") > HOT_SHARE * total))
    all_ = all_.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return all_.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.95)
