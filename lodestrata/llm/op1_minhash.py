"""Near-duplicate detection with DartMinHash signatures.

A document is the multiset of its runs of five words; similarity is the weighted Jaccard index, and documents of 0.8 or
more are linked. Each occurrence of a run is an element region of width one (a fraction for fractional weights). Darts are
thrown into regions as a Poisson process over rank that depends on the region alone, so equal regions of two documents get
equal darts; a document of weight n looks only at darts of rank under t / n, about t of them however long it is. Each dart
names one of `coordinates` coordinates and the earliest dart of a coordinate is the signature there; where one stays empty,
t is doubled. Two signatures agree in a coordinate with the probability of the similarity.

Bands of `rows` coordinates make candidates: 24 bands of 4 miss a pair of similarity 0.8 with a probability of 3e-6. Links
are exact, by the element regions themselves:

1. Documents of equal word sequences are one text, with one representative.
2. In each band's bucket, all texts are compared with the smallest one. So a group of near copies of any size becomes one
   component by as many comparisons as it has texts.
3. In buckets that still hold texts of different components, texts of different components are compared with each other
   inside tasks, block by block: one pass over a block's regions gives a text's overlaps with all others. A block emits
   no pairs but the links that join components, one less than its texts at most. Texts of the bucket's largest component
   meet only the others. So no link between texts is lost to step 2, and no group makes pairs of its size squared.

Regions are 64-bit hashes throughout, made once for each text that shares a band. Where regions meet, cells are bounded in
bytes: a text that many are compared with goes once to each cell of those, and blocks of a bucket hold about BLOCK_TEXTS
texts or BLOCK_BYTES, or twice the bucket's longest text if that is more.

Components follow from the links in Spark. Result: one row per document with the smallest doc_id of its class.

Defined results: a text of fewer than five words is one run of all its words; a null text or one without words is alone in
its class; a null doc_id is alone in its class, with a null class_id; rows that repeat give repeated rows of one class; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, look_up, no_broadcast_bound, read, small_batches
from .components import components
from .words import GOLDEN, hashed, mix, split_words, windows

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Words that are sketched at once.
CHUNK_WORDS = 50_000
#: Texts of a bucket that meet as one block, and bytes of their regions.
BLOCK_TEXTS, BLOCK_BYTES = 1024, 8 << 20
#: Bytes of regions that are compared with the first of their bucket in one cell.
CELL_BYTES = 4 << 20
#: Ids that are broadcast to pick out the documents that need an exact comparison.
BROADCAST_IDS = 1_000_000

_TURN = 0xD1B54A32D192ED03


def regions(shingles: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Rising ids of the unit regions of a multiset: the k-th occurrence of a shingle is a region of its own.

    With weights, shingles are distinct, and a weight of 2.3 is two regions of width 1 and one of 0.3; widths come second.
    """
    if weights is None:
        s = np.sort(shingles)
        new = np.concatenate([[True], s[1:] != s[:-1]])
        at = np.flatnonzero(new)
        nth = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
        width = None
    else:
        n = np.ceil(weights).astype(np.int64)
        s = np.repeat(shingles, n)
        nth = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
        width = np.minimum(1.0, np.repeat(weights, n) - nth)
    ids = mix(s + nth.astype(np.uint64) * GOLDEN)
    order = np.argsort(ids)
    return ids[order], None if width is None else width[order]


def darts(ids: np.ndarray, owner: np.ndarray, most: np.ndarray, width: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, rank, dart) of all darts of rank under most in these regions. owner: each region's document."""
    rank, step, found = np.zeros(len(ids)), 0, []
    while len(ids):
        step += 1
        x = mix(ids + np.uint64(step * _TURN % 2**64))
        rank = rank - np.log(((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)  # the next arrival
        near = rank < most
        ids, owner, most, rank, x = ids[near], owner[near], most[near], rank[near], x[near]
        inside = slice(None)
        if width is not None:
            width = width[near]
            inside = (mix(x ^ GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < width  # where in the region it fell
        found.append((owner[inside], rank[inside], x[inside]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (owner, rank, ids)


def signatures(ids: np.ndarray, sizes: np.ndarray, coordinates: int, width: np.ndarray | None = None) -> np.ndarray:
    """The signatures of documents whose regions stand one after the other; sizes: regions of each, at least one."""
    n = len(sizes)
    out, best = np.zeros((n, coordinates), np.uint64), np.full((n, coordinates), np.inf)
    todo, throw = np.arange(n), coordinates * (np.log(coordinates) + 3)
    starts = np.cumsum(sizes) - sizes
    while len(todo):
        own = sizes[todo]
        at = np.repeat(starts[todo], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        weight = own if width is None else np.add.reduceat(width[at], np.cumsum(own) - own)
        owner, rank, dart = darts(ids[at], np.repeat(np.arange(len(todo)), own), np.repeat(throw / weight, own), None if width is None else width[at])
        place = owner * coordinates + (((mix(dart) >> np.uint64(32)) * np.uint64(coordinates)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(rank)[::-1]  # the earliest is written last
        flat_best, flat_out = np.full(len(todo) * coordinates, np.inf), np.zeros(len(todo) * coordinates, np.uint64)
        flat_best[place[order]], flat_out[place[order]] = rank[order], dart[order]
        best[todo], out[todo] = flat_best.reshape(-1, coordinates), flat_out.reshape(-1, coordinates)
        todo = todo[np.isinf(best[todo]).any(axis=1)]
        throw *= 2
    return out


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of a document's runs of words; of all its words, if they are fewer."""
    return windows(hashes, min(size, len(hashes)), 11 + min(size, len(hashes)))


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """The rows of a batch; no more than step of them are Python objects at once."""
    for at in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


SKETCH = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("bands", pa.list_(pa.int64()))])
SKETCH_DDL = "doc_id long, text_key binary, bands array<long>"


def sketches(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Of each document with words: the key of its word sequence and its band hashes."""

    def flush(ids: list, words: list) -> pa.RecordBatch:
        keys = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
        parts = [regions(shingle_hashes(hashed(w), shingle))[0] for w in words]
        sig = signatures(np.concatenate(parts), np.array([len(p) for p in parts]), bands * rows)
        band = np.zeros((len(ids), bands), np.uint64)
        for k in range(rows):
            band = mix(band * GOLDEN + sig[:, k::rows])
        band = mix(band + np.arange(bands, dtype=np.uint64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * bands, pa.int32()), pa.array(band.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), lists], schema=SKETCH)

    ids, words, held = [], [], 0
    for batch in batches:
        for i, text in rows_of(batch):
            if w := split_words(text):
                ids.append(i)
                words.append(w)
                held += len(w)
            if held >= CHUNK_WORDS:
                yield flush(ids, words)
                ids, words, held = [], [], 0
    if ids:
        yield flush(ids, words)


def region_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(id, regions) of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [regions(shingle_hashes(hashed(split_words(x)), shingle))[0].tobytes() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["id", "regions"])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two rising arrays of regions."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def linked(members: pa.Table, firsts: pa.Table, least: float) -> pa.Table:
    """The pairs (a, b) of at least that similarity. members: a, b, regions of b; firsts: first, own (its regions)."""
    known, keep = {}, []
    for a, x in zip(firsts.column("first").to_pylist(), firsts.column("own")):
        known.setdefault(a, []).append(np.frombuffer(x.as_buffer(), np.uint64))
    for a, y in zip(members.column("a").to_pylist(), members.column("regions")):
        y = np.frombuffer(y.as_buffer(), np.uint64)
        keep.append(any(min(len(x), len(y)) >= least * max(len(x), len(y)) and weighted_jaccard(x, y) >= least for x in known[a]))
    return members.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def regions_of(docs: DataFrame, ids: DataFrame, shingle: int, broadcast_ids: int) -> DataFrame:
    """(id, regions) of the documents that ids (doc_id) names."""
    ids = cut(ids.distinct())
    if not no_broadcast_bound(ids, broadcast_ids):
        ids = F.broadcast(ids)
    texts = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text")
    return cut(texts.mapInArrow(lambda it: region_rows(it, shingle), "id long, regions binary"))


def verified(pairs: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar. found: (id, regions) of all of them."""
    sizes = found.groupBy("id").agg(F.min(F.octet_length("regions")).alias("_low"), F.max(F.octet_length("regions")).alias("_high"))
    of = lambda c: sizes.select(F.col("id").alias(c), F.col("_low").alias(f"_low_{c}"), F.col("_high").alias(f"_high_{c}"))
    near = (F.col("_high_a") >= least * F.col("_low_b")) & (F.col("_high_b") >= least * F.col("_low_a"))
    # a text shares no more than its bands with smaller ones, but one first text may have the pairs of a large group of copies
    hubs = cut(pairs.groupBy("a").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_SHARE * pairs.count()).select("a"))
    pairs = cut(look_up(pairs, of("a"), "a", hubs).join(of("b"), "b").where(near).select("a", "b", F.col("_high_a").cast("long").alias("_own"), F.col("_high_b").cast("long").alias("_bytes")))
    held = pairs.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    group = F.pmod(F.xxhash64("a"), F.lit(max(1, -(-held // CELL_BYTES)))).cast("int").alias("grp")
    # a cell holds no less of a text's partners than of the text itself, so repeating it at most doubles what is sent
    firsts = pairs.groupBy("a").agg(F.ceil(F.sum("_bytes") / F.greatest(F.lit(CELL_BYTES), F.max("_own"))).cast("int").alias("_cells"))
    members = look_up(pairs, firsts, "a", hubs).select(group, F.pmod(F.xxhash64("b"), F.col("_cells")).cast("int").alias("cell"), "a", "b")
    members = members.join(found.withColumnRenamed("id", "b"), "b")
    firsts = firsts.select(group, F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)).alias("cell"), "a")
    firsts = firsts.join(found.withColumnRenamed("id", "a"), "a").select(F.col("grp").alias("grp"), F.col("cell").alias("cell"), F.col("a").alias("first"), F.col("regions").alias("own"))
    cells = members.groupBy("grp", "cell").cogroup(firsts.groupBy("grp", "cell"))
    return cut(cells.applyInArrow(lambda m, f: linked(m, f, least), "a long, b long").distinct())


def across(table: pa.Table, least: float) -> pa.Table:
    """Links between texts of different labels in one cell of a bucket that join all components which the cell can join.

    Texts of side 0 meet those of side 1; side 2 stands for both.
    """
    ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("regions")]
    sizes = np.array([len(x) for x in parts])
    names, flat = np.unique(np.concatenate(parts), return_inverse=True)
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(names), bool)
    group = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
    left, right = side != 1, side != 0
    if left.sum() > right.sum():
        left, right = right, left
    a, b = [], []
    for k in np.flatnonzero(left):
        if not (right & (group != group[k])).any():
            continue
        own = flat[starts[k] : starts[k] + sizes[k]]
        mark[own] = True
        shared = np.add.reduceat(mark[flat], starts)
        mark[own] = False
        for j in np.flatnonzero((shared >= least * (sizes + sizes[k] - shared)) & right & (group != group[k])):
            if group[j] != group[k]:
                a.append(min(ids[k], ids[j]))
                b.append(max(ids[k], ids[j]))
                group[group == group[j]] = group[k]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def cross_links(found: DataFrame, buckets: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between components that share a bucket. buckets: band, id; found: (id, regions) of all ids."""
    sizes = found.groupBy("id").agg(F.max(F.octet_length("regions")).cast("long").alias("_bytes"))
    rows = buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    each = rows.join(sizes, "id").groupBy("band", "label").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_b"), F.max("_bytes").alias("_most"))
    # the largest component of a bucket, by texts; what is left of the bucket's sums are the others
    mixed = each.groupBy("band").agg(F.max_by(F.struct("label", "_n", "_b"), "_n").alias("_major"), F.sum("_n").alias("_n"), F.sum("_b").alias("_b"), F.max("_most").alias("_most"), F.count("*").alias("_labels")).where("_labels > 1")
    blocks = lambda n, b: F.ceil(F.greatest(n / F.lit(BLOCK_TEXTS), b / F.greatest(F.lit(BLOCK_BYTES), 2 * F.col("_most")))).cast("int")
    major, minor = blocks(F.col("_major._n"), F.col("_major._b")), blocks(F.col("_n") - F.col("_major._n"), F.col("_b") - F.col("_major._b"))
    mixed = cut(mixed.select("band", F.col("_major.label").alias("_major"), major.alias("_of_major"), minor.alias("_of_minor"), "_n"))
    rows = cut(look_up(rows, mixed.drop("_n"), "band", mixed.where(F.col("_n") > HOT_SHARE * buckets.count())).where("_major is not null"))

    # cells of kind 1: a block of the largest component against a block of the others; of kind 0: two blocks of the others
    major = F.col("label") == F.col("_major")
    own = F.pmod(F.xxhash64("id"), F.when(major, F.col("_of_major")).otherwise(F.col("_of_minor"))).cast("int")
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumn("_own", own)
    with_minor = F.transform(to("_of_minor"), lambda w: cell(1, F.col("_own"), w, F.lit(0)))
    with_major = F.transform(to("_of_major"), lambda w: cell(1, w, F.col("_own"), F.lit(1)))
    among = F.transform(to("_of_minor"), lambda w: cell(0, F.least("_own", w), F.greatest(F.col("_own"), w), F.when(F.col("_own") == w, 2).when(F.col("_own") < w, 0).otherwise(1)))
    cells = rows.select("band", "id", "label", F.explode(F.when(major, with_minor).otherwise(F.concat(with_major, among))).alias("x")).select("band", "id", "label", "x.*")
    columns = ["id", "label", "side", "regions"]
    links = cells.join(found, "id").groupBy("band", "kind", "i", "j").applyInArrow(lambda t: across(t.select(columns), least), "a long, b long")
    return cut(links.distinct())


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, kept."""
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = source.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sketched = cut(known.mapInArrow(lambda it: sketches(it, shingle, bands, rows), SKETCH_DDL))
    texts = sketched.groupBy("text_key").agg(F.min(F.struct("doc_id", "bands")).alias("x"))
    texts = cut(texts.select("text_key", F.col("x.doc_id").alias("id"), F.col("x.bands").alias("bands")))

    banded = texts.select(F.explode("bands").alias("band"), "id")
    shared = banded.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("_last"), F.count("*").alias("_n")).where("first < _last").drop("_last")
    shared = cut(shared)
    wide = shared.where(F.col("_n") > HOT_SHARE * shared.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    buckets = cut(look_up(banded, shared.drop("_n"), "band", wide).where("first is not null"))
    pairs = cut(buckets.where("first <> id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    held = regions_of(known, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), shingle, broadcast_ids)
    links = verified(pairs, held, similarity)
    labels = components(links)

    more = cross_links(held, buckets.select("band", "id"), labels, similarity)
    if more.limit(1).count():
        labels = components(links.union(more))

    of_text = texts.select("text_key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("text_key", F.coalesce("label", "id").alias("class_id"))
    members = sketched.select("doc_id", "text_key").distinct().join(of_text, "text_key").select("doc_id", "class_id")
    # a doc_id that stands for several texts belongs to the smallest of their classes
    members = members.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    found = cut(source.select("doc_id").join(members, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")))
    sizes = cut(found.where("class_id is not null").groupBy("class_id").agg(F.count("*").cast("long").alias("class_size")))
    hot = sizes.where(F.col("class_size") > F.lit(HOT_SHARE * found.count()))
    out = look_up(found, sizes, "class_id", hot).withColumn("class_size", F.coalesce("class_size", F.lit(1).cast("long")))
    return out.select("doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one row of each class, the one of the smallest doc_id. Rows of equal doc_id count as one document."""
    gone = near_classes(docs, **parameters).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))
