r"""Substring deduplication with fixed-block anchors.

Text is a sequence of words ([^\x20\x09-\x0D]+). A word goes if it lies in a window of `window` words that also starts
earlier in the corpus (smaller doc_id, or the same document and an earlier start).

1. Anchors: every document's non-overlapping blocks of `block` words are the index. A window of at least 2 * block - 1
   words holds one whole block of its document, so of two equal windows each holds an anchor of the other.
2. Probes: every rolling run of `block` words probes the index. Documents are dealt to groups by ranges of doc_id that hold
   like bytes; rows of one doc_id, or without one, that fill more than a range are split by a hash of their text. A group
   sends each distinct fingerprint once, packed by fingerprint bucket, so neither a frequent passage nor copies of a
   document crowd a bucket, and a row holds thousands of fingerprints instead of one. A bucket answers each group with
   those of its probes that are anchors and occur twice.
3. Extension: each hit is extended to all windows around it. The windows' 96-bit hashes go the same way, each once a
   group, and a bucket tells every group but the first which of its windows start earlier. Within a group the order is
   the documents' order. The union of the windows found is the union of the maximal exact repeats.

Groups and buckets grow with the corpus and stay of one size; nothing is collected, no pairs are made. Fingerprints of
the first exchange are 32 bits in a bucket: a false hit costs an extended window and cannot change the result. Texts are
shuffled once, and the three passes read the same exchange.

Equality is that of hashes: windows are equal if 96 bits of a sum over their words' 64-bit hashes are. For n distinct windows
and v distinct words, texts that differ are taken for equal with a probability under n**2 / 2**97 + v**2 / 2**65.

Defined results: a null text has no words; documents of fewer than `window` words lose none; a null doc_id sorts after all
others; rows of equal doc_id are in the order of a hash of their texts; repeated rows give repeated rows; an empty table
gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches
from .words import constants, hashed, members, mix, split_words, windows

#: Bytes of text in a group and fingerprints in a bucket, on average.
GROUP_BYTES, BUCKET_PRINTS = 6 << 20, 1 << 20
#: Most marks between groups that are quantiles of doc_id by bytes; with more groups, those between two marks are of equal width.
MARKS = 4096
#: Bytes of text for which a row counts once more when quantiles are taken.
UNIT = 4096


class Group:
    """The documents of one group in order, their words and hashes one after the other."""

    def __init__(self, table: pa.Table, window: int, block: int) -> None:
        ids, texts, ties = (table.column(c).to_pylist() for c in ("doc_id", "text", "tie"))
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, ties[k], texts[k] or ""))
        self.window, self.block = window, block
        self.ids = [ids[k] for k in order]
        self.words = [split_words(texts[k]) for k in order]
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.hashes = np.concatenate([hashed(w) for w in self.words]) if len(sizes) else np.empty(0, np.uint64)
        self.left = np.repeat(self.starts + sizes, sizes) - np.arange(int(sizes.sum()))  # words up to the document's end
        self.place = np.arange(int(sizes.sum())) - np.repeat(self.starts, sizes)
        long = np.repeat(sizes >= window, sizes)
        prints = windows(self.hashes, block, 1)
        self.prints = np.zeros(len(self.hashes), np.uint64)
        self.prints[: len(prints)] = prints
        self.probes = long & (self.left >= block)

    def extended(self, hit: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a hit whole."""
        reach = self.window - self.block + 1
        total = np.concatenate([[0], np.cumsum(hit)])
        n = len(hit)
        some = total[np.minimum(np.arange(n) + reach, n)] > total[:n]
        return np.flatnonzero(some & (self.left >= self.window))

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for k, (c, d) in enumerate(zip(constants(self.window, 2), constants(self.window, 3))):
            words = self.hashes[at + k]
            a += words * c
            b += words * d
        return mix(a), (mix(b) >> np.uint64(32)).astype(np.uint32)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal entries of a rising array."""
    at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.empty(0, np.int64)
    for s, e in zip(at, [*at[1:], len(buckets)]):
        yield int(buckets[s]), slice(int(s), int(e))


def low(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype(np.uint32)


PRINTS = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("probes", pa.binary()), ("again", pa.binary()), ("anchors", pa.binary())])
FOUND = pa.schema([("grp", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary())])
WINDOWS = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("high", pa.binary()), ("low", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
HIT, EARLIER = 0, 1


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{x.name} {names[x.type]}" for x in schema)


def rows_to_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], x.type) for k, x in enumerate(schema)], schema=schema)


def prints_of(table: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    """A group's probes (each once), those that it has twice, and its anchors."""
    group, g = Group(table, window, block), table.column("grp")[0].as_py()
    distinct, counts = np.unique(group.prints[group.probes], return_counts=True)
    anchors = np.unique(group.prints[group.probes & (group.place % block == 0)])
    again = distinct[counts > 1]
    parts = [dict(by_bucket(bucket_of(x, buckets))) for x in (distinct, again, anchors)]
    cut = lambda x, part, b: low(x[part[b]]).tobytes() if b in part else b""
    return rows_to_table([(b, g, *(cut(x, part, b) for x, part in zip((distinct, again, anchors), parts))) for b in parts[0]], PRINTS)


def hits_of(table: pa.Table) -> pa.Table:
    """For each group, its probes in this bucket that are anchors somewhere and occur twice."""
    unpack = lambda name: [np.frombuffer(x, np.uint32) for x in table.column(name).to_pylist()]
    groups, probes = table.column("grp").to_pylist(), unpack("probes")
    probes = [np.unique(x) for x in probes]
    distinct, counts = np.unique(np.concatenate(probes), return_counts=True)
    twice = (counts > 1) | np.isin(distinct, np.concatenate(unpack("again")))
    repeated = distinct[twice]
    repeated = repeated[np.isin(repeated, np.concatenate(unpack("anchors")))]
    bucket = table.column("bucket")[0].as_py()
    rows = [(g, HIT, bucket, x[np.isin(x, repeated, assume_unique=True)].tobytes()) for g, x in zip(groups, probes)] if len(repeated) else []
    return rows_to_table([r for r in rows if r[3]], FOUND)


def windows_around(group: Group, found: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows around a group's hits; of the distinct windows, rising: hashes, first start; of each start: which window."""
    hits = [(b, np.frombuffer(x, np.uint32)) for k, b, x in zip(*(found.column(c).to_pylist() for c in ("kind", "bucket", "found"))) if k == HIT]
    keys = np.concatenate([np.empty(0, np.uint64), *((np.uint64(b) << np.uint64(32)) | x.astype(np.uint64) for b, x in hits)])
    at = np.flatnonzero(group.probes)
    own = (bucket_of(group.prints[at], buckets) << np.uint64(32)) | (group.prints[at] & np.uint64(0xFFFFFFFF))
    hit = np.zeros(len(group.probes), bool)
    hit[at[members(own, keys)]] = True
    starts = group.extended(hit)
    high, lower = group.window_hashes(starts)
    order = np.lexsort((starts, lower, high))
    h, w = high[order], lower[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]) if len(order) else np.empty(0, bool)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return starts, h[new], w[new], starts[order][new], which


def windows_of(table: pa.Table, found: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    """The distinct windows around a group's hits, by bucket."""
    if not table.num_rows or not found.num_rows:
        return rows_to_table([], WINDOWS)
    group, g = Group(table, window, block), table.column("grp")[0].as_py()
    _, high, lower, _, _ = windows_around(group, found, buckets)
    return rows_to_table([(b, g, high[x].tobytes(), lower[x].tobytes()) for b, x in by_bucket(bucket_of(high, buckets))], WINDOWS)


def earlier_of(table: pa.Table) -> pa.Table:
    """For each group, which of its windows in this bucket an earlier group has too, as places in its rising list."""
    groups = table.column("grp").to_numpy().astype(np.int64)
    highs = [np.frombuffer(x, np.uint64) for x in table.column("high").to_pylist()]
    lows = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
    sizes = np.array([len(x) for x in highs])
    high, lower, grp = np.concatenate(highs), np.concatenate(lows), np.repeat(groups, sizes)
    place = np.arange(len(high)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((grp, lower, high))
    h, w = high[order], lower[order]
    later = np.concatenate([[False], (h[1:] == h[:-1]) & (w[1:] == w[:-1])])
    late = order[later]
    bucket, rows = table.column("bucket")[0].as_py(), []
    for g in np.unique(grp[late]):
        rows.append((int(g), EARLIER, bucket, np.sort(place[late[grp[late] == g]]).astype(np.uint32).tobytes()))
    return rows_to_table(rows, FOUND)


def removed(table: pa.Table, found: pa.Table, window: int, block: int, buckets: int) -> tuple[Group, np.ndarray]:
    """A group and which of its words go."""
    group = Group(table, window, block)
    gone = np.zeros(len(group.hashes) + 1, np.int64)
    if found.num_rows:
        starts, high, _, first, which = windows_around(group, found, buckets)
        earlier = np.zeros(len(high), bool)
        parts = dict(by_bucket(bucket_of(high, buckets)))
        for kind, b, x in zip(*(found.column(c).to_pylist() for c in ("kind", "bucket", "found"))):
            if kind == EARLIER:
                earlier[parts[b].start + np.frombuffer(x, np.uint32).astype(np.int64)] = True
        late = starts[earlier[which] | (starts != first[which])]
        np.add.at(gone, late, 1)
        np.add.at(gone, late + window, -1)
    return group, np.cumsum(gone)[:-1] > 0


def kept_words(table: pa.Table, found: pa.Table, window: int, block: int, buckets: int) -> Iterator[tuple[int | None, int, list[bytes]]]:
    """doc_id, number of words and the words that stay, of each document of a group."""
    if not table.num_rows:
        return
    group, gone = removed(table, found, window, block, buckets)
    for i, words, s in zip(group.ids, group.words, group.starts.tolist()):
        mask = gone[s : s + len(words)]
        yield i, len(words), words if not mask.any() else [w for w, x in zip(words, mask.tolist()) if not x]


def digests(table: pa.Table, found: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    rows = [(i, n, n - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()) for i, n, stay in kept_words(table, found, window, block, buckets)]
    return rows_to_table(rows, RESULT)


TEXTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def texts(table: pa.Table, found: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    rows = [(i, n, n - len(stay), b" ".join(stay).decode()) for i, n, stay in kept_words(table, found, window, block, buckets)]
    return rows_to_table(rows, TEXTS)


def group_of(ids: np.ndarray, missing: np.ndarray, ties: np.ndarray, marks: np.ndarray, each: int, null_groups: int) -> np.ndarray:
    """The numbers of the groups that rows belong to, rising with (doc_id, tie); missing doc_ids come last.

    marks are quantiles. Up to each mark there are `each` groups of equal width, and a doc_id that is several marks has as
    many more groups of its own, to which its rows are dealt by their ties, in [0, 1).
    """
    at, times = np.unique(marks, return_counts=True)
    own = (times - 1) * each
    first = np.arange(len(at) + 1) * each + np.concatenate([[0], np.cumsum(own)])
    j = np.searchsorted(at, ids)
    left, right = at[np.maximum(j - 1, 0)].astype(np.float64), at[np.minimum(j, len(at) - 1)].astype(np.float64)
    inside = np.clip(np.floor((ids - left) * each / np.maximum(right - left, 1)), 0, each - 1).astype(np.int64)
    inside[(j == 0) | (j == len(at))] = 0
    more = np.append(own, 0)[j]
    many = (more > 0) & (right == ids)
    group = first[j] + np.where(many, each + np.minimum((ties * more).astype(np.int64), more - 1), inside)
    nulls = first[-1] + each + np.minimum((ties * null_groups).astype(np.int64), null_groups - 1)
    return np.where(missing, nulls, group).astype(np.int32)


def grouped(docs: DataFrame, groups: int, size: int) -> DataFrame:
    """docs with tie, a hash of the text in [0, 1), and grp. size: bytes of all texts."""
    x, n = F.col("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0))
    units = (F.lit(1) + F.floor(n / F.lit(UNIT))).cast("int")
    weights = docs.select(x.alias("x"), F.explode(F.array_repeat(F.lit(0), units)))
    at = min(groups, MARKS)
    marks = np.array(sorted(int(m) for m in weights.where("x is not null").approxQuantile("x", [k / at for k in range(1, at)], 1 / (8 * at))), np.int64) if at > 1 else np.empty(0, np.int64)
    nulls = docs.where(x.isNull()).agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    each, null_groups = -(-groups // at), max(1, -(-nulls * groups // max(1, size)))

    @F.pandas_udf("int")
    def number(ids: pd.Series, missing: pd.Series, ties: pd.Series) -> pd.Series:
        if not len(marks):
            return missing.astype("int32")
        return pd.Series(group_of(ids.to_numpy(), missing.to_numpy(), ties.to_numpy(), marks, each, null_groups))

    tie = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), 11) / F.lit(2.0**53)
    return docs.withColumn("tie", tie).withColumn("grp", number(F.coalesce(x, F.lit(0)), x.isNull(), "tie"))


def deduplicate(docs: DataFrame, window: int = 20, block: int = 10, output=digests, schema: pa.Schema = RESULT) -> DataFrame:
    """One row per document; output chooses digests (doc_id, n_words, n_removed, kept_sha256) or texts (text instead)."""
    if window < 2 * block - 1:
        raise ValueError("a window has to hold a whole block")
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, math.ceil(size / GROUP_BYTES))
    buckets = max(least, math.ceil(size / 6 / BUCKET_PRINTS))
    dealt = grouped(docs, groups, size).repartition(groups, "grp")

    prints = dealt.groupBy("grp").applyInArrow(lambda t: prints_of(t, window, block, buckets), ddl(PRINTS))
    hits = prints.groupBy("bucket").applyInArrow(hits_of, ddl(FOUND))
    around = dealt.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(lambda t, f: windows_of(t, f, window, block, buckets), ddl(WINDOWS))
    earlier = around.groupBy("bucket").applyInArrow(earlier_of, ddl(FOUND))
    found = hits.unionByName(earlier)
    return dealt.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(lambda t, f: output(t, f, window, block, buckets), ddl(schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"), window=20, block=10)
