"""Exact deduplication with Patricia-trie owners.

A text's identity is its bytes without white space. Texts are dealt to partitions by length and content hash; each
partition inserts the full byte strings into a compressed radix trie whose terminal nodes hold the owner (most code
points, then smallest id) and the number of rows. Equal strings meet in one terminal node, so equality is decided by
the bytes and never by a hash alone.

* Before the shuffle each task runs a trie of its own, so a text that a third of all rows share crosses the network once a
  task. That trie has a byte budget, which counts labels and a fixed cost of each node and owner: over it, its largest subtree
  is spilled, that is, emitted as partial owners and freed. The weight of each subtree below the root is kept as strings come.
* After the shuffle a partition's strings go into one trie again, whose terminals merge the partial owners. They arrive in
  byte order (Spark's external sort holds what waits), so a string can only meet those on the rightmost path. Over the byte
  budget, all subtrees left of that path are spilled: nothing can reach them any more, so what they hold is final. Memory
  is bounded by the budget and the longest text, and not by the partition.
* Documents then look up their owner by (length, SHA-256). The trie checks that this pair names one byte string only and
  fails the job otherwise, rather than merging different texts. The owner of a text that more than HOT_SHARE of all rows have
  is repeated under several salts, over which these rows are dealt, so a reducer gets no more than about that share of one text.

Defined results: a null text counts as empty, and empty texts are one group; a null doc_id sorts after all others; an empty
table gives no rows. Rows that repeat give repeated rows in exact_groups; of rows of one doc_id that are copies of each
other, those of the most code points are marked kept, and drop_exact_copies keeps one of them. exact_groups ignores other
columns; drop_exact_copies returns them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, HOT_SHARE, cut, no_broadcast_bound, read, small_batches

#: Bytes of memory that a task's trie may hold.
TRIE_BYTES = 64 << 20
#: Memory of a node with its children's table, and of an owner, as CPython 3.13 takes it; a test measures it.
NODE_BYTES, OWNER_BYTES = 330, 260
#: Bytes of text in one Arrow batch on the way out.
BATCH_BYTES = 4 << 20
#: Texts with copies that are broadcast; each takes about 100 bytes.
BROADCAST_TEXTS = 200_000
LAST = (1 << 63) - 1


def common_prefix(a: bytes, at_a: int, b: bytes, at_b: int) -> int:
    """The length of the longest common prefix of a[at_a:] and b[at_b:]."""
    most, low = min(len(a) - at_a, len(b) - at_b), 0
    step = 16
    while low < most:
        n = min(step, most - low)
        if a[at_a + low : at_a + low + n] == b[at_b + low : at_b + low + n]:
            low += n
            step *= 4
        elif n == 1:
            break
        else:
            step = max(1, n // 2)
            most = min(most, low + n)
    return low


class Node:
    """label: the bytes on the edge to this node; owner: [code points, id, rows, rows like the owner, tag] at terminals."""

    __slots__ = ("children", "label", "owner")

    def __init__(self, label: bytes, owner: list | None = None) -> None:
        self.label, self.owner, self.children = label, owner, {}


def merge(owner: list, other: list) -> None:
    """Takes other's rows into owner; both belong to one text."""
    if owner[4] != other[4]:
        raise ValueError("one text has two digests")
    owner[2] += other[2]
    if (-owner[0], owner[1]) == (-other[0], other[1]):
        owner[3] += other[3]
    elif (-other[0], other[1]) < (-owner[0], owner[1]):
        owner[0], owner[1], owner[3] = other[0], other[1], other[3]


class PatriciaTrie:
    """A compressed radix trie over byte strings that knows its memory, whole and by subtree of the root."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.root, self.bytes, self.weights = Node(b""), 0, {}

    def grow(self, key: bytes, n: int) -> None:
        self.bytes += n
        self.weights[key[0]] = self.weights.get(key[0], 0) + n

    def insert(self, key: bytes, owner: list) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.owner is None:
                    node.owner = owner
                    if key:  # the root's own owner is one only
                        self.grow(key, OWNER_BYTES)
                else:
                    merge(node.owner, owner)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], owner)
                self.grow(key, len(key) - at + NODE_BYTES + OWNER_BYTES)
                return
            n = common_prefix(child.label, 0, key, at)
            if n < len(child.label):  # split the edge
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                child = upper
                self.grow(key, NODE_BYTES)
            node, at = child, at + n

    def subtree(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        """The strings below node, in byte order."""
        todo = [(node, prefix + node.label)]
        while todo:
            node, key = todo.pop()
            if node.owner is not None:
                yield key, node.owner
            todo.extend((child, key + child.label) for _, child in sorted(node.children.items(), reverse=True))

    def spill_largest(self) -> Iterator[tuple[bytes, list]]:
        """Takes out the root's largest subtree and yields its strings."""
        if self.weights:
            byte = max(self.weights, key=self.weights.get)
            yield from self.subtree(self.root.children.pop(byte), b"")
            self.bytes -= self.weights.pop(byte)

    def spill_before(self, key: bytes) -> Iterator[tuple[bytes, list]]:
        """Takes out all strings but key, the last in byte order, and yields them."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                break  # what was below it would come after it
            if node.owner is not None:
                yield key[:at], node.owner
                node.owner = None
            child = node.children.pop(key[at])
            for _, done in sorted(node.children.items()):
                yield from self.subtree(done, key[:at])
            node.children = {key[at]: child}
            node, at = child, at + len(child.label)
        # one path is left, so its edges become one
        self.clear()
        self.insert(key, node.owner)

    def drain(self) -> Iterator[tuple[bytes, list]]:
        yield from self.subtree(self.root, b"")
        self.clear()


PARTIAL = pa.schema([("bytes", pa.binary()), ("size", pa.int64()), ("digest", pa.binary()), ("points", pa.int64()), ("id", pa.int64()), ("rows", pa.int64()), ("same", pa.int64())])
PARTIAL_DDL = "bytes binary, size long, digest binary, points long, id long, rows long, same long"
OWNER = pa.schema([("digest", pa.binary()), ("size", pa.int64()), ("points", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("same", pa.int64())])
OWNER_DDL = "digest binary, size long, points long, keep_id long, group_size long, same long"


def _partials(pairs: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for key, (points, i, n, same, digest) in pairs:
        rows.append((key, len(key), digest, points, i, n, same))
        held += len(key)
        if held >= BATCH_BYTES or len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), PARTIAL)], schema=PARTIAL)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), PARTIAL)], schema=PARTIAL)


def local_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial owners of one task's rows."""
    trie = PatriciaTrie()

    def pairs() -> Iterator[tuple[bytes, list]]:
        for batch in batches:
            for key, digest, points, i in zip(*(batch.column(k).to_pylist() for k in range(4))):
                trie.insert(key, [points, i, 1, 1, digest])
                while trie.bytes > TRIE_BYTES:
                    yield from trie.spill_largest()
        yield from trie.drain()

    yield from _partials(pairs())


def final_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owners from partial owners in byte order."""
    trie = PatriciaTrie()

    def pairs() -> Iterator[tuple[bytes, list]]:
        last = b""
        for batch in batches:
            for key, digest, points, i, n, same in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6))):
                if key < last:
                    raise ValueError("strings out of order")
                trie.insert(key, [points, i, n, same, digest])
                last = key
                if trie.bytes > TRIE_BYTES:
                    yield from trie.spill_before(key)
        yield from trie.drain()

    final = ((o[4], len(key), o[0], o[1] if o[1] != LAST else None, o[2], o[3]) for key, o in pairs())
    while rows := list(islice(final, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), OWNER)], schema=OWNER)


def _identity(docs: DataFrame, *more) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*more, text.alias("_text"), F.translate(text, BLANKS, "").cast("binary").alias("_bytes")).withColumn("_digest", F.unhex(F.sha2("_bytes", 256)))


def owners(docs: DataFrame) -> DataFrame:
    """digest, size, points and keep_id (of the owner), group_size and same (rows like the owner) for each distinct text."""
    keys = _identity(small_batches(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"))
    partial = keys.select("_bytes", "_digest", F.char_length("_text").cast("long").alias("_points"), "_id").mapInArrow(local_owners, PARTIAL_DDL)
    return partial.repartition("size", "digest").sortWithinPartitions("bytes").mapInArrow(final_owners, OWNER_DDL)


def with_owners(rows: DataFrame, found: DataFrame, total: int, how: str) -> DataFrame:
    """rows (digest, size, i) joined with found; the texts of more than HOT_SHARE of total rows are dealt over salts.

    Such a text has one salt for each HOT_SHARE of all rows that it has, so all salts together are no more than twice
    1 / HOT_SHARE, and so are the rows that are broadcast to tell them.
    """
    found = found.withColumn("_salts", F.ceil(F.col("group_size") / F.lit(max(1.0, total * HOT_SHARE))).cast("long"))
    hot = F.broadcast(found.where("_salts > 1").select("digest", F.col("_salts").alias("_of")))
    # rows without an id are told apart by their place
    spread = F.xxhash64(F.coalesce("i", F.monotonically_increasing_id()))
    rows = rows.join(hot, "digest", "left").withColumn("_salt", F.pmod(spread, F.coalesce("_of", F.lit(1)))).drop("_of")
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    return rows.join(found, ["digest", "size", "_salt"], how).drop("_salt")


def _rows_in(found: DataFrame) -> int:
    return found.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = _identity(docs, F.col("doc_id").cast("long").alias("i"))
    keys = keys.select("i", F.char_length("_text").cast("long").alias("_points"), F.col("_digest").alias("digest"), F.octet_length("_bytes").cast("long").alias("size"))
    texts = cut(owners(docs))
    found = with_owners(keys, texts, _rows_in(texts), "inner")
    kept = F.col("i").eqNullSafe(F.col("keep_id")) & (F.col("_points") == F.col("points"))
    return found.select(F.col("i").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """docs without the rows whose text another row owns; of rows like the owner, one stays.

    Only texts with copies are looked up. Up to broadcast_texts of them the rows of docs stay where they are; beyond that
    they are joined by a shuffle, hot texts over salts.
    """
    shared = cut(owners(docs).where("group_size > 1"))
    row, text = F.struct(*docs.columns), F.coalesce(F.col("text"), F.lit(""))
    norm = F.translate(text, BLANKS, "").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.char_length(text).cast("long").alias("n"), F.unhex(F.sha2(norm, 256)).alias("digest"), F.octet_length(norm).cast("long").alias("size"), row.alias("row"))
    if no_broadcast_bound(shared, broadcast_texts):
        found = with_owners(rows, shared, _rows_in(shared), "left")
    else:
        found = rows.join(F.broadcast(shared), ["digest", "size"], "left")
    owner = F.col("i").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("points"))
    kept = found.where(F.col("same").isNull() | (owner & (F.col("same") == 1))).select("row.*")
    if not shared.where("same > 1").limit(1).count():
        return kept
    return kept.unionByName(found.where(owner & (F.col("same") > 1)).groupBy("digest", "size").agg(F.first("row").alias("row")).select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
