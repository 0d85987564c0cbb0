"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token pieces of at most `capacity` tokens; pieces are packed into as few sequences as possible. The
packing itself works on the histogram of piece lengths: pieces of one length are interchangeable, so capacity + 1 counters
describe any corpus, and the plan (which run of equal-length pieces goes to which run of sequences at which offset) is
computed on the driver from those counters alone.

1. Reduction: for a piece j, a set of pieces {j, ...} that dominates every other set with j is fixed for good, for as many
   copies as the histogram holds: j alone if nothing fits beside it; j and the largest i that fits, if i fills the rest
   exactly or no feasible pair of companions is larger than i; j and two companions, if at most two fit and each feasible
   pair is dominated item by item. This repeats until nothing changes.
2. Best fit, in decreasing order, for what is left.

The plan has at most 2 * capacity ** 2 runs, whatever the number of documents. Pieces get their number within a length by
bucketed ranking (no task sorts all pieces of a length) and look their run up in the plan.

A token's bytes never span a space that precedes a non-space, so texts are cut there. The distinct chunks of a batch are
joined and encoded in one call; as they hold no space but the one before them, each begins at a token that starts with a
space. (A single text takes its chunks from a bounded cache.) Chunks in Latin script go through tiktoken, whose rank file is
the same vocabulary under the same splitting pattern; others go through tokenizers. Special-token strings inside a text count
as ordinary text.

Defined results: a null text counts as empty and is a sequence part of one token (id 0); rows that repeat are packed
separately; a null doc_id is kept; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import Stretches, encode_all, parts, spaced
from .common import BUCKET_ROWS, cut, numbers_of_copies, read, small_batches, unit31, with_offsets

VOCABULARY = "byte_bpe_50k"
#: Chunks that a worker remembers, and the longest that it remembers.
CACHE_CHUNKS, CACHE_CHARS = 150_000, 40
SPACE_BEFORE_WORD = re.compile(r" (?=\S)")
#: Up to here both libraries classify characters alike in every version.
LATIN_END = "ɐ"
BEYOND_LATIN = re.compile(f"[{LATIN_END}-\U0010ffff]")
#: Texts with a space before white space of any kind or at the end, which are not split at each space.
ODD = r" (?:[\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}]|\z)"


class _Irregular(Exception):
    """A chunk that starts with white space."""


class Encoder(dict):
    """Text to ids as little-endian unsigned 32-bit; a dict from chunks (without their leading space) to bytes."""

    def __init__(self, vocabulary: str | None = None) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        self.stem = vocabulary or public_tokenizers.path(f"{VOCABULARY}.json").removesuffix(".json")
        with open(f"{self.stem}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def full(self):
        """The tokenizer itself; loaded when a text needs it."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(f"{self.stem}.json")
        tokenizer.encode_special_tokens = True
        return tokenizer

    def direct(self, text: str) -> bytes:
        if BEYOND_LATIN.search(text):
            ids = self.full.encode(text, add_special_tokens=False).ids
        else:
            ids = self.quick.encode_ordinary(text)
        return array("I", ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise _Irregular
        ids = self.direct(" " + chunk)
        if len(self) < CACHE_CHUNKS and len(chunk) <= CACHE_CHARS:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = text.split(" ")
        try:
            return self.direct(chunks[0]) + b"".join([self[x] for x in chunks[1:]])
        except _Irregular:
            chunks = SPACE_BEFORE_WORD.split(text)
            return self.direct(chunks[0]) + b"".join([self[x] for x in chunks[1:]])

    def fresh(self, chunks: pa.Array) -> Stretches:
        """The ids of chunks that start with a non-space, with the space before them."""
        spaces = pc.match_substring(chunks, " ").to_numpy(zero_copy_only=False)
        beyond = pc.match_substring_regex(chunks, rf"[{LATIN_END}-\x{{10ffff}}]").to_numpy(zero_copy_only=False)
        values, starts, sizes, n = [np.empty(0, np.uint32)], np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), 0
        for rows in (np.flatnonzero(~spaces & ~beyond), np.flatnonzero(~spaces & beyond), *np.flatnonzero(spaces).reshape(-1, 1)):
            if len(rows):
                ids = np.frombuffer(self.direct(" " + spaced(chunks.take(pa.array(rows)))), np.uint32)
                at = np.zeros(1, np.int64) if spaces[rows[0]] else np.flatnonzero(self.opens[ids])
                if len(at) != len(rows):
                    raise ValueError("a chunk's ids hold a space that does not begin it")
                starts[rows], sizes[rows] = n + at, np.diff(at, append=len(ids))
                values.append(ids)
                n += len(ids)
        return np.concatenate(values), starts, sizes

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (none null)."""
        return encode_all(texts, ODD, SPACE_BEFORE_WORD.split, self.fresh, self.direct)


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(vocabulary: str | None) -> Encoder:
    """The worker's encoder; made once per worker process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than capacity."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces_of(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    own = encoder(vocabulary)
    for batch in batches:
        for at, texts in parts(batch.column(1)):
            rows: list[tuple] = []
            for i, ids in zip(batch.column(0).slice(at, len(texts)).to_pylist(), own.encode_all(pc.fill_null(texts, ""))):
                ids += b"\0\0\0\0"
                rows += [(i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut_points(len(ids) // 4, capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), PIECES)], schema=PIECES)


class Plan:
    """Runs of equal-length pieces: (length, first piece number, pieces, first sequence, offset in each)."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity, self.count = capacity, [0] * (capacity + 1)
        for n, c in histogram.items():
            self.count[n] += c
        self.used, self.bins, self.runs = [0] * (capacity + 1), 0, []
        self.reduce()
        self.fixed = self.bins
        self.best_fit()

    def put(self, n: int, pieces: int, first_bin: int, offset: int) -> None:
        self.runs.append((n, self.used[n], pieces, first_bin, offset))
        self.used[n] += pieces
        self.count[n] -= pieces

    def fix(self, members: tuple[int, ...], times: int) -> None:
        offset = 0
        for n in members:
            self.put(n, times, self.bins, offset)
            offset += n
        self.bins += times

    def others(self, j: int) -> list[tuple[int, int]]:
        """(length, count) of the pieces other than one of length j, in rising order."""
        return [(n, c - (n == j)) for n, c in enumerate(self.count) if c - (n == j) > 0]

    def dominating(self, j: int) -> tuple[int, ...] | None:
        """The companions in a set that dominates all sets with a piece of length j; None if none is known to."""
        rest, others = self.capacity - j, self.others(j)
        fitting = [x for x in others if x[0] <= rest]
        if not fitting:
            return ()
        largest = fitting[-1][0]
        if largest == rest:
            return (largest,)
        small = [n for n, c in others[:3] for _ in range(min(c, 3))][:3]
        if len(small) < 2 or small[0] + small[1] > rest:
            return (largest,)
        if len(small) == 3 and sum(small) <= rest:
            return None
        # at most two companions fit: the largest sum of two, and the largest that the smaller of two can be
        best, second = 0, 0
        low, high = 0, len(fitting) - 1
        while low <= high:
            (a, ca), (b, _) = fitting[low], fitting[high]
            if a + b > rest:
                high -= 1
            elif low == high and ca < 2:
                break
            else:
                best, second = max(best, a + b), max(second, a)
                low += 1
        if best <= largest:
            return (largest,)
        left = [n for n, c in fitting if n <= rest - largest and c - (n == largest) > 0]
        return (largest, left[-1]) if left and second <= left[-1] else None

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for j in range(self.capacity, 0, -1):
                while self.count[j]:
                    found = self.dominating(j)
                    if found is None:
                        break
                    members = (j, *found)
                    self.fix(members, min(self.count[n] // members.count(n) for n in set(members)))
                    changed = True

    def best_fit(self) -> None:
        room: list[deque] = [deque() for _ in range(self.capacity + 1)]  # by what is left: runs of sequences
        for n in range(self.capacity, 0, -1):
            left = n
            while self.count[n]:
                while left < self.capacity and not room[left]:
                    left += 1
                if left == self.capacity:  # a new sequence
                    times = max(1, self.count[n] // (left // n))
                    room[left].append((self.bins, times))
                    self.bins += times
                first, times = room[left].popleft()
                each = min(left // n, self.count[n])  # a sequence takes all that fit before the next one is touched
                taken = min(times, self.count[n] // each)
                for k in range(each):
                    self.put(n, taken, first, self.capacity - left + k * n)
                room[left - each * n].append((first, taken))
                if taken < times:
                    room[left].appendleft((first + taken, times - taken))
                left = n if left - each * n >= n else left

    def arrays(self) -> tuple[np.ndarray, ...]:
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)
        return (runs[:, 0] << 40) + runs[:, 1], runs[:, 1], runs[:, 3], runs[:, 4]


PACKED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def assigned(batches: Iterator[pa.RecordBatch], plan: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    keys, first, sequence, offset = plan
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
        at = np.searchsorted(keys, (length.astype(np.int64) << 40) + rank, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("piece"), batch.column("start"), pa.array(length.astype(np.int64)), batch.column("ids_crc32"), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. vocabulary: path without suffix."""
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = source.mapInArrow(lambda it: pieces_of(it, capacity, vocabulary), "doc_id long, piece int, start long, length int, ids_crc32 long")
    pieces = cut(pieces.withColumn("_row", F.monotonically_increasing_id()))
    histogram = dict(pieces.groupBy("length").count().collect())  # capacity rows at most
    plan = Plan(histogram, capacity).arrays()
    sizes = docs.sparkSession.createDataFrame([(int(n), -(-c // BUCKET_ROWS)) for n, c in histogram.items()], "length int, _buckets long")
    # rows that repeat are spread by their number, or all of them would be in one bucket
    pieces = numbers_of_copies(pieces, ["doc_id", "piece", "ids_crc32"], "_row").join(F.broadcast(sizes), "length")
    pieces = pieces.withColumn("_u", unit31(F.lit(7), F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("_row")))
    pieces = pieces.withColumn("_bucket", F.floor(F.col("_u") * F.col("_buckets") / F.lit(2**31)).cast("long")).drop("_buckets")
    offsets = with_offsets(pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), ["length"], "_bucket", "_n", "_off").drop("_n")
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_u", "doc_id", "piece")))
    ranked = ranked.join(offsets, ["length", "_bucket"]).withColumn("_rank", (F.col("_rank") + F.col("_off") - 1).cast("long"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(lambda it: assigned(it, plan), PACKED_DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), capacity=2048)
