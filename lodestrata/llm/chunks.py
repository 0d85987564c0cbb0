"""Texts as chunks that repeat: each distinct chunk of a batch is encoded once, and ids are put together as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at once; a longer text is encoded alone.
PART_BYTES = 4_000_000
#: Chunks whose ids are put together at once.
STEP = 500_000

#: Values, and for each chunk where its ids start in them and how many they are.
Stretches = tuple[np.ndarray, np.ndarray, np.ndarray]


def parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of stretches of texts of about PART_BYTES, so that ids of many long texts aren't held at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PART_BYTES, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def listed(texts: pa.Array) -> list[str]:
    """The texts (none null); to_pylist makes a scalar of each on the way."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def spaced(texts: pa.Array) -> str:
    """The texts with a space between two."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), " ")[0].as_py()


def taken(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at starts and have these sizes, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def encode_all(texts: pa.Array, odd: str, chunks: Callable[[str], list[str]], fresh: Callable[[pa.Array], Stretches], first: Callable[[str], bytes] | None = None) -> list[bytes]:
    """The ids of each text (none null) as little-endian unsigned 32-bit.

    Texts are split at each space, but those that match the pattern odd by chunks. fresh makes the ids of distinct chunks;
    the first chunk of a text goes to first, if given.
    """
    is_odd = pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False)
    order = np.concatenate([np.flatnonzero(~is_odd), np.flatnonzero(is_odd)])
    split = pc.split_pattern(texts.filter(pa.array(~is_odd)), " ")
    own = [chunks(x) for x in listed(texts.filter(pa.array(is_odd)))]
    counts = np.concatenate([split.value_lengths().to_numpy(zero_copy_only=False), [len(x) for x in own]]).astype(np.int64)
    all_chunks, ends = pa.concat_arrays([split.flatten(), pa.array(chain.from_iterable(own), texts.type)]), np.cumsum(counts)
    if first:
        apart = np.zeros(len(all_chunks), bool)
        apart[ends - counts] = True
        coded = all_chunks.filter(pa.array(~apart)).dictionary_encode()
        values, starts, sizes = fresh(coded.dictionary)
        firsts = [first(x) for x in listed(all_chunks.filter(pa.array(apart)))]
        codes = np.empty(len(all_chunks), np.int64)
        codes[~apart], codes[apart] = coded.indices.to_numpy(), len(sizes) + np.arange(len(firsts))
        more = np.array([len(x) // 4 for x in firsts], np.int64)
        starts = np.concatenate([starts, len(values) + np.cumsum(more) - more])
        values, sizes = np.concatenate([values, np.frombuffer(b"".join(firsts), np.uint32)]), np.concatenate([sizes, more])
    else:
        coded = all_chunks.dictionary_encode()
        codes, (values, starts, sizes) = coded.indices.to_numpy(), fresh(coded.dictionary)
    at = np.concatenate([[0], np.cumsum(sizes[codes])])
    ids = np.empty(at[-1], np.uint32)
    for k in range(0, len(codes), STEP):
        some = codes[k : k + STEP]
        ids[at[k] : at[k + len(some)]] = taken(values, starts[some], sizes[some])
    out: list[bytes] = [b""] * len(texts)
    for i, a, b in zip(order.tolist(), at[ends - counts].tolist(), at[ends].tolist()):
        out[i] = ids[a:b].tobytes()
    return out
