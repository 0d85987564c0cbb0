"""Virtual disk arrays: a volume whose chunks are made from the chunks of its members by joins on stripe numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import raid as layout
from ..functions.binary import gf_div, gf_mul, gf_pow2
from ..functions.raid import check

STRIPE = 64 * 1024
#: Bytes of stripes that are rebuilt at once.
AT_ONCE = 16 << 20


def rebuilt(level: int, blocks: dict[int, bytes | None], row: int, disks: int, size: int) -> list[bytes | None]:
    """The data blocks of a stripe row in order. blocks: by disk, None for what can't be read. None: lost for good."""
    a = {k: np.frombuffer(v, np.uint8) for k, v in blocks.items() if v is not None}
    if level == 0:
        return [blocks.get(k) for k in range(disks)]
    if level == 1:
        return [next((blocks[k] for k in sorted(blocks) if blocks[k] is not None), None)]
    if level == 10:
        return [next((blocks[k] for k in (2 * p, 2 * p + 1) if blocks.get(k) is not None), None) for p in range(disks // 2)]
    p = disks - 1 - row % disks
    q = (p - 1) % disks if level == 6 else None
    order = [k for k in range(disks) if k not in (p, q)]
    lost = [n for n, k in enumerate(order) if k not in a]
    out = [blocks.get(k) for k in order]
    if not lost:
        return out
    known = np.zeros(size, np.uint8)
    for n, k in enumerate(order):
        if n not in lost:
            known ^= a[k]
    if len(lost) == 1 and p in a:
        out[lost[0]] = (known ^ a[p]).tobytes()
    elif level == 6 and q in a and len(lost) <= (2 if p in a else 1):
        syndrome = a[q].copy()
        for n, k in enumerate(order):
            if n not in lost:
                syndrome ^= gf_mul(gf_pow2(n), a[k])
        if len(lost) == 1:
            out[lost[0]] = gf_div(syndrome, gf_pow2(lost[0])).astype(np.uint8).tobytes()
        else:
            x, y = lost
            both = known ^ a[p]  # x + y
            first = gf_div(syndrome ^ gf_mul(gf_pow2(y), both), np.uint8(gf_pow2(x) ^ gf_pow2(y))).astype(np.uint8)
            out[x], out[y] = first.tobytes(), (first ^ both).tobytes()
    return out


def stripes_rebuilt(batches: Iterator[pa.RecordBatch], n: int, level: int, name: str) -> Iterator[pa.RecordBatch]:
    """Chunks of stripes (row, size, _d0, _d1, ... of n disks)."""
    for b in batches:
        rows, sizes = (b.column(c).to_pylist() for c in ("row", "size"))
        blocks = [b.column(c) for c in (f"_d{k}" for k in range(n))]
        # stripes that have their parity on the same disk and lack the same blocks are one long stripe
        alike: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip((r % n for r in rows), sizes, *(pc.equal(pc.binary_length(c), b.column("size")).to_pylist() for c in blocks))):
            alike.setdefault(key, []).append(i)
        for (turn, size, *whole), found in alike.items():
            step = max(1, AT_ONCE // max(1, size * n))
            for k in range(0, len(found), step):
                part = found[k : k + step]
                long = {d: b"".join(blocks[d].take(pa.array(part)).to_pylist()) if whole[d] else None for d in range(n)}
                for j, data in enumerate(made := rebuilt(level, long, turn, n, size * len(part))):
                    numbers = [rows[i] * len(made) + j for i in part]
                    columns = [[name] * len(part), numbers, [x * size for x in numbers], [bytes(size) if data is None else data[at : at + size] for at in range(0, size * len(part), size)] if size else [b""] * len(part), [data is None] * len(part)]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["volume_id", "chunk_no", "byte_offset", "data", "lost"])


def assemble(members: DataFrame, disks: list[str], level: int, name: str = "array") -> DataFrame:
    """Chunks of the array from its members' chunks, whose size is the stripe's. disks: volume ids in the array's order.

    Chunks that the array has lost are zeros, with lost set.
    """
    check(level, len(disks))
    n = len(disks)
    place = F.create_map(*[F.lit(x) for k, d in enumerate(disks) for x in (d, k)])
    rows = members.where(F.col("volume_id").isin(*disks)).select(F.col("chunk_no").alias("row"), F.try_element_at(place, F.col("volume_id")).alias("disk"), "data")
    stripes = rows.groupBy("row").agg(F.collect_list(F.struct("disk", "data")).alias("blocks"), F.coalesce(F.max(F.octet_length("data")), F.lit(0)).alias("size"))
    one = lambda k: F.try_element_at(F.filter("blocks", lambda x: x["disk"] == k), F.lit(-1))["data"]
    stripes = stripes.select("row", "size", *[one(k).alias(f"_d{k}") for k in range(n)])

    return stripes.mapInArrow(lambda batches: stripes_rebuilt(batches, n, level, name), "volume_id string, chunk_no long, byte_offset long, data binary, lost boolean")


capacity = layout.capacity
