"""Where blocks of disk arrays lie, as integer column expressions. Arrays rotate parity from the last disk leftwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raid0_disk(block: Column, disks: int) -> Column:
    return (block % disks).cast("int")


def raid5_parity(stripe: Column, disks: int) -> Column:
    return (F.lit(disks - 1) - stripe % disks).cast("int")


def raid5_data(stripe: Column, block: Column, disks: int) -> Column:
    """The disk of a data block of a stripe: data blocks fill the other disks from the left."""
    parity = raid5_parity(stripe, disks)
    return (block + F.when(block >= parity, 1).otherwise(0)).cast("int")


def raid6_p(stripe: Column, disks: int) -> Column:
    return raid5_parity(stripe, disks)


def raid6_q(stripe: Column, disks: int) -> Column:
    """Left of P, round the end."""
    return F.pmod(raid6_p(stripe, disks) - 1, F.lit(disks)).cast("int")


def raid6_data(stripe: Column, block: Column, disks: int) -> Column:
    p, q = raid6_p(stripe, disks), raid6_q(stripe, disks)
    low, high = F.least(p, q), F.greatest(p, q)
    first = block + F.when(block >= low, 1).otherwise(0)
    return (first + F.when(first >= high, 1).otherwise(0)).cast("int")


def raid10_members(block: Column, disks: int) -> tuple[Column, Column]:
    pair = (block % (disks // 2)).cast("int")
    return pair * 2, pair * 2 + 1


def capacity(level: int, disks: int, size: int) -> int:
    """Usable bytes of disks of one size."""
    data = {0: disks, 1: 1, 5: disks - 1, 6: disks - 2, 10: disks // 2}
    check(level, disks)
    return data[level] * size


def check(level: int, disks: int) -> None:
    least = {0: 2, 1: 2, 5: 3, 6: 4, 10: 4}
    if level not in least:
        raise ValueError(f"no such level: {level}")
    if disks < least[level] or level == 10 and disks % 2:
        raise ValueError(f"level {level} can't have {disks} disks")
