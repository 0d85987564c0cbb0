"""Progress: meters that never rewind, speeds and estimates over time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Window, smoothing, stall, jump and longest estimate of a scan's speed.
WINDOW_MS, ALPHA, STALL_MS, JUMP, MOST_SECONDS = 30_000, 0.15, 8_000, 0.02, 36 * 3600
#: Ticks that a smoothed speed looks back; older ones weigh under 1e-18.
SMOOTHED_OVER = 256


def monotonic(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with the running maximum of value."""
    return df.withColumn(out, F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def window_speed(df: DataFrame, keys: list[str], time_ms: str, work: str, out: str = "speed") -> DataFrame:
    """df with the work per second over the last WINDOW_MS; null where the window holds one time only. Work does not fall."""
    first = F.min(F.struct(F.col(time_ms).alias("t"), F.col(work).alias("w"))).over(Window.partitionBy(*keys).orderBy(time_ms).rangeBetween(-WINDOW_MS, 0))
    seconds = (F.col(time_ms) - first["t"]) / 1000.0
    return df.withColumn(out, F.when(seconds > 0, (F.col(work) - first["w"]) / seconds))


def work_to_budget(done: Column, total: Column, budget: Column) -> Column:
    """done of total as a share of [0, budget), exact for values up to 2**63; the budget itself means complete."""
    d = lambda x: x.cast("decimal(19,0)")
    whole = F.floor(d(done) * d(budget - 1) / d(F.greatest(total, F.lit(1)))).cast("long")
    # division of decimals rounds; the product is exact, so the remainder tells
    exact = F.when(whole.cast("decimal(19,0)") * d(F.greatest(total, F.lit(1))) > d(done) * d(budget - 1), whole - 1).otherwise(whole)
    return F.when(budget <= 0, F.lit(0)).when(done >= F.greatest(total, F.lit(1)), budget - 1).otherwise(exact).cast("long")


def eta(df: DataFrame, key: str, time_ms: str, work: str, total: str) -> DataFrame:
    """(key, time_ms, work, speed, eta_seconds, stalled) of each tick, by windows alone.

    Work is metered, so late ticks only move time on. A rise of more than JUMP of the total starts a new episode, and the
    speed of a tick is that of the last WINDOW_MS of its episode. Speeds are smoothed exponentially; a tick without a speed
    of its own keeps the smoothed one. Where the meter has not risen for STALL_MS the scan is stalled, and smoothing starts
    anew. eta_seconds is -1 where there is no speed, or nothing left.
    """
    rows = monotonic(df.select(F.col(key).alias("k"), F.col(time_ms).cast("long").alias("t"), F.col(work).cast("long").alias("w"), F.col(total).cast("long").alias("n")), ["k"], ["t", "w"], "w", "m")
    order = Window.partitionBy("k").orderBy("t", "w")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rise = F.col("m") - F.lag("m").over(order)
    rows = rows.withColumn("rise", rise)
    jump = F.coalesce(F.col("rise") > F.greatest(F.lit(1.0), F.col("n") * F.lit(JUMP)), F.lit(False))
    rose = F.max(F.when(F.col("rise").isNull() | (F.col("rise") > 0), F.col("t"))).over(so_far)
    rows = rows.withColumns({"episode": F.sum(jump.cast("int")).over(so_far), "stalled": F.col("t") - rose >= STALL_MS})
    rows = window_speed(rows, ["k", "episode"], "t", "m", "own")
    last = F.collect_list(F.struct("own", "stalled")).over(order.rowsBetween(1 - SMOOTHED_OVER, 0))
    smooth = lambda s, x: F.when(x["stalled"], F.lit(0.0)).when(x["own"].isNull(), s).when(s > 0, s * (1 - ALPHA) + x["own"] * ALPHA).otherwise(x["own"])
    rows = rows.withColumn("speed", F.aggregate(last, F.lit(0.0), smooth))
    left = F.when(~F.col("stalled") & (F.col("speed") > 0) & (F.col("n") > F.col("m")), F.least((F.col("n") - F.col("m")) / F.col("speed"), F.lit(float(MOST_SECONDS)))).otherwise(-1.0)
    return rows.select(F.col("k").alias(key), F.col("t").alias("time_ms"), F.col("w").alias("work"), "speed", left.alias("eta_seconds"), "stalled")


def eta_fold(state: tuple | None, times: np.ndarray, works: np.ndarray, totals: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """The next ticks of one key as eta sees them, for streams: (state, speed, eta_seconds, stalled).

    The state is the times and meters of the episode's last WINDOW_MS, when the meter rose last, and the smoothed speed.
    Times are in order; those before the state's last one count as that.
    """
    held_t, held_m, rose, speed = state or ([], [], None, 0.0)
    old = len(held_t)
    t = np.maximum.accumulate(np.concatenate([np.asarray(held_t, np.int64), times]))
    m = np.maximum.accumulate(np.concatenate([np.asarray(held_m, np.int64), works]))
    n = np.concatenate([np.zeros(old, np.int64), totals])
    rise = np.diff(m, prepend=m[:1])
    jump = rise > np.maximum(1.0, n * JUMP)
    jump[: old + (not old)] = False
    first = np.maximum(np.searchsorted(t, t - WINDOW_MS), np.maximum.accumulate(np.where(jump, np.arange(len(t)), 0)))
    up = np.where(rise > 0, t, np.int64(-(2**62)))
    up[:old], up[0 if not old else old - 1] = -(2**62), t[0] if rose is None else rose
    stalled = t - np.maximum.accumulate(up) >= STALL_MS
    seconds = (t - t[first]) / 1000.0
    own = np.where(seconds > 0, (m - m[first]) / np.where(seconds > 0, seconds, 1), np.nan)
    speeds = np.zeros(len(t))
    for k in range(old, len(t)):
        if stalled[k]:
            speed = 0.0
        elif not np.isnan(own[k]):
            speed = speed * (1 - ALPHA) + own[k] * ALPHA if speed > 0 else float(own[k])
        speeds[k] = speed
    left = np.where(~stalled & (speeds > 0) & (n > m), np.minimum((n - m) / np.where(speeds > 0, speeds, 1), MOST_SECONDS), -1.0)
    keep = slice(int(first[-1]), None)
    state = (t[keep].tolist(), m[keep].tolist(), int(np.maximum.accumulate(up)[-1]), speed)
    return state, speeds[old:], left[old:], stalled[old:]
