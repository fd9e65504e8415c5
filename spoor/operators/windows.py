"""Sliding windows over row counts, splits by row, and per-process deltas.

A window of 128 rows every 32 consists of 4 whole blocks. Sums, maxima and flags are first taken
per block, so each window costs 4 block rows instead of 128 event rows; only the median needs the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.operators.order import lagged

SIZE, STRIDE = 128, 32
MASK_SHARE = 0.15


def window_count(rows: int, size: int = SIZE, stride: int = STRIDE) -> int:
    if rows < size:
        raise ValueError(f"{rows} rows are fewer than a window of {size}")
    return (rows - size) // stride + 1


def _windows_of(index: Column, last: int, size: int, stride: int) -> Column:
    """The windows that cover a row (or block, in blocks), as an array."""
    low = F.greatest(F.lit(0), F.floor((index - size) / stride) + 1).cast("long")
    high = F.least(F.lit(last), F.floor(index / stride)).cast("long")
    return F.when(low <= high, F.sequence(low, high))


def to_windows(df: DataFrame, rows: int, size: int = SIZE, stride: int = STRIDE, index: str = "row_idx") -> DataFrame:
    """A row per event and window that covers it: ``window_idx`` and the place ``pos`` in it."""
    last = window_count(rows, size, stride) - 1
    each = df.withColumn("window_idx", F.explode(_windows_of(F.col(index), last, size, stride)))
    return each.withColumn("pos", (F.col(index) - F.col("window_idx") * stride).cast("int"))


def window_aggregate(
    df: DataFrame, rows: int, partial: dict[str, Column], final: dict[str, Column], size: int = SIZE, stride: int = STRIDE, index: str = "row_idx"
) -> DataFrame:
    """``window_idx`` with ``final`` aggregates of ``partial`` ones taken per block of rows."""
    last = window_count(rows, size, stride) - 1
    if size % stride:
        each = to_windows(df, rows, size, stride, index).groupBy("window_idx", index)
        blocks = each.agg(*[c.alias(n) for n, c in partial.items()])
    else:
        per_block = df.groupBy(F.floor(F.col(index) / stride).alias("_block")).agg(*[c.alias(n) for n, c in partial.items()])
        blocks = per_block.withColumn("window_idx", F.explode(_windows_of(F.col("_block"), last, size // stride, 1)))
    return blocks.groupBy("window_idx").agg(*[c.alias(n) for n, c in final.items()])


def window_max(df: DataFrame, rows: int, score: str = "score", **kw) -> DataFrame:
    return window_aggregate(df, rows, {"_m": F.max(score)}, {"score": F.max("_m")}, **kw)


def window_max_any(df: DataFrame, rows: int, score: str = "score", label: str = "is_attack", **kw) -> DataFrame:
    """Per window the highest score, and whether any row is labelled."""
    return window_aggregate(df, rows, {"_m": F.max(score), "_l": F.bool_or(label)}, {"score": F.max("_m"), "is_attack": F.bool_or("_l")}, **kw)


def window_median(df: DataFrame, rows: int, score: str = "score", size: int = SIZE, stride: int = STRIDE, index: str = "row_idx") -> DataFrame:
    return to_windows(df, rows, size, stride, index).groupBy("window_idx").agg(F.percentile(score, F.lit(0.5)).alias("score"))


def event_scores(scored: DataFrame, events: DataFrame, index: str = "row_idx", score: str = "score") -> DataFrame:
    """Every event's highest score over the windows that cover it; those in no window get the least score of all."""
    best = scored.groupBy(index).agg(F.max(score).alias(score))
    least = best.agg(F.min(score).alias("_least"))
    return events.join(best, index, "left").crossJoin(F.broadcast(least)).withColumn(score, F.coalesce(score, "_least")).drop("_least")


def masked(windows: DataFrame, size: int = SIZE, share: float = MASK_SHARE, seed: int = 0) -> DataFrame:
    """``windows`` (rows of window_idx, pos) with ``mask``: a seeded choice of int(share * size) places of each window."""
    n = max(1, int(share * size))
    rank = F.xxhash64(F.lit(seed), "window_idx", "pos")
    places = windows.groupBy("window_idx").agg(F.slice(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "pos"))), 1, n).alias("_m"))
    chosen = F.array_contains(F.transform("_m", lambda s: s["pos"]), F.col("pos"))
    return windows.join(places, "window_idx").withColumn("mask", chosen).drop("_m")


@dataclass
class Split:
    """Where a table was split by time, and how many rows went where."""

    split_row: int
    split_time_ns: int
    train: DataFrame
    validation: DataFrame
    n: int
    n_train: int
    n_validation: int

    @property
    def n_gap(self) -> int:
        return self.n - self.n_train - self.n_validation


def carve(df: DataFrame, fraction: float = 0.2, gap_seconds: float = 900.0, size: int = SIZE, time: str = "event_time", index: str = "row_idx") -> Split:
    """Splits indexed rows by the time of row ``int((1 - fraction) * n)``, without those within half the gap of it."""
    n = df.count()
    if not n:
        raise ValueError("no rows to split")
    row = min(max(int((1 - fraction) * n), 1), n - 1)
    at = df.where(F.col(index) == row).head()[time]
    half = int(gap_seconds * 1e9 / 2)
    train, validation = df.where(F.col(time) < at - half), df.where(F.col(time) >= at + half)
    counts = df.agg(F.count_if(F.col(time) < at - half).alias("a"), F.count_if(F.col(time) >= at + half).alias("b")).head()
    if min(counts["a"], counts["b"]) < size:
        raise ValueError(f"a part of the split is shorter than a window: {counts['a']}, {counts['b']}")
    return Split(row, at, train, validation, n, counts["a"], counts["b"])


def validation_tail(df: DataFrame, n: int, fraction: float = 0.2, index: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """All rows but the last ``max(1, int(n * fraction))``, and those."""
    start = n - max(1, int(n * fraction))
    return df.where(F.col(index) < start), df.where(F.col(index) >= start)


def delta_previous(df: DataFrame, order: list[str], key: str = "proc_exec_id", time: str = "event_time") -> DataFrame:
    """``df`` with ``delta_t_prev_ns``: time since the process's previous row that has a time, in row order; negative
    ones become 0 and are marked in ``negative_delta``."""
    timed = df.where(F.col(time).isNotNull() & F.col(key).isNotNull())
    rest = df.where(F.col(time).isNull() | F.col(key).isNull())
    with_prev = lagged(timed, key, order, time, 1)
    d = F.col(time) - F.col("prev1")
    # greatest() would take a missing delta for 0
    got = with_prev.withColumns({"negative_delta": F.coalesce(d < 0, F.lit(False)), "delta_t_prev_ns": F.when(d < 0, F.lit(0)).otherwise(d)}).drop("prev1")
    none = rest.withColumns({"negative_delta": F.lit(False), "delta_t_prev_ns": F.lit(None).cast("bigint")})
    return got.unionByName(none)


def process_age(time: str = "event_time", start: str = "proc_start_time") -> Column:
    return F.col(time) - F.col(start)


def group_starts(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``starts``: whether a row begins a run of its key in ``order`` (key first)."""
    return lagged(df, key, order, key, 1).withColumn("starts", F.col("prev1").isNull()).drop("prev1")
