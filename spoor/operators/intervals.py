"""Joins of events to labelled time intervals.

Of intervals that overlap only the latest started counts, so each is first cut off where the next starts.
What is left is disjoint and joins by an equality on time bins plus a range check; a bin is so wide
that the intervals together fall into a few thousand. The bins are broadcast where they are few, as a busy hour may hold most events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor.functions.scalars import parse_time_ns
from spoor.operators.order import cut, small

_BINS = 2048


def read_intervals(spark: SparkSession, path: str, trials: bool = False) -> DataFrame:
    """``start_ns, end_ns, technique_id`` (and ``trial_id``) of a labels file; fails on a bound that is no time."""
    raw = spark.read.option("header", "true").schema("technique_id string, trial string, start_ts string, end_ts string").csv(path)
    return from_label_rows(raw, trials)


def from_label_rows(raw: DataFrame, trials: bool = False) -> DataFrame:
    def bound(c: str) -> Column:
        ns = parse_time_ns(c)
        return F.when(ns.isNull(), F.raise_error(F.concat(F.lit("not a time: "), F.coalesce(F.col(c), F.lit("null")))).cast("bigint")).otherwise(ns)

    cols = [bound("start_ts").alias("start_ns"), bound("end_ts").alias("end_ns"), F.col("technique_id")]
    if trials:
        cols.append(F.concat_ws("#", "technique_id", "trial").alias("trial_id"))
    out = raw.select(*cols).orderBy("start_ns", "end_ns", "technique_id")
    if trials and out.groupBy("trial_id").count().where("count > 1").head(1):
        raise ValueError("trial ids repeat")
    return out


def disjoint(intervals: DataFrame) -> DataFrame:
    """``intervals`` with ``eff_end``: the end, or the next start if that is earlier; empty ones are left out."""
    w = Window.orderBy("start_ns", "end_ns", "technique_id")  # a label file: a few rows per attack
    return intervals.withColumn("eff_end", F.least("end_ns", F.lead("start_ns").over(w))).where("start_ns < eff_end")


def _binned(events: DataFrame, found: DataFrame, low: str, high: Column, time: str) -> DataFrame:
    """Left join of events to disjoint intervals ``[low, high)``."""
    found = cut(found)
    span = found.agg(F.min(low).alias("a"), F.max(high).alias("b")).head()
    if span["a"] is None:
        return events.join(found.limit(0), F.lit(False), "left")
    width = max(1, (span["b"] - span["a"]) // _BINS + 1)
    def at(c: Column) -> Column:
        return F.floor((c - F.lit(span["a"])) / F.lit(width))

    bins = found.withColumn("_bin", F.explode(F.sequence(at(F.col(low)), at(high - 1))))
    cond = (at(F.col(time)) == F.col("_bin")) & (F.col(time) >= F.col(low)) & (F.col(time) < high)
    return events.join(small(bins), cond, "left").drop("_bin")


def label_events(events: DataFrame, intervals: DataFrame, time: str = "event_time") -> DataFrame:
    """``events`` with ``is_attack`` and ``technique_id``: that of the latest started interval, if it holds the time (half open)."""
    found = disjoint(intervals).select("start_ns", "eff_end", "technique_id")
    joined = _binned(events, found, "start_ns", F.col("eff_end"), time)
    return joined.withColumn("is_attack", F.col("start_ns").isNotNull()).drop("start_ns", "eff_end")


def trial_membership(events: DataFrame, trials: DataFrame, time: str = "event_time") -> DataFrame:
    """``events`` with ``trial_idx``: the place (from 0, by start, end) of the trial that holds the time, else -1."""
    w = Window.orderBy("start_ns", "end_ns", "technique_id")
    numbered = disjoint(trials.withColumn("trial_idx", (F.row_number().over(w) - 1).cast("int"))).select("start_ns", "eff_end", "trial_idx")
    joined = _binned(events, numbered, "start_ns", F.col("eff_end"), time)
    return joined.withColumn("trial_idx", F.coalesce("trial_idx", F.lit(-1))).drop("start_ns", "eff_end")


def drop_sentinels(events: DataFrame, bounds: DataFrame, time: str = "event_time") -> DataFrame:
    """Events outside all intervals ``[start_ns, end_ns]``, closed at both ends; those without a time stay."""
    bounds = cut(bounds)
    span = bounds.agg(F.min("start_ns").alias("a"), F.max("end_ns").alias("b")).head()
    if span["a"] is None:
        return events
    width = max(1, (span["b"] - span["a"]) // _BINS + 1)
    at = lambda c: F.floor((c - F.lit(span["a"])) / F.lit(width))
    bins = bounds.select("start_ns", "end_ns", F.explode(F.sequence(at(F.col("start_ns")), at(F.col("end_ns")))).alias("_bin"))
    inside = (at(F.col(time)) == F.col("_bin")) & F.col(time).between(F.col("start_ns"), F.col("end_ns"))
    return events.join(small(bins), inside, "left_anti")


def benign(events: DataFrame, label: str = "is_attack") -> DataFrame:
    return events.where(~F.col(label))
