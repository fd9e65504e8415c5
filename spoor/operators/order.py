"""Global order without a single-task window: row numbers, running sums and lags over range partitions.

Rows are range-partitioned and sorted once and the result is checkpointed, as sampled ranges may
differ if they are worked out again. What crosses from one partition to the next is one small
row per partition, so a key that holds a third of all rows is still shared by many tasks.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SMALL = 100_000  # rows of a table that may be broadcast
_IN_PART = (1 << 33) - 1  # monotonically_increasing_id: partition above 33 bits, row within below


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder the session names; one of our own only where it names none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one the session names, or one of our own on a single machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spoor-checkpoint-")
        sc.setCheckpointDir(found)
    return found


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, marked to be broadcast if it has ``rows`` rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` range-partitioned and sorted, with ``_part`` and ``_at`` (place within the partition)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    return cut(placed).withColumns({"_part": F.shiftright("_mid", 33).cast("int"), "_at": F.col("_mid").bitwiseAND(F.lit(_IN_PART))}).drop("_mid")


def _before(parts: DataFrame, sums: list[str]) -> DataFrame:
    """Per partition, the sums over those before it; one row per partition goes in."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_before_{s}") for s in sums])


def with_row_index(df: DataFrame, *order: str | Column, name: str = "row_idx") -> DataFrame:
    """``df`` with its 0-based place in ``order``."""
    placed = in_order(df, *order)
    starts = _before(placed.groupBy("_part").agg(F.count("*").alias("n")), ["n"])
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before_n") + F.col("_at")).drop("_part", "_at", "_before_n")


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, str], index: str | None = None) -> DataFrame:
    """``df`` with running sums (inclusive) of columns in ``order``: ``sums`` maps new names to columns."""
    placed = in_order(df, *order)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(new) for new, c in sums.items()])
    starts = _before(parts, ["_n", *sums])
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(starts), "_part")
    out = joined.withColumns({new: F.sum(c).over(w) + F.col(f"_before_{new}") for new, c in sums.items()})
    if index:
        out = out.withColumn(index, F.col("_before__n") + F.col("_at"))
    return out.drop("_part", "_at", "_before__n", *[f"_before_{s}" for s in sums])


def lagged(df: DataFrame, key: str, order: list[str], value: str, k: int = 1, prefix: str = "prev") -> DataFrame:
    """``df`` with ``prev1`` ... ``prevk``: ``value`` of the rows before in the same ``key``; null at its start.

    Rows with a null key have none."""
    placed = in_order(df, key, *order)
    run = Window.partitionBy("_part", key).orderBy("_at")
    local = placed.withColumn("_pos", F.row_number().over(run)).withColumns({f"_lag{j}": F.lag(value, j).over(run) for j in range(1, k + 1)})
    last = placed.groupBy("_part").agg(F.max("_at").alias("_end"))
    tail = placed.join(F.broadcast(last), "_part").where(F.col("_at") > F.col("_end") - k).select("_part", "_at", key, value)
    rows = sorted(tail.collect(), key=lambda r: (r["_part"], r["_at"]))  # k rows per partition
    carry, recent, part = [], [], None
    for r in [*rows, None]:
        if r is None or r["_part"] != part:
            if part is not None:
                carry.append((part, list(before)))
            before, part = list(recent), r and r["_part"]
        if r is not None:
            recent = [*recent, (r[key], r[value])][-k:]
    kind, what = df.schema[key].dataType.simpleString(), df.schema[value].dataType.simpleString()
    given = []
    for part, seen in carry:
        if seen:
            same = [v for x, v in reversed(seen) if x == seen[-1][0]]
            given.append((part, seen[-1][0], len(same), *(same + [None] * k)[:k]))
    schema = f"_part int, _key {kind}, _have int, " + ", ".join(f"_c{j} {what}" for j in range(1, k + 1))
    small = F.broadcast(df.sparkSession.createDataFrame(given, schema))
    joined = local.join(small.withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p")) & (F.col(key) == F.col("_key")), "left")
    out = {}
    for j in range(1, k + 1):
        c = F.when(F.col("_pos") > j, F.col(f"_lag{j}"))
        for at in range(1, j + 1):  # the at-th row of its key here reaches j - at + 1 rows back into the carry
            c = c.when(F.col("_pos") == at, F.col(f"_c{j - at + 1}"))
        out[f"{prefix}{j}"] = F.when(F.col(key).isNotNull(), c)
    extra = ["_part", "_at", "_pos", "_p", "_key", "_have", *[f"_lag{j}" for j in range(1, k + 1)], *[f"_c{j}" for j in range(1, k + 1)]]
    return joined.withColumns(out).drop(*extra)


def place_in_group(df: DataFrame, key: str, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with its 0-based place among the rows of its ``key`` in ``order``; rows with a null key are one group.

    A key may span partitions: what its rows before a partition add comes from one small row per partition."""
    run = Window.partitionBy("_part", key).orderBy("_at")
    local = in_order(df, key, *order).withColumn("_pos", F.row_number().over(run))
    ends = local.groupBy("_part").agg(F.min_by(key, "_at").alias("first"), F.max_by(key, "_at").alias("last"), F.max_by("_pos", "_at").alias("n"))
    given, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        carry = before["n"] if before and before["last"] == r["first"] else 0
        if carry:
            given.append((r["_part"], r["first"], carry))
        before = {"last": r["last"], "n": r["n"] + (carry if r["first"] == r["last"] else 0)}
    small = F.broadcast(df.sparkSession.createDataFrame(given, f"_p int, _key {df.schema[key].dataType.simpleString()}, _carry long"))
    joined = local.join(small, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(name, F.col("_pos") - 1 + F.coalesce("_carry", F.lit(0))).drop("_part", "_at", "_pos", "_p", "_key", "_carry")
