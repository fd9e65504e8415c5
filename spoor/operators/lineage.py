"""Process lineage: ancestors of every process by pointer doubling.

The process map has one row per process, the first seen. Six self-joins carry every process 64
hops up, or to the last ancestor in the map. What has not ended by then is a chain of 64 or more,
or leads into a cycle; for those few, more doubling leaves just the nodes on cycles, and a binary descent
finds where each walk enters one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions.scalars import basename_or_empty
from spoor.functions.vocab import MAX_DEPTH, MAX_HOPS
from spoor.operators.order import cut

_ROUNDS = MAX_HOPS.bit_length() - 1


def resolved_parent(own: str | Column = "proc_parent_exec_id", other: str | Column = "parent_exec_id") -> Column:
    a = F.col(own) if isinstance(own, str) else own
    b = F.col(other) if isinstance(other, str) else other
    return F.coalesce(F.nullif(a, F.lit("")), b)


def process_map(events: DataFrame, order: list[str], seeds: DataFrame | None = None) -> DataFrame:
    """``exec_id, parent, basename``: the first row of each process in ``order``; rows of ``seeds`` come first."""
    cols = ["proc_exec_id", "proc_parent_exec_id", "parent_exec_id", "proc_binary"]
    rank = lambda df, k: df.select(*cols, F.struct(F.lit(k).alias("source"), *order).alias("rank"))
    rows = rank(events, 1) if seeds is None else rank(seeds, 0).unionByName(rank(events, 1))
    given = rows.where("proc_exec_id <> ''")
    body = F.struct(resolved_parent().alias("parent"), basename_or_empty("proc_binary").alias("basename"))
    first = given.groupBy(F.col("proc_exec_id").alias("exec_id")).agg(F.min_by(body, "rank").alias("b"))
    return first.select("exec_id", "b.parent", "b.basename")


def duplicates(events: DataFrame, processes: DataFrame) -> DataFrame:
    """One row: how many rows name a known process with another parent or base name."""
    m = processes.select(F.col("exec_id").alias("_id"), F.col("parent").alias("_parent"), F.col("basename").alias("_base"))
    same = resolved_parent().eqNullSafe(F.col("_parent")) & (basename_or_empty("proc_binary") == F.col("_base"))
    return events.join(m, F.col("proc_exec_id") == F.col("_id")).agg(F.coalesce(F.sum(F.when(same, 0).otherwise(1)), F.lit(0)).alias("duplicate_exec_ids"))


def _double(jumps: DataFrame) -> DataFrame:
    """Twice as far: ``node, to, hops``, where ``to`` is the last node if the walk ends sooner."""
    next_ = jumps.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("hops").alias("_hops"))
    return jumps.join(next_, F.col("to") == F.col("_n")).select("node", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"))


def ancestors(processes: DataFrame) -> DataFrame:
    """``exec_id, depth, root, root_basename, cycle`` of every process in the map.

    ``depth`` ends at 15; ``cycle`` also marks chains of 64 hops and more, whose root is the 64th ancestor."""
    known = processes.select(F.col("exec_id").alias("_k"))
    own = F.col("parent") == F.col("exec_id")  # its own parent: an end of walks, and a cycle of one
    up = processes.join(known, (F.col("parent") == F.col("_k")) & ~own, "left").select(
        F.col("exec_id").alias("node"), F.coalesce("_k", "exec_id").alias("to"), F.col("_k").isNotNull().cast("int").alias("hops")
    )
    up = jumps = cut(up)
    for k in range(_ROUNDS):  # each round reads the last one twice, so lineage is cut at every other
        jumps = cut(_double(jumps)) if k % 2 else _double(jumps)
    endless = jumps.where(F.col("hops") >= MAX_HOPS)
    loops = processes.where(own).select(F.col("exec_id").alias("_l"))
    looped = jumps.where(F.col("hops") < MAX_HOPS).join(loops, F.col("to") == F.col("_l"), "left")
    in_loop = F.col("_l").isNotNull()
    ended = looped.select("node", (F.col("hops") + in_loop.cast("int")).alias("depth"), F.col("to").alias("root"), in_loop.alias("cycle"))
    found = ended
    if not endless.isEmpty():
        found = ended.unionByName(_endless(up, endless))
    names = processes.select(F.col("exec_id").alias("_r"), F.col("basename").alias("root_basename"))
    return found.join(names, F.col("root") == F.col("_r")).select(
        F.col("node").alias("exec_id"), F.least("depth", F.lit(MAX_DEPTH)).alias("depth"), "root", "root_basename", "cycle"
    )


def _endless(up: DataFrame, endless: DataFrame) -> DataFrame:
    """Walks that do not end within 64 hops: where they enter a cycle, if they do within the hops allowed."""
    step = cut(up.join(endless.select("node"), "node", "left_semi").where("hops = 1").select("node", "to"))
    far = step  # images under 2^k hops, within the endless nodes; chains run out of them
    tables = [step]
    rounds = max(_ROUNDS, step.count().bit_length())  # no chain of endless nodes is longer than there are of them
    for k in range(1, rounds + 1):
        hop = far.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
        far = cut(far.join(hop, F.col("to") == F.col("_n")).select("node", F.col("_to").alias("to")))
        tables.append(far)
    on_cycle = cut(far.select(F.col("to").alias("node")).distinct())
    label = on_cycle.select("node", F.col("node").alias("low"))
    for t in tables:  # the least node over 2, 4, ... hops, at last over more than any cycle has, names the cycle
        ahead = label.select(F.col("node").alias("_n"), F.col("low").alias("_low"))
        label = cut(label.join(t, "node").join(ahead, F.col("to") == F.col("_n")).select("node", F.least("low", "_low").alias("low")))
    sizes = label.groupBy("low").agg(F.count("*").alias("size"))
    entries = label.join(sizes, "low").select(F.col("node").alias("_e"), "size")
    at = endless.select("node", F.col("node").alias("pos"), F.lit(0).alias("t"))
    flags = on_cycle.select(F.col("node").alias("_c"), F.lit(True).alias("_on"))
    for k in reversed(range(_ROUNDS)):  # as far as one can go and still be off every cycle
        hop = tables[k].select(F.col("node").alias("_n"), F.col("to").alias("_to"))
        moved = at.join(hop, F.col("pos") == F.col("_n"), "left").join(flags, F.col("_to") == F.col("_c"), "left")
        go = F.col("_to").isNotNull() & F.col("_on").isNull()
        at = moved.select("node", F.when(go, F.col("_to")).otherwise(F.col("pos")).alias("pos"), F.when(go, F.col("t") + 2**k).otherwise(F.col("t")).alias("t"))
    starts = at.join(flags, F.col("node") == F.col("_c"), "left").join(step.select(F.col("node").alias("_n"), F.col("to").alias("_to")), F.col("pos") == F.col("_n"), "left")
    entry = starts.select("node", F.when(F.col("_on"), F.col("node")).otherwise(F.col("_to")).alias("entry"), F.when(F.col("_on"), F.lit(0)).otherwise(F.col("t") + 1).alias("t"))
    sized = entry.join(entries, F.col("entry") == F.col("_e"), "left").withColumn("d", F.col("t") + F.col("size"))
    short = F.col("d").isNotNull() & (F.col("d") <= MAX_HOPS)
    last = endless.select(F.col("node").alias("_x"), F.col("to").alias("_last"))
    return sized.join(last, F.col("node") == F.col("_x")).select(
        "node", F.when(short, F.col("d")).otherwise(F.lit(MAX_HOPS)).cast("int").alias("depth"),
        F.when(short, F.col("entry")).otherwise(F.col("_last")).alias("root"), F.lit(True).alias("cycle"),
    )


def with_lineage(events: DataFrame, processes: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """``events`` with depth, root, flags and the parent's base name.

    A parent counts as missing if neither id is given, or the one that counts is not in the map."""
    walks = ancestors(processes) if walks is None else walks
    w = walks.select(F.col("exec_id").alias("_w"), F.col("depth").alias("_depth"), F.col("root").alias("_root"), F.col("root_basename").alias("_rb"), F.col("cycle").alias("_cycle"))
    p = processes.select(F.col("exec_id").alias("_p"), F.col("basename").alias("_pb"))
    own, other, parent = F.col("proc_parent_exec_id"), F.col("parent_exec_id"), resolved_parent()
    joined = events.withColumn("_parent", parent).join(w, F.col("proc_exec_id") == F.col("_w"), "left").join(p, F.col("_parent") == F.col("_p"), "left")
    missing = (own.isNull() & other.isNull()) | (F.col("_parent").isNotNull() & F.col("_p").isNull())
    from_map = F.col("_p").isNotNull() & (F.col("_parent") != "")
    return joined.withColumns(
        {
            "lineage_depth": F.coalesce("_depth", F.lit(0)).cast("int"),
            "root_ancestor_exec_id": F.col("_root"),
            "root_ancestor_basename": F.coalesce("_rb", F.lit("")),
            "lineage_parent_fallback_used": own.isNull() & other.isNotNull(),
            "lineage_missing_parent": missing,
            "lineage_cycle_detected": F.coalesce("_cycle", F.lit(False)),
            "parent_binary_basename": F.when(from_map, F.col("_pb")).otherwise(basename_or_empty("parent_binary")),
        }
    ).drop("_parent", "_w", "_depth", "_root", "_rb", "_cycle", "_p", "_pb")
