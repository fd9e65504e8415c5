"""Mixing sources to target weights by Pfair scheduling.

Target weights are whole numbers ``a`` per source; with their sum ``D`` a source
is due ``a / D`` of every block slot. Its ``j``-th block (from 1) may run from slot
``floor((j - 1) * D / a)`` and must have run before slot ``ceil(j * D / a)``. In each
slot the released block with the earliest deadline runs; as the weights fill
the slots exactly, every deadline holds and no source is ever a whole block
ahead of or behind its share. The schedule repeats after ``D`` slots, so one period
is worked out from the weights alone and every document finds its slot on its own.

Within a source documents follow the digest of their ids. The place in that
order comes from counts per digest prefix, so no task sees a whole source. A
source that has run out leaves its slots empty; the others keep theirs, and no
document is dropped or repeated.

Defined cases: sources without a weight of their own, and null, share the weight
of ``other``; null ids come first; rows that share an id follow their texts' digest where
a text column is given; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_PERIOD = 10_000
OTHER = "(other)"
#: Production targets: blocks per period of 24.
WEIGHTS = {"src0": 4, **{f"src{i}": 1 for i in range(1, 20)}}
BLOCK = 16


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks within one period, by earliest deadline among the released."""
    if any(not isinstance(a, int) or a < 1 for a in weights.values()) or sum(weights.values()) > MAX_PERIOD:
        raise ValueError(f"weights are whole numbers from 1, of sum {MAX_PERIOD} at most")
    d = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    slots: dict[str, list[int]] = {s: [] for s in weights}
    order = {s: k for k, s in enumerate(weights)}
    for t in range(d):
        # the next block of s is its done[s] + 1st: released at floor(done * d / a), due at ceil((done + 1) * d / a)
        ready = [s for s, a in weights.items() if done[s] < a and done[s] * d // a <= t]
        run = min(ready, key=lambda s: (-(-(done[s] + 1) * d // weights[s]), order[s]))
        slots[run].append(t)
        done[run] += 1
    return slots


def schedule(
    docs: DataFrame, weights: dict[str, int] = WEIGHTS, other: int = 1, block: int = BLOCK, id_col: str = "doc_id", source: str = "source", text: str | None = None
) -> DataFrame:
    """``docs`` with ``mix``: struct of source, block (from 0 in its source), slot and place in the block."""
    docs = docs.drop("mix")  # columns of these names are replaced
    shares = {**weights, OTHER: other}
    slots, d = period(shares), sum(shares.values())
    table = F.create_map(*[x for s, at in slots.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in at]))])
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    src = F.col(f"`{source}`")
    cls = F.when(src.isin(*weights), src).otherwise(F.lit(OTHER))
    key = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    tie = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))) if text else F.lit("")
    keyed = docs.withColumn("_mix", F.struct(cls.alias("cls"), F.substring(key, 1, 3).alias("part"), key.alias("key"), tie.alias("tie")))
    # at most 4096 parts per source, whatever the input
    parts = keyed.groupBy(F.col("_mix.cls").alias("_cls"), F.col("_mix.part").alias("_part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_cls").orderBy("_part")) - F.col("n")
    starts = parts.select("_cls", "_part", before.alias("_before"))
    m = F.col("_mix")
    w = Window.partitionBy(m["cls"], m["part"]).orderBy(m["key"], F.col(f"`{id_col}`"), m["tie"])
    ranked = keyed.withColumn("_rn", F.row_number().over(w).cast("long") - 1)
    joined = ranked.join(starts, (m["cls"] == F.col("_cls")) & (m["part"] == F.col("_part")))

    def slot(b: Column, a: Column) -> Column:
        return F.floor(b / a) * d + F.get(F.element_at(table, m["cls"]), F.pmod(b, a).cast("int"))

    rank = F.col("_before") + F.col("_rn")
    b, a = F.floor(rank / block), F.element_at(share, m["cls"]).cast("long")
    mix = F.struct(m["cls"].alias("source"), b.alias("block"), slot(b, a).cast("long").alias("slot"), F.pmod(rank, F.lit(block)).cast("long").alias("place"))
    return joined.withColumn("mix", mix).drop("_mix", "_rn", "_cls", "_part", "_before")


SQL = """
WITH RECURSIVE weights(cls, a, k) AS (VALUES {values}),
total AS (SELECT sum(a)::BIGINT AS d FROM weights),
blocks AS (
  SELECT cls, a, k, j, (j - 1) * d // a AS released, -((-j * d) // a) AS due, d, k * 100000 + j AS id
  FROM weights, total, generate_series(1, a) AS g(j)
),
sched(t, done, id) AS (
  SELECT -1::BIGINT, []::BIGINT[], NULL::BIGINT
  UNION ALL
  SELECT t + 1, list_append(done, pick), pick FROM (
    SELECT s.t, s.done, arg_min(b.id, b.due * 10000000000 + b.id)::BIGINT AS pick
    FROM sched s JOIN blocks b ON b.released <= s.t + 1 AND NOT list_contains(s.done, b.id)
    WHERE s.t + 1 < b.d GROUP BY s.t, s.done)
),
slots AS (SELECT b.cls, b.a, b.d, b.j - 1 AS j, s.t FROM sched s JOIN blocks b USING (id)),
ranked AS (
  SELECT doc_id, CASE WHEN source IN ({names}) THEN source ELSE '(other)' END AS cls,
         row_number() OVER (PARTITION BY cls ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r
  FROM documents
)
SELECT doc_id, r.cls AS source, r // {block} AS block, ((r // {block}) // s.a * s.d + s.t)::BIGINT AS slot, r % {block} AS place
FROM ranked r JOIN slots s ON s.cls = r.cls AND s.j = (r // {block}) % s.a
"""


def oracle(weights: dict[str, int] = WEIGHTS, other: int = 1, block: int = BLOCK) -> str:
    rows = [*weights.items(), (OTHER, other)]
    return SQL.format(
        values=", ".join(f"('{s}', {a}, {k})" for k, (s, a) in enumerate(rows)),
        names=", ".join(f"'{s}'" for s in weights),
        block=block,
    )
