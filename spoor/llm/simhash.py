"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits, fewer than a plain
pigeonhole needs: of two fingerprints at most three bits apart, one segment
differs by at most one bit. Each distinct fingerprint is indexed under both
segments, whole and with each single bit struck out. Equal keys propose pairs
and the whole fingerprints verify them. Struck-out keys only pair the two
values of the missing bit, so no pair is proposed twice by one segment.

Equal fingerprints are first merged, so copies never multiply. A key with more
than ``BUCKET`` fingerprints is not expanded into pairs. For two bits its members are indexed
again under every choice of two struck-out bits of the whole fingerprint, where a key holds at
most four of them; for three bits they are compared in blocks of bounded size, each of which
returns a forest, never its pairs. Nothing is dropped.

With several tables a text has as many fingerprints, from independent mixes of the same
shingle hashes, and links if any pair of them is close.

Defined cases: a null text counts as an empty one; a text with fewer words than
a shingle hashes its whole word sequence; no words give fingerprint zero, which
links like any other; repeated rows share a component; a null id counts as the smallest in grouping and
is named null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor.llm.common import materialize
from spoor.llm.components import components

SEED = 42
BUCKET = 64
BLOCK = 4096
_NULL_ID = -(1 << 63)
_CHUNK = 1 << 16
_LOW = 0xFFFFFFFF


def _mixed(h: np.ndarray, table: int) -> np.ndarray:
    """Another 64-bit hash of the same shingles: the finaliser of SplitMix64, offset per table; table 0 is the hash itself."""
    if not table:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(table)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints_of(text: str | None, size: int = 3, tables: int = 1) -> list[int]:
    """Unsigned SimHashes of one text: XXH64 of its word shingles, a bit is set if over half of them set it."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return [0] * tables
    grams: Iterator[bytes] = map(b" ".join, zip(*[w[i:] for i in range(size)], strict=False)) if len(w) >= size else iter([b" ".join(w)])
    n, counts = 0, np.zeros((tables, 64), dtype=np.int64)
    while part := [xxhash.xxh64_intdigest(g, SEED) for g in islice(grams, _CHUNK)]:
        n += len(part)
        h = np.array(part, dtype="<u8")
        for k in range(tables):
            bits = np.unpackbits(_mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[k] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprints(docs: DataFrame, size: int = 3, tables: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fps``: the fingerprints of every whole text, an array of signed longs."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(fingerprints_of(t, size, tables), dtype=np.uint64).view(np.int64) for t in texts])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), of(F.col(f"`{text}`")).alias("fps"))


def _keys(fp: Column) -> Column:
    """Each segment whole, and with each bit struck out: structs of key, the struck bit's value and the fingerprint."""
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 32)
    out = []
    for tag, seg in ((0, low), (33, high)):
        out.append(F.struct((seg + F.lit(tag << 32)).alias("key"), F.lit(0).cast("byte").alias("bit")))
        for i in range(32):
            masked = seg.bitwiseAND(F.lit(_LOW ^ (1 << i)))
            bit = F.shiftrightunsigned(seg, i).bitwiseAND(F.lit(1)).cast("byte")
            out.append(F.struct((masked + F.lit((tag + 1 + i) << 32)).alias("key"), bit.alias("bit")))
    return F.array(*out)


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _forest(pdf: pd.DataFrame, distance: int) -> pd.DataFrame:
    """One block of a large bucket: edges that connect what its verified pairs connect."""
    x, y = pdf[pdf["left"]], pdf[~pdf["left"]]
    fx, fy = (z["fp"].to_numpy().view(np.uint64) for z in (x, y))
    bx, by, nx, ny = x["bit"].to_numpy(), y["bit"].to_numpy(), x["node"].to_numpy(), y["node"].to_numpy()
    whole = bool(pdf["whole"].iloc[0]) if len(pdf) else True
    ids = np.unique(pdf["node"].to_numpy())
    up = np.arange(len(ids))
    at_x, at_y = np.searchsorted(ids, nx), np.searchsorted(ids, ny)

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for k in range(len(fx)):
        near = np.bitwise_count(fx[k] ^ fy) <= distance
        if not whole:
            near &= by != bx[k]
        r = root(at_x[k])
        for other in np.unique(up[at_y[near]]).tolist():  # of those close, one per tree known so far
            o = root(other)
            up[max(r, o)] = r = min(r, o)
    top = np.array([root(k) for k in range(len(ids))], dtype=np.int64)
    moved = top != np.arange(len(ids))
    return pd.DataFrame({"u": ids[moved], "v": ids[top[moved]] if len(ids) else ids})


def links(fps: DataFrame, distance: int = 2, bucket: int = BUCKET, block: int = BLOCK, propose: bool = False) -> DataFrame:
    """``u, v``: nodes of distinct ``(table, fp)`` whose links connect all nodes with fingerprints ``distance`` or fewer bits apart.

    With ``propose``, members of a large bucket are tied to its least one unverified, for callers that verify the texts themselves."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments serve distances of 0 to 3 bits")
    w = Window.partitionBy("table", "key")
    # a row becomes 66, so the few bytes of input must not be coalesced into a few tasks first
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = fps.repartition(parts, "table", "fp")
    indexed = spread.select("table", "fp", "node", F.explode(_keys(F.col("fp"))).alias("k")).select("table", "fp", "node", "k.key", "k.bit")
    whole = F.shiftright("key", 32).isin(0, 33)
    met = (
        indexed.withColumn("n", F.count("*").over(w)).withColumn("ones", F.sum("bit").over(w))
        .where(F.when(whole, F.col("n") > 1).otherwise((F.col("ones") > 0) & (F.col("ones") < F.col("n"))))
    )
    met = materialize(met.select("table", "fp", "node", "key", "bit", "n"))
    buckets = met.where(F.col("n") <= bucket).groupBy("table", "key").agg(F.sort_array(F.collect_list(F.struct("bit", "fp", "node"))).alias("m"))

    def partners(x: Column, i: Column) -> Column:
        rest = F.slice(F.col("m"), i + 2, F.size("m"))
        ok = F.filter(rest, lambda y: _near(x["fp"], y["fp"], distance) & (whole | (x["bit"] != y["bit"])))
        return F.transform(ok, lambda y: F.struct(x["node"].alias("u"), y["node"].alias("v")))

    pairs = buckets.select(F.explode(F.flatten(F.transform("m", partners))).alias("p")).select("p.u", "p.v")
    hot = met.where(F.col("n") > bucket)
    if propose:
        least = hot.groupBy("table", "key").agg(F.min("node").alias("v"))
        return pairs.union(hot.join(least, ["table", "key"]).where("node <> v").select(F.col("node").alias("u"), "v")).distinct()
    more = _by_deletion(hot, distance) if distance <= 2 else _by_blocks(hot.withColumn("whole", whole), distance, block)
    return pairs.union(more).distinct()


def _by_deletion(hot: DataFrame, distance: int) -> DataFrame:
    """Members of large buckets under every choice of ``distance`` struck-out bits: at most 4 share what is left."""
    bits = F.sequence(F.lit(0), F.lit(63))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    choices = {
        0: F.array(F.lit(0).cast("long")),
        1: F.transform(bits, one),
        2: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda a: F.transform(F.sequence(a + 1, F.lit(63)), lambda b: one(a).bitwiseOR(one(b))))),
    }[distance]
    variants = hot.select("table", "fp", "node").distinct().select("*", F.explode(choices).alias("mask"))
    stars = variants.groupBy("table", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest")).agg(F.collect_list("node").alias("m"))
    edges = F.transform("m", lambda x: F.struct(x.alias("u"), F.array_min("m").alias("v")))
    return stars.where(F.size("m") > 1).select(F.explode(edges).alias("p")).select("p.u", "p.v").where(F.col("u") != F.col("v"))


def _by_blocks(hot: DataFrame, distance: int, block: int) -> DataFrame:
    """Members of large buckets, each part of a bucket against each, in tasks of at most about two blocks."""
    parts = F.ceil(F.col("n") / block).cast("int")
    own = hot.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    last = F.col("parts") - 1
    left = own.select("*", F.lit(True).alias("left"), F.col("part").alias("i"), F.explode(F.sequence("part", last)).alias("j"))
    right = own.select("*", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"))
    both = left.unionByName(right).select("table", "key", "i", "j", "left", "whole", "bit", "fp", "node")
    return both.groupBy("table", "key", "i", "j").applyInPandas(lambda pdf: _forest(pdf, distance), "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 2, tables: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fps, component_id``: one row per document, its component named by the smallest doc_id in it."""
    found = materialize(fingerprints(docs, size, tables, id_col, text))
    texts = found.groupBy("fps").agg(F.coalesce(F.min("doc_id"), F.lit(_NULL_ID)).alias("node"))
    each = texts.select("node", F.posexplode("fps").alias("table", "fp"))
    edges = None
    if tables == 1:
        distinct = each
    else:  # equal fingerprints of one table link their texts
        distinct = each.groupBy("table", "fp").agg(F.min("node").alias("first"))
        same = each.join(distinct, ["table", "fp"]).where("node <> first")
        edges = same.select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
        distinct = distinct.withColumnRenamed("first", "node")
    close = links(distinct, distance)
    comp = components(close if edges is None else edges.union(close)).withColumnRenamed("node", "_node")
    named = texts.join(comp, F.col("node") == F.col("_node"), "left").select("fps", F.coalesce("component", "node").alias("component_id"))
    component = F.when(F.col("component_id") != _NULL_ID, F.col("component_id"))
    return found.join(named, "fps").select("doc_id", "fps", component.alias("component_id"))
