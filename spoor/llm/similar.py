"""Texts that share 0.8 or more of their five-word shingles, each pair verified on the shingle sets.

Candidates come from SimHash fingerprints of word pairs, at most three bits apart (see ``simhash``), and from bands of
MinHash values of the shingles: of two texts at a similarity of 0.8, a band of 5 values agrees with
probability 0.33, so one of 20 bands does with 0.9996. Large buckets of the deletion index are proposed whole. Candidates only form groups. Within a group all
pairs that are not linked yet are compared by their whole shingle sets, in blocks of bounded
size, so a group that hangs together by chance falls apart again, and none of its true pairs is lost.

Nodes are distinct texts, named by a 64-bit hash, never ids: rows without an id, or different texts of one id, stay apart.

Defined cases: a null text counts as an empty one; a text with fewer words than a shingle
has its whole word sequence as its only shingle; texts without words are alike.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm import simhash
from spoor.llm.common import materialize, stored
from spoor.llm.components import components

SIZE, SHARE = 5, 0.8
TABLES = 1
BANDS, ROWS = 20, 5
BLOCK = 4_000_000  # shingles compared at once, of one side
_CHUNK = 1 << 14
_SEEDS = np.random.default_rng(7).integers(1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = map(b" ".join, zip(*[w[i:] for i in range(size)], strict=False)) if len(w) >= size else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, simhash.SEED) for g in grams), dtype=np.uint64))


def bands(text: str | None) -> list[int]:
    """A key per band: a hash of its MinHash values."""
    h, least = shingles(text), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(h), _CHUNK):
        least = np.minimum(least, (h[s : s + _CHUNK, None] * _SEEDS[0] + _SEEDS[1]).min(axis=0))
    return [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in least.reshape(BANDS, ROWS)]


def node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keys(docs: DataFrame) -> DataFrame:
    """``node, fps, bands`` of every distinct text."""

    @F.pandas_udf("struct<fps: array<long>, bands: array<long>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        fps = [np.array(simhash.fingerprints_of(t, 2, TABLES), dtype=np.uint64).view(np.int64) for t in texts]
        return pd.DataFrame({"fps": fps, "bands": [bands(t) for t in texts]})

    got = docs.select("node", of("text").alias("k")).select("node", "k.fps", "k.bands")
    return materialize(got.dropDuplicates(["node"]))


def candidates(keys: DataFrame) -> DataFrame:
    """``u, v``: edges that connect all texts with a band in common or fingerprints at most three bits apart."""
    fps = keys.select("node", F.posexplode("fps").alias("table", "fp"))
    all_keys = fps.union(keys.select("node", F.posexplode("bands").alias("b", "key")).select("node", F.col("b") + TABLES, "key"))
    first = all_keys.groupBy("table", "fp").agg(F.min("node").alias("node"), F.count("*").alias("n"))
    shared = first.where("n > 1").select("table", "fp", F.col("node").alias("first"))
    same = all_keys.join(shared, ["table", "fp"]).where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
    distinct = fps.groupBy("table", "fp").agg(F.min("node").alias("node"))
    return same.union(simhash.links(distinct, 3, propose=True))


def verified_forest(pdf: pd.DataFrame, share: float = SHARE) -> pd.DataFrame:
    """One block of a group: edges, each verified, that connect what its similar pairs connect."""
    pdf = pdf.sort_values(["left", "node"])
    left, ids, side = pdf["left"].to_numpy(), pdf["node"].to_numpy(), pdf["side"].to_numpy()
    sets = [np.asarray(x).view(np.uint64) for x in pdf["shingles"]]
    sizes = np.array([len(x) for x in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.argsort(np.argsort(times, kind="stable"), kind="stable")[number]
    ends = np.cumsum(sizes)
    tree = np.arange(len(ids))
    index: dict[int, list[int]] = {}
    u, v = [], []
    for x in range(len(ids)):
        # two sets at the share have one of their rarest n - ceil(share * n) + 1 members in common
        mine = np.sort(rarity[ends[x] - sizes[x] : ends[x]])[: sizes[x] - math.ceil(share * sizes[x] - 1e-9) + 1].tolist()
        met = np.array(sorted({y for m in mine for y in index.get(m, ())}), dtype=np.int64)
        for m in mine:
            index.setdefault(m, []).append(x)
        met = met[np.minimum(sizes[met], sizes[x]) >= share * np.maximum(sizes[met], sizes[x])]
        if side[x] == "two":
            met = met[left[met] != left[x]]
        for y in met[tree[met] != tree[x]].tolist():
            if tree[x] == tree[y]:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= share * (sizes[x] + sizes[y] - both):
                tree[tree == tree[y]] = tree[x]
                u.append(ids[x])
                v.append(ids[y])
    return pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})


def verified(groups: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``u, v``: edges that connect what the similar pairs of every group ``(node, component)`` connect."""

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).view(np.int64) for t in texts])

    texts = docs.select("node", "text").dropDuplicates(["node"])  # once per partition before any shuffle, however many copies there are
    found = stored(groups.join(texts, "node").select("node", "component", sets("text").alias("shingles")))
    sized = found.join(found.groupBy("component").agg(F.sum(F.size("shingles")).alias("n")), "component")
    members = sized.withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # part i against each later part j; within a part, each text against those before it
    inner = members.select("*", F.lit(True).alias("left"), F.lit("one").alias("side"), F.col("part").alias("i"), F.col("part").alias("j"))
    large = members.where("parts > 1")
    later = large.where("part + 1 < parts").select("*", F.lit(True).alias("left"), F.lit("two").alias("side"), F.col("part").alias("i"), F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("j"))
    before = large.where("part > 0").select("*", F.lit(False).alias("left"), F.lit("two").alias("side"), F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("i"), F.col("part").alias("j"))
    both = inner.unionByName(later).unionByName(before).select("component", "i", "j", "left", "side", "node", "shingles")
    return both.groupBy("component", "i", "j").applyInPandas(lambda pdf: verified_forest(pdf), "u long, v long")


def similar(docs: DataFrame) -> DataFrame:
    """``node, component`` of all nodes of ``docs(node, text)`` that are linked to another."""
    groups = components(candidates(_keys(docs)))
    return components(verified(groups, docs))
