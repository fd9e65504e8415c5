"""Embedding near-duplicates by an exact metric range join.

On unit vectors a cosine of at least ``c`` is a distance of at most
``r = sqrt(2 - 2c)``. Pivots drawn from the vectors cut them into cells of nearest pivot, and a cell
that holds too many is cut again by pivots of its own, so the pivots form a tree. A cell
knows its radius ``R``. A vector at distance ``d`` from a cell's pivot, and ``e`` from the nearest
one beside it, is within ``r`` of none of the cell if ``d - R > r`` or
``(d^2 - e^2) / (2 |p - q|) > r``, and of all of it if ``d + R <= r``; by the triangle inequality both are
certain. In the second case the whole cell is counted unseen. Only vectors in between are sent
there, each pair of cells in one direction, and cells are joined independently.

A cell that cannot be cut further is dealt to several slots, and what is sent to a slot to
as many turns as its number asks for, so every block is of bounded size, whatever the data. A block
returns the links of those that have any and a forest that connects what its links connect,
never the links themselves. Equal vectors are one class with a count. Products in single precision
decide what lies clear of the threshold; double precision decides the rest.

The pivots, a share of ``1 / cell`` of the vectors at most, are broadcast; beyond ``MAX_TREE``
bytes of them cells are left as they are, in more slots, which is as exact.

Defined cases: null, empty or zero vectors and those with a null or non-finite component link
with nothing; vectors of different lengths never link; repeated rows are vectors of their own and
link with each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import materialize
from spoor.llm.components import components

BLOCK_BYTES = 8 << 20  # of one side of a block, in double precision
FAN = 16  # pivots per cut
MAX_TREE = 64 << 20
_ROWS = 512  # rows multiplied at once
_NULL_ID = -(1 << 63)
_SLACK = 1e-6  # for rounding in the bounds; a pair is decided by its own product
_MARGIN = 1e-5
Batches = Iterator[pd.DataFrame]


def _unit(blobs: pd.Series, size: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype=kind).reshape(-1, size).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _apart(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ p.T)))


class Cut:
    """A cell cut by pivots: its children's numbers, radii and counts."""

    def __init__(self, pivots: np.ndarray, first: int):
        self.pivots, self.first = pivots, first
        self.between = _apart(pivots, pivots)
        self.radius = np.full(len(pivots), -np.inf)  # of an empty child

    def reached(self, x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """Per vector and child: whether any of it may be within ``r``, and whether all of it is."""
        d = _apart(x, self.pivots)
        own = d.argmin(axis=1)
        gap = self.between[own]
        plane = (d**2 - d.min(axis=1, keepdims=True) ** 2) / np.maximum(2 * gap, 1e-12)
        return (d - self.radius <= r + _SLACK) & ((plane <= r + _SLACK) | (gap < 1e-3)), d + self.radius <= r - _SLACK


class Cells:
    """The tree of cuts and what is known of its leaves; leaf numbers give the direction in which pairs of cells are joined."""

    def __init__(self, r: float):
        self.r, self.cuts, self.size = r, {}, 1
        self.n, self.weight, self.low = {}, {}, {}
        self.parts, self.whole = {}, set()

    def leaves(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The leaves that vectors may reach: leaf, their places, and whether all of the leaf is within reach."""
        todo = [(0, np.arange(len(x)), np.zeros(len(x), bool))]
        while todo:
            cell, at, whole = todo.pop()
            if cell not in self.cuts:
                yield cell, at, whole
                continue
            cut = self.cuts[cell]
            some, every = cut.reached(x[at], self.r)
            for k in range(len(cut.pivots)):
                if len(mine := np.flatnonzero(some[:, k])):
                    todo.append((cut.first + k, at[mine], every[mine, k]))

    def bytes(self) -> int:
        return sum(c.pivots.nbytes + c.between.nbytes for c in self.cuts.values())


def _grow(classes: DataFrame, size: int, kind: str, r: float, limit: int) -> tuple[DataFrame, Cells]:
    """Classes with their leaf, and the tree: cells over ``limit`` are cut until none is, or none can be."""
    cells = Cells(r)
    homed = classes.withColumns({"cell": F.lit(0), "far": F.lit(2.0).cast("double")})
    # a row per cell, of which there are a few per block of vectors
    per_cell = lambda df: df.groupBy("cell").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min("cid").alias("low"), F.max("far").alias("far")).collect()
    found = {x["cell"]: x for x in per_cell(homed)}
    stuck: set[int] = set()
    while large := [c for c, x in found.items() if x["n"] > limit and c not in stuck]:
        share = {c: min(1.0, 8 * FAN / found[c]["n"]) for c in large}
        place = F.pmod(F.xxhash64("vec", F.lit(len(cells.cuts))), F.lit(1 << 30)) / float(1 << 30)
        wanted = F.element_at(F.create_map(*[F.lit(z) for kv in share.items() for z in kv]), F.col("cell"))
        drawn = homed.where(F.col("cell").isin(large) & (place < wanted)).select("cell", "vec").toPandas()  # about 8 FAN rows per cell to cut
        new: dict[int, Cut] = {}
        for c in large:
            mine = drawn.loc[drawn["cell"] == c, "vec"].sort_values()
            p = np.unique(_unit(mine, size, kind), axis=0) if len(mine) else np.empty((0, size))
            k = min(FAN, max(2, -(-2 * found[c]["n"] // limit)))
            if len(p) >= 2 and cells.bytes() + 8 * size * k <= MAX_TREE:
                p = p[np.random.default_rng(c).permutation(len(p))[:k]]
                new[c] = cells.cuts[c] = Cut(p, cells.size)
                cells.size += len(p)
            else:
                stuck.add(c)
        if not new:
            break

        def deal(batches: Batches, new=new) -> Batches:
            for b in batches:
                cell, far = b["cell"].to_numpy().copy(), b["far"].to_numpy().copy()
                for c in np.unique(cell):
                    if c in new:
                        at = np.flatnonzero(cell == c)
                        d = _apart(_unit(b["vec"].iloc[at], size, kind), new[c].pivots)
                        cell[at], far[at] = new[c].first + d.argmin(axis=1), d.min(axis=1)
                yield b.assign(cell=cell, far=far)

        homed = materialize(homed.mapInPandas(deal, "cid long, w long, vec binary, cell int, far double"))
        before, found = found, {x["cell"]: x for x in per_cell(homed)}
        for c, cut in new.items():
            for k in range(len(cut.pivots)):
                if child := found.get(cut.first + k):
                    cut.radius[k] = child["far"]
                    if child["n"] > 0.9 * before[c]["n"]:
                        stuck.add(cut.first + k)  # as good as uncut
    for c, x in found.items():
        cells.n[c], cells.weight[c], cells.low[c], cells.parts[c] = x["n"], x["w"], x["low"], -(-x["n"] // limit)
        if 2 * x["far"] <= r - _SLACK:
            cells.whole.add(c)  # all of it links with all of it
    return homed, cells


def _forest(a: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the same nodes as the true entries of ``a``."""
    r, c = np.flatnonzero(a.any(axis=1)), np.flatnonzero(a.any(axis=0))
    if not len(r):
        return []
    a = a[np.ix_(r, c)]
    ids, back = np.unique(np.concatenate([rows[r], cols[c]]), return_inverse=True)
    at_r, at_c = back[: len(r)], back[len(r) :]
    label = np.arange(len(ids))
    while True:
        low = np.array([label[at_c[row]].min() for row in a])
        new = label.copy()
        np.minimum.at(new, at_r, low)
        up = np.array([new[at_r[col]].min() for col in a.T])
        np.minimum.at(new, at_c, up)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(u), int(v)) for u, v in zip(ids, ids[label], strict=True) if u != v]


class _Links:
    """Counts per vector of a block, and edges."""

    def __init__(self, cosine: float):
        self.cosine, self.edges, self.n = cosine, [], {}

    def join(self, x: np.ndarray, y: np.ndarray, xid: np.ndarray, yid: np.ndarray, xw: np.ndarray, yw: np.ndarray, upper: bool = False) -> None:
        """Links between rows and columns; with ``upper``, of each row with later columns of the same vectors only."""
        x4, y4 = x.astype(np.float32), y.astype(np.float32)
        xn, yn = np.zeros(len(x)), np.zeros(len(y))
        for s in range(0, len(x), _ROWS):
            e, o = min(s + _ROWS, len(x)), s if upper else 0
            near = x4[s:e] @ y4[o:].T
            if upper:
                near[:, : e - s][np.tri(e - s, dtype=bool)] = -2.0
            linked = near >= np.float32(self.cosine - _MARGIN)
            if not linked.any():
                continue
            close = linked & (near < np.float32(self.cosine + _MARGIN))
            i, j = np.nonzero(close)
            for z in range(0, len(i), 1 << 16):
                a, b = i[z : z + (1 << 16)], j[z : z + (1 << 16)]
                linked[a, b] = np.einsum("ij,ij->i", x[s + a], y[o + b]) >= self.cosine
            r, c = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            if not len(r):
                continue
            some = linked[np.ix_(r, c)].astype(np.float64)
            xn[s + r] += some @ yw[o + c]
            yn[o + c] += xw[s + r] @ some
            self.edges += _forest(some > 0, xid[s + r], yid[o + c])
        self._add(xid, xn)
        self._add(yid, yn)

    def _add(self, ids: np.ndarray, n: np.ndarray) -> None:
        for k in np.flatnonzero(n).tolist():
            self.n[int(ids[k])] = self.n.get(int(ids[k]), 0) + int(n[k])

    def frame(self) -> pd.DataFrame:
        u = [*self.n, *(e[0] for e in self.edges)]
        v, n = [0] * len(self.n) + [e[1] for e in self.edges], [*self.n.values(), *[-1] * len(self.edges)]
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64), "n": np.array(n, np.int64)})


def _join_block(pdf: pd.DataFrame, size: int, kind: str, cosine: float) -> pd.DataFrame:
    """Links of what was sent to a slot with the slot's own vectors and, in its first turn, among its own."""
    out = _Links(cosine)
    own = pdf[~pdf["query"]]
    y, yid, yw = _unit(own["vec"], size, kind), own["cid"].to_numpy(), own["w"].to_numpy(np.float64)
    if len(own):
        if own["inner"].iloc[0] and pdf["turn"].iloc[0] == 0:
            out.join(y, y, yid, yid, yw, yw, upper=True)
        q = pdf[pdf["query"]]
        if len(q):
            out.join(_unit(q["vec"], size, kind), y, q["cid"].to_numpy(), yid, q["w"].to_numpy(np.float64), yw)
    return out.frame()


def _links_of_size(classes: DataFrame, size: int, kind: str, cosine: float, limit: int) -> DataFrame:
    """``u, v, n``: rows of n > 0 count links of class u, rows of n = -1 are edges."""
    r = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    homed, cells = _grow(classes, size, kind, r, limit)
    shared = classes.sparkSession.sparkContext.broadcast(cells)

    def sent(b: pd.DataFrame, cells: Cells) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Leaf, slot in it, places of the vectors sent there; the slot -1 for those within reach of all of the leaf."""
        home, part = b["cell"].to_numpy(), b["part"].to_numpy()
        for leaf, at, whole in cells.leaves(_unit(b["vec"], size, kind)):
            if leaf not in cells.n:
                continue
            later = home[at] < leaf
            if (done := at[later & whole]).size:
                yield leaf, -1, done
            there = at[later & ~whole]
            same = at[home[at] == leaf] if leaf not in cells.whole else at[:0]
            for k in range(cells.parts[leaf]):
                go = np.concatenate([there, same[part[same] < k]])
                if len(go):
                    yield leaf, k, go

    def parted(df: DataFrame) -> DataFrame:
        parts = F.lit(1)
        if more := {c: p for c, p in cells.parts.items() if p > 1}:
            parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(z) for kv in more.items() for z in kv]), F.col("cell")), F.lit(1))
        return df.withColumn("part", F.pmod(F.xxhash64("cid"), parts).cast("int"))

    def counted(batches: Batches) -> Batches:
        n: dict[tuple[int, int], int] = {}
        for b in batches:
            if len(b):
                for leaf, k, at in sent(b, shared.value):
                    if k >= 0:
                        n[leaf, k] = n.get((leaf, k), 0) + len(at)
        yield pd.DataFrame({"cell": [c for c, _ in n], "part": [p for _, p in n], "n": list(n.values())}).astype({"cell": "int32", "part": "int32", "n": "int64"})

    given = parted(homed)
    numbers = given.mapInPandas(counted, "cell int, part int, n long").groupBy("cell", "part").agg(F.sum("n").alias("n")).collect()  # a row per slot
    turns = classes.sparkSession.sparkContext.broadcast({(x["cell"], x["part"]): -(-x["n"] // limit) for x in numbers})

    def send(batches: Batches) -> Batches:
        cells, turn_of = shared.value, turns.value

        def rows(b: pd.DataFrame, at: np.ndarray, cell, part, turn, query: bool) -> Batches:
            for s in range(0, len(at), 20_000):
                z = at[s : s + 20_000]
                inner = ~b["cell"].iloc[z].isin(cells.whole).to_numpy()
                pick = lambda v, s=s, z=z: v[s : s + len(z)] if isinstance(v, np.ndarray) else v
                yield pd.DataFrame({"cell": pick(cell), "part": pick(part), "turn": pick(turn), "query": query, "inner": inner, "cid": b["cid"].iloc[z], "w": b["w"].iloc[z], "vec": b["vec"].iloc[z], "v": 0, "n": 0})

        for b in batches:
            if not len(b):
                continue
            cid, w = b["cid"].to_numpy(), b["w"].to_numpy()
            covered: list[tuple[int, np.ndarray]] = []
            for leaf, k, at in sent(b, cells):
                if k < 0:
                    covered.append((leaf, at))
                else:
                    yield from rows(b, at, leaf, k, cid[at] % turn_of[leaf, k], True)
            keys = list(zip(b["cell"].tolist(), b["part"].tolist(), strict=True))
            copies = np.array([turn_of.get(key, 1) for key in keys])
            for t in range(int(copies.max())):
                at = np.flatnonzero(copies > t)
                yield from rows(b, at, b["cell"].to_numpy()[at], b["part"].to_numpy()[at], t, False)
            own = np.flatnonzero(b["cell"].isin(cells.whole))
            if covered or len(own):
                # counted unseen: a vector with the cell's weight, the cell with the weights that reach it
                n = np.zeros(len(b), np.int64)
                lows = np.array([cells.low[c] for c, _ in covered], np.int64)
                reach = np.zeros((len(b), len(covered)), bool)
                for k, (leaf, at) in enumerate(covered):
                    n[at] += cells.weight[leaf]
                    reach[at, k] = True
                extra: dict[int, int] = {}
                for leaf, at in covered:
                    extra[leaf] = extra.get(leaf, 0) + int(w[at].sum())
                home = b["cell"].to_numpy()
                n[own] += np.array([cells.weight[c] for c in home[own]], np.int64) - w[own]
                edges = _forest(reach, cid, lows) + [(int(cid[k]), cells.low[home[k]]) for k in own if cid[k] != cells.low[home[k]]]
                some = np.flatnonzero(n)
                frames = [
                    pd.DataFrame({"cid": cid[some], "v": 0, "n": n[some], "cell": -1}), pd.DataFrame({"cid": [u for u, _ in edges], "v": [v for _, v in edges], "n": -1, "cell": -1}),
                    pd.DataFrame({"cid": 0, "v": 0, "n": list(extra.values()), "cell": list(extra)}),
                ]
                if frames := [f for f in frames if len(f)]:
                    yield pd.concat(frames).assign(part=-1, turn=0, query=True, inner=False, w=0, vec=b"")

    schema = "cell int, part int, turn long, query boolean, inner boolean, cid long, w long, vec binary, v long, n long"
    all_sent = given.mapInPandas(send, schema)
    blocks = all_sent.where("part >= 0").groupBy("cell", "part", "turn")
    found = blocks.applyInPandas(lambda pdf: _join_block(pdf, size, kind, cosine), "u long, v long, n long")
    unseen = all_sent.where("part < 0 and cell < 0").select(F.col("cid").alias("u"), "v", "n")
    # of cells within a vector's reach, each member links with it: so all hang together, through the least of them
    reached = all_sent.where("part < 0 and cell >= 0").groupBy("cell").agg(F.sum("n").alias("n"))
    members = given.select("cid", "cell").join(reached, "cell")
    low = F.min("cid").alias("low")
    hub = members.join(homed.groupBy("cell").agg(low), "cell")
    return found.union(unseen).union(members.select(F.col("cid").alias("u"), F.lit(0).cast("long").alias("v"), "n")).union(hub.select(F.col("cid").alias("u"), F.col("low").alias("v"), F.lit(-1).cast("long").alias("n")))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", limit: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row; ``limit`` is the number of vectors aimed at per cell and block side."""
    given = F.col(f"`{vec_col}`")
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    v = given.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(ok, v).alias("v"))
    grouped = rows.where("v is not null").groupBy("v").agg(F.coalesce(F.min("vec_id"), F.lit(_NULL_ID)).alias("cid"), F.count("*").alias("w"))
    classes = materialize(grouped.withColumn("size", F.size("v")))

    def packed(batches: Batches) -> Batches:
        for b in batches:
            yield pd.DataFrame({"cid": b["cid"], "w": b["w"], "vec": [np.asarray(x, dtype=kind).tobytes() for x in b["v"]]})

    found = None
    for (size,) in classes.select("size").distinct().orderBy("size").collect():
        of_size = classes.where(F.col("size") == size).select("cid", "w", "v").mapInPandas(packed, "cid long, w long, vec binary")
        part = _links_of_size(of_size, size, kind, cosine, limit or max(256, BLOCK_BYTES // (8 * size)))
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found)
    counts = found.where("n > 0").groupBy(F.col("u").alias("_u")).agg(F.sum("n").alias("n"))
    comp = components(found.where("n = -1").select("u", "v")).select(F.col("node").alias("_node"), "component")
    joined = classes.join(counts, F.col("cid") == F.col("_u"), "left").join(comp, F.col("cid") == F.col("_node"), "left")
    by_class = joined.select("v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return rows.join(by_class, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
