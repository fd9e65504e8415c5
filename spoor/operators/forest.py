"""Isolation forest: grown on bounded samples on the driver, applied by an Arrow UDF.

Trees follow the published algorithm: each isolates ``min(256, n)`` rows by random cuts, and a
row's score is ``2 ** (-mean path length / c(sample))``; higher is more anomalous.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE, SEED = 200, 256, 42
MAX_ROWS = TREES * SAMPLE  # rows that reach the driver


def sample_rows(df: DataFrame, k: int, seed: int = SEED, index: str = "row_idx", in_order: bool = False) -> DataFrame:
    """``k`` distinct rows chosen by the hash of their index, the same each time; all rows if there are fewer."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(index).cast("string"))), 1, 15), 16, 10).cast("bigint")  # of 60 bits
    placed = df.withColumn("_place", place)
    n = df.count()
    few = placed
    if n > 4 * k:  # so few rows only can be among the k least that one task may sort them
        few = placed.where(F.col("_place") < int((k + 8 * math.sqrt(k) + 32) / n * (1 << 60)))
        few = few if few.limit(k).count() == k else placed
    out = few.orderBy("_place", index).limit(k).drop("_place")
    return out.orderBy(index) if in_order else out


def evenly_spaced(df: DataFrame, n: int, k: int, index: str = "row_idx") -> DataFrame:
    """``k`` of ``n`` indexed rows at even steps from the first to the last; all if there are fewer."""
    if n <= k:
        return df
    i = F.col(index).cast("double")
    step = (n - 1) / (k - 1) if k > 1 else float(n)
    j = F.round(i / step)
    return df.where((j < k) & (F.floor(j * step) == F.col(index)))


def path_correction(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), cut, children, and the path length a leaf stands for."""

    trees: list[dict[str, list]]
    sample: int
    columns: list[str]

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in self.trees:
            f, cut, low, high, length = (np.array(t[k]) for k in ("feature", "cut", "low", "high", "length"))
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := f[at] >= 0).any():
                r, node = rows[inner], at[inner]
                at[inner] = np.where(x[r, f[node]] < cut[node], low[node], high[node])
            total += length[at]
        return total / len(self.trees)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 2.0 ** (-self.path_lengths(x) / max(path_correction(self.sample), 1e-12))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self)))

    @classmethod
    def load(cls, path: str) -> Forest:
        return cls(**json.loads(Path(path).read_text()))


def grow(x: np.ndarray, columns: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    m = min(sample, len(x))
    limit = max(1, math.ceil(math.log2(max(m, 2))))
    found = []
    for _ in range(trees):
        t: dict[str, list] = {k: [] for k in ("feature", "cut", "low", "high", "length")}
        todo = [(rng.choice(len(x), m, replace=False), 0, -1, "")]
        while todo:
            rows, depth, parent, side = todo.pop()
            here = len(t["feature"])
            if side:
                t[side][parent] = here
            part = x[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            leaf = depth >= limit or len(rows) < 2 or not len(usable)
            f = -1 if leaf else int(rng.choice(usable))
            cut = 0.0 if leaf else float(rng.uniform(low[f], high[f]))
            for k, v in (("feature", f), ("cut", cut), ("low", here), ("high", here), ("length", depth + path_correction(len(rows)))):
                t[k].append(v)
            if not leaf:
                below = part[:, f] < cut
                todo += [(rows[~below], depth + 1, here, "high"), (rows[below], depth + 1, here, "low")]
        found.append(t)
    return Forest(found, m, columns)


def fit(df: DataFrame, columns: list[str], label: str | None = "is_attack", trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, index: str = "row_idx") -> Forest:
    """Grown on a sample of benign rows of at most ``trees * sample``; of all rows where ``label`` is None."""
    benign = df.where(~F.col(label)) if label else df
    pool = sample_rows(benign, min(trees * sample, MAX_ROWS), seed, index).select(*[F.col(c).cast("double") for c in columns]).toPandas()
    if pool.empty:
        raise ValueError("no benign rows to fit on")
    return grow(pool.fillna(0.0).to_numpy(), columns, trees, sample, seed)


def score_column(forest: Forest) -> Column:
    @F.pandas_udf("float")
    def of(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float, na_value=0.0) for c in cols])
        return pd.Series(forest.score(x).astype(np.float32))

    return of(*[F.col(c).cast("double") for c in forest.columns])


def score(df: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    return df.withColumn(name, score_column(forest))
