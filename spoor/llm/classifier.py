"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics are standardised and mapped to random Fourier features, whose
inner products approximate a Gaussian kernel. Every partition sums its
part of the normal equations; the sums, of fixed size, are added in two steps and solved on the
driver. Sums are kept per fold, so that each training row can be scored by the model of the other folds. These
ridge scores are counted on a fixed grid with their labels, and pooling adjacent violators on that grid makes
calibrated probabilities of the scores of the model of all folds.

All labelled rows outside the held-out fold are used. Labels, languages, sources and ids are never inputs of a score.

Defined cases: a null text counts as an empty one and is scored like any other; labels that are null are no
labels, and of several for one document the largest counts; a null id is hashed as the empty text and has no label; without
training rows every score is 0.5; repeated rows are scored one by one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import materialize

FEATURES = 256
GAMMA = 0.02  # of the kernel exp(-gamma * |x - y|^2) on standardised statistics
RIDGE = 1e-5
GRID = 2048
SEED = 20240
_STEPS = 4  # partial sums per fold that reach the driver
_PUNCT = b".,;:?!'\"()-"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
NAMES = [
    "log_words", "word_length", "symbols", "bars", "upper", "bangs", "digits", "punctuation", "distinct_words", "repeated_trigrams",
    "repeated_lines", "line_words", "longest_word", "odd_words", "common_share", "non_ascii",
]
_ODD = re.compile(rb"[^A-Za-z\x80-\xff.,;:!?'\"()-]")


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text, each of a bounded or logarithmic range."""
    b = (text or "").encode("utf-8", "surrogatepass")
    w = b.split()
    n = len(w)
    if not n:
        return [0.0] * len(NAMES)
    size = sum(map(len, w))

    def share(chars: bytes) -> float:
        return math.sqrt((len(b) - len(b.translate(None, chars))) / size)

    grams = max(0, n - 2)
    distinct = len(set(zip(w, w[1:], w[2:], strict=False))) if grams else 0
    lines = [x for x in b.split(b"\n") if x.strip()]
    kinds = set(w)
    most = max(Counter(w).values())
    return [
        math.log10(n), math.log10(size / n), share(b"#*$%&<>"), share(b"|"), share(_UPPER), share(b"!"), share(_DIGITS), share(_PUNCT),
        len(kinds) / n ** 0.8, 1 - distinct / grams if grams else 0.0, 1 - len(set(lines)) / len(lines), math.log10(n / len(lines)),
        math.log10(max(map(len, w))), sum(1 for x in w if _ODD.search(x)) / n, most / n, 1 - len(b.decode("utf-8", "surrogatepass")) / len(b),
    ]


def _features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features, with a constant in front; the draw depends on the seed only."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0.0, math.sqrt(2 * GAMMA), (x.shape[1], FEATURES))
    b = rng.uniform(0.0, 2 * math.pi, FEATURES)
    z = np.clip((x - mean) / scale, -8.0, 8.0)
    return np.hstack([np.ones((len(x), 1)), math.sqrt(2.0 / FEATURES) * np.cos(z @ w + b)])


def _sums(mean: np.ndarray, scale: np.ndarray):
    d = FEATURES + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for fold, rows in batch.groupby("fold"):
                a, c = sums.setdefault(int(fold), (np.zeros((d, d)), np.zeros(d)))
                z = _features(np.stack(rows["x"].to_numpy()), mean, scale)
                a += z.T @ z
                c += z.T @ rows["y"].to_numpy(dtype=float)
        yield pd.DataFrame({"fold": list(sums), "s": [np.concatenate([a.ravel(), c]).tobytes() for a, c in sums.values()]}).astype({"fold": "int32"})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, blob in zip(batch["fold"], batch["s"], strict=True):
                sums[fold] = sums.get(fold, 0.0) + np.frombuffer(blob)
        yield pd.DataFrame({"fold": list(sums), "s": [s.tobytes() for s in sums.values()]}).astype({"fold": "int32"})

    return run, add


def isotonic(mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pooling adjacent violators: the non-decreasing fit to ``mean``."""
    blocks: list[list[float]] = []
    for m, w in zip(mean, weight, strict=True):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, n2 = blocks.pop()
            m1, w1, n1 = blocks[-1]
            blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), m) for m, _, n in blocks])


class Model:
    """What scoring needs: a few kilobytes, whatever the corpus."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray | None):
        self.mean, self.scale, self.beta = mean, scale, beta
        self.at, self.p = np.array([0.0]), np.array([0.5])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _features(x, self.mean, self.scale) @ self.beta

    def cell(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((self.raw(x) + 0.5) / 2 * GRID), 0, GRID).astype(np.int32)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.at, self.p), 0.0, 1.0)


def fit(train: DataFrame) -> Model:
    """Fits on materialised rows ``x`` (array of double), ``y`` (0 or 1) and ``fold`` (int)."""
    k = len(NAMES)
    parts = [f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(k) for f in (F.avg, F.stddev_pop)]
    got = train.agg(F.count("*").alias("n"), *parts).head()
    mean = np.array([got[f"avg{i}"] or 0.0 for i in range(k)])
    scale = np.array([got[f"stddev_pop{i}"] or 0.0 for i in range(k)])
    scale[scale < 1e-9] = 1.0
    if not got["n"]:
        return Model(mean, scale, None)
    run, add = _sums(mean, scale)
    summed = train.mapInPandas(run, "fold int, s binary").repartition(_STEPS).mapInPandas(add, "fold int, s binary").collect()
    per_fold: dict[int, np.ndarray] = {}
    for r in summed:  # a few rows per fold
        per_fold[r["fold"]] = per_fold.get(r["fold"], 0.0) + np.frombuffer(r["s"])
    d, whole = FEATURES + 1, sum(per_fold.values())

    def solved(s: np.ndarray) -> Model:
        rows = max(s[0], 1.0)  # the constant feature counts them
        return Model(mean, scale, np.linalg.solve(s[: d * d].reshape(d, d) + RIDGE * rows * np.eye(d), s[d * d :]))

    model = solved(whole)
    others = {k: solved(whole - s) if len(per_fold) > 1 else model for k, s in per_fold.items()}

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, rows in batch.groupby("fold"):
                yield pd.DataFrame({"cell": others[int(fold)].cell(np.stack(rows["x"].to_numpy())), "y": rows["y"]})

    grid = train.mapInPandas(cells, "cell int, y int").groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("cell").collect()
    n, ones = np.array([r["n"] for r in grid], float), np.array([r["ones"] for r in grid], float)
    fitted = isotonic(ones / n, n)
    model.at, model.p = np.array([r["cell"] for r in grid]) * 2.0 / GRID - 0.5, fitted
    return model


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, cut: float = 0.3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    fold = (F.crc32(key) % folds).cast("int")
    given = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), fold.alias("fold"), (fold == held).alias("held_out"), stats(F.col(f"`{text}`")).alias("x")))
    y = labels.where(F.col(label).isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    model = fit(materialize(given.where("not held_out").join(y, "doc_id").select("x", "y", "fold")))

    @F.pandas_udf("double")
    def scored(xs: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(xs.to_numpy())) if len(xs) else np.empty(0))

    found = given.select("doc_id", "held_out", scored("x").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= cut).cast("int"))
