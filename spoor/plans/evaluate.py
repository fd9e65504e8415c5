"""The evaluation bundle of a scored event table, and its files."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.operators import metrics as m
from spoor.operators.order import cut


@dataclass
class Evaluation:
    model_name: str
    n_events: int
    n_attack: int
    n_benign: int
    auroc: float | None
    auroc_ci_low: float
    auroc_ci_high: float
    average_precision: float | None
    tpr_at_fpr: dict[str, float]
    per_technique: list[dict]
    window_auroc: float | None
    n_windows_attack: int
    n_windows_benign: int
    window_size: int
    stride: int
    wall_seconds: float
    extra: dict[str, Any] = field(default_factory=dict)

    def write(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))


def evaluate(df: DataFrame, model_name: str, rows: int, bootstrap: int = 1000, seed: int = 0, size: int = 128, stride: int = 32, **extra) -> Evaluation:
    """All metrics of indexed rows with ``score, is_attack, technique_id``; one histogram serves most of them."""
    began = time.time()
    hist = cut(m.score_histogram(df))
    a = m.auroc(hist).head()
    if not a["n_pos"]:
        raise ValueError("no attack events to evaluate on")
    low, high = m.bootstrap_auroc(hist, bootstrap, seed)
    w = m.per_window_auroc(df, rows, size=size, stride=stride).head()
    tpr = {str(r["fpr_target"]): r["tpr"] for r in m.tpr_at_fpr(hist).collect()}
    techniques = [r.asDict() for r in m.per_technique_auroc(df, histogram=hist).orderBy("technique_id").collect()]
    return Evaluation(
        model_name, a["n_pos"] + a["n_neg"], a["n_pos"], a["n_neg"], a["auroc"], low, high, m.average_precision(hist).head()[0], tpr, techniques,
        w["auroc"], w["n_pos"], w["n_neg"], size, stride, time.time() - began, dict(extra),
    )


def score_table(df: DataFrame, trials: bool = False) -> DataFrame:
    """``event_time, score, is_attack, technique_id`` (and ``trial_id``); an empty technique is null."""
    cols = [F.col("event_time").cast("bigint"), F.col("score").cast("float"), F.col("is_attack"), F.nullif("technique_id", F.lit("")).alias("technique_id")]
    return df.select(*cols, *([F.col("trial_id")] if trials else []))
