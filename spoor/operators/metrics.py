"""Ranking metrics from one sorted histogram of scores.

Equal scores are merged first, with their positives and negatives; running counts over that
histogram give AUROC (ties count half), average precision, the ROC curve, and the AUROC of every
technique against the same benign rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.operators.order import running_sums
from spoor.operators.windows import SIZE, STRIDE, window_max_any

MIN_ATTACK_EVENTS = 50
MAX_BOOTSTRAP_SCORES = 100_000


def score_histogram(df: DataFrame, score: str = "score", label: str = "is_attack") -> DataFrame:
    """``score, pos, neg`` and their running counts ``tp, fp`` from the highest score down, with the place ``rank``."""
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("int")).cast("bigint").alias("pos"), F.sum(1 - F.col(label).cast("int")).cast("bigint").alias("neg")
    )
    return running_sums(counts, [F.col("score").desc()], {"tp": "pos", "fp": "neg"}, index="rank")


def _totals() -> tuple[Column, Column]:
    return F.sum("pos").cast("double"), F.sum("neg").cast("double")


def _share(part: Column, whole: Column) -> Column:
    """``part / whole``; NaN of nothing, as in the SQL, where Spark's division raises."""
    return F.when(whole != 0, part / whole).otherwise(F.when(whole == 0, F.lit(float("nan"))))


def _rates() -> tuple[Column, Column]:
    return _share(F.col("fp"), F.col("_n")).alias("fpr"), _share(F.col("tp"), F.col("_p")).alias("tpr")


def auroc(histogram: DataFrame) -> DataFrame:
    """One row ``n_pos, n_neg, auroc``; null if a class is missing."""
    p, n = _totals()
    area = F.sum(F.col("pos") * (F.col("neg") / 2.0 - F.col("fp")))
    return histogram.agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.when((p > 0) & (n > 0), (area + p * n) / (p * n)).alias("auroc")
    )


def average_precision(histogram: DataFrame) -> DataFrame:
    """One row ``ap``: precision at every distinct score, weighted by the recall it adds."""
    p, _ = _totals()
    return histogram.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(p, F.lit(0.0))).alias("ap"))


def roc_vertices(histogram: DataFrame) -> DataFrame:
    """``fpr, tpr`` of the ROC curve from (0, 0), without points on a straight line between their neighbours; the rate of a missing class is NaN."""
    after = histogram.select((F.col("rank") - 1).alias("_rank"), F.col("pos").alias("_pos"), F.col("neg").alias("_neg"))
    joined = histogram.join(after, F.col("rank") == F.col("_rank"), "left")
    bends = F.col("_rank").isNull() | (F.col("pos") != F.col("_pos")) | (F.col("neg") != F.col("_neg"))
    totals = histogram.agg(F.sum("pos").cast("double").alias("_p"), F.sum("neg").cast("double").alias("_n"))
    kept = joined.where(bends).crossJoin(F.broadcast(totals)).select(*_rates())
    return kept.unionByName(totals.select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def tpr_at_fpr(histogram: DataFrame, targets: list[float] = (0.01, 0.05), vertices_only: bool = True) -> DataFrame:
    """``fpr_target, tpr``: the highest true positive rate of a kept ROC vertex (or any point) within each target; 0 if none is, as without negatives."""
    if vertices_only:
        curve = roc_vertices(histogram)
    else:
        totals = histogram.agg(F.sum("pos").cast("double").alias("_p"), F.sum("neg").cast("double").alias("_n"))
        curve = histogram.crossJoin(F.broadcast(totals)).select(*_rates())
    wide = curve.agg(*[F.coalesce(F.max(F.when(F.col("fpr") <= t, F.col("tpr"))), F.lit(0.0)).alias(f"t{k}") for k, t in enumerate(targets)])
    pairs = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("fpr_target"), F.col(f"t{k}").alias("tpr")) for k, t in enumerate(targets)]))
    return wide.select(pairs.alias("p")).select("p.*")


def per_technique_auroc(
    df: DataFrame, score: str = "score", label: str = "is_attack", technique: str = "technique_id", min_events: int = MIN_ATTACK_EVENTS, histogram: DataFrame | None = None
) -> DataFrame:
    """``technique_id, n_attack, auroc, skipped``: each technique's rows against all benign ones; null if it has too few, NaN without benign rows."""
    hist = score_histogram(df, score, label) if histogram is None else histogram
    attacks = df.where(F.col(label)).groupBy(F.col(technique).alias("technique_id"), F.col(score).cast("double").alias("_s")).agg(F.count("*").alias("k"))
    n = hist.agg(F.sum("neg").cast("double").alias("_n"))
    joined = attacks.join(hist.select("score", "neg", "fp"), F.col("_s") == F.col("score")).crossJoin(F.broadcast(n))
    area = _share(F.sum(F.col("k") * (F.col("_n") - F.col("fp") + F.col("neg") / 2.0)), F.sum("k") * F.first("_n"))
    got = joined.groupBy("technique_id").agg(F.sum("k").alias("n_attack"), area.alias("_a"))
    few = F.col("n_attack") < min_events
    return got.select("technique_id", "n_attack", F.when(~few, F.col("_a")).alias("auroc"), few.alias("skipped"))


def per_window_auroc(df: DataFrame, rows: int, score: str = "score", label: str = "is_attack", size: int = SIZE, stride: int = STRIDE, index: str = "row_idx") -> DataFrame:
    """``n_pos, n_neg, auroc`` over windows: highest score, any label; null if all windows are alike."""
    return auroc(score_histogram(window_max_any(df, rows, score, label, size=size, stride=stride, index=index)))


def technique_distribution(df: DataFrame, score: str = "score", label: str = "is_attack", technique: str = "technique_id") -> DataFrame:
    """Per technique: count, mean, population deviation, median, 95th percentile and maximum, beside the benign percentiles."""
    s = F.col(score).cast("double")
    benign = df.where(~F.col(label)).agg(F.percentile(s, F.lit(0.5)).alias("benign_p50"), F.percentile(s, F.lit(0.95)).alias("benign_p95"))
    own = df.where(F.col(label)).groupBy(F.col(technique).alias("technique_id")).agg(
        F.count("*").alias("n_attack"), F.avg(s).alias("score_mean"), F.stddev_pop(s).alias("score_std"),
        F.percentile(s, F.lit(0.5)).alias("score_p50"), F.percentile(s, F.lit(0.95)).alias("score_p95"), F.max(s).alias("score_max"),
    )
    return own.crossJoin(F.broadcast(benign))


def bootstrap_auroc(histogram: DataFrame, iters: int = 1000, seed: int = 0) -> tuple[float, float]:
    """2.5 and 97.5 percentiles of the AUROC over resamples of all rows.

    Rows with equal score and label are alike, so a resample is a multinomial draw over the histogram. More than
    ``MAX_BOOTSTRAP_SCORES`` distinct scores are first merged into as many steps of rank."""
    if histogram.count() > MAX_BOOTSTRAP_SCORES:
        total = histogram.agg(F.sum(F.col("pos") + F.col("neg"))).head()[0]
        step = F.floor((F.col("tp") + F.col("fp") - 1) * MAX_BOOTSTRAP_SCORES / F.lit(total))
        histogram = histogram.groupBy(step.alias("rank")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = histogram.orderBy(F.col("rank").desc()).select("pos", "neg").toPandas()  # from the lowest score up; bounded above
    pos, neg = rows["pos"].to_numpy(), rows["neg"].to_numpy()
    n = int(pos.sum() + neg.sum())
    if not pos.sum() or not neg.sum():
        return float("nan"), float("nan")
    rng = np.random.default_rng(seed)
    p = np.concatenate([pos, neg]) / n
    found = []
    for _ in range(iters):
        for _ in range(6):  # again, up to five times, if a class is missing
            draw = rng.multinomial(n, p)
            a, b = draw[: len(pos)].astype(float), draw[len(pos) :].astype(float)
            if a.sum() and b.sum():
                found.append(float((a * (np.cumsum(b) - b / 2)).sum() / (a.sum() * b.sum())))
                break
    return (float(np.percentile(found, 2.5)), float(np.percentile(found, 97.5))) if found else (float("nan"), float("nan"))


def decision_branch(c: Column) -> Column:
    """How strong an AUROC is; thresholds are fixed values of the evaluation."""
    return F.when(c >= 0.85, F.lit("strong")).when(c >= 0.710, F.lit("mixed")).otherwise(F.lit("weak"))


def stitch_folds(scores: DataFrame, label: str = "is_attack", trial: str = "trial_idx", fold: str = "fold", score: str = "score", keys: list[str] = ("row_idx",)) -> DataFrame:
    """One score per event from one per fold: benign events take the mean, attacks that of the fold that held out their trial."""
    own = F.max(F.when(F.col(fold) == F.col(trial), F.col(score)))
    return scores.groupBy(*keys, label, trial).agg(F.when(F.col(label), own).otherwise(F.avg(score)).alias(score))


def nll_summary(df: DataFrame, nll: str = "nll", correct: str | None = None) -> DataFrame:
    """``n, mean, variance, perplexity`` (and ``accuracy``) of per-event losses."""
    cols = [F.count(nll).alias("n"), F.avg(nll).alias("mean"), F.var_pop(nll).alias("variance"), F.exp(F.least(F.avg(nll), F.lit(50.0))).alias("perplexity")]
    return df.agg(*cols, *([F.avg(F.col(correct).cast("double")).alias("accuracy")] if correct else []))


def mean_loss(df: DataFrame, loss: str = "loss", mask: str | None = None) -> DataFrame:
    """``n, mean_loss`` over all places, or over the masked ones; 0 if there are none."""
    rows = df.where(mask) if mask else df
    return rows.agg(F.count(loss).alias("n"), (F.coalesce(F.sum(loss), F.lit(0.0)) / F.greatest(F.count(loss), F.lit(1))).alias("mean_loss"))


def masked_summary(df: DataFrame, loss: str = "loss", mask: str = "mask", family: str = "f_action_family") -> DataFrame:
    """Mean loss at masked places per action family; the code past the vocabulary is named OOV."""
    from spoor.functions.vocab import ACTION_FAMILIES

    names = F.create_map(*[x for k, v in enumerate(ACTION_FAMILIES) for x in (F.lit(k), F.lit(v))])
    got = df.where(F.col(mask)).groupBy(family).agg(F.count("*").alias("n"), F.avg(loss).alias("mean_loss"))
    return got.withColumn("family", F.coalesce(F.try_element_at(names, F.col(family)), F.lit("OOV")))
