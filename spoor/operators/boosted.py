"""Boosted trees on Spark ML: class weights, a chronological validation tail, and folds that hold out one trial.

Fitting stops as soon as a round makes the loss of the validation rows worse (Spark ML has no patience of several rounds)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.operators.order import cut

#: Production settings of one fit and of a fold.
SETTINGS = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "validationTol": 0.0, "seed": 0}
FOLD_SETTINGS = {**SETTINGS, "maxIter": 300}


@dataclass
class BoostedModel:
    """A fitted ensemble, or a constant where training rows had one class only."""

    columns: list[str]
    model: GBTClassificationModel | None
    constant: float = 0.5

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        if self.model is None:
            return df.withColumn(name, F.lit(self.constant).cast("float"))
        out = self.model.transform(_vectors(df, self.columns))
        return out.withColumn(name, vector_to_array("probability")[1].cast("float")).drop("_x", "rawPrediction", "probability", "prediction")

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.columns, self.constant, self.model is not None)]
        spark.createDataFrame(row, "columns array<string>, constant double, fitted boolean").write.mode("overwrite").parquet(f"{path}/meta")
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        m = spark.read.parquet(f"{path}/meta").head()
        return cls(list(m["columns"]), GBTClassificationModel.load(f"{path}/trees") if m["fitted"] else None, m["constant"])


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    given = df.withColumns({f"_in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=[f"_in_{c}" for c in columns], outputCol="_x").transform(given).drop(*[f"_in_{c}" for c in columns])


def fit(df: DataFrame, columns: list[str], n: int | None = None, validation: float = 0.2, label: str = "is_attack", index: str = "row_idx", **settings) -> BoostedModel:
    """Fits on indexed rows; the last fifth by index only decides when to stop. Attacks weigh as much as benign rows together."""
    if validation:
        n = df.count() if n is None else n
        late = F.col(index) >= n - max(1, int(n * validation))
    else:
        late = F.lit(False)  # all rows train, whatever their index
    y = F.col(label).cast("int")
    counts = df.where(~late).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q")).head()
    if not counts["p"] or not counts["q"]:
        return BoostedModel(columns, None)
    rows = _vectors(df, columns).select(
        "_x", y.cast("double").alias("_y"), F.when(y == 1, counts["q"] / counts["p"]).otherwise(1.0).alias("_w"), late.alias("_v")
    )
    given = {**SETTINGS, **settings, "featuresCol": "_x", "labelCol": "_y", "weightCol": "_w"}
    if validation:
        given["validationIndicatorCol"] = "_v"
    return BoostedModel(columns, GBTClassifier(**given).fit(rows))


def held_out_trials(benign: DataFrame, test: DataFrame, columns: list[str], trials: list[int] | None = None, trial: str = "trial_idx", **settings) -> DataFrame:
    """``test`` rows scored once per fold: each fold trains on benign rows and on all attacks but those of its trial.

    ``trials`` are all that ``test`` holds unless given (a row per trial goes to the driver, as each is a fit)."""
    if trials is None:
        trials = [r[0] for r in test.where(F.col(trial) >= 0).select(trial).distinct().orderBy(trial).collect()]
    found = None
    base = benign.select(*columns, F.lit(False).alias("is_attack"))
    for k in trials:
        others = test.where((F.col(trial) >= 0) & (F.col(trial) != k)).select(*columns, F.lit(True).alias("is_attack"))
        model = fit(base.unionByName(others), columns, validation=0.0, **{**FOLD_SETTINGS, **settings})
        part = cut(model.score(test).withColumn("fold", F.lit(k)))
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no trials to hold out")
    return found
