"""Tables whose events all lie in attacks, as a dense month of events does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.operators import forest, metrics
from spoor.plans import queries
from spoor.sources import schema

N = 340


@pytest.fixture(scope="module")
def attacked(spark, tmp_path_factory):
    """340 events a second apart: half an hour from every 160th on is an attack."""
    d = str(tmp_path_factory.mktemp("attacked"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where(F.col("event_id") < N)
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")).cast(events.schema["ts"].dataType)
    events.withColumn("ts", ts).coalesce(1).write.parquet(f"{d}/events.parquet")
    assert queries.labelled(spark, d).where("NOT is_attack").count() == 0
    return d


@pytest.mark.parametrize(("name", "feature_set"), [("q_iforest", "rich"), ("q_iforest_flat", "flat")])
def test_forest_without_benign_rows_scores_every_row(spark, attacked, name, feature_set):
    with pytest.warns(UserWarning, match="no benign rows"):
        got = {r["row_idx"]: r["score"] for r in queries.QUERIES[name](spark, attacked).collect()}
    columns = schema.model_columns(feature_set)
    x = np.array([[float(v or 0) for v in r[1:]] for r in queries._model_rows(spark, attacked).select("row_idx", *columns).orderBy("row_idx").collect()])
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], ["row_idx", *columns])
    want = forest.fit(rows, columns, label=None).score(x)
    assert sorted(got) == list(range(N)) and len(set(got.values())) > 10
    assert [got[k] for k in range(N)] == pytest.approx(want.tolist(), rel=1e-6)
    with pytest.raises(ValueError, match="no benign rows"):  # who asks for benign rows gets no others
        forest.fit(rows.withColumn("is_attack", F.lit(True)), columns)


def twin(name, d):
    """Rows of a query's SQL."""
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
        return sorted(c.execute(queries.SQL[name]).fetchall())


def test_true_positive_rates_without_benign_rows(spark, attacked):
    got = sorted(tuple(r) for r in queries.QUERIES["q_tpr_at_fpr"](spark, attacked).collect())
    assert got == [(0.01, 0.0), (0.05, 0.0), (0.3, 0.0)] == twin("q_tpr_at_fpr", attacked)


@pytest.mark.parametrize("vertices_only", [True, False])
def test_true_positive_rates_of_one_class(spark, vertices_only):
    found = lambda label: metrics.tpr_at_fpr(metrics.score_histogram(spark.createDataFrame([(k % 5 / 5, label) for k in range(40)], "score double, is_attack boolean")), [0.0, 1.0], vertices_only).collect()
    assert [r["tpr"] for r in found(True)] == [0.0, 0.0]
    none, every = (r["tpr"] for r in found(False))
    assert none == 0.0 and np.isnan(every)


def test_techniques_without_benign_rows(spark, attacked):
    rows = [sorted(tuple(r) for r in queries.QUERIES["q_per_technique_auroc"](spark, attacked).collect()), twin("q_per_technique_auroc", attacked)]
    for got in rows:  # NaN where nothing is compared, null where a technique has too few rows
        assert [(t, n, a is not None and np.isnan(a), few) for t, n, a, few in got] == [("T0", 160, True, False), ("T1", 160, True, False), ("T2", 20, False, True)]
        assert got[2][2] is None
