"""Samples by hash threshold, and tables that are broadcast only if they are small."""

import hashlib

from pyspark.sql import functions as F

from spoor.operators import forest, order


def place(i, seed):
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16)


def test_sample_is_the_rows_of_least_hash(spark):
    for n, k in ((5000, 40), (60, 40), (30, 40)):
        got = [r["row_idx"] for r in forest.sample_rows(spark.range(n).withColumnRenamed("id", "row_idx"), k, seed=7).collect()]
        assert got == sorted(range(n), key=lambda i: place(i, 7))[:k]
    rows = spark.range(5000).withColumnRenamed("id", "row_idx")
    assert [r["row_idx"] for r in forest.sample_rows(rows, 40, seed=7, in_order=True).collect()] == sorted(sorted(range(5000), key=lambda i: place(i, 7))[:40])
    assert forest.sample_rows(rows.limit(0), 5).count() == 0


def test_only_small_tables_are_broadcast(spark):
    left = spark.range(10)
    plan = lambda n: left.join(order.small(spark.range(n).withColumnRenamed("id", "k"), rows=50), F.col("id") == F.col("k"))._jdf.queryExecution().toString()
    assert "broadcast" in plan(50).split("== Optimized")[0] and "broadcast" not in plan(51).split("== Optimized")[0]
