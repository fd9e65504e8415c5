"""Packing follows the mixing schedule through the written files."""

from collections import Counter, defaultdict

import corpus_pipeline

from spoor.llm import mixing, packing

SCHEMA = "doc_id long, text string, source string"


def test_sequences_follow_the_mixed_order(spark, tmp_path):
    rows = [(k, f"text {k} " * (3 + k % 5), "src0" if k % 3 else f"src{1 + k % 19}") for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = corpus_pipeline.mix(spark, docs, "")
    mixed.repartitionByRange(3, "doc_id").write.parquet(str(tmp_path / "unmixed"))
    mixed.write.parquet(str(tmp_path / "mixed"))
    before, corpus_pipeline.RUN = corpus_pipeline.RUN, 48
    try:
        got = {x: corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / x)), "").collect() for x in ("mixed", "unmixed")}
    finally:
        corpus_pipeline.RUN = before
    placed = mixing.schedule(docs, text="text").select("doc_id", "mix.slot", "mix.source", "mix.place").collect()
    order = [r["doc_id"] for r in sorted(placed, key=lambda r: (r["slot"], r["source"], r["place"]))]
    for x, rows_of in got.items():
        assert Counter(r["doc_id"] for r in rows_of) == Counter(range(400))
        space, runs = Counter(), defaultdict(set)
        for r in rows_of:
            space[r["sequence_id"]] += r["length"]
            runs[r["sequence_id"] >> 32].add(r["doc_id"])
        assert max(space.values()) <= packing.CAPACITY
        follows = all(runs[k] == set(order[48 * k : 48 * k + 48]) for k in range(9))
        assert follows == (x == "mixed")
