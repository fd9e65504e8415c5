"""The pipeline's stages against brute-force versions, and as a whole."""

from collections import Counter

import brute
import pytest
from test_text_operators import SCHEMA, make

import corpus_pipeline
from spoor.llm import mixing, packing, simhash


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(7, 80), SCHEMA).cache()


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_names_and_columns(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "source mixing", "best-fit packing"]
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, "").dtypes == docs.dtypes
        assert f(spark, docs.limit(0), "").count() == 0


def test_quality_stage_keeps_only_what_passes_the_base(spark, docs):
    kept = stage("quality rules")(spark, docs, "").collect()
    given = Counter(map(tuple, docs.collect()))
    assert kept and not Counter(map(tuple, kept)) - given
    assert not any(brute.quality_base(r["text"])["base_failed"] for r in kept)


def test_line_stage(spark, docs):
    want = brute.dedup_lines(list({r["doc_id"]: (r["doc_id"], r["text"]) for r in docs.collect()}.values()), 3, 8)
    got = stage("line dedup")(spark, docs, "").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["text"] == want[r["doc_id"]][0] and r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["id"] == "i"


def test_near_duplicate_stage_keeps_the_first_of_each_group(spark, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: simhash.fingerprints_of(t, 2, 4) for i, t in rows.items()}
    u = brute.Union()
    for i in rows:
        u.find(i)
        for j in rows:
            if j < i and any((a ^ b).bit_count() <= 3 for a, b in zip(fps[i], fps[j], strict=True)):
                u.join(i, j)
    got = [r["doc_id"] for r in stage("simhash near-dedup")(spark, docs, "").collect()]
    assert sorted(got) == sorted({u.find(i) for i in rows})


def test_mixing_stage_orders_by_slot(spark, docs):
    got = [r["doc_id"] for r in stage("source mixing")(spark, docs, "").collect()]
    placed = mixing.schedule(docs, text="text").select("doc_id", "mix.*").collect()
    at = {r["doc_id"]: (r["slot"], r["source"], r["place"]) for r in placed}
    assert Counter(got) == Counter(r["doc_id"] for r in docs.collect())
    keys = [at[i][:1] for i in got]
    assert keys == sorted(keys)


def test_whole_pipeline(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(got[0].asDict())
    space = Counter()
    for r in got:
        space[r["sequence_id"]] += r["length"]
    assert max(space.values()) <= packing.CAPACITY
