"""Operators against golden vectors and plain versions of their own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.operators import boosted, forest, intervals, lineage, metrics, ngram, order, seqnet, windows
from spoor.plans import evaluate, features
from spoor.sources import schema


def test_row_index_and_lags_over_a_hot_key(spark):
    r = random.Random(0)
    rows = [(i, "hot" if r.random() < 0.6 else f"k{r.randrange(5)}" if r.random() < 0.95 else None, r.randrange(50)) for i in range(800)]
    d = spark.createDataFrame(rows, "i long, k string, v int")
    got = order.with_row_index(d, F.col("v").desc(), F.col("i")).orderBy("row_idx").collect()
    assert [x["i"] for x in got] == [i for i, _, _ in sorted(rows, key=lambda x: (-x[2], x[0]))] and [x["row_idx"] for x in got] == list(range(800))
    want, last = {}, {}
    for i, k, v in rows:
        seen = last.setdefault(k, [])
        want[i] = (seen[-1] if seen else None, seen[-2] if len(seen) > 1 else None) if k is not None else (None, None)
        seen.append(v)
    assert {x["i"]: (x["prev1"], x["prev2"]) for x in order.lagged(d, "k", ["i"], "v", 2).collect()} == want
    sums = order.running_sums(d, ["i"], {"s": "v"}).collect()
    run = dict(zip([x[0] for x in rows], np.cumsum([x[2] for x in rows]).tolist(), strict=True))
    assert {x["i"]: x["s"] for x in sums} == run


def walk(parents, node):
    """Depth, root and cycle flag, hop by hop."""
    seen, cur, depth = set(), node, 0
    while True:
        if cur in seen:
            return min(depth, 15), cur, True
        seen.add(cur)
        up = parents[cur]
        if up is None or up not in parents:
            return min(depth, 15), cur, False
        cur, depth = up, depth + 1
        if depth >= 64:
            return 15, cur, True


@pytest.mark.parametrize("seed", [0])
def test_ancestors_match_a_walk(spark, seed):
    r = random.Random(seed)
    parents = {"b": "a", "c": "b", "a": None, "x": "y", "y": "x", "z": "z", "q": "gone"}
    parents |= {f"s{i}": f"s{i - 1}" if i else None for i in range(21)} | {f"l{i}": f"l{i - 1}" if i else None for i in range(140)}
    parents |= {f"m{i}": f"m{(i + 1) % 40}" for i in range(40)} | {f"t{i}": f"t{i - 1}" if i else "m7" for i in range(50)}
    parents |= {f"g{i}": f"g{(i + 1) % 90}" for i in range(90)}
    parents |= {f"r{i}": r.choice([None, f"r{r.randrange(150)}", f"r{max(0, i - 1)}"]) for i in range(150)}
    d = spark.createDataFrame([(k, v, k.upper()) for k, v in parents.items()], "exec_id string, parent string, basename string")
    got = {x["exec_id"]: (x["depth"], x["root"], x["cycle"]) for x in lineage.ancestors(d).collect()}
    assert got == {k: walk(parents, k) for k in parents}
    assert got["c"] == (2, "a", False) and got["x"] == (2, "x", True) and got["z"] == (1, "z", True) and got["s20"] == (15, "s0", False)
    assert got["l63"][2] is False and got["l64"][2] is True


def test_first_row_of_a_process_wins_and_seeds_come_first(spark):
    cols = "i int, proc_exec_id string, proc_parent_exec_id string, parent_exec_id string, proc_binary string, parent_binary string"
    d = spark.createDataFrame([(2, "a", "p", None, "/x/late", None), (1, "a", None, "p", "/x/first", None), (3, "b", "", "a", None, "/y/z"), (4, None, None, None, "c", "c"), (5, "c", "", "", "c", "/q/w")], cols)
    m = {r["exec_id"]: (r["parent"], r["basename"]) for r in lineage.process_map(d, ["i"]).collect()}
    assert m == {"a": ("p", "first"), "b": ("a", ""), "c": ("", "c")}
    seeded = {r["exec_id"]: r["basename"] for r in lineage.process_map(d, ["i"], spark.createDataFrame([(9, "a", None, None, "/seed", None)], cols)).collect()}
    assert seeded["a"] == "seed"
    got = {r["i"]: r for r in lineage.with_lineage(d, lineage.process_map(d, ["i"])).collect()}
    assert got[1]["lineage_parent_fallback_used"] and not got[2]["lineage_parent_fallback_used"]
    assert [got[k]["lineage_missing_parent"] for k in (1, 2, 3, 4, 5)] == [True, True, False, True, True]
    assert got[3]["parent_binary_basename"] == "first" and got[5]["parent_binary_basename"] == "w" and got[4]["lineage_depth"] == 0
    assert lineage.duplicates(d, lineage.process_map(d, ["i"])).head()[0] == 1


def test_delta(spark):
    rows = [(0, "p", 100), (1, "p", 90), (2, "p", None), (3, "p", 95), (4, "q", 5), (5, None, 7)]
    got = windows.delta_previous(spark.createDataFrame(rows, "i int, proc_exec_id string, event_time bigint"), ["i"]).orderBy("i").collect()
    assert [r["delta_t_prev_ns"] for r in got] == [None, 0, None, 5, None, None]
    assert sum(r["negative_delta"] for r in got) == 1


def test_windows(spark):
    with pytest.raises(ValueError):
        windows.window_count(127)
    assert [windows.window_count(n) for n in (128, 159, 160, 300)] == [1, 1, 2, 6]
    s = np.random.default_rng(0).random(300)
    d = spark.createDataFrame([(i, float(x), bool(x > 0.99)) for i, x in enumerate(s)], "row_idx long, score double, is_attack boolean")
    spans = [s[w * 32 : w * 32 + 128] for w in range(6)]
    got = windows.window_max_any(d, 300).orderBy("window_idx").collect()
    assert [(r["score"], r["is_attack"]) for r in got] == [(x.max(), bool((x > 0.99).any())) for x in spans]
    assert np.allclose([r["score"] for r in windows.window_median(d, 300).orderBy("window_idx").collect()], [np.median(x) for x in spans])
    odd = windows.window_max(d, 300, size=100, stride=30).orderBy("window_idx").collect()
    assert [r["score"] for r in odd] == [s[w * 30 : w * 30 + 100].max() for w in range(7)]
    each = windows.to_windows(d.select("row_idx"), 300).withColumn("score", F.col("window_idx").cast("double"))
    best = {r["row_idx"]: r["score"] for r in windows.event_scores(each, d.select("row_idx")).collect()}
    assert best[0] == 0 and best[287] == 5 and best[299] == min(best[i] for i in range(288))
    masked = windows.masked(windows.to_windows(d.select("row_idx"), 300)).groupBy("window_idx").agg(F.sum(F.col("mask").cast("int")).alias("n")).collect()
    assert {r["n"] for r in masked} == {19}


def test_carve_keeps_count(spark):
    d = spark.createDataFrame([(i, i * 10**10) for i in range(1000)], "row_idx long, event_time bigint")
    c = windows.carve(d, size=50)
    assert c.split_row == 800 and c.n == 1000 and c.n_train == 755 and c.n_validation == 155 and c.n_gap == 90
    with pytest.raises(ValueError):
        windows.carve(d, size=500)


def test_labels(spark):
    given = spark.createDataFrame([(0, 100, "A"), (10, 20, "B"), (50, 60, "C")], "start_ns bigint, end_ns bigint, technique_id string")
    times = spark.createDataFrame([(t,) for t in (5, 10, 19, 20, 49, 50, 60, -1, None)], "event_time bigint")
    got = {r["event_time"]: r["technique_id"] for r in intervals.label_events(times, given).collect()}
    assert got == {5: "A", 10: "B", 19: "B", 20: None, 49: None, 50: "C", 60: None, -1: None, None: None}
    idx = {r["event_time"]: r["trial_idx"] for r in intervals.trial_membership(times, given).collect()}
    assert idx[5] == 0 and idx[10] == 1 and idx[20] == -1
    kept = [r[0] for r in intervals.drop_sentinels(times, spark.createDataFrame([(10, 20)], "start_ns bigint, end_ns bigint")).collect()]
    assert set(kept) == {5, 49, 50, 60, -1, None}
    assert intervals.label_events(times, given.limit(0)).where("is_attack").count() == 0


def test_labels_match_a_search(spark):
    r = random.Random(2)
    given = sorted((a := r.randrange(1000), a + r.randrange(1, 60), f"T{r.randrange(4)}") for _ in range(60))
    starts = [g[0] for g in given]
    times = list(range(-5, 1070, 3))
    want = {}
    for t in times:
        k = np.searchsorted(starts, t, side="right") - 1
        want[t] = given[k][2] if k >= 0 and t < given[k][1] else None
    d = intervals.label_events(spark.createDataFrame([(t,) for t in times], "event_time bigint"), spark.createDataFrame(given, "start_ns bigint, end_ns bigint, technique_id string"))
    assert {x["event_time"]: x["technique_id"] for x in d.collect()} == want


def test_label_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("technique_id,trial,start_ts,end_ts\nT2,1,2026-04-19T08:00:00Z,2026-04-19T09:00:00Z\nT1,1,2026-04-19T07:00:00Z,2026-04-19T07:30:00.5Z\n")
    got = intervals.read_intervals(spark, str(tmp_path / "l.csv"), trials=True).collect()
    assert [r["trial_id"] for r in got] == ["T1#1", "T2#1"] and got[0]["end_ns"] - got[0]["start_ns"] == 1800500000000
    (tmp_path / "bad.csv").write_text("technique_id,trial,start_ts,end_ts\nT2,1,nonsense,2026-04-19T09:00:00Z\n")
    with pytest.raises(Exception, match="not a time"):
        intervals.read_intervals(spark, str(tmp_path / "bad.csv")).collect()


def test_metrics(spark):
    d = spark.createDataFrame([(0.9, True), (0.9, False), (0.5, True), (0.5, False), (0.1, False)], "score double, is_attack boolean")
    h = metrics.score_histogram(d)
    assert abs(metrics.auroc(h).head()["auroc"] - 2 / 3) < 1e-12 and abs(metrics.average_precision(h).head()[0] - 0.5) < 1e-12
    assert metrics.auroc(metrics.score_histogram(d.where("is_attack"))).head()["auroc"] is None


def test_metrics_match_plain_versions(spark):
    r = np.random.default_rng(1)
    y = r.random(600) < 0.3
    s = np.round(r.random(600) + 0.3 * y, 2)
    t = np.where(y, np.where(r.random(600) < 0.8, "A", "B"), None)
    d = spark.createDataFrame([(i, float(a), bool(b), c) for i, (a, b, c) in enumerate(zip(s, y, t, strict=True))], "row_idx long, score double, is_attack boolean, technique_id string").cache()

    def auc(y, s):
        p, n = s[y], s[~y]
        return ((p[:, None] > n).sum() + (p[:, None] == n).sum() / 2) / (len(p) * len(n))

    h = order.cut(metrics.score_histogram(d))
    assert abs(metrics.auroc(h).head()["auroc"] - auc(y, s)) < 1e-12
    ap, last = 0.0, 0.0
    for c in np.unique(s)[::-1]:
        hit = s >= c
        recall = (hit & y).sum() / y.sum()
        ap, last = ap + (recall - last) * (hit & y).sum() / hit.sum(), recall
    assert abs(metrics.average_precision(h).head()[0] - ap) < 1e-12
    got = {x["technique_id"]: x for x in metrics.per_technique_auroc(d, min_events=50).collect()}
    for k in "AB":
        m = (t == k) | ~y
        assert got[k]["skipped"] == ((t == k).sum() < 50)
        if not got[k]["skipped"]:
            assert abs(got[k]["auroc"] - auc(y[m], s[m])) < 1e-12
    full = {x["fpr_target"]: x["tpr"] for x in metrics.tpr_at_fpr(h, [0.05, 0.5], vertices_only=False).collect()}
    for target, tpr in full.items():
        assert abs(tpr - max([0.0, *[((s >= c) & y).sum() / y.sum() for c in np.unique(s) if ((s >= c) & ~y).sum() / (~y).sum() <= target]])) < 1e-12
    low, high = metrics.bootstrap_auroc(h, 200)
    assert low < auc(y, s) < high and high - low < 0.2
    e = evaluate.evaluate(d, "test", 600, bootstrap=20)
    assert e.n_attack == y.sum() and abs(e.auroc - auc(y, s)) < 1e-12
    with pytest.raises(ValueError):
        evaluate.evaluate(d.where("not is_attack"), "none", 400)


def test_ngram(spark):
    rows = [(i, p, i, w, False) for i, (p, w) in enumerate([("p1", "A"), ("p1", "B"), ("p1", "C"), ("p2", "A"), ("p2", "B"), ("p2", "C")])]
    cols = "row_idx long, proc_exec_id string, event_time long, token string, is_attack boolean"
    m = ngram.fit(spark.createDataFrame([*rows, (9, "p1", 1, "Z", True)], cols))
    assert (m.n, m.v) == (6, 3)
    test = [("a", "A"), ("a", "B"), ("a", "C"), ("b", "A"), ("b", "X"), ("c", "Q"), ("c", "A"), ("d", "Q"), ("e", None)]
    got = ngram.score(spark.createDataFrame([(i, p, i, w, False) for i, (p, w) in enumerate(test)], cols), m).orderBy("row_idx").collect()
    want = [1.098612, 1.427116, 0.510826, 1.098612, 2.525729, 2.197225, 2.931194, 2.197225, 2.197225]
    assert np.allclose([r["nll"] for r in got], want, atol=1e-6)
    assert [r["level"] for r in got][:3] == ["unigram", "bigram", "trigram"]


def test_ngram_is_saved_and_loaded(spark, tmp_path):
    cols = "row_idx long, proc_exec_id string, event_time long, token string, is_attack boolean"
    d = spark.createDataFrame([(i, f"p{i % 3}", i, "ABC"[i % 2], False) for i in range(30)], cols)
    m = ngram.fit(d)
    m.save(str(tmp_path / "m"))
    again = ngram.NgramModel.load(spark, str(tmp_path / "m"))
    a, c = ([r["nll"] for r in ngram.score(d, x).orderBy("row_idx").collect()] for x in (m, again))
    assert a == c


def test_forest(spark, tmp_path):
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(size=(400, 3)), [[9, 9, 9]]])
    d = spark.createDataFrame([(i, *map(float, v), False) for i, v in enumerate(x)], "row_idx long, a double, b double, c double, is_attack boolean")
    f = forest.fit(d, ["a", "b", "c"], trees=60)
    got = {q["row_idx"]: q["score"] for q in forest.score(d, f).collect()}
    assert max(got, key=got.get) == 400 and got[400] > 0.6 > np.median(list(got.values()))
    f.save(str(tmp_path / "f.json"))
    assert np.allclose(forest.Forest.load(str(tmp_path / "f.json")).score(x), f.score(x))
    assert abs(forest.path_correction(256) - 10.2448) < 1e-3
    assert forest.sample_rows(d, 10).count() == 10 and forest.evenly_spaced(d, 401, 11).count() == 11


def test_boosted_degenerate_and_fit(spark):
    d = spark.createDataFrame([(i, float(i % 7), i % 7 > 4) for i in range(300)], "row_idx long, a double, is_attack boolean")
    m = boosted.fit(d, ["a"], maxIter=5, maxDepth=2)
    got = m.score(d).groupBy("is_attack").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    by = {r["is_attack"]: r for r in got}
    assert by[True]["lo"] > by[False]["hi"]
    assert {r["score"] for r in boosted.fit(d.where("not is_attack"), ["a"]).score(d).collect()} == {0.5}


def test_boosted_is_saved_and_read(spark, tmp_path):
    d = spark.createDataFrame([(i, float(i % 7), i % 7 > 4) for i in range(300)], "row_idx long, a double, is_attack boolean")
    for k, rows in enumerate((d, d.where("not is_attack"))):
        m = boosted.fit(rows, ["a"], maxIter=3, maxDepth=2)
        m.save(spark, str(tmp_path / str(k)))
        again = boosted.BoostedModel.load(spark, str(tmp_path / str(k)))
        assert again.columns == ["a"] and (again.model is None) == (k == 1)
        assert [r["score"] for r in again.score(d).orderBy("row_idx").collect()] == [r["score"] for r in m.score(d).orderBy("row_idx").collect()]


def test_every_trial_is_held_out(spark):
    # trial 3's attacks are like no other trial's, so the fold that has not seen them scores them low
    rows = [(i, float(i % 5), -1) for i in range(60)] + [(60 + i, 9.0, t) for t in (1, 2) for i in range(t, t + 20, 2)] + [(100 + i, -9.0, 3) for i in range(10)]
    d = spark.createDataFrame([(k, a, t >= 0, t) for k, (_, a, t) in enumerate(rows)], "row_idx long, a double, is_attack boolean, trial_idx int")
    folds = boosted.held_out_trials(d.where("not is_attack"), d, ["a"], maxIter=10, maxDepth=2, subsamplingRate=1.0, featureSubsetStrategy="all")
    assert {r["fold"]: r["n"] for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()} == dict.fromkeys((1, 2, 3), len(rows))
    got = metrics.stitch_folds(folds).collect()
    assert len(got) == len(rows)
    score = {t: [r["score"] for r in got if r["trial_idx"] == t] for t in (-1, 1, 2, 3)}
    assert min(score[1] + score[2]) > 0.5 > max(score[3])
    per_fold = {(r["row_idx"], r["fold"]): r["score"] for r in folds.collect()}
    for r in got:
        want = per_fold[r["row_idx"], r["trial_idx"]] if r["is_attack"] else sum(per_fold[r["row_idx"], k] for k in (1, 2, 3)) / 3
        assert abs(r["score"] - want) < 1e-9


def test_place_in_group(spark):
    r = np.random.default_rng(3)
    rows = [(k, None if x == 9 else f"p{x if x < 4 else 0}", int(r.integers(50))) for k, x in enumerate(r.integers(10, size=3000).tolist())]
    d = spark.createDataFrame(rows, "row_idx long, key string, t long").repartition(7)
    got = {x["row_idx"]: x["place"] for x in order.place_in_group(d, "key", ["t", "row_idx"]).collect()}
    seen = {}
    for i, key, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        assert got[i] == seen.get(key, 0)
        seen[key] = seen.get(key, 0) + 1
    assert order.place_in_group(d.limit(0), "key", ["t"]).count() == 0


def test_mean_loss(spark):
    d = spark.createDataFrame([(1.0, True), (3.0, True), (8.0, False)], "loss double, mask boolean")
    assert [tuple(x) for m in (None, "mask") for x in metrics.mean_loss(d, mask=m).collect()] == [(3, 4.0), (2, 2.0)]
    assert tuple(metrics.mean_loss(d.limit(0)).head()) == (0, 0.0)
    with pytest.raises(ValueError):
        seqnet.scorer("other", None)


def test_scan_matches_the_recurrence():
    r = np.random.default_rng(0)
    u, dt, a, b, c = r.normal(size=(2, 5, 3)), r.random((2, 5, 3)), -r.random((3, 4)), r.normal(size=(2, 5, 4)), r.normal(size=(2, 5, 4))
    y = seqnet.selective_scan(u, dt, a, b, c)
    for n in range(2):
        for k in range(3):
            h = np.zeros(4)
            for t in range(5):
                h = np.exp(dt[n, t, k] * a[k]) * h + dt[n, t, k] * b[n, t] * u[n, t, k]
                assert np.isclose(y[n, t, k], h @ c[n, t])


@pytest.mark.parametrize("objective", seqnet.OBJECTIVES)
def test_network_scores(objective):
    r = np.random.default_rng(1)
    w = seqnet.random_weights(objective, d_model=8, d_state=4, layers=2)
    x = {c: r.integers(0, n, (2, 12)) for c, n, _ in schema.EMBEDDED} | {c: r.integers(0, 2, (2, 12)) for c, _ in schema.NUMERIC}
    assert schema.input_width() == 277 and schema.input_width("flat") == 149 and len(schema.model_columns()) == 42 and len(schema.model_columns("flat")) == 35
    if objective == "nll":
        y = seqnet.next_event_nll(x, w)
        assert (y[:, 0] == 0).all() and (y[:, 1:] > 0).all()
        late = {c: v.copy() for c, v in x.items()}
        late["f_proc_name_hash"][:, -1] = 0  # causal: later inputs change nothing before
        assert np.allclose(seqnet.next_event_nll(late, w)[:, :11], y[:, :11])
    else:
        y = seqnet.all_positions(x, w, objective, chunk=4)
        mask = np.zeros((2, 12), dtype=bool)
        mask[:, 1::3] = True
        assert (y > 0).all() and np.allclose(seqnet.masked_loss(x, mask, w, objective)[mask], y[mask])
        assert seqnet.repeated_random(x, w, objective).shape == (2, 12)
    assert seqnet.learning_rate(0, 100, 1.0) == 0.1 and seqnet.learning_rate(99, 100, 1.0) < 0.01


def test_feature_and_behaviour_tables(spark):
    from spoor.sources.schema import raw_schema

    rows = spark.createDataFrame([], raw_schema())
    one = rows.unionByName(spark.createDataFrame([("process_exec", 10, "a", 5, "/usr/bin/curl", "/bin/bash")], "event_type string, event_time bigint, proc_exec_id string, proc_pid bigint, proc_binary string, parent_binary string"), allowMissingColumns=True)
    assert len(raw_schema()) == 126 and len(schema.FEATURES) == 33 and len(schema.BEHAVIOUR) == 27
    assert features.build_features(one).columns == [*schema.IDS, *schema.FEATURES]
    got = features.build_behaviour(one.withColumn("_source_line", F.lit(1)), ["_source_line"])
    assert len(got.columns) == 63
    r = got.head()
    assert r["token"] == "PROC_EXEC:bash->curl" and r["f_kp_fd_install_fd_int32"] == -1 and r["f_dst_port_category"] == 6 and r["lineage_missing_parent"]
