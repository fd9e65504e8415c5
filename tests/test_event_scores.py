"""The network queries score every event, by its highest score over overlapping windows."""

import pytest

from spoor.operators import windows
from spoor.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q_nll_score", "q_mem_fa_score"])
def test_every_event_has_its_highest_score(spark, name):
    scored, events = queries._network(spark, SF, {"q_nll_score": "nll", "q_mem_fa_score": "mem-fa"}[name])
    rows, best = scored.collect(), {}
    assert len({r["window_idx"] for r in rows}) == windows.window_count(events.count())
    for r in rows:
        at = r["window_idx"] * 32 + r["pos"]
        best[at] = max(best.get(at, r["score"]), r["score"])
    least = min(best.values())
    got = {r["row_idx"]: r["score"] for r in queries.QUERIES[name](spark, SF).collect()}
    assert got == {r["row_idx"]: pytest.approx(best.get(r["row_idx"], least), rel=1e-5) for r in events.collect()}
