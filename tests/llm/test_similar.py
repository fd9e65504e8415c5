"""The near-duplicate stage: pairs verified on five-word shingles, and rows without an id of their own."""

import random

import brute
import corpus_pipeline
import pytest

from spoor.llm import similar, simhash

SCHEMA = "doc_id long, text string, source string"


def grams(text):
    w = brute.words(brute.lower_ascii(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def alike(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) >= 0.8 * len(x | y)


def edited(r, words, n):
    out = list(words)
    for k in r.sample(range(len(out)), n):
        out[k] = f"new{r.randrange(10**9)}"
    return " ".join(out)


def kept(spark, rows):
    return sorted(((x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()), key=str)


@pytest.mark.parametrize("block", [2000, 4_000_000])
def test_only_pairs_at_the_share_are_linked_and_all_of_them(spark, block, monkeypatch):
    monkeypatch.setattr(similar.verified, "__defaults__", (block,))
    r, rows = random.Random(5), []
    for base in range(25):
        words = [f"w{r.randrange(5000)}" for _ in range(300)]
        for n in (0, 2, 5, 7, 11, 16, 30):
            rows.append((len(rows), edited(r, words, n), "src0"))
    u = brute.Union()
    for i, a, _ in rows:
        u.find(i)
        for j, b, _ in rows[max(0, i - 8) : i]:
            if alike(a, b):
                u.join(i, j)
    assert [i for i, _ in sorted(kept(spark, rows))] == sorted({u.find(i) for i, _, _ in rows})


def test_close_fingerprints_of_unlike_texts_lose_no_document(spark):
    r = random.Random(9)
    words = [f"w{k % 40}" for k in range(1200)]
    near = (" ".join(words), edited(r, words, 80))
    assert not alike(*near)
    assert min((a ^ b).bit_count() for a, b in zip(*[simhash.fingerprints_of(t, 2, 4) for t in near], strict=True)) <= 3
    assert len(kept(spark, [(k, t, "src0") for k, t in enumerate(near)])) == 2


def test_rows_without_ids_and_shared_ids(spark):
    r = random.Random(2)
    say = lambda: [f"w{r.randrange(5000)}" for _ in range(120)]
    a, b, c, d = say(), say(), say(), say()
    rows = [(None, " ".join(a), "s"), (None, " ".join(b), "s"), (None, " ".join(b), "s"), (1, edited(r, a, 1), "s"), (2, edited(r, b, 1), "s"), (7, " ".join(c), "s"), (7, " ".join(d), "s")]
    want = [(None, rows[0][1]), (None, rows[1][1]), (7, rows[5][1]), (7, rows[6][1])]
    assert kept(spark, rows) == sorted(want, key=str)
