"""Every operator against a brute-force version, on rows with nulls, empties, ties, repeats and clashing columns."""

import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.llm import classifier, embeddings, htmltext, licenses, line_dedup, mixing, packing, quality_rules, queries, simhash, suffix_tree
from spoor.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, fp string, stats string, mix string, digest string"


def make(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["th", "er", "on", "an", "re", "É", "ü"]) for _ in range(r.randint(1, 3))) for _ in range(120)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = [say(12), say(9), say(30)]
    rows = []
    for i in range(n):
        lines = [say(r.randint(1, 25)) for _ in range(r.randint(1, 8))]
        if i % 3 == 0:
            at = r.randrange(len(lines) + 1)
            lines[at:at] = passage
        if i % 7 == 0:
            lines = [x.upper() + " ###" for x in lines]
        rows.append((i, "\n".join(lines), r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", "other", None])))
    rows += [(100, rows[3][1], "en", "src0"), (101, rows[3][1].replace(" ", "\t"), "en", "src0"), (102, "", "en", "src0"), (103, None, None, None), (104, " \n\t", "en", "src1")]
    rows += [(105, "A", "en", "src1"), (106, "one two", "en", "src1"), (107, "word " * 3000, "en", "src0"), rows[5], rows[5]]
    return [(*x, len(x[1] or ""), "i", "h", "f", "s", "m", "d") for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_simhash_matches_brute_force(docs):
    want = brute.simhash_components(list(dict(pairs(docs)).items()))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["fps"][0] % (1 << 64), r["component_id"]) == want[r["doc_id"]]


def test_simhash_nothing_and_null_ids(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (5, "")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, 4), (4, 4), (5, 5)}


@pytest.mark.parametrize(("distance", "bucket"), [(2, 4), (2, 64), (3, 4), (1, 4)])
def test_simhash_links_in_large_buckets(spark, distance, bucket):
    r = random.Random(3)
    base, fps = r.getrandbits(64), set()
    for _ in range(150):
        x = base
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.choice([1, 2, 3, 5, 8, 13, 21, 33, 34, 40, 50, 63])
        fps.add(x)
    fps = sorted(fps | {r.getrandbits(64) for _ in range(40)})
    rows = [(0, f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    edges = simhash.links(spark.createDataFrame(rows, "table int, fp long, node long"), distance, bucket, block=16)
    got = {x["node"]: x["component"] for x in components(edges).collect()}
    u = brute.Union()
    for i, a in enumerate(fps):
        u.find(i)
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= distance:
                u.join(i, j)
    assert [got.get(i, i) for i in range(len(fps))] == [u.find(i) for i in range(len(fps))]


def test_simhash_finds_near_copies_with_several_tables(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    rows = []
    for i in range(40):
        w = [r.choice(words) for _ in range(300)]
        rows.append((2 * i, " ".join(w)))
        w[r.randrange(300)] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2, distance=3, tables=4)
    found = {x["doc_id"]: x["component_id"] for x in got.collect()}
    assert sum(found[2 * i] == found[2 * i + 1] == 2 * i for i in range(40)) >= 36
    assert len({found[2 * i] for i in range(40)}) == 40


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000)}


def test_quality_counts_match_brute_force(docs):
    stats = quality_rules.statistics(docs)
    rows = quality_rules.judge(stats, quality_rules.sketches(stats)).select("doc_id", "text", "stats.*", "kept").collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = brute.quality_base(r["text"])
        assert {k: r[k] for k in want} == want
        assert not (r["kept"] and r["base_failed"])


def test_quality_rejects_outliers_of_a_group(spark, empty):
    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    rows = [(i, text(), "en", "s") for i in range(100)] + [(200, text().replace(" ", "### "), "en", "s"), (201, text().upper(), "en", "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = quality_rules.statistics(d)
    kept = {x["doc_id"] for x in quality_rules.judge(stats, quality_rules.sketches(stats)).where("kept").collect()}
    assert kept == set(range(100))
    none = quality_rules.statistics(empty)
    assert quality_rules.judge(none, quality_rules.sketches(none)).count() == 0


def test_licences(spark, empty):
    mit = licenses.KNOWN[0][1]
    rows = [
        (1, mit.upper()), (2, "Copyright (c) 2020 A. Person\n\n" + mit.replace("NONINFRINGEMENT", "non-infringement")), (3, mit + " More."), (4, None), (5, ""),
        (6, "text\n  licensed under the Apache Licence, version 2 \nmore\nReleased under the MIT License."), (7, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0."),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))
    got = {r["doc_id"]: (r["license"], [(n["line"], n["license"]) for n in r["notices"]]) for r in licenses.scan(d).collect()}
    assert got == {
        1: ("MIT", []), 2: ("MIT", []), 3: (None, []), 4: (None, []), 5: (None, []), 6: (None, [(1, "Apache-2.0"), (3, "MIT")]), 7: ("CC-BY-NC-4.0", [(0, "CC-BY-NC-4.0")]),
    }
    assert licenses.scan(empty).count() == 0


def test_whole_licence_texts_in_other_guises(spark):
    """Every known text, re-wrapped, in capitals, with other punctuation and copyright lines, is found as a whole; changed by a word it is not."""
    rows, want, changed = [], {}, []
    for k, (name, text) in enumerate(licenses.KNOWN):
        w = text.replace("-", " - ").split()
        guise = "Copyright 1999 Some One\n(c) 2001 Another One. All rights reserved.\n\n" + "\n * ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)).upper()
        rows += [(2 * k, guise.replace(",", " ;"), "x"), (2 * k + 1, text + " indeed", "x")]
        want[2 * k] = name
    table = spark.createDataFrame([("Own-1.0", "Take this, and\ndo as you like."), ("Own-1.0", ""), ("Late", licenses.KNOWN[0][1])], "license string, text string")
    rows += [(1000, "TAKE THIS AND DO - as you like", "x"), (1001, None, "x"), (1002, "w " * 200_000, "x")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, digest string"), more=table).collect()}
    assert {k: got[k] for k in want} == want and got[1000] == "Own-1.0"
    assert all(got[2 * k + 1] is None for k in range(len(licenses.KNOWN))) and got[1001] is got[1002] is None


def test_classifier_learns_and_never_sees_held_out_labels(spark, empty):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 120))]
        rows.append((i, " ".join(w if good else [x + "###" for x in w])))
        labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (None, "abc")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit("clash"))
    y = spark.createDataFrame([*labels, (5, None), (999, 1)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in classifier.score(d, y).collect()}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i, _ in labels)
    truth = dict(labels)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    flipped = y.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {x["doc_id"]: x["score"] for x in classifier.score(d, flipped).collect()}
    assert all(math.isclose(again[i], got[i]["score"], abs_tol=1e-9) for i in again)
    assert all(x["score"] == 0.5 for x in classifier.score(d, y.limit(0)).collect())
    assert classifier.score(empty, y).count() == 0


def test_tokens_equal_those_of_the_tokenizers_file():
    from tokenizers import Tokenizer

    file, ranks = packing.tokenizer_files()
    t, e = Tokenizer.from_file(file), packing.encoder(ranks)
    r = random.Random(0)
    texts = ["", " ", "a  b\n\n c\t", "<|endoftext|> x <|endoftext|>", "naïve café £5 — “q”", "  x　", "a\r\nb", "don't we'll I'M", "日本語 テキスト", "🙂🙂 é", "x" * 300, "\x00\x01", "1234567 89"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 600), 10, 32, 0x1F600])) for _ in range(60)) for _ in range(300)]
    for x in texts:
        assert e.encode(x, allowed_special="all", disallowed_special=()) == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_packing_is_an_exact_round_trip(spark, docs, empty):
    e = packing.encoder(packing.tokenizer_files()[1])
    packed = packing.pack_documents(docs, capacity=64, keep_ids=True).cache()
    rows = packed.collect()
    want = Counter()
    for i, t in pairs(docs):
        ids = [*e.encode(t or "", allowed_special="all"), 2]
        for k, (s, n) in enumerate(packing.cuts(len(ids), 64)):
            want[(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for seq in packing.sequences(packed).collect():
        parts = sorted((r["offset"], r["ids"]) for r in rows if r["sequence_id"] == seq["sequence_id"])
        at = 0
        for offset, ids in parts:
            assert offset == at
            at += len(ids)
        assert at <= 64 and seq["ids"] == [x for _, ids in parts for x in ids]
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_length_once_and_few_sequences(seed):
    r = random.Random(seed)
    draw = [lambda: r.randint(1, 1024), lambda: r.choice([512, 341, 700, 3]), lambda: int(r.paretovariate(1.2) * 20) % 1024 + 1, lambda: r.randint(400, 1024)][seed]
    counts = Counter(draw() for _ in range(20_000))
    plan, got = packing.plan(dict(counts)), Counter()
    for lengths, times in plan:
        assert times > 0 and sum(lengths) <= 1024
        for x in lengths:
            got[x] += times
    assert got == counts
    bound = max(-(-sum(k * v for k, v in counts.items()) // 1024), sum(v for k, v in counts.items() if k > 512))
    assert sum(t for _, t in plan) <= bound * [1.02, 1.21, 1.02, 1.35][seed] + 2  # 700 and 341 leave no room for each other


def test_embeddings_match_brute_force(spark, monkeypatch):
    r = np.random.default_rng(0)
    rows = []
    for c in range(6):
        centre = r.normal(size=16)
        rows += [(centre + r.normal(size=16) * s).tolist() for s in (0.01, 0.05, 0.1, 0.2, 0.3) for _ in range(8)]
    rows += r.normal(size=(60, 16)).tolist() + [rows[0], rows[0], [0.0] * 16, None, [], [float("nan")] * 16, [1.0, None], [1e200] * 16, [2e200] * 16, [1.0, 2.0], [2.0, 4.0]]
    table = [(i, x, 1) for i, x in enumerate(rows)]
    want = brute.embedding_links([(i, x) for i, x, _ in table if x is None or not x or abs(x[0] or 0) < 1e100])
    for limit, tree in ((None, 64 << 20), (40, 64 << 20), (9, 64 << 20), (30, 1000)):
        monkeypatch.setattr(embeddings, "MAX_TREE", tree)
        got = embeddings.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>, w int"), limit=limit)
        got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got.collect()}
        assert len(got) == len(rows)
        assert {i: got[i] for i in want} == want
        big = [i for i, x, _ in table if x and abs(x[0] or 0) > 1e100]
        assert got[big[0]] == got[big[1]] == (1, big[0])
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_dedup_matches_brute_force(docs, empty, min_lines):
    rows = docs.select("doc_id", "text").distinct()
    want = brute.dedup_lines([(r["doc_id"], r["text"]) for r in rows.collect()], min_lines, 8)
    got = {r["doc_id"]: (r["text"], list(r["removed_lines"])) for r in line_dedup.dedup_lines(docs, min_lines).collect()}
    assert got == want
    assert line_dedup.dedup_lines(empty).count() == 0


def test_mixing_keeps_every_source_within_a_block_of_its_share(docs, empty):
    weights = {"a": 7, "b": 3, "c": 1, "d": 5}
    slots, total = mixing.period(weights), 16
    assert sorted(t for x in slots.values() for t in x) == list(range(total))
    for s, at in slots.items():
        for t in range(total + 1):
            assert abs(sum(x < t for x in at) - t * weights[s] / total) < 1
    rows = mixing.schedule(docs, {"src0": 2, "src1": 1}, block=4, text="text").select("doc_id", "source", "mix.slot", "mix.block", "mix.place", F.col("mix.source").alias("cls")).collect()
    assert len(rows) == docs.count()
    per = Counter(r["cls"] for r in rows)
    assert {(r["cls"], r["block"], r["place"]) for r in rows} == {(c, k // 4, k % 4) for c, n in per.items() for k in range(n)}
    assert len({r["slot"] for r in rows}) == len({(r["cls"], r["block"]) for r in rows})
    assert mixing.schedule(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.period({"a": 0})


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script><style>p{}</style></head><body><header>Site name</header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, do you agree?</div>
<article><h1>Head &amp;  line</h1><p>First <b>bold</b> para&shy;graph &#233; &lt;tag&gt;<br>goes on.</p><p>Short.<div class="ad">Buy now and save a lot of money today</div>
<p>Second 1 < 2 paragraph<!-- hidden <p>x</p> --> ends.<ul><li>Item one</li><li>Item two</ul></article><section id="comments"><p>A reader writes a long comment about the article here.</p></section>
<form><p>Mail: <input></p></form><aside><p>Related words</p></aside><footer>&copy; 2020 Site</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "no markup at all, but a sentence that is long enough to count as the text"), (5, "u", PAGE.replace("article>", "ARTICLE>")), (6, "u", "<article><p>cut &am")]
    d = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    want = "Head & line\nFirst bold para­graph é <tag> goes on.\nShort.\nSecond 1 < 2 paragraph ends.\nItem one\nItem two"
    got = htmltext.extract(d).collect()
    assert len(got) == 7
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == want and text[5] == want and text[2] == text[3] == "" and text[4].startswith("no markup") and text[6] == "cut &am"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert htmltext.extract(d.limit(0)).count() == 0


def page(r, style):
    """A random page and its main text, known as it is made."""
    word = lambda: "".join(r.choice(["an", "ber", "is", "ko", "lé", "ß", "tum"]) for _ in range(r.randint(1, 3)))
    say = lambda n: " ".join(word() for _ in range(n))
    spaced = lambda t: t.replace(" ", r.choice([" ", "\n", "  ", "&#32;"]))
    links = lambda n: "".join(f"<li><a href='/{k}'>{say(r.randint(1, 2))}</a></li>" for k in range(n))
    texts = [say(r.randint(2, 9))] + [say(r.choice([1, 4, 12, 40, 90])) for _ in range(r.randint(1, 9))]
    body = f"<h1>{spaced(texts[0])}</h1>"
    for t in texts[1:]:
        w = t.split(" ")
        if len(w) > 12:  # a few words in a link, others emphasised
            w[2], w[5] = f"<a href=x>{w[2]}</a>", f"<b class='hot'>{w[5]}</b>"
        body += f"<p>{spaced(' '.join(w))}" + r.choice(["</p>", "", "<script>if (a < b) { c('</p>') }</script></p>", "<!-- <p>note</p> --></p>"])
    article = {"article": f"<article>{body}</article>", "main": f"<main><div class=content>{body}</div></main>", "plain": f"<div id=content>{body}</div>"}[style]
    extras = [
        f"<aside><p>{say(30)}</p><ul>{links(4)}</ul></aside>", f"<section id=comments><p>{say(60)}</p><p>{say(3)}</p></section>", f"<div class='cookie-notice'>{say(20)}</div>",
        f"<form><label>{say(3)}</label><textarea>{say(30)}</textarea><input></form>", f"<ul>{links(5)}</ul>", f"<div class=sidebar><h3>{say(2)}</h3><ul>{links(3)}</ul></div>", f"<div class=ad>{say(12)}</div>",
    ]
    before, after = r.sample(extras, 2), r.sample(extras, 3)
    head = f"<html><head><title>{say(5)}</title><style>p {{ x: '</p>' }}</style></head><body><header><p>{say(4)}</p></header><nav><ul>{links(6)}</ul></nav>"
    return head + "".join(before) + article + "".join(after) + f"<footer>&copy; {say(10)}</footer></body></html>", "\n".join(texts)


def test_html_of_generated_pages(spark):
    r = random.Random(6)
    made = [page(r, style) for style in ("article", "main", "plain") for _ in range(60)]
    long = "<article>" + "".join(f"<p>{'word ' * 500}</p>" for _ in range(400)) + "</article>"
    rows = [(k, x) for k, (x, _) in enumerate(made)] + [(1000, long), (1000, long), (1001, made[0][0])]
    got = {x["page_id"]: x["text"] for x in htmltext.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert [got[k] for k in range(len(made))] == [t for _, t in made]
    assert got[1001] == got[0] and got[1000] == "\n".join([("word " * 500).strip()] * 400)


def test_html_tree_uses_words_and_links_of_neighbours():
    tree, used = htmltext.grow(htmltext.labelled()), set()

    def walk(t):
        if not isinstance(t, int):
            used.add(htmltext.NAMES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(tree)
    assert htmltext.NAMES[tree[0]] == "links" and {"words", "links_before", "links_after"} <= used
    rows = htmltext.labelled()
    assert sum(htmltext.decide(tree, r[:-1]) == r[-1] for r in rows) >= 0.97 * len(rows)


@pytest.mark.parametrize("model", [suffix_tree.Settings(), suffix_tree.Settings(chunk=300, bucket=500, hot=5)])
def test_lm_counts_and_states_match_brute_force(spark, docs, empty, model):
    """The second run has many chunks and buckets, and hot contexts in sub-buckets; the model is the same."""
    rows = list(dict(pairs(docs)).items())
    base = brute.unigram(rows)
    full, retained, mass = brute.suffix_tree(rows, model.depth, model.divergence, model.smooth)
    given = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, chunk int, blob string")
    got = suffix_tree.score(given, model=model).collect()
    assert len(got) == len(rows) and retained > 100
    for r in got:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == base[r["doc_id"]][:4]
        assert math.isclose(r["base_score"], base[r["doc_id"]][4], rel_tol=1e-9)
        assert math.isclose(r["score"], full[r["doc_id"]], rel_tol=1e-9, abs_tol=1e-9)
    some = brute.words(brute.lower_ascii(rows[3][1]))
    assert all(math.isclose(mass(tuple(some[k : k + d])), 1.0, rel_tol=1e-9) for k in range(20) for d in range(4))
    assert suffix_tree.score(empty).count() == 0
    again = spark.createDataFrame([(None, None), (None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    assert suffix_tree.score(again).count() == 4


def test_every_query_is_registered_in_order():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{n}" for n in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
