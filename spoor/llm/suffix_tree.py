"""LM scoring with a probabilistic suffix tree over tokens.

A text is its words and one end token. As in the base score, the events are the distinct
training tokens and one event for all others. The root gives the unknown the share of tokens
met once, ``u``, and a known token ``(1 - u) * c / N``.

A state is a context ``s`` of one to ``depth`` tokens before the next, met ``n >= 2`` times in
training, whatever its words. Its distribution is smoothed with that of the longest retained suffix of it (its parent):
``P(x | s) = (n(s, x) + k * P(x | parent)) / (n + k)`` with ``k = n ** SMOOTH``, which sums to one over all events.
A state is retained by a divergence test against its parent: its occurrences, each
predicted from the others, must gain at least ``divergence`` in log10. (For the test alone
``P(x | parent)`` is rounded to a 20th in log10.) Each position is scored by its longest retained suffix.

Where things are counted. Texts are encoded once into chunks of about ``chunk`` tokens, with words numbered within the chunk. Level by
level, a chunk asks for what its contexts need: their distinct (context, next) pairs with their training
counts, packed per bucket of contexts. A bucket adds up the requests of all chunks, tests its states and answers with the
counts and the states retained. Level 0 counts the words. The count of a context is the count of its last pair one
level above, so contexts met once are never sent, and what is asked for shrinks with depth. A context of over ``hot`` occurrences is dealt to as many sub-buckets as it needs by its next tokens; their
gains add up. Buckets follow the number of tokens, so no task grows with the corpus, and no model is broadcast.

Words are told apart by 64 bits of a hash, contexts by 40 bits within a bucket, next tokens of a context by 32 bits (24 for contexts met up to 4096 times).

Defined cases: a null or empty text is the end token alone; a null id is hashed as the empty text; without training
documents counts are zero and the unknown has probability one; repeated rows are scored one by one; an empty table gives no
rows; other columns are ignored; a text is held whole by one task.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import shared_folder, stored

_STEPS = 20.0  # of the rounded parent's probability
_KEY = 5
_LARGE = 4096  # occurrences from which a context's next tokens take the fourth byte
_ROWS = "chunk long, level int, bucket long, blob binary"
Docs = Iterator[pd.DataFrame]


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a text in UTF-8, then the end token (the empty word)."""
    found = (text or b"").lower().split()
    found.append(b"")
    return found


def is_held(doc_id: int | None, folds: int, held: int) -> bool:
    return zlib.crc32(b"" if pd.isna(doc_id) else str(int(doc_id)).encode()) % folds == held


@dataclass(frozen=True)
class Settings:
    """Of the model: depth, divergence and smoothing. Of the work, without effect on the model: chunk, bucket and hot."""

    depth: int = 3
    divergence: float = 1.5
    smooth: float = 0.85
    chunk: int = 1 << 20  # tokens encoded together
    bucket: int = 1 << 20  # tokens of the corpus per bucket
    hot: int = 1 << 18  # occurrences of a context per sub-bucket


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed, with their sizes in front."""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays)
    sizes = np.array([len(a) for a in arrays], dtype="<i8").tobytes()
    return sizes + zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, "<i8", len(kinds)), 0, []
    raw = zstandard.ZstdDecompressor().decompress(blob[8 * len(kinds) :])
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        width = _KEY if kind == "key" else np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        if kind == "key":
            whole = np.zeros((n, 8), np.uint8)
            whole[:, :_KEY] = planes
            out.append(whole.view("<u8")[:, 0] if n else np.empty(0, "<u8"))
        else:
            out.append(np.ascontiguousarray(planes).view(kind)[:, 0] if n else np.empty(0, kind))
    return out


def _key_bytes(key: np.ndarray) -> np.ndarray:
    """The lower 40 bits of keys, as five bytes each."""
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY])


def _mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _encode(folds: int, held: int, chunk: int):
    """Documents to chunks: what is known of each document, the hashes of the chunk's words, and its tokens by their numbers."""

    def run(batches: Docs) -> Docs:
        part, serial = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        found: list[np.ndarray] = []
        size = 0
        local: dict[bytes, int] = defaultdict(count().__next__)

        def flush() -> Docs:
            nonlocal rows, found, size, local, serial
            ids, null, out, n = (np.array(x, dtype=k) for x, k in zip(zip(*rows, strict=True), ("<i8", "u1", "u1", "<i4"), strict=True))
            words, token = np.array([xxhash.xxh64_intdigest(w) for w in local], dtype="<u8"), np.concatenate(found)
            often = np.argsort(-np.bincount(token, minlength=len(words)), kind="stable")  # small numbers for frequent words pack well
            rank = np.empty(len(words), "<u4")
            rank[often] = np.arange(len(words))
            blob = _pack(ids, null, out, n, words[often], rank[token])
            yield pd.DataFrame({"chunk": [(part << 24) + serial], "level": [-1], "bucket": [size], "blob": [blob]})
            rows, found, size, local = [], [], 0, defaultdict(count().__next__)
            serial += 1

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                t = tokens(text)
                null = pd.isna(doc_id)
                found.append(np.fromiter(map(local.__getitem__, t), dtype="<u4", count=len(t)))
                rows.append((0 if null else int(doc_id), null, is_held(doc_id, folds, held), len(t)))
                size += len(t)
                if size >= chunk:
                    yield from flush()
        if rows:
            yield from flush()

    return run


def _groups(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes in order, a row of each, and the number of each row's code."""
    order = np.argsort(code)
    s = code[order]
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    of = np.empty(len(s), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    at = np.flatnonzero(new)
    return s[at], order[at], of


class _Level:
    """Where a chunk stands between two levels: of each position the number of its last pair (-1: not asked for), and that pair's count; of each pair its hash and count."""

    def __init__(self, pair: np.ndarray, times: np.ndarray, key: np.ndarray, count: np.ndarray):
        self.pair, self.times, self.key, self.count = pair, times, key, count


class _Asked:
    """What a chunk asks for at one level: entries (a context, or a sub-bucket of a hot one) and pairs, in the order of their buckets.

    The context of a position is the last pair of the position before."""

    def __init__(self, walk: _Walk, before: _Level, d: int, buckets: int, model: Settings):
        self.walk, self.model = walk, model
        ctx = np.empty_like(before.pair)
        ctx[:1], ctx[1:] = -1, before.pair[:-1]
        self.n_at = np.where((walk.place >= d) & (ctx >= 0), before.count[ctx] if len(before.count) else 0, 0)
        # two occurrences, one with a pair met once one level above, are never retained
        wide = (self.n_at >= 2) & (~walk.train | (before.times >= 2) | (self.n_at > 2))
        self.ctx_at = np.flatnonzero(wide)
        self.pair_at = np.flatnonzero(wide & (before.times >= 1))
        compact = np.zeros(len(before.key), np.int32)
        compact[ctx[self.ctx_at]] = 1
        used = np.flatnonzero(compact)
        compact[used] = np.arange(len(used), dtype=np.int32)
        self.of, self.n, key = compact[ctx[self.ctx_at]], before.count[used], before.key[used]
        bits = max(1, len(walk.word).bit_length())
        code, self.first, self.pair_of = _groups(compact[ctx[self.pair_at]].astype(np.int64) << bits | walk.token[self.pair_at])
        pair_ctx, self.word = code >> bits, walk.word[code & (1 << bits) - 1]
        golden = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            self.pair_key = _mix(key[pair_ctx] * golden + self.word)
        if len(self.n) and self.n.max() > model.hot:
            parts = -(-self.n // model.hot)
            start = np.cumsum(parts) - parts
            self.ctx = np.repeat(np.arange(len(used)), parts)
            sub = (np.arange(len(self.ctx)) - start[self.ctx]).astype(np.uint64)
            entry = start[pair_ctx] + ((self.word >> np.uint64(32)) % parts[pair_ctx].astype(np.uint64)).astype(np.int64)
            with np.errstate(over="ignore"):
                full = _mix(key[self.ctx] + sub * golden)
        else:
            self.ctx, entry, full = np.arange(len(used)), pair_ctx, _mix(key)
        # entries by bucket, pairs by entry, each then as they are
        mixed = np.sort((_mix(full) % np.uint64(buckets)).astype(np.int64) << 32 | np.arange(len(full)))
        self.bucket, self.order = mixed >> 32, mixed & 0xFFFFFFFF
        rank = np.empty(len(full), np.int64)
        rank[self.order] = np.arange(len(full))
        mixed = np.sort(rank[entry] << 32 | np.arange(len(code)))
        self.entry, self.pair_order = mixed >> 32, mixed & 0xFFFFFFFF
        self.key = full[self.order]

    def blocks(self, p: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The requests, given the probability of each token so far."""
        n = self.n[self.ctx][self.order]
        per = np.bincount(self.entry, minlength=len(n))
        ends = np.cumsum(per)
        x = (self.word >> np.uint64(32))[self.pair_order].astype("<u4")
        count = np.bincount(self.pair_of, weights=self.walk.train[self.pair_at], minlength=len(self.word))[self.pair_order].astype("<u4")
        q = np.minimum(255, np.rint(-_STEPS * np.log10(p[self.pair_at[self.first]])))[self.pair_order].astype(np.uint8)
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(n)], strict=True):
            lo, hi = int(ends[s] - per[s]), int(ends[e - 1])
            far = np.repeat(n[s:e] > _LARGE, per[s:e])
            nxt = np.ascontiguousarray(x[lo:hi]).view(np.uint8).reshape(-1, 4)
            yield int(self.bucket[s]), _pack(_key_bytes(self.key[s:e]), n[s:e].astype("<i8"), per[s:e].astype("<u4"), *nxt[:, :3].T, nxt[far, 3], q[lo:hi], count[lo:hi])

    def answered(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Whether the state of each position that asked is retained, and the count of each pair."""
        got = [_unpack(b, "u1", "<f8", "<i8") for b in blobs]
        join = lambda k, kind: np.concatenate([g[k] for g in got]) if got else np.empty(0, kind)
        flag, gain, counts = join(0, "u1"), join(1, "<f8"), join(2, "<i8")
        hot = (self.n > self.model.hot)[self.ctx][self.order]
        total = np.zeros(len(self.n))
        np.add.at(total, self.ctx[self.order][hot], gain)
        kept = np.zeros(len(self.n), bool)
        kept[self.ctx[self.order][~hot]] = flag[~hot] > 0
        large = self.n > self.model.hot
        kept[large] = self.n[large] * singles(self.n[large], self.model) + total[large] >= self.model.divergence
        of_pair = np.empty(len(self.pair_order), np.int64)
        of_pair[self.pair_order] = counts
        return kept[self.of], of_pair


def singles(n: np.ndarray, model: Settings) -> np.ndarray:
    """What an occurrence gains whose next token its state has not seen otherwise."""
    k = np.power(n - 1.0, model.smooth)
    return np.log10(k / (n - 1.0 + k))


def gains(n: np.ndarray, n_pair: np.ndarray, lp: np.ndarray, model: Settings) -> np.ndarray:
    """What a pair's occurrences gain over the parent, less what they would as singles."""
    k = np.power(n - 1.0, model.smooth)
    times = np.maximum(n_pair, 1)  # a pair met once, or not in training, gains nothing
    return times * (np.log10((times - 1 + k * 10.0**lp) / (n - 1.0 + k)) - lp - singles(n, model))


def _count_states(pdf: pd.DataFrame, model: Settings) -> pd.DataFrame:
    """One bucket: adds up the pairs asked for, tests the states, and answers each chunk."""
    got = [_unpack(b, "key", "<i8", "<u4", "u1", "u1", "u1", "u1", "u1", "<u4") for b in pdf["blob"]]
    key, n, per, *low, high, q, times = (np.concatenate(z) for z in zip(*got, strict=True))
    x = low[0] | low[1].astype("<u4") << 8 | low[2].astype("<u4") << 16
    x[np.repeat(n > _LARGE, per)] |= high.astype("<u4") << 24
    _, first, entry = _groups(key)
    code, at, pair = _groups(np.repeat(entry.astype(np.uint64), per) << np.uint64(32) | x)
    total = np.bincount(pair, weights=times, minlength=len(code))
    of, size = (code >> np.uint64(32)).astype(np.int64), n[first].astype(np.float64)
    gain = np.bincount(of, weights=gains(size[of], total, q[at] / -_STEPS, model), minlength=len(first))
    flag = ((size * singles(size, model) + gain >= model.divergence) & (size <= model.hot)).astype(np.uint8)[entry]
    hot, gain, counts = n > model.hot, gain[entry], total[pair].astype("<i8")
    out, e0, p0 = [], 0, 0
    for g in got:
        e1, p1 = e0 + len(g[0]), p0 + len(g[3])
        out.append(_pack(flag[e0:e1], gain[e0:e1][hot[e0:e1]], counts[p0:p1]))
        e0, p0 = e1, p1
    return pd.DataFrame({"chunk": pdf["chunk"], "level": pdf["level"], "bucket": pdf["bucket"], "blob": out})


def _count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket of words: their training counts for each chunk that has them, and the sums of N, V and words met once."""
    got = [_unpack(b, "<u8", "<u4") for b in pdf["blob"]]
    word, times = (np.concatenate(z) for z in zip(*got, strict=True))
    distinct, at = np.unique(word, return_inverse=True)
    c = np.bincount(at, weights=times, minlength=len(distinct))
    counts, ends = c[at].astype("<i8"), np.cumsum([len(g[0]) for g in got])
    out = [_pack(counts[e - len(g[0]) : e]) for g, e in zip(got, ends.tolist(), strict=True)]
    sums = np.array([c.sum(), (c > 0).sum(), (c == 1).sum()], dtype="<i8").tobytes()
    answers = pd.DataFrame({"chunk": pdf["chunk"], "level": 0, "bucket": pdf["bucket"], "blob": out})
    return pd.concat([answers, pd.DataFrame({"chunk": [-1], "level": [0], "bucket": pdf["bucket"].iloc[:1].to_numpy(), "blob": [sums]})])


def _narrow(count: np.ndarray) -> np.ndarray:
    return count.astype(np.int32) if len(count) == 0 or count.max() < 1 << 31 else count


class _Root:
    def __init__(self, n: int, v: int, once: int):
        self.n, self.v = n, v
        self.u = (once + 0.5) / (n + 1) if n else 1.0

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (1 - self.u) * c / max(self.n, 1), self.u)


class _Walk:
    """A chunk on its way down the tree: its encoded texts, and the answers it has got so far."""

    def __init__(self, blob: bytes, answers: pd.DataFrame | None = None):
        self.ids, self.null, self.out, self.size, self.word, self.token = _unpack(blob, "<i8", "u1", "u1", "<i4", "<u8", "<u4")
        got = () if answers is None else answers.sort_values(["level", "bucket"]).groupby("level")
        self.answers = {int(k): g["blob"].tolist() for k, g in got}
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.token), dtype=np.int32) - (np.cumsum(self.size, dtype=np.int32) - self.size)[self.doc]
        self.train = np.repeat(self.out == 0, self.size)

    def words(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        bucket = (self.word % np.uint64(buckets)).astype(np.int64)
        return bucket, np.argsort(bucket, kind="stable")

    def ask_words(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        bucket, order = self.words(buckets)
        times = np.bincount(self.token, weights=self.train, minlength=len(self.word)).astype("<u4")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            yield int(bucket[order[s]]), _pack(self.word[order[s:e]], times[order[s:e]])

    def counts(self, buckets: int) -> np.ndarray:
        """Training counts of the chunk's words."""
        c = np.empty(len(self.word), np.int64)
        c[self.words(buckets)[1]] = np.concatenate([_unpack(b, "<i8")[0] for b in self.answers[0]])
        return _narrow(c)

    def descend(self, root: _Root, buckets: int, depth: int, model: Settings) -> tuple[_Asked | None, np.ndarray, np.ndarray]:
        """Down to level ``depth``: what it asks for there if that is not answered yet; the probability of each token, and its count."""
        of_word = self.counts(buckets)
        c = of_word[self.token]
        p, at = root.of(of_word.astype(np.float64))[self.token], _Level(self.token.astype(np.int32), c, self.word, of_word)
        for d in range(1, depth + 1):
            asked = _Asked(self, at, d, buckets, model)
            if d not in self.answers and (d == depth and len(asked.ctx_at)):
                return asked, p, c
            kept, counts = asked.answered(self.answers.get(d, []))
            counts = _narrow(counts)
            pair, times = np.full(len(c), -1, np.int32), np.minimum(at.times, asked.n_at)
            pair[asked.pair_at] = asked.pair_of
            times[asked.pair_at] = counts[asked.pair_of]
            some = asked.ctx_at[kept]
            k = np.power(asked.n.astype(np.float64), model.smooth)[asked.of[kept]]
            p[some] = (times[some] + k * p[some]) / (asked.n_at[some] + k)
            at = _Level(pair, times, asked.pair_key, counts)
        return None, p, c


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are stored: it does so when their handles are collected."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def _by_chunk(df: DataFrame) -> DataFrame:
    """``df`` stored by chunk in the shared folder, so that answers come to the chunks and chunks stay where they are."""
    spark = df.sparkSession
    name = f"spoor_chunks_{uuid.uuid4().hex}"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    df.write.option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").bucketBy(parts, "chunk").sortBy("chunk").saveAsTable(name)
    return spark.table(name)


def score(docs: DataFrame, folds: int = 7, held: int = 2, model: Settings = Settings(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    chunks = _by_chunk(given.mapInPandas(_encode(folds, held, model.chunk), _ROWS))
    size = chunks.agg(F.coalesce(F.sum("bucket"), F.lit(0))).head()[0]
    buckets = max(1, -(-size // model.bucket))
    columns = ["chunk", "level", "bucket", "blob"]

    def ask_words(batches: Docs) -> Docs:
        for b in batches:
            for chunk, blob in zip(b["chunk"], b["blob"], strict=True):
                yield pd.DataFrame([(chunk, 0, to, asked) for to, asked in _Walk(blob).ask_words(buckets)], columns=columns)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 8)

    def answer(asked: DataFrame, work) -> DataFrame:
        return stored(asked.repartition(parts, "bucket").groupBy("bucket").applyInPandas(work, _ROWS))

    def with_chunks(answers: DataFrame, work, schema: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(work, schema)

    words = answer(chunks.mapInPandas(ask_words, _ROWS), _count_words)
    release(spark)

    def added(batches: Docs) -> Docs:
        total = np.zeros(3, np.int64)
        for b in batches:
            for blob in b["blob"]:
                total += np.frombuffer(blob, "<i8")
        yield pd.DataFrame([total.tolist()], columns=["n", "v", "once"])

    sums = words.where("chunk < 0").select("blob").mapInPandas(added, "n long, v long, once long").agg(F.sum("n"), F.sum("v"), F.sum("once"))
    n, v, once = (int(x or 0) for x in sums.head())
    root, known = _Root(n, v, once), words.where("chunk >= 0")

    def ask_states(d: int):
        def ask(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            asked, p, _ = _Walk(chunk["blob"].iloc[0], answers).descend(root, buckets, d, model)
            return pd.DataFrame([(chunk["chunk"].iloc[0], d, to, blob) for to, blob in asked.blocks(p)] if asked else [], columns=columns)

        return ask

    def count_states(pdf: pd.DataFrame) -> pd.DataFrame:
        return _count_states(pdf, model)

    for d in range(1, model.depth + 1):
        known = known.union(answer(with_chunks(known, ask_states(d), _ROWS), count_states))
        release(spark)

    def add_up(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        walk = _Walk(chunk["blob"].iloc[0], answers)
        _, p, c = walk.descend(root, buckets, model.depth, model)
        per_doc = lambda x: np.bincount(walk.doc, weights=x, minlength=len(walk.size))
        ids = pd.array(walk.ids, dtype="Int64")
        ids[walk.null > 0] = pd.NA
        known, base = per_doc(c > 0).astype(np.int64), per_doc(np.log10(c + 1.0))
        return pd.DataFrame({"doc_id": ids, "held_out": walk.out > 0, "n_tokens": walk.size.astype(np.int64), "n_known": known, "base": base, "score": per_doc(np.log10(p))})

    found = with_chunks(known, add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    base = F.col("base") - F.col("n_tokens") * float(np.log10(n + v + 1))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
