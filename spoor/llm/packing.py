"""Best-fit packing of token sequences by exact-complement hashing.

Documents are tokenised where they lie and cut into pieces of at most
``capacity`` tokens. Only the number of pieces of each length (at most
``capacity`` counters) goes to the driver, which plans on counts: sums of one, two and
three lengths are looked up by the gap they fill exactly and consumed as
often as the lengths last; what remains is placed by best fit, longest first.
The plan is a list of patterns with multiplicities. A piece finds its pattern from its
length and its rank among the pieces of that length, and ranks come from
counts per hash part, so neither pieces nor sequences are ever gathered.

Defined cases: a null or empty text is the end token alone; repeated rows are packed as
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor.llm.common import materialize

CAPACITY = 1024
END = 2
PARTS = 1024


def tokenizer_files() -> tuple[str, str]:
    """The tokenizer and the same vocabulary as ranks, from the public package of vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(ranks_file: str):
    """The byte-level BPE over the same merges; its ids equal those of the tokenizers file (see the tests)."""
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` tokens: full pieces, a shorter one first."""
    head = n % capacity
    starts = [0] * bool(head) + list(range(head, n, capacity))
    return [(s, (head if s == 0 and head else capacity)) for s in starts]


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, ranks_file: str | None = None, keep_ids: bool = False, id_col: str = "doc_id", text: str = "text", run_col: str | None = None
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, and ``run`` of the document) of every piece."""
    file = ranks_file or tokenizer_files()[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(file)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, t, *of in zip(*(batch[c] for c in columns), strict=True):
                ids = np.array([*enc.encode(t or "", allowed_special="all", disallowed_special=()), END], dtype="<u4")
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[s : s + n]
                    out.append((doc_id, k, s, n, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if keep_ids else []), *of))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    columns = ["doc_id", "text", *["run"] * bool(run_col)]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, *["run"] * bool(run_col)]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", run long" * bool(run_col)
    runs = [F.col(f"`{run_col}`").cast("long").alias("run")] if run_col else []
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *runs)
    return given.mapInPandas(_nullable_ids(run), schema)


def _nullable_ids(run):
    """Null ids arrive as NaN in a float column; turn them back before use."""

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(b.assign(doc_id=b["doc_id"].astype("Int64")) for b in batches)

    return inner


Pattern = tuple[tuple[int, ...], int]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (lengths of one sequence, how often) that use up ``counts`` of each length."""
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("lengths are from 1 to the capacity")
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    out: list[Pattern] = []

    def take(lengths: tuple[int, ...]) -> None:
        each = {n: lengths.count(n) for n in lengths}
        times = min(int(left[n]) // k for n, k in each.items())
        if times > 0:
            for n, k in each.items():
                left[n] -= k * times
            out.append((lengths, times))

    take((capacity,))
    for a in range(capacity - 1, 0, -1):  # gaps filled by one length
        if left[a] and capacity - a <= a and left[capacity - a]:
            take((a, capacity - a))
    for a in range(capacity - 1, 0, -1):  # by the sum of two
        gap = capacity - a
        for b in range(min(a, gap - 1), (gap - 1) // 2, -1):
            if not left[a]:
                break
            if left[b] and left[gap - b]:
                take((a, b, gap - b))
    _triples(left, capacity, take)
    out += _best_fit(left, capacity)
    return out


def _triples(left: np.ndarray, capacity: int, take) -> None:
    """Gaps filled by the sum of three lengths: pair sums are indexed once, each pair checked again when met."""
    present = np.flatnonzero(left)
    sums: dict[int, list[tuple[int, int]]] = {}
    for i, c in enumerate(present.tolist()):
        for d in present[: i + 1].tolist():
            if c + d < capacity:
                sums.setdefault(c + d, []).append((c, d))
    for a in present[::-1].tolist():
        for b in present[present <= a][::-1].tolist():
            gap = capacity - a - b
            if gap < 2:
                continue
            if not left[a]:
                break
            pairs = sums.get(gap, [])
            while pairs and left[a] and left[b]:
                c, d = pairs[-1]
                if not left[c] or not left[d]:
                    pairs.pop()  # used up for good
                    continue
                before = len(pairs), int(left[a])
                take((a, b, c, d))
                if before == (len(pairs), int(left[a])):
                    break  # the four share a length that does not last


def _best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Longest first, each into the fullest open sequence that has room; equal sequences move together."""
    open_: dict[int, list[list]] = {}
    for n in np.flatnonzero(left)[::-1].tolist():
        k = int(left[n])
        for gap in range(n, capacity + 1):
            while k and open_.get(gap):
                lengths, times = open_[gap].pop()
                fit = gap // n  # the same length goes on while it fits
                used = min(times, k // fit)
                if used:
                    open_.setdefault(gap - fit * n, []).append([lengths + (n,) * fit, used])
                    k -= used * fit
                rest = times - used
                if rest and 0 < k < fit:
                    open_.setdefault(gap - k * n, []).append([lengths + (n,) * k, 1])
                    k, rest = 0, rest - 1
                if rest:
                    open_[gap].append([lengths, rest])
                    if not k:
                        break
            if not k:
                break
        fit = capacity // n
        if k >= fit:
            open_.setdefault(capacity - fit * n, []).append([(n,) * fit, k // fit])
        if k % fit:
            open_.setdefault(capacity - (k % fit) * n, []).append([(n,) * (k % fit), 1])
        left[n] = 0
    return [(tuple(x), t) for found in open_.values() for x, t in found]


def _lookup(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, in order of rank: first rank, occurrences per sequence, first sequence, and where the offsets stand."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    offsets: list[int] = []
    base = 0
    for lengths, times in patterns:
        at, where = 0, {}
        for n in lengths:
            where.setdefault(n, []).append(at)
            at += n
        for n, offs in where.items():
            rows.setdefault(n, []).append((used.get(n, 0), len(offs), base, len(offsets)))
            used[n] = used.get(n, 0) + len(offs) * times
            offsets += offs
        base += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for n, r in rows.items()} | {0: (np.array(offsets, dtype=np.int64),)}


def _place(n: np.ndarray, rank: np.ndarray, table: dict[int, tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces from their length and their rank among those of that length."""
    seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    for x in np.unique(n):
        m = n == x
        first, per, base, at = table[int(x)]
        k = np.searchsorted(first, rank[m], side="right") - 1
        inner = rank[m] - first[k]
        seq[m], off[m] = base[k] + inner // per[k], table[0][0][at[k] + inner % per[k]]
    return seq, off


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (materialised pieces) with ``sequence_id`` and ``offset``."""
    counts = {int(r["length"]): int(r["n"]) for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = _lookup(plan(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = _place(length.to_numpy(), rank.to_numpy(), table)
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int")
    parted = found.withColumn("_part", part)
    sizes = parted.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "_part", (F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).alias("_before"))
    in_part = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1
    ranked = parted.withColumn("_rn", in_part).join(before, ["length", "_part"])
    placed = ranked.withColumn("_at", place("length", F.col("_before") + F.col("_rn")))
    return placed.select(*found.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, ranks_file: str | None = None, keep_ids: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with their places; ``keep_ids`` adds the token ids themselves."""
    return pack(materialize(pieces(docs, capacity, ranks_file, keep_ids, id_col, text)), capacity)


def pack_runs(docs: DataFrame, capacity: int = CAPACITY, run_col: str = "run") -> DataFrame:
    """The pieces of all documents packed run by run, each run of bounded size by a plan of its own.

    Sequences of a run have ids from ``run << 32``, so ids follow the runs; no sequence holds two runs."""
    found = pieces(docs, capacity, run_col=run_col)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        got = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        table = _lookup(plan({int(k): int(n) for k, n in got["length"].value_counts().items()}, capacity))
        rank = got.groupby("length").cumcount().to_numpy()
        seq, off = _place(got["length"].to_numpy(), rank, table)
        return got.drop(columns="run").assign(sequence_id=(got["run"].to_numpy() << 32) + seq, offset=off)

    return found.groupBy("run").applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed token sequences of pieces that keep their ids (at most ``capacity`` tokens each)."""
    got = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return got.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
