"""Plain, single-machine versions of the operators, written apart from them, to compare against."""

from __future__ import annotations

import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, size=3):
    w = words(lower_ascii(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def simhash_components(rows, distance=2, size=3):
    """rows: (doc_id, text). doc_id -> (fingerprint, component)."""
    fp = [(i, simhash(t, size)) for i, t in rows]
    u = Union()
    for k, (i, a) in enumerate(fp):
        u.find(i)
        for j, b in fp[:k]:
            if (a ^ b).bit_count() <= distance:
                u.join(i, j)
    return {i: (f, u.find(i)) for i, f in fp}


def quality_base(text):
    w = words(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(w)
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def embedding_links(rows, cosine=0.95):
    """rows: (vec_id, vector). vec_id -> (links, component), in double precision."""
    import numpy as np

    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [(i, np.array(v, dtype=float)) for i, v in rows if usable(v)]
    u, n = Union(), {i: 0 for i, _ in rows}
    for i, _ in rows:
        u.find(i)
    for a, (i, x) in enumerate(ok):
        for j, y in ok[:a]:
            if len(x) == len(y) and float(x @ y) / (float(np.linalg.norm(x)) * float(np.linalg.norm(y))) >= cosine:
                n[i] += 1
                n[j] += 1
                u.join(i, j)
    return {i: (n[i], u.find(i)) for i, _ in rows}


def unigram(rows, folds=7, held=2):
    """rows: (doc_id, text). doc_id -> (held out, tokens, known, training tokens, base score)."""
    import math
    import zlib

    out = {i: zlib.crc32(str(i).encode()) % folds == held for i, _ in rows}
    toks = {i: [*words(lower_ascii(t)), None] for i, t in rows}
    c = Counter(w for i, _ in rows if not out[i] for w in toks[i])
    n, v = sum(c.values()), len(c)
    return {
        i: (out[i], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in toks.items()
    }


def dedup_lines(rows, min_lines, min_words):
    """rows: (doc_id, text). doc_id -> (text left, places removed); later copies by (doc_id, place)."""
    white = " \t\n\x0b\x0c\r"
    seq = {i: [(k, x.strip(white)) for k, x in enumerate(t.split("\n")) if x.strip(white)] for i, t in rows if t is not None}
    runs, lines, gone = set(), set(), {i: set() for i, _ in rows}
    for i in sorted(seq):
        s = seq[i]
        for k in range(len(s)):
            run = tuple(x for _, x in s[k : k + min_lines])
            if len(run) == min_lines:
                if run in runs:
                    gone[i] |= {p for p, _ in s[k : k + min_lines]}
                runs.add(run)
            if len(words(s[k][1])) >= min_words:
                if s[k][1] in lines:
                    gone[i].add(s[k][0])
                lines.add(s[k][1])
    return {i: (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), sorted(gone[i])) for i, t in rows}


def suffix_tree(rows, depth, threshold, power, folds=7, held=2):
    """rows: (doc_id, text). doc_id -> log10 probability by the states of suffix_tree.py, one position at a time."""
    import math
    import zlib
    from collections import defaultdict
    from functools import cache

    out = {i: zlib.crc32(str(i).encode()) % folds == held for i, _ in rows}
    toks = {i: [*words(lower_ascii(t)), ""] for i, t in rows}
    after = defaultdict(Counter)
    for i, t in toks.items():
        if not out[i]:
            for j, w in enumerate(t):
                for d in range(min(j, depth) + 1):
                    after[tuple(t[j - d : j])][w] += 1
    c = after[()]
    n = sum(c.values())
    u = (sum(k == 1 for k in c.values()) + 0.5) / (n + 1)
    total = {s: sum(x.values()) for s, x in after.items()}

    @cache
    def retained(s):
        m = total.get(s, 0)
        if m < 2:
            return False
        k, gain = (m - 1) ** power, 0.0
        for w, times in after[s].items():
            p = 10 ** -(min(255, round(-20 * logp(w, s[1:]))) / 20)
            gain += times * math.log10(((times - 1 + k * p) / (m - 1 + k)) / p)
        return gain >= threshold

    @cache
    def logp(w, s):
        if not s:
            return math.log10((1 - u) * c[w] / n) if c[w] else math.log10(u)
        shorter = logp(w, s[1:])
        if not retained(s):
            return shorter
        k = total[s] ** power
        return math.log10((after[s][w] + k * 10**shorter) / (total[s] + k))

    got = {i: sum(logp(w, tuple(t[max(0, j - depth) : j])) for j, w in enumerate(t)) for i, t in toks.items()}
    return got, sum(retained(s) for s in after if s), lambda s: (sum(10 ** logp(w, s) for w in c) + 10 ** logp("\n", s))
