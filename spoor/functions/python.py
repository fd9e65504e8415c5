"""The scalar functions Spark has no expression for: BLAKE2b buckets, gzip ratio, entropy and IP rules.

Each is an Arrow-batched UDF that works once per distinct value of a batch, so repeated
binaries, directories and addresses cost one call each and no shuffle.
"""

from __future__ import annotations

import gzip
import hashlib
import ipaddress
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_of(value: str | None, buckets: int) -> int:
    """The 64-bit BLAKE2b digest, read as an unsigned big-endian number, modulo ``buckets``; 0 for null and empty."""
    if not value:
        return 0
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "big") % buckets


def gzip_ratio_of(value: str | None) -> float | None:
    if not value:
        return None
    raw = value.encode("utf-8", "replace")
    return len(gzip.compress(raw)) / len(raw)


def entropy_of(value: str | None) -> float | None:
    """Shannon entropy in bits over code points; equal multisets of characters give equal sums. None for null and empty."""
    if not value:
        return None
    points = np.frombuffer(value.encode("ascii"), np.uint8) if value.isascii() else np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(points) if value.isascii() else np.unique(points, return_counts=True)[1]
    share = np.sort(counts[counts > 0]) / len(points)
    return float(-np.cumsum(share * np.log2(share))[-1]) + 0.0


def ip_category_of(value: str | None) -> str:
    """By the rules of Python 3.13's ipaddress, which count shared and documentation ranges as private or not."""
    try:
        ip = ipaddress.ip_address((value or "").strip())
    except ValueError:
        return "NONE"
    tests = [("LOOPBACK", ip.is_loopback), ("LINK_LOCAL", ip.is_link_local), ("PRIVATE", ip.is_private), ("MULTICAST", ip.is_multicast)]
    return next((name for name, holds in tests if holds), "PUBLIC")


def _once_per_value(s: pd.Series, f: Callable) -> pd.Series:
    codes, values = pd.factorize(s, use_na_sentinel=True)
    found = [f(v) for v in values] + [f(None)]
    return pd.Series([found[k] for k in codes])


def hash_bucket(c: Column | str, buckets: int) -> Column:
    @F.pandas_udf("int")
    def of(s: pd.Series) -> pd.Series:
        return _once_per_value(s, lambda v: bucket_of(v, buckets))

    return of(c)


def gzip_ratio(c: Column | str) -> Column:
    @F.pandas_udf("double")
    def of(s: pd.Series) -> pd.Series:
        return _once_per_value(s, gzip_ratio_of).astype("float64")

    return of(c)


def entropy(c: Column | str) -> Column:
    @F.pandas_udf("double")
    def of(s: pd.Series) -> pd.Series:
        return _once_per_value(s, entropy_of).astype("float64")

    return of(c)


def ip_category(c: Column | str) -> Column:
    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return _once_per_value(s, ip_category_of)

    return of(c)
