"""Scalar encoders as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoor.functions import vocab

C = str | Column


def _col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """CASE WHEN in order."""
    head, *rest = cases
    out = F.when(head[0], F.lit(head[1]))
    for cond, value in rest:
        out = out.when(cond, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def _steps(x: Column, bounds: list[int | float], first: int = 0) -> Column:
    """How many of ``bounds`` (ascending) ``x`` reaches, counted from ``first``."""
    return _first([(x < b, first + k) for k, b in enumerate(bounds)], first + len(bounds))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# ---- categories to codes


def vocab_code(c: C, values: list[str], null: int, other: int) -> Column:
    """Position of ``c`` in ``values``; codes of their own for null and for anything else."""
    x = _col(c)
    return _first([(x.isNull(), null), *[(x == v, k) for k, v in enumerate(values)]], other).cast("int")


def event_type_code(c: C = "event_type") -> Column:
    return vocab_code(c, vocab.EVENT_TYPES, 3, 3)


def kprobe_function_code(c: C = "kprobe_function_name") -> Column:
    return vocab_code(c, vocab.KPROBE_FUNCTIONS, 12, 13)


def kprobe_policy_code(c: C = "kprobe_policy_name") -> Column:
    return vocab_code(c, vocab.KPROBE_POLICIES, 6, 7)


def kprobe_action_code(c: C = "kprobe_action") -> Column:
    return vocab_code(c, vocab.KPROBE_ACTIONS, 1, 2)


def sock_family_code(c: C = "kp_sock_family") -> Column:
    return vocab_code(c, vocab.SOCK_FAMILIES, 2, 3)


def action_family_code(c: C) -> Column:
    return vocab_code(c, vocab.ACTION_FAMILIES, 14, 14)


def path_category_code(c: C) -> Column:
    return vocab_code(c, vocab.PATH_CATEGORIES, 9, 9)


def ip_category_code(c: C) -> Column:
    return vocab_code(c, vocab.IP_CATEGORIES, 5, 5)


def port_category_code(c: C) -> Column:
    return vocab_code(c, vocab.PORT_CATEGORIES, 6, 6)


def object_category_code(c: C) -> Column:
    return vocab_code(c, vocab.OBJECT_CATEGORIES, 6, 6)


# ---- numbers to buckets


def uid_bucket(c: C = "proc_uid") -> Column:
    u = _col(c)
    return _first([(u == 0, 0), (u == 1000, 1), (u.between(1, 99), 2), (u.between(100, 999), 3)], 4).cast("int")


def port_bucket(c: C = "kp_sock_dport") -> Column:
    p = _col(c)
    return _first(
        [(p.isNull(), 0), (p == 0, 1), (p == 22, 2), (p == 53, 3), (p.isin(vocab.WEB_PORTS), 4), (p.between(1, 1023), 5)], 6
    ).cast("int")


def port_category(c: C = "kp_sock_dport") -> Column:
    p = _col(c)
    return _first(
        [(p.isNull(), "NONE"), (p == 53, "DNS"), (p.isin(vocab.WEB_CATEGORY_PORTS), "WEB"), (p == 22, "SSH"), (p < 1024, "WELL_KNOWN"), (p < 49152, "REGISTERED")],
        "HIGH",
    )


def args_length_bucket(c: C = "proc_arguments") -> Column:
    return _steps(F.coalesce(F.octet_length(_col(c)), F.lit(0)), [1, 50, 200, 1000, 5000]).cast("int")


def cap_count_bucket(c: C = "proc_cap_effective") -> Column:
    return _steps(_length(c, 0), [1, 3, 6, 16]).cast("int")


def _length(c: C, null: int) -> Column:
    return F.when(_col(c).isNull(), F.lit(null)).otherwise(F.size(_col(c)))


def time_since_bucket(event: C = "event_time", parent: C = "parent_start_time") -> Column:
    d = _col(event) - _col(parent)
    return F.when(d.isNull(), F.lit(0)).otherwise(_steps(d, [10**6, 10**9, 60 * 10**9, 3600 * 10**9], 1)).cast("int")


def log_bucket(c: C, buckets: int = vocab.TIME_BUCKETS) -> Column:
    """Digits of a positive number, at most ``buckets - 1``; zero for null and for what isn't positive."""
    x = _col(c)
    return F.when(x.isNull() | (x <= 0), F.lit(0)).otherwise(_steps(x, [10**k for k in range(1, buckets - 1)], 1)).cast("int")


def entropy_bucket(c: C) -> Column:
    return bind(_col(c), lambda x: F.when(x.isNull(), F.lit(0)).otherwise(_steps(x, [2.0, 3.5, 4.5, 5.5], 1)).cast("int"))


def ratio_bucket(c: C) -> Column:
    return F.when(_col(c).isNull(), F.lit(0)).otherwise(_steps(_col(c), [0.3, 0.5, 0.7, 0.9], 1)).cast("int")


def scaled(c: C, scale: float) -> Column:
    return _col(c).cast("float") / F.lit(float(scale)).cast("float")


# ---- flags


def flag(c: C) -> Column:
    return F.coalesce(_col(c), F.lit(False)).cast("int")


def same_uid(a: C = "proc_uid", b: C = "parent_uid") -> Column:
    return flag(_col(a) == _col(b))


def setuid_exec(event: C = "event_type", own: C = "proc_cap_effective", parent: C = "parent_cap_effective") -> Column:
    return flag((_col(event) == "process_exec") & (_length(own, 0) > 0) & (_length(parent, 0) == 0))


def creds_uid_change(new: C = "kp_creds_uid", old: C = "proc_uid") -> Column:
    return flag(_col(new) != _col(old))


def creds_caps_change(new: C = "kp_creds_caps", old: C = "proc_cap_effective") -> Column:
    """Whether the number of capabilities changed; no event without new ones changes any."""
    return flag(_col(new).isNotNull() & (_length(new, -1) != _length(old, -1)))


def is_dns(c: C = "kp_sock_dport") -> Column:
    return flag(_col(c) == 53)


# ---- paths


def basename(c: C) -> Column:
    return F.substring_index(_col(c), "/", -1)


def basename_or_empty(c: C) -> Column:
    return F.coalesce(basename(c), F.lit(""))


def dirname(c: C) -> Column:
    """Up to the last slash, which stays; a path without one is its own; null for null and empty."""
    p = _col(c)
    return F.when(p == "", F.lit(None)).when(p.contains("/"), F.regexp_extract(p, r"(?s)^(.*/)[^/]*$", 1)).otherwise(p)


def first_components(c: C, n: int) -> Column:
    """The first ``n`` components of a path; an absolute one keeps its slash; null for null and empty."""
    p = _col(c)
    absolute = p.startswith("/")
    parts = F.slice(F.split(F.when(absolute, F.substr(p, F.lit(2))).otherwise(p), "/"), 1, n)
    return F.when(p != "", F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/")))


def path_sensitivity(c: C) -> Column:
    if not isinstance(c, str):
        return bind(c, _path_sensitivity)
    return _path_sensitivity(F.col(c))


def _path_sensitivity(p: Column) -> Column:

    tests = {"start": p.startswith, "pattern": p.rlike, "part": p.contains}
    cases = [(_any([tests[kind](s) for s in texts]), code) for code, kind, texts in vocab.PATH_TESTS]
    return _first([(p.isNull() | (p == ""), vocab.PATH_NONE), *cases], vocab.PATH_OTHER).cast("int")


def path_category(c: C) -> Column:
    if not isinstance(c, str):
        return bind(c, _path_category)
    return _path_category(F.col(c))


def _path_category(p: Column) -> Column:
    cases = [(_any([p.contains(s) for s in parts]), name) for name, parts in vocab.PATH_PARTS]
    return _first([(p.isNull() | (p == ""), "NONE"), *cases], "OTHER")


def normal_cwd(c: C = "proc_cwd") -> Column:
    low = F.lower(_col(c))
    return F.when(F.coalesce(low, F.lit("")) == "", F.lit("")).when(low.endswith("/"), low).otherwise(F.concat(low, F.lit("/")))


def kprobe_path() -> Column:
    return F.coalesce(*vocab.KP_PATHS)


def path_to_classify(kp: C | None = None, event: C = "event_type", binary: C = "proc_binary", cwd: C = "proc_cwd") -> Column:
    """A probed path, else the binary of an exec, else the working directory; empty ones count as missing until the last."""
    own = kprobe_path() if kp is None else _col(kp)
    run = F.when((_col(event) == "process_exec") & (_col(binary) != ""), _col(binary))
    return F.coalesce(F.nullif(own, F.lit("")), run, _col(cwd))


# ---- event categories and tokens


def action_family(event: C = "event_type", function: C = "kprobe_function_name") -> Column:
    e, f = _col(event), _col(function)
    probes = [((e == "process_kprobe") & (f == name), family) for name, family in vocab.KPROBE_ACTION.items()]
    return _first([(e == "process_exec", "PROC_EXEC"), (e == "process_exit", "PROC_EXIT"), *probes], "OTHER")


def object_category(event: C = "event_type", function: C = "kprobe_function_name") -> Column:
    e, f = _col(event), _col(function)
    probes = [((e == "process_kprobe") & (f == name), kind) for name, kind in vocab.KPROBE_OBJECT.items()]
    return _first([(e.isNull(), "NONE"), (e.isin("process_exec", "process_exit"), "PROCESS"), *probes], "OTHER")


def token(family: C, name: C, parent: C, path: C, ip: C, port: C) -> Column:
    """An event as one token of categories and base names, never of addresses or paths."""

    def named(c: C, missing: str) -> Column:
        return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(missing))

    f, who = _col(family), named(name, "unknown")
    return (
        F.when(f == "PROC_EXEC", F.concat(F.lit("PROC_EXEC:"), named(parent, "unknown"), F.lit("->"), who))
        .when(f.startswith("NET_"), F.concat_ws(":", f, who, named(ip, "NONE"), named(port, "NONE")))
        .when(f.startswith("FILE_"), F.concat_ws(":", f, who, named(path, "NONE")))
        .otherwise(F.concat_ws(":", f, who))
    )


def leaks_artifact(c: C) -> Column:
    """Whether a token holds a raw IPv4 address or a system path."""
    return F.coalesce(_col(c).rlike(vocab.RAW_IP) | _col(c).rlike(vocab.RAW_PATH), F.lit(False))


def parent_child(parent: C, name: C) -> Column:
    p, n = F.coalesce(_col(parent), F.lit("")), F.coalesce(_col(name), F.lit(""))
    return F.when((p == "") & (n == ""), F.lit("")).otherwise(F.concat(p, F.lit("->"), n))


# ---- time


def parse_time_ns(c: C) -> Column:
    """Nanoseconds since the epoch of ``YYYY-MM-DDTHH:MM:SS[.fraction]Z``; null for anything else.

    The fraction is cut after nine digits. Bigint throughout: Spark's timestamps end at microseconds."""
    t = _col(c)
    ok = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]*)?Z$")
    fraction = F.rpad(F.substring(F.regexp_extract(t, r"\.([0-9]*)Z$", 1), 1, 9), 9, "0").cast("bigint")
    head = F.concat(F.translate(F.substring(t, 1, 19), "T", " "), F.lit("Z"))
    seconds = F.unix_seconds(F.try_to_timestamp(head, F.lit("yyyy-MM-dd HH:mm:ssX")))
    return F.when(ok, seconds * F.lit(10**9) + fraction)


def micros_to_ns(c: C) -> Column:
    return F.unix_micros(_col(c)) * 1000
