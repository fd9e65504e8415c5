"""Golden vectors of the scalar functions."""

import random
from collections import Counter
from math import log2

import pytest
from pyspark.sql import functions as F

from spoor.functions import python as py
from spoor.functions import scalars as s

CASES = {
    "uid": (s.uid_bucket, "bigint", {0: 0, 1: 2, 99: 2, 100: 3, 999: 3, 1000: 1, 1001: 4, None: 4}),
    "port": (s.port_bucket, "bigint", {None: 0, 0: 1, 22: 2, 53: 3, 8080: 4, 443: 4, 631: 5, 1023: 5, 1024: 6}),
    "port category": (s.port_category, "bigint", {None: "NONE", 0: "WELL_KNOWN", 53: "DNS", 80: "WEB", 22: "SSH", 8080: "REGISTERED", 49151: "REGISTERED", 49152: "HIGH"}),
    "args": (s.args_length_bucket, "string", {"": 0, None: 0, "a" * 49: 1, "a" * 50: 2, "a" * 199: 2, "a" * 200: 3, "a" * 1000: 4, "a" * 4999: 4, "a" * 5000: 5, "é" * 25: 2}),
    "sensitivity": (s.path_sensitivity, "string", {"/etc/x": 0, "/tmp/x": 1, "/run/x": 2, "/proc/12/m": 2, "/home/u/.git/c": 3, "/proc/self/m": 4, "/opt/a/.git/c": 5, "/usr/bin/x": 6, "/etc": 6, "": 7, None: 7}),
    "category": (s.path_category, "string", {
        "/home/u/.git/c": "VSCODE_DEV", "/home/u/etc/x": "SENSITIVE_SYS", "/usr/local/sbin/x": "SENSITIVE_SYS", "/proc/1/m": "RUNTIME", "/proc/self/m": "PROC_SELF",
        "/usr/lib/x": "LIBRARY", "/usr/bin/x": "USR_BIN", "/opt/x": "OPT", "/srv/x": "OTHER", "": "NONE", None: "NONE",
    }),
    "log": (s.log_bucket, "bigint", {None: 0, 0: 0, -5: 0, 1: 1, 9: 1, 10: 2, 99: 2, 10**7: 8, 99_999_999: 8, 10**8: 9, 10**12: 9}),
    "components": (lambda c: s.first_components(c, 4), "string", {"/home/u/p/q/r": "/home/u/p/q", "a/b/c": "a/b/c", "/": "/", "": None, None: None}),
    "dirname": (s.dirname, "string", {"/usr/sbin/cron": "/usr/sbin/", "/foo": "/", "foo": "foo", "": None, None: None, "a/": "a/"}),
    "basename": (s.basename, "string", {"/usr/bin/x": "x", "x": "x", "a/": "", None: None}),
    "cwd": (s.normal_cwd, "string", {"/A/b": "/a/b/", "/x/": "/x/", "": "", None: ""}),
    "time": (s.parse_time_ns, "string", {
        "2026-04-19T07:54:00Z": 1776585240000000000, "2026-04-19T07:54:00.1Z": 1776585240100000000, "2026-04-19T07:54:00.1234567899Z": 1776585240123456789,
        "2026-04-19T07:54:00": None, "": None, None: None, "2026-13-40T07:54:00Z": None, "1969-12-31T23:59:59.5Z": -500000000,
    }),
    "leak": (s.leaks_artifact, "string", {"NET_CONNECT:curl:10.0.0.1": True, "FILE_OPEN:/etc/x": True, "FILE_OPEN:curl:OPT": False, None: False}),
    "function code": (s.kprobe_function_code, "string", {"fd_install": 0, "sys_process_vm_writev": 11, None: 12, "x": 13}),
    "event code": (s.event_type_code, "string", {"process_exec": 0, None: 3, "x": 3}),
    "ip": (py.ip_category, "string", {
        "0.0.0.0": "PRIVATE", "192.0.2.1": "PRIVATE", "198.18.0.1": "PRIVATE", "240.0.0.1": "PRIVATE", "255.255.255.255": "PRIVATE", "::": "PRIVATE", "2001:db8::1": "PRIVATE",
        "100.64.0.1": "PUBLIC", "::ffff:127.0.0.1": "LOOPBACK", "::ffff:10.0.0.1": "PRIVATE", "ff02::1": "MULTICAST", "010.0.0.1": "NONE", "": "NONE", None: "NONE", " 8.8.8.8 ": "PUBLIC", "169.254.1.1": "LINK_LOCAL",
    }),
    "hash": (lambda c: py.hash_bucket(c, 256), "string", {"bash": 47, "python3.12": 135, "/home/u/p/q": 70, "bash->curl": 137, "": 0, None: 0}),
    "gzip": (lambda c: s.ratio_bucket(py.gzip_ratio(c)), "string", {"abcd": 5, "a" * 200: 1, "": 0, None: 0}),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    f, kind, cases = CASES[name]
    rows = spark.createDataFrame([(k,) for k in cases], f"x {kind}").select("x", f(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == cases


def test_time_since_parent(spark):
    deltas = {None: 0, -1: 1, 999_999: 1, 10**6: 2, 10**9: 3, 6 * 10**10: 4, 36 * 10**11: 5}
    rows = spark.createDataFrame([(k, 10**15, None if k is None else 10**15 - k) for k in deltas], "k bigint, event_time bigint, parent_start_time bigint")
    assert {r["k"]: r["y"] for r in rows.select("k", s.time_since_bucket().alias("y")).collect()} == deltas


def test_capabilities(spark):
    sizes = {None: 0, 0: 0, 2: 1, 3: 2, 5: 2, 6: 3, 15: 3, 16: 4}
    rows = spark.createDataFrame([(k, None if k is None else ["c"] * k) for k in sizes], "k int, c array<string>")
    assert {r["k"]: r["y"] for r in rows.select("k", s.cap_count_bucket("c").alias("y")).collect()} == sizes


def test_creds_and_flags(spark):
    rows = spark.createDataFrame(
        [(1, 1, ["a"], ["b"], "process_exec"), (1, 2, [], None, "process_exec"), (None, 2, None, ["a"], "process_exec"), (3, 4, ["a", "b"], ["c"], "x")],
        "kp_creds_uid bigint, proc_uid bigint, kp_creds_caps array<string>, proc_cap_effective array<string>, event_type string",
    )
    got = rows.select(s.creds_uid_change(), s.creds_caps_change(), s.same_uid("kp_creds_uid", "proc_uid"), s.setuid_exec("event_type", "proc_cap_effective", "kp_creds_caps")).collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 0), (1, 1, 0, 0), (0, 0, 0, 1), (1, 1, 0, 0)]


def test_token(spark):
    cases = [
        ("PROC_EXEC", "curl", "bash", "OPT", "NONE", "NONE", "PROC_EXEC:bash->curl"), ("NET_CONNECT", "curl", "", "OPT", "PUBLIC", "WEB", "NET_CONNECT:curl:PUBLIC:WEB"),
        ("FILE_OPEN", "", "x", "OPT", "", "", "FILE_OPEN:unknown:OPT"), ("MEM_MAP", "node", None, None, None, None, "MEM_MAP:node"), ("PROC_EXIT", None, None, None, None, None, "PROC_EXIT:unknown"),
    ]
    d = spark.createDataFrame(cases, "a string, b string, c string, d string, e string, f string, want string")
    assert all(r["got"] == r["want"] for r in d.select("want", s.token("a", "b", "c", "d", "e", "f").alias("got")).collect())


def test_entropy(spark):
    r = random.Random(1)
    texts = ["abcd", "-la", "-c 'echo hello world'", "aaa", "ab" * 700, "🙂é" * 3, *["".join(r.choice("abcdé🙂 x") for _ in range(r.randint(1, 80))) for _ in range(50)]]
    got = spark.createDataFrame([(t,) for t in [*texts, "", None]], "x string").select("x", py.entropy("x").alias("h"), s.entropy_bucket(py.entropy("x")).alias("b")).collect()
    for row in got:
        if not row["x"]:
            assert row["h"] is None and row["b"] == 0
            continue
        n = len(row["x"])
        assert abs(row["h"] + sum(c / n * log2(c / n) for c in Counter(row["x"]).values())) < 1e-9
    assert [row["b"] for row in got[:4]] == [2, 1, 2, 1]
