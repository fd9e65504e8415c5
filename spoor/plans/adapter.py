"""Host telemetry made from the ``events`` table, for queries over tables that hold none.

One list of expressions in SQL that Spark and DuckDB both read, so a query and its SQL twin start from the same
rows: every event becomes an exec, an exit or a probe with paths, ports, addresses, ids and capabilities chosen by
its numbers, with nulls, unknown values, self-parents and orphans among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spoor.functions import vocab

_SPARK = {"open": "array(", "close": ")"}
_DUCK = {"open": "[", "close": "]"}


def _pick(index: str, values: list) -> str:
    """CASE on a number: values are SQL literals or expressions, None is null."""
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values) if v is not None)
    return f"CASE {index} {cases} END"


def _text(index: str, values: list[str | None]) -> str:
    return _pick(index, [None if v is None else f"'{v}'" for v in values])


def _list(d: dict, n: int) -> str:
    return d["open"] + ", ".join(f"'CAP_{k}'" for k in range(n)) + d["close"]


PATHS = [
    "/etc/passwd", "/tmp/x", "/run/x", "/proc/12/mem", "/home/u/.git/c", "/proc/self/mem", "/opt/a/.git/c", "/usr/bin/x", "/etc", "", None,
    "/home/u/etc/x", "/usr/local/sbin/x", "/usr/lib/x", "/srv/x", "/var/run/y", "node_modules/z", "/Users/A/b",
]
BINARIES = ["/usr/bin/bash", "/usr/bin/python3.12", "/tmp/payload", "/home/u/.git/c", "/usr/local/sbin/x", "/opt/a/run", "node", "", None]
CWDS = ["/", "", None, "/home/u/p/q/r", "a/b/c", "/proc/12/m", "/proc/self/m", "/etc", "/run/x", "/Users/A/", "/home/u/p", "/opt/b/c/d/e/f"]
ADDRESSES = [
    "127.0.0.1", "10.0.0.1", "172.16.5.4", "172.32.0.1", "192.168.1.1", "169.254.1.1", "8.8.8.8", "100.64.0.1", "224.0.0.1", "0.0.0.0", "192.0.2.1",
    "198.18.0.1", "240.0.0.1", "255.255.255.255", "010.0.0.1", "1.2.3", "", None,
]
PORTS = [None, 0, 22, 53, 80, 443, 8080, 8443, 631, 1023, 1024, 49151, 49152, 65535]


def columns(dialect: str, micros: str) -> dict[str, str]:
    d = _SPARK if dialect == "spark" else _DUCK
    e, u = "event_id", "user_id"
    fn = "kprobe_function_name"
    t = f"({micros}) * 1000"
    half = f"concat('u', CAST(CAST(floor({u} / 2) AS BIGINT) AS STRING))"
    kind = "CASE event_type WHEN 'signup' THEN 'process_exec' WHEN 'error' THEN 'process_exit' WHEN 'view' THEN 'process_kprobe' WHEN 'click' THEN 'process_kprobe' WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'process_exec' ELSE 'process_kprobe' END END"
    probe = _text(f"{e} % 14", [*vocab.KPROBE_FUNCTIONS, "unknown_probe", None])
    name = f"CASE WHEN {kind} = 'process_kprobe' THEN {probe} END"

    def on(f: str, value: str) -> str:
        return f"CASE WHEN ({name}) = '{f}' THEN {value} END"

    caps = lambda i, sizes: _pick(i, [None if n is None else _list(d, n) for n in sizes])
    out = {
        "row_idx": f"CAST({e} AS BIGINT)",
        "event_time": f"CAST({t} AS BIGINT)",
        "event_type": kind,
        "proc_exec_id": f"concat('u', CAST({u} AS STRING))",
        "proc_parent_exec_id": f"CASE WHEN {u} = 0 OR {u} % 13 = 4 THEN NULL WHEN {u} % 37 = 5 THEN concat('u', CAST({u} AS STRING)) WHEN {u} % 41 = 7 THEN concat('gone', CAST({u} AS STRING)) WHEN {u} % 29 = 6 THEN '' ELSE {half} END",
        "parent_exec_id": f"CASE WHEN {u} % 13 = 4 OR {u} % 29 = 6 THEN {half} END",
        "proc_pid": f"CAST({u} AS BIGINT)",
        "proc_binary": _text(f"{u} % 9", BINARIES),
        "parent_binary": _text(f"({u} + 4) % 9", BINARIES),
        "proc_cwd": _text(f"{e} % 12", CWDS),
        "proc_arguments": f"CASE {e} % 6 WHEN 1 THEN '' WHEN 2 THEN '-la' WHEN 3 THEN repeat('é', CAST({e} % 40 AS INT)) WHEN 4 THEN props WHEN 5 THEN repeat(concat(props, ' --flag=', CAST({e} % 1000 AS STRING), ' '), CAST({e} % 300 AS INT)) END",
        "proc_uid": _pick(f"{e} % 8", ["CAST(0 AS BIGINT)", 1, 99, 100, 999, 1000, 1001, None]),
        "parent_uid": _pick(f"{e} % 5", ["CAST(0 AS BIGINT)", 1, 99, 1000, None]),
        "proc_cap_effective": caps(f"{e} % 9", [None, 0, 1, 2, 3, 5, 6, 15, 16]),
        "parent_cap_effective": caps(f"{e} % 4", [None, 0, 2, 3]),
        "proc_start_time": _pick(f"{e} % 9", [None, *[f"({t}) - {x}" for x in (5, 50, 500, 100000, 20000000, 3000000000, 90000000000)], f"({t}) + 7"]),
        "parent_start_time": _pick(f"{e} % 8", [None, f"({t}) + 1", *[f"({t}) - {x}" for x in (999999, 1000000, 1000000000, 59999999999, 60000000000, 3600000000000)]]),
        "proc_in_init_tree": _pick(f"{e} % 3", ["true", "false", None]),
        "proc_is_procfs_walk": f"{kind} = 'process_exec' AND {e} % 4 = 0",
        fn: name,
        "kprobe_policy_name": _text(f"{e} % 8", [*vocab.KPROBE_POLICIES, "other-monitor", None]),
        "kprobe_action": _text(f"{e} % 3", ["KPROBE_ACTION_POST", "KPROBE_ACTION_SIGKILL", None]),
        "kp_sock_family": _text(f"{e} % 4", ["AF_INET", "AF_INET6", "AF_UNIX", None]),
        "kp_sock_daddr": _text(f"{e} % 18", ADDRESSES),
        "kp_sock_dport": _pick(f"{e} % 14", [None, *[f"CAST({p} AS BIGINT)" for p in PORTS[1:]]]),
        "kp_fd_install_path": on("fd_install", _text(f"({e} + {u}) % 18", PATHS)),
        "kp_mmap_path": on("security_mmap_file", _text(f"({e} + {u}) % 18", PATHS)),
        "kp_unlink_path": on("do_unlinkat", _text(f"({e} + {u}) % 18", PATHS)),
        "kp_chmod_path": on("chmod_common", _text(f"({e} + {u}) % 18", PATHS)),
        "kp_fd_install_fd": on("fd_install", f"CAST({e} % 50 AS INT)"),
        "kp_mmap_prot": on("security_mmap_file", f"CAST({e} % 8 AS BIGINT)"),
        "kp_mprotect_prot": on("security_file_mprotect", f"CAST({e} % 8 AS BIGINT)"),
        "kp_creds_uid": on("commit_creds", _pick(f"{e} % 3", ["CAST(0 AS BIGINT)", 1000, None])),
        "kp_creds_caps": on("commit_creds", caps(f"({e} + {u}) % 4", [0, 2, 5, None])),
        "path": _text(f"({e} + {u}) % 18", PATHS),
        "late_time": f"CAST(CASE WHEN {e} % 17 = 3 THEN NULL WHEN {e} % 13 = 5 THEN ({t}) - 7200000000000 ELSE {t} END AS BIGINT)",
    }
    return out


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ntz = isinstance(events.schema["ts"].dataType, T.TimestampNTZType)
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)" if ntz else "unix_micros(ts)"
    return events.selectExpr(*[f"{v} AS {k}" for k, v in columns("spark", micros).items()])


def telemetry_sql() -> str:
    """The body of a CTE with the same rows."""
    cols = columns("duckdb", "epoch_us(ts)")
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + " FROM events"


_ANCHOR = "row_idx % 160 = 0"
_NO = "CAST(floor(row_idx / 160) AS BIGINT)"
INTERVALS_SQL = f"""
SELECT event_time AS start_ns, event_time + 1800000000000 AS end_ns, concat('T', CAST({_NO} % 5 AS STRING)) AS technique_id FROM telemetry WHERE {_ANCHOR}
UNION ALL
SELECT event_time + 600000000000, event_time + 900000000000, 'T9' FROM telemetry WHERE {_ANCHOR} AND {_NO} % 7 = 3
UNION ALL
SELECT event_time, event_time + 300000000000, 'T0' FROM telemetry WHERE {_ANCHOR} AND {_NO} % 11 = 4
"""


def intervals(tel: DataFrame) -> DataFrame:
    """Label intervals: half an hour at every 160th event, some with another inside, some with an equal start."""
    return tel.sparkSession.sql(INTERVALS_SQL.replace("telemetry", "{telemetry}"), telemetry=tel.select("row_idx", "event_time"))
