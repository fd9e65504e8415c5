"""Parsing event lines, tables and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from spoor.sources import jsonl, schema, tables
from spoor.streaming.delta import stream_delta

CONFIG = jsonl.ParserConfig([5], node_name="n1", parser_version="7", sentinel_intervals=[("2026-04-19T08:00:00Z", "2026-04-19T09:00:00Z", "x")])


def process(**kw):
    return {"exec_id": "e1", "pid": 7, "uid": 0, "binary": "/bin/x", "flags": "execve procFS", "ns": {"pid": {"inum": 5}}, **kw}


def kprobe(fn, args, **kw):
    return {"time": "2026-04-19T07:00:00.5Z", "process_kprobe": {"process": process(), "function_name": fn, "args": args, **kw}}


def parsed(spark, events):
    lines = [e if isinstance(e, str) else json.dumps(e) for e in events]
    d = spark.createDataFrame([(x, "f.json", k + 1) for k, x in enumerate(lines)], "value string, _source_file string, _source_line bigint")
    return d, {r["_source_line"]: r for r in jsonl.parse_events(d, CONFIG).collect()}


def test_filters_and_counters(spark):
    events = [
        "", "not json", "[1]", {"other": {}}, {"process_exec": {"process": {}}}, {"process_exec": {"process": process(ns={"pid": {"is_host": True, "inum": 5}})}},
        {"process_exec": {"process": process(ns={})}}, {"process_exec": {"process": process(ns={"pid": {"inum": 6}})}}, {"time": "2026-04-19T08:00:00Z", "process_exec": {"process": process()}},
        {"time": "2026-04-19T09:00:00Z", "process_exec": {"process": process()}}, {"time": "2026-04-19T09:00:00.1Z", "process_exec": {"process": process()}}, {"process_exit": {"process": process(), "status": "3", "signal": "KILL"}},
    ]
    d, got = parsed(spark, events)
    assert sorted(got) == [11, 12]
    c = {r["counter"]: r["n"] for r in jsonl.counters(d, CONFIG).collect()}
    assert c == {
        "errors_json_parse": 1, "drop_wrong_event_type": 2, "drop_no_process": 1, "drop_container_filter_is_host": 1, "drop_container_filter_no_inum": 1, "drop_container_filter_wrong_inum": 1,
        "drop_sentinel_interval": 2, "lines_kept": 2, "kept_process_exec": 1, "kept_process_exit": 1, "kept_process_kprobe": 0, "tagged_procfs_walk_execs": 1, "unparseable_event_time": 1,
    }
    assert got[11]["proc_is_procfs_walk"] and not got[12]["proc_is_procfs_walk"] and got[12]["exit_status"] == 3 and got[12]["exit_signal"] == "KILL"
    assert got[12]["event_time"] is None and got[11]["node_name"] == "n1" and got[11]["parent_pid"] is None and got[11]["proc_cap_effective"] == []
    anyone = jsonl.ParserConfig([], sentinel_intervals=[])
    assert jsonl.parse_events(d, anyone).count() == 5


def test_arguments(spark):
    f = {"file_arg": {"path": "/é", "permission": "-rw"}}
    sock = {"sock_arg": {"family": "AF_INET", "daddr": "1.2.3.4", "dport": "53", "sport": "x", "cookie": 18446744073709551615}}
    _, got = parsed(spark, [
        kprobe("fd_install", [{"int_arg": 3}, f]), kprobe("fd_install", [{"int_arg": "bad"}]), kprobe("security_mmap_file", [f, {"uint_arg": "x", "int_arg": 4}]), kprobe("security_mmap_file", [f, {"size_arg": 4}]),
        kprobe("commit_creds", [{"process_credentials_arg": {"uid": 0, "caps": {"effective": ["A"]}, "user_ns": {"ns": {"inum": 9, "is_host": True}}}}]), kprobe("udp_sendmsg", [{"x": 1}, sock, {"int_arg": 99}]),
        kprobe("do_unlinkat", [{"int_arg": -100}, {"string_arg": "/a"}]), kprobe("do_unlinkat", [{"int_arg": 1}, f]), kprobe("chmod_common", [f, {"int_arg": 493}]),
        kprobe("security_file_mprotect", [f, {"size_arg": 5}, {"int_arg": 7}]), kprobe("sys_ptrace", [{"long_arg": 16}, {"int_arg": 44}]), kprobe("sys_process_vm_writev", [{"long_arg": 45}]), kprobe("other", [f]), kprobe("tcp_connect", None),
    ])
    pick = lambda k, *c: tuple(got[k][x] for x in c)
    assert pick(1, "kp_fd_install_fd", "kp_fd_install_path", "kp_fd_install_permission") == (3, "/é", "-rw")
    assert pick(2, "kp_fd_install_fd", "kp_fd_install_path") == (None, None)
    assert pick(3, "kp_mmap_path", "kp_mmap_prot") == ("/é", None) and got[4]["kp_mmap_prot"] == 4
    assert pick(5, "kp_creds_uid", "kp_creds_gid", "kp_creds_caps", "kp_creds_user_ns_is_host") == (0, None, ["A"], True) and int(got[5]["kp_creds_user_ns_inum"]) == 9
    assert pick(6, "kp_sock_daddr", "kp_sock_dport", "kp_sock_sport", "kp_sock_cookie", "kp_msg_length") == ("1.2.3.4", 53, None, "18446744073709551615", 99)
    assert pick(7, "kp_unlink_dirfd", "kp_unlink_path") == (-100, "/a") and got[8]["kp_unlink_path"] == "/é" and got[9]["kp_chmod_mode"] == 493
    assert tuple(map(int, pick(10, "kp_mprotect_reqprot", "kp_mprotect_prot"))) == (5, 7) and pick(11, "kp_ptrace_request", "kp_ptrace_target_pid") == (16, 44) and got[12]["kp_pvw_target_pid"] == 45
    assert got[13]["kp_fd_install_path"] is None and json.loads(got[13]["kprobe_args_json"]) == [f] and got[14]["kprobe_args_json"] == "[]"
    assert got[1]["event_time"] == 1776582000500000000


def test_files_and_line_numbers(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(f"line {k}" for k in range(1, 51)))
    with gzip.open(tmp_path / "b.json.gz", "wt") as z:
        z.write("one\ntwo\n")
    got = {(r["_source_file"], r["_source_line"]): r["value"] for r in jsonl.read_lines(spark, str(tmp_path)).collect()}
    assert got[("a.json", 1)] == "line 1" and got[("a.json", 50)] == "line 50" and got[("b.json.gz", 2)] == "two" and len(got) == 52


def test_files_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text("1\n\n3\n")
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json.gz").write_bytes(b"not gzip at all")
    with gzip.open(tmp_path / "d.json.gz", "wt") as z:
        z.write("one\ntwo\n")
    got = {r["counter"]: r["n"] for r in jsonl.file_counters(spark, str(tmp_path)).collect()}
    assert got == {"files_read": 3, "files_failed": 1, "lines_read": 5}


def test_paths_of_the_input_are_kept(spark, tmp_path):
    for name in ("x/1", "x/2", "y/1"):
        spark.range(3).write.parquet(str(tmp_path / "in" / name))
    got = tables.read_events(spark, str(tmp_path / "in"), recursive=True, source=str(tmp_path / "in"))
    tables.write_table(got, str(tmp_path / "out"), partition=["source_path"])
    paths = [r["source_path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(paths) == 9 and {p.rsplit("/", 1)[0] for p in paths} == {"x/1", "x/2", "y/1"}


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("target_pid_ns_inum: 12\nhost_id: h\n")
    c = jsonl.ParserConfig.from_yaml(tmp_path / "c.yaml")
    assert c.target_pid_ns_inums == [12] and c.node_name == "h" and c.bounds_ns == []
    with pytest.raises(ValueError):
        jsonl.ParserConfig(sentinel_intervals=[("nonsense", "2026-04-19T09:00:00Z", "x")])


def test_tables_keep_nanoseconds_and_order(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"event_time": pa.array([3, 1, 2], pa.timestamp("ns", tz="UTC")), "v": [30, 10, 20], "__index": [0, 1, 2]}), tmp_path / "t.parquet")
    d = tables.read_events(spark, str(tmp_path))
    assert d.columns == ["event_time", "v"]
    assert [(r["event_time"], r["v"], r["row_idx"]) for r in tables.sorted_events(d).orderBy("row_idx").collect()] == [(1, 10, 0), (2, 20, 1), (3, 30, 2)]
    tables.write_table(d.limit(0), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).columns == ["event_time", "v"]
    tables.write_csv(spark.createDataFrame([("a", 1 / 3)], "k string, v double"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).head()["v"] == "0.333333"
    x = spark.createDataFrame([(1, 2, 3.5)], "event_time bigint, a int, b double")
    assert tables.feature_matrix(x, ["a", "b"]).head()["x"] == [2.0, 3.5]


def test_stream_carries_state_between_batches(spark, tmp_path):
    rows = [(0, "p", 100), (1, "p", 90), (2, "q", 5), (3, "p", None), (4, "p", 95), (5, None, 7)]
    cols = "row_idx long, proc_exec_id string, event_time long"
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, cols).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_delta(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["row_idx"]: (r["delta_t_prev_ns"], r["negative_delta"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (None, False), 1: (0, True), 2: (None, False), 3: (None, False), 4: (5, False), 5: (None, False)}


def test_schema_is_complete():
    assert len(schema.RAW_COLUMNS) == len({c for c, _ in schema.RAW_COLUMNS}) == 126
