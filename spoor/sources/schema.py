"""The raw event schema: 126 columns, in their fixed order, with Spark types.

Unsigned 32-bit numbers are bigint, unsigned 64-bit ones decimal(20,0), times bigint nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import types as T

NAMESPACES = ["pid", "mnt", "net", "user", "uts", "ipc", "cgroup"]
HOST_FLAGS = ["pid", "user", "time"]
CREDENTIALS = ["uid", "gid", "euid", "egid", "suid", "sgid", "fsuid", "fsgid"]
CAPABILITIES = ["permitted", "effective", "inheritable"]
U64 = "decimal(20,0)"

_ENVELOPE = [("event_type", "string"), ("event_time", "bigint"), ("node_name", "string")]
_PROCESS = [
    ("exec_id", "string"), ("parent_exec_id", "string"), ("pid", "bigint"), ("tid", "bigint"), ("uid", "bigint"), ("auid", "bigint"),
    ("binary", "string"), ("arguments", "string"), ("cwd", "string"), ("flags", "string"), ("start_time", "bigint"), ("in_init_tree", "boolean"),
    ("refcnt", "bigint"), ("is_procfs_walk", "boolean"), ("flag_execve", "boolean"), ("flag_clone", "boolean"), ("flag_rootcwd", "boolean"),
    *[(f"cap_{c}", "array<string>") for c in CAPABILITIES],
    *[(f"ns_{n}_inum", U64) for n in NAMESPACES],
    *[(f"ns_{n}_is_host", "boolean") for n in HOST_FLAGS],
    *[(f"creds_{c}", "bigint") for c in CREDENTIALS],
]
_SPECIFIC = [
    ("exit_status", "int"), ("exit_signal", "string"), ("kprobe_function_name", "string"), ("kprobe_policy_name", "string"),
    ("kprobe_action", "string"), ("kprobe_return_action", "string"),
]
_ARGUMENTS = [
    ("kp_fd_install_fd", "int"), ("kp_fd_install_path", "string"), ("kp_fd_install_permission", "string"),
    ("kp_mmap_path", "string"), ("kp_mmap_permission", "string"), ("kp_mmap_prot", "bigint"),
    *[(f"kp_creds_{c}", "bigint") for c in CREDENTIALS],
    ("kp_creds_caps", "array<string>"), ("kp_creds_user_ns_inum", U64), ("kp_creds_user_ns_is_host", "boolean"),
    ("kp_sock_family", "string"), ("kp_sock_type", "string"), ("kp_sock_protocol", "string"), ("kp_sock_saddr", "string"), ("kp_sock_daddr", "string"),
    ("kp_sock_sport", "bigint"), ("kp_sock_dport", "bigint"), ("kp_sock_state", "string"), ("kp_sock_cookie", "string"),
    ("kp_msg_length", "int"), ("kp_unlink_dirfd", "int"), ("kp_unlink_path", "string"),
    ("kp_chmod_path", "string"), ("kp_chmod_permission_before", "string"), ("kp_chmod_mode", "bigint"),
    ("kp_mprotect_reqprot", U64), ("kp_mprotect_prot", U64), ("kp_ptrace_request", "bigint"), ("kp_ptrace_target_pid", "int"), ("kp_pvw_target_pid", "int"),
    ("kprobe_args_json", "string"),
]
_PROVENANCE = [("_source_file", "string"), ("_source_line", "bigint"), ("_parser_version", "string")]

PROCESS_COLUMNS = _PROCESS
RAW_COLUMNS = [
    *_ENVELOPE, *[(f"{p}{c}", t) for p in ("proc_", "parent_") for c, t in _PROCESS], *_SPECIFIC, *_ARGUMENTS, *_PROVENANCE,
]
RAW_TYPES = dict(RAW_COLUMNS)

#: Identifiers and encoded features of the model table, in their fixed order.
IDS = ["event_time", "proc_exec_id", "proc_pid"]
FEATURES = [
    "f_event_type", "f_kprobe_function", "f_kprobe_policy", "f_kprobe_action", "f_proc_uid_bucket",
    "f_dst_port_bucket", "f_args_length_bucket", "f_cap_count_bucket", "f_path_sens_cwd", "f_path_sens_binary", "f_path_sens_kp",
    "f_proc_name_hash", "f_parent_proc_hash", "f_proc_cwd_hash", "f_lineage_bag_hash",
    "f_in_init_tree", "f_is_procfs_walk", "f_uid_eq_parent", "f_is_setuid_exec", "f_args_truncated",
    "f_cmdline_entropy", "f_cmdline_compress", "f_time_since_parent_exec",
    "f_kp_fd_install_fd_int32", "f_kp_fd_install_path_sensitivity", "f_kp_mmap_path_sensitivity", "f_kp_mmap_prot_uint", "f_kp_mprotect_prot_uint",
    "f_kp_commit_creds_uid_change", "f_kp_commit_creds_cap_change", "f_kp_tcp_connect_dst_port_bucket", "f_kp_tcp_connect_sock_family", "f_kp_udp_sendmsg_dport_eq_53",
]
BEHAVIOUR_CODES = [
    "f_action_family", "f_lineage_depth", "f_parent_child_pair_hash", "f_root_ancestor_basename_hash", "f_process_tree_id_hash",
    "f_delta_t_log_bucket", "f_process_age_log_bucket", "f_path_category", "f_dst_ip_category", "f_dst_port_category", "f_object_category",
]
BEHAVIOUR = [
    "proc_binary_basename", "parent_binary_basename", "proc_cwd_normalized", "root_ancestor_basename", "process_tree_root_exec_id", "parent_child_pair",
    "path_category", "dst_ip_category", "dst_port_category", "object_category", "lineage_parent_fallback_used", "lineage_missing_parent", "lineage_cycle_detected",
    "token", "delta_t_prev_ns", "process_age_ns", *BEHAVIOUR_CODES,
]

HASHED = [
    "f_proc_name_hash", "f_parent_proc_hash", "f_proc_cwd_hash", "f_lineage_bag_hash",
    "f_parent_child_pair_hash", "f_root_ancestor_basename_hash", "f_process_tree_id_hash",
]
#: Model inputs read as categories: (column, cardinality, embedding width).
EMBEDDED = [
    ("f_event_type", 4, 8), ("f_kprobe_function", 14, 16), ("f_kprobe_policy", 8, 8), ("f_kprobe_action", 3, 4), ("f_proc_uid_bucket", 5, 4),
    ("f_dst_port_bucket", 7, 4), ("f_args_length_bucket", 6, 4), ("f_cap_count_bucket", 5, 4), ("f_path_sens_cwd", 8, 8), ("f_path_sens_binary", 8, 8),
    ("f_path_sens_kp", 8, 8), ("f_proc_name_hash", 2048, 32), ("f_parent_proc_hash", 1024, 32), ("f_proc_cwd_hash", 4096, 16), ("f_lineage_bag_hash", 256, 16),
    ("f_cmdline_entropy", 6, 4), ("f_cmdline_compress", 6, 4), ("f_time_since_parent_exec", 6, 4), ("f_kp_fd_install_path_sensitivity", 8, 4),
    ("f_kp_mmap_path_sensitivity", 8, 4), ("f_kp_tcp_connect_dst_port_bucket", 7, 4), ("f_kp_tcp_connect_sock_family", 4, 4),
    ("f_action_family", 15, 8), ("f_lineage_depth", 16, 4), ("f_parent_child_pair_hash", 1024, 16), ("f_root_ancestor_basename_hash", 1024, 8),
    ("f_process_tree_id_hash", 4096, 8), ("f_delta_t_log_bucket", 10, 4), ("f_process_age_log_bucket", 10, 4), ("f_path_category", 11, 4),
    ("f_dst_ip_category", 6, 4), ("f_dst_port_category", 7, 4), ("f_object_category", 8, 4),
]
#: Model inputs read as numbers: (column, divisor).
NUMERIC = [
    ("f_is_procfs_walk", 1.0), ("f_uid_eq_parent", 1.0), ("f_is_setuid_exec", 1.0), ("f_kp_commit_creds_uid_change", 1.0), ("f_kp_commit_creds_cap_change", 1.0),
    ("f_kp_udp_sendmsg_dport_eq_53", 1.0), ("f_kp_fd_install_fd_int32", 1024.0), ("f_kp_mmap_prot_uint", 256.0), ("f_kp_mprotect_prot_uint", 256.0),
]


def embedded(feature_set: str = "rich") -> list[tuple[str, int, int]]:
    if feature_set not in ("rich", "flat"):
        raise ValueError(f"feature_set is 'rich' or 'flat', not {feature_set!r}")
    return [e for e in EMBEDDED if feature_set == "rich" or e[0] not in HASHED]


def model_columns(feature_set: str = "rich") -> list[str]:
    return [e[0] for e in embedded(feature_set)] + [c for c, _ in NUMERIC]


def input_width(feature_set: str = "rich") -> int:
    return sum(e[2] for e in embedded(feature_set)) + len(NUMERIC)


def raw_schema() -> T.StructType:
    return T._parse_datatype_string(", ".join(f"`{c}` {t}" for c, t in RAW_COLUMNS))


PROCESS_KEYS = [
    "exec_id", "parent_exec_id", "pid", "tid", "uid", "auid", "binary", "arguments", "cwd", "flags", "start_time", "in_init_tree", "refcnt", "cap", "ns", "process_credentials",
]
_PROC_JSON = (
    "struct<exec_id:string,parent_exec_id:string,pid:string,tid:string,uid:string,auid:string,binary:string,arguments:string,cwd:string,flags:string,"
    "start_time:string,in_init_tree:string,refcnt:string,cap:struct<" + ",".join(f"{c}:array<string>" for c in CAPABILITIES) + ">,ns:struct<"
    + ",".join(f"{n}:struct<inum:string,is_host:string>" for n in [*NAMESPACES, "time"]) + ">,process_credentials:struct<" + ",".join(f"{c}:string" for c in CREDENTIALS) + ">>"
)
#: What is read of an event line. Scalars are read as text and cast one by one, so one bad value cannot spoil a row; args stay raw.
EVENT_JSON = (
    "struct<time:string,node_name:string,"
    f"process_exec:struct<process:{_PROC_JSON},parent:{_PROC_JSON}>,"
    f"process_exit:struct<process:{_PROC_JSON},parent:{_PROC_JSON},status:string,signal:string>,"
    f"process_kprobe:struct<process:{_PROC_JSON},parent:{_PROC_JSON},function_name:string,policy_name:string,action:string,return_action:string,args:string>>"
)
