"""The model table: raw events to 3 identifiers and 33 encoded features, and to 27 behaviour columns more.

All encoders stand in one select; the few Python scalars share one pass to the workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import python as py
from spoor.functions import scalars as s
from spoor.functions import vocab
from spoor.operators.lineage import ancestors, duplicates, process_map, with_lineage
from spoor.operators.windows import delta_previous, process_age
from spoor.sources import schema


def feature_columns(df: DataFrame) -> dict[str, Column]:
    """The 33 encoded features as expressions over the raw columns."""
    have = set(df.columns)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    port = s.port_bucket()
    return {
        "f_event_type": s.event_type_code(), "f_kprobe_function": s.kprobe_function_code(), "f_kprobe_policy": s.kprobe_policy_code(),
        "f_kprobe_action": s.kprobe_action_code(), "f_proc_uid_bucket": s.uid_bucket(), "f_dst_port_bucket": port,
        "f_args_length_bucket": s.args_length_bucket(), "f_cap_count_bucket": s.cap_count_bucket(), "f_path_sens_cwd": s.path_sensitivity("proc_cwd"),
        "f_path_sens_binary": s.path_sensitivity(s.dirname("proc_binary")), "f_path_sens_kp": s.path_sensitivity(s.kprobe_path()),
        "f_proc_name_hash": py.hash_bucket(s.basename("proc_binary"), vocab.NAME_BUCKETS),
        "f_parent_proc_hash": py.hash_bucket(s.basename("parent_binary"), vocab.PARENT_BUCKETS),
        "f_proc_cwd_hash": py.hash_bucket(s.first_components("proc_cwd", 4), vocab.CWD_BUCKETS),
        "f_lineage_bag_hash": py.hash_bucket(s.basename("parent_binary"), vocab.LINEAGE_BUCKETS),
        "f_in_init_tree": s.flag("proc_in_init_tree"), "f_is_procfs_walk": s.flag("proc_is_procfs_walk"), "f_uid_eq_parent": s.same_uid(),
        "f_is_setuid_exec": s.setuid_exec(), "f_args_truncated": s.flag("exec_truncated_args") if "exec_truncated_args" in have else F.lit(0),
        "f_cmdline_entropy": s.entropy_bucket(py.entropy("proc_arguments")), "f_cmdline_compress": s.ratio_bucket(py.gzip_ratio("proc_arguments")),
        "f_time_since_parent_exec": s.time_since_bucket(),
        "f_kp_fd_install_fd_int32": F.coalesce(F.col("kp_fd_install_fd"), F.lit(-1)), "f_kp_fd_install_path_sensitivity": s.path_sensitivity("kp_fd_install_path"),
        "f_kp_mmap_path_sensitivity": s.path_sensitivity("kp_mmap_path"), "f_kp_mmap_prot_uint": zero("kp_mmap_prot"), "f_kp_mprotect_prot_uint": zero("kp_mprotect_prot"),
        "f_kp_commit_creds_uid_change": s.creds_uid_change(), "f_kp_commit_creds_cap_change": s.creds_caps_change(),
        "f_kp_tcp_connect_dst_port_bucket": port, "f_kp_tcp_connect_sock_family": s.sock_family_code(), "f_kp_udp_sendmsg_dport_eq_53": s.is_dns(),
    }


def build_features(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Identifiers and features, in their fixed order, after the columns named in ``keep``."""
    found = feature_columns(events)
    return events.select(*keep, *[c for c in schema.IDS if c not in keep], *[found[c].alias(c) for c in schema.FEATURES])


def with_categories(events: DataFrame) -> DataFrame:
    """Base names, categories and tokens; expects the lineage columns."""
    named = events.withColumns(
        {
            "proc_binary_basename": s.basename_or_empty("proc_binary"), "proc_cwd_normalized": s.normal_cwd(), "_family": s.action_family(),
            "object_category": s.object_category(), "path_category": s.path_category(s.path_to_classify()),
            "dst_ip_category": py.ip_category("kp_sock_daddr"), "dst_port_category": s.port_category(),
        }
    )
    return named.withColumns(
        {
            "process_tree_root_exec_id": F.coalesce("root_ancestor_exec_id", F.lit("")),
            "parent_child_pair": s.parent_child("parent_binary_basename", "proc_binary_basename"),
            "token": s.token("_family", "proc_binary_basename", "parent_binary_basename", "path_category", "dst_ip_category", "dst_port_category"),
        }
    )


def build_behaviour(events: DataFrame, order: list[str], seeds: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 63 columns of the enriched table; ``order`` is the row order of the raw table, and ``seeds`` are raw tables read before it."""
    processes = process_map(events, order, seeds)
    lineage = with_lineage(events, processes, ancestors(processes))
    timed = delta_previous(lineage, order).withColumn("process_age_ns", process_age())
    rich = with_categories(timed)
    found = feature_columns(events)
    codes = {
        "f_action_family": s.action_family_code("_family"), "f_lineage_depth": F.col("lineage_depth"),
        "f_parent_child_pair_hash": py.hash_bucket("parent_child_pair", vocab.PAIR_BUCKETS),
        "f_root_ancestor_basename_hash": py.hash_bucket("root_ancestor_basename", vocab.ROOT_BUCKETS),
        "f_process_tree_id_hash": py.hash_bucket("root_ancestor_exec_id", vocab.TREE_BUCKETS),
        "f_delta_t_log_bucket": s.log_bucket("delta_t_prev_ns"), "f_process_age_log_bucket": s.log_bucket("process_age_ns"),
        "f_path_category": s.path_category_code("path_category"), "f_dst_ip_category": s.ip_category_code("dst_ip_category"),
        "f_dst_port_category": s.port_category_code("dst_port_category"), "f_object_category": s.object_category_code("object_category"),
    }
    ids = [c for c in schema.IDS if c not in keep]
    rest = [codes.get(c, F.col(c)).alias(c) for c in schema.BEHAVIOUR]
    return rich.select(*keep, *ids, *[found[c].alias(c) for c in schema.FEATURES], *rest)


def behaviour_stats(enriched: DataFrame, events: DataFrame, processes: DataFrame) -> DataFrame:
    """One row: rows, processes, conflicting repeats, and how often each lineage flag and a negative delta occurs."""
    flags = ["lineage_parent_fallback_used", "lineage_missing_parent", "lineage_cycle_detected"]
    sums = enriched.agg(F.count("*").alias("rows"), *[F.sum(F.col(c).cast("bigint")).alias(c) for c in flags])
    return sums.crossJoin(processes.agg(F.count("*").alias("unique_processes"))).crossJoin(duplicates(events, processes))
