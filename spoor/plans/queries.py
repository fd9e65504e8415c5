"""Queries over the adapter's telemetry, one per group of operators, with their SQL twins."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import python as py
from spoor.functions import scalars as s
from spoor.functions import vocab
from spoor.operators import boosted, filters, forest, intervals, lineage, metrics, ngram, order, seqnet, windows
from spoor.plans import adapter, evaluate, features
from spoor.sources import jsonl, schema, tables
from spoor.streaming.delta import stream_delta

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a function under its name, and SQL that starts from ``telemetry`` and the CTEs named."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: longs(f(spark, sf_dir))
        if sql:
            parts = ["telemetry AS (" + adapter.telemetry_sql() + ")", *[f"{c} AS ({CTES[c]})" for c in ctes]]
            SQL[f.__name__] = "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql
        return f

    return add


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, floats as double, so that types do not differ between engines."""
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double", "decimal(20,0)": "bigint"}
    return df.select(*[F.col(c).cast(kinds[t]).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def b(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def case(cond_values: list[tuple[str, object]], otherwise: object) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {c} THEN {lit(v)}" for c, v in cond_values) + f" ELSE {lit(otherwise)} END"


# ---- SQL of the scalar encoders, written apart from the column functions


def sql_vocab(c: str, values: list[str], null: int, other: int) -> str:
    return case([(f"{c} IS NULL", null), *[(f"{c} = '{v}'", k) for k, v in enumerate(values)]], other)


def sql_sensitivity(c: str) -> str:
    tests = [
        ("starts_with({0}, '/etc/') OR starts_with({0}, '/root/') OR starts_with({0}, '/boot/') OR starts_with({0}, '/usr/sbin/') OR starts_with({0}, '/sbin/')", 0),
        ("starts_with({0}, '/tmp/') OR starts_with({0}, '/var/tmp/') OR starts_with({0}, '/dev/shm/')", 1),
        ("starts_with({0}, '/var/run/') OR starts_with({0}, '/run/') OR regexp_matches({0}, '^/proc/[0-9]+/')", 2),
        ("starts_with({0}, '/home/') OR starts_with({0}, '/Users/')", 3), ("starts_with({0}, '/proc/self/')", 4),
        ("contains({0}, '.vscode-server/') OR contains({0}, 'node_modules/') OR contains({0}, '.git/')", 5),
    ]
    return case([(f"({c}) IS NULL OR ({c}) = ''", 7), *[(t.format(f"({c})"), k) for t, k in tests]], 6)


def sql_path_category(c: str) -> str:
    found = [(" OR ".join(f"contains({c}, '{p}')" for p in parts), name) for name, parts in vocab.PATH_PARTS]
    return case([(f"{c} IS NULL OR {c} = ''", "NONE"), *found], "OTHER")


PORT_BUCKET = case([("kp_sock_dport IS NULL", 0), ("kp_sock_dport = 0", 1), ("kp_sock_dport = 22", 2), ("kp_sock_dport = 53", 3), ("kp_sock_dport IN (80, 443, 8080, 8443)", 4), ("kp_sock_dport BETWEEN 1 AND 1023", 5)], 6)
PORT_CATEGORY = case([("kp_sock_dport IS NULL", "NONE"), ("kp_sock_dport = 53", "DNS"), ("kp_sock_dport IN (80, 443)", "WEB"), ("kp_sock_dport = 22", "SSH"), ("kp_sock_dport < 1024", "WELL_KNOWN"), ("kp_sock_dport < 49152", "REGISTERED")], "HIGH")
FAMILY = case([("event_type = 'process_exec'", "PROC_EXEC"), ("event_type = 'process_exit'", "PROC_EXIT"), *[(f"event_type = 'process_kprobe' AND kprobe_function_name = '{k}'", v) for k, v in vocab.KPROBE_ACTION.items()]], "OTHER")
OBJECT = case([("event_type IS NULL", "NONE"), ("event_type IN ('process_exec', 'process_exit')", "PROCESS"), *[(f"event_type = 'process_kprobe' AND kprobe_function_name = '{k}'", v) for k, v in vocab.KPROBE_OBJECT.items()]], "OTHER")
BASE = "coalesce(regexp_extract({0}, '[^/]*$'), '')"
KP_PATH = "coalesce(kp_fd_install_path, kp_mmap_path, kp_unlink_path, kp_chmod_path)"
CHOSEN = f"coalesce(nullif({KP_PATH}, ''), CASE WHEN event_type = 'process_exec' THEN nullif(proc_binary, '') END, proc_cwd)"
LOG_BUCKET = "CASE WHEN {0} IS NULL OR {0} <= 0 THEN 0 ELSE least(length(CAST({0} AS VARCHAR)), 9) END"
#: IPv4 by ranges, in the order of the rules; anything that is no address is NONE.
_IP4 = "regexp_matches(a, '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$')"
_N = "(CAST(split_part(a, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(a, '.', 2) AS BIGINT) * 65536 + CAST(split_part(a, '.', 3) AS BIGINT) * 256 + CAST(split_part(a, '.', 4) AS BIGINT))"


def _net(cidr: str) -> str:
    base, bits = cidr.split("/")
    n = sum(int(x) << 8 * (3 - k) for k, x in enumerate(base.split(".")))
    return f"{_N} BETWEEN {n} AND {n + (1 << 32 - int(bits)) - 1}"


#: Private ranges of Python 3.13, and the global ones within them.
_PRIVATE = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
_GLOBAL = ["192.0.0.9/32", "192.0.0.10/32"]
IP_CATEGORY = (
    f"CASE WHEN a IS NULL OR NOT {_IP4} THEN 'NONE' WHEN {_net('127.0.0.0/8')} THEN 'LOOPBACK' WHEN {_net('169.254.0.0/16')} THEN 'LINK_LOCAL' "
    f"WHEN ({' OR '.join(_net(x) for x in _PRIVATE)}) AND NOT ({' OR '.join(_net(x) for x in _GLOBAL)}) THEN 'PRIVATE' WHEN {_net('224.0.0.0/4')} THEN 'MULTICAST' ELSE 'PUBLIC' END"
)
CTES = {
    "intervals": adapter.INTERVALS_SQL,
    "cut_intervals": "SELECT *, least(end_ns, coalesce(lead(start_ns) OVER (ORDER BY start_ns, end_ns, technique_id), end_ns)) AS eff_end, row_number() OVER (ORDER BY start_ns, end_ns, technique_id) - 1 AS k FROM intervals",
    "labelled": "SELECT t.*, i.technique_id, i.start_ns IS NOT NULL AS is_attack, coalesce(i.k, -1) AS trial_idx FROM telemetry t LEFT JOIN cut_intervals i ON t.event_time >= i.start_ns AND t.event_time < i.eff_end",
    "scored": "SELECT row_idx, event_time, is_attack, technique_id, trial_idx, ((row_idx * 7919) % 997 + CASE WHEN is_attack THEN 150 ELSE 0 END) / 1000.0::DOUBLE AS score FROM labelled",
    "hist": "SELECT score, sum(is_attack::INT) AS pos, sum(1 - is_attack::INT) AS neg FROM scored GROUP BY score",
    "curve": "SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n, lead(pos) OVER (ORDER BY score DESC) AS pos2, lead(neg) OVER (ORDER BY score DESC) AS neg2 FROM hist WINDOW w AS (ORDER BY score DESC)",
    "win": "SELECT w, t.* FROM scored t, generate_series(0, (SELECT (count(*) - 128) // 32 FROM telemetry)) AS g(w) WHERE t.row_idx BETWEEN w * 32 AND w * 32 + 127",
    "walk": "SELECT exec_id, exec_id AS cur, 0 AS depth, false AS cycle, [exec_id] AS seen, true AS going FROM procs UNION ALL SELECT w.exec_id, p.parent, w.depth + 1, list_contains(w.seen, p.parent) OR w.depth + 1 >= 64, list_append(w.seen, p.parent), NOT (list_contains(w.seen, p.parent) OR w.depth + 1 >= 64) FROM walk w JOIN procs p ON p.exec_id = w.cur JOIN procs q ON q.exec_id = p.parent WHERE w.going",
    "walked": "SELECT exec_id, arg_max(cur, depth) AS root, least(max(depth), 15) AS depth, bool_or(cycle) AS cycle FROM walk GROUP BY exec_id",
    "seq": "SELECT row_idx, proc_exec_id, is_attack, f AS w, lag(f, 1) OVER o AS p1, lag(f, 2) OVER o AS p2 FROM (SELECT *, coalesce(event_type, 'None') || ':' || coalesce(kprobe_function_name, '') AS f FROM labelled) WINDOW o AS (PARTITION BY proc_exec_id ORDER BY event_time, row_idx)",
    "bseq": "SELECT f AS w, lag(f, 1) OVER o AS p1, lag(f, 2) OVER o AS p2 FROM (SELECT *, coalesce(event_type, 'None') || ':' || coalesce(kprobe_function_name, '') AS f FROM labelled WHERE NOT is_attack) WINDOW o AS (PARTITION BY proc_exec_id ORDER BY event_time, row_idx)",
}
CTES["procs"] = f"SELECT proc_exec_id AS exec_id, arg_min_null(coalesce(nullif(proc_parent_exec_id, ''), parent_exec_id), row_idx) AS parent, arg_min({BASE.format('proc_binary')}, row_idx) AS basename FROM telemetry WHERE proc_exec_id <> '' GROUP BY proc_exec_id"
LABELS = ("intervals", "cut_intervals", "labelled")
SCORES = (*LABELS, "scored")
CURVE = (*SCORES, "hist", "curve")


# ---- shared inputs on the Spark side


def tel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.telemetry(spark, sf_dir)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tel(spark, sf_dir)
    found = adapter.intervals(t)
    return intervals.trial_membership(intervals.label_events(t, found), found)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ((F.col("row_idx") * 7919) % 997 + F.when(F.col("is_attack"), 150).otherwise(0)) / F.lit(1000.0)
    return labelled(spark, sf_dir).select("row_idx", "event_time", "is_attack", "technique_id", "trial_idx", base.alias("score"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_histogram(scored(spark, sf_dir))


def n_rows(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()


# ---- flagship and scalars


@query(f"SELECT {FAMILY} AS action_family, {b(PORT_BUCKET, 'dst_port_bucket')}, count(*) AS n FROM telemetry GROUP BY ALL")
def q_action_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tel(spark, sf_dir)
    return t.groupBy(s.action_family().alias("action_family"), s.port_bucket().alias("dst_port_bucket")).agg(F.count("*").alias("n"))


@query(
    "SELECT row_idx, " + ", ".join([
        b(sql_vocab("event_type", vocab.EVENT_TYPES, 3, 3), "event_code"), b(sql_vocab("kprobe_function_name", vocab.KPROBE_FUNCTIONS, 12, 13), "function_code"),
        b(sql_vocab("kprobe_policy_name", vocab.KPROBE_POLICIES, 6, 7), "policy_code"), b(sql_vocab("kprobe_action", vocab.KPROBE_ACTIONS, 1, 2), "action_code"),
        b(sql_vocab("kp_sock_family", vocab.SOCK_FAMILIES, 2, 3), "sock_code"), b(sql_vocab(FAMILY, vocab.ACTION_FAMILIES, 14, 14), "family_code"), b(sql_vocab(OBJECT, vocab.OBJECT_CATEGORIES, 6, 6), "object_code"),
    ]) + " FROM telemetry"
)
def q_vocab_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select(
        "row_idx", s.event_type_code().alias("event_code"), s.kprobe_function_code().alias("function_code"), s.kprobe_policy_code().alias("policy_code"),
        s.kprobe_action_code().alias("action_code"), s.sock_family_code().alias("sock_code"), s.action_family_code(s.action_family()).alias("family_code"),
        s.object_category_code(s.object_category()).alias("object_code"),
    )


@query("SELECT row_idx, " + b(case([("proc_uid = 0", 0), ("proc_uid = 1000", 1), ("proc_uid BETWEEN 1 AND 99", 2), ("proc_uid BETWEEN 100 AND 999", 3)], 4), "uid_bucket") + " FROM telemetry")
def q_uid_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("row_idx", s.uid_bucket().alias("uid_bucket"))


@query(f"SELECT row_idx, {b(PORT_BUCKET, 'port_bucket')} FROM telemetry")
def q_port_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("row_idx", s.port_bucket().alias("port_bucket"))


@query(f"SELECT row_idx, {PORT_CATEGORY} AS port_category, {b(sql_vocab(PORT_CATEGORY, vocab.PORT_CATEGORIES, 6, 6), 'code')} FROM telemetry")
def q_port_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("row_idx", s.port_category().alias("port_category"), s.port_category_code(s.port_category()).alias("code"))


_BYTES = "coalesce(strlen(proc_arguments), 0)"


@query("SELECT row_idx, " + b(case([(f"{_BYTES} = 0", 0), (f"{_BYTES} < 50", 1), (f"{_BYTES} < 200", 2), (f"{_BYTES} < 1000", 3), (f"{_BYTES} < 5000", 4)], 5), "args_bucket") + " FROM telemetry")
def q_args_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("row_idx", s.args_length_bucket().alias("args_bucket"))


_CAPS = "coalesce(len(proc_cap_effective), 0)"


@query("SELECT row_idx, " + b(case([(f"{_CAPS} = 0", 0), (f"{_CAPS} <= 2", 1), (f"{_CAPS} <= 5", 2), (f"{_CAPS} <= 15", 3)], 4), "cap_bucket") + " FROM telemetry")
def q_cap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("row_idx", s.cap_count_bucket().alias("cap_bucket"))


_DIR = "CASE WHEN proc_binary = '' THEN NULL WHEN contains(proc_binary, '/') THEN regexp_extract(proc_binary, '^(.*/)[^/]*$', 1) ELSE proc_binary END"


@query(f"SELECT row_idx, {b(sql_sensitivity('path'), 'of_path')}, {b(sql_sensitivity('proc_cwd'), 'of_cwd')}, {b(sql_sensitivity(_DIR), 'of_binary')}, {b(sql_sensitivity(KP_PATH), 'of_probe')} FROM telemetry")
def q_path_sens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select(
        "row_idx", s.path_sensitivity("path").alias("of_path"), s.path_sensitivity("proc_cwd").alias("of_cwd"),
        s.path_sensitivity(s.dirname("proc_binary")).alias("of_binary"), s.path_sensitivity(s.kprobe_path()).alias("of_probe"),
    )


@query(f"SELECT row_idx, {sql_path_category('path')} AS of_path, {sql_path_category('chosen')} AS of_chosen, {b(sql_vocab(sql_path_category('chosen'), vocab.PATH_CATEGORIES, 9, 9), 'code')} FROM (SELECT *, {CHOSEN} AS chosen FROM telemetry)")
def q_path_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = s.path_category(s.path_to_classify())
    return tel(spark, sf_dir).select("row_idx", s.path_category("path").alias("of_path"), c.alias("of_chosen"), s.path_category_code(c).alias("code"))


@query(
    f"SELECT row_idx, regexp_extract(path, '[^/]*$') AS base, {_DIR.replace('proc_binary', 'path')} AS dir, {BASE.format('path')} AS base_or_empty, "
    "CASE WHEN path = '' THEN NULL WHEN starts_with(path, '/') THEN '/' || array_to_string(string_split(substr(path, 2), '/')[1:2], '/') ELSE array_to_string(string_split(path, '/')[1:2], '/') END AS head FROM telemetry"
)
def q_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select(
        "row_idx", s.basename("path").alias("base"), s.dirname("path").alias("dir"), s.basename_or_empty("path").alias("base_or_empty"), s.first_components("path", 2).alias("head")
    )


@query(
    "SELECT row_idx, " + ", ".join([
        b("coalesce(proc_in_init_tree, false)", "in_init_tree"), b("coalesce(proc_is_procfs_walk, false)", "procfs"), b("coalesce(proc_uid = parent_uid, false)", "uid_eq_parent"),
        b("coalesce(event_type = 'process_exec', false) AND coalesce(len(proc_cap_effective), 0) > 0 AND coalesce(len(parent_cap_effective), 0) = 0", "setuid_exec"),
    ]) + " FROM telemetry"
)
def q_bool_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select(
        "row_idx", s.flag("proc_in_init_tree").alias("in_init_tree"), s.flag("proc_is_procfs_walk").alias("procfs"), s.same_uid().alias("uid_eq_parent"), s.setuid_exec().alias("setuid_exec")
    )


_D = "(event_time - parent_start_time)"


@query("SELECT row_idx, " + b(case([(f"{_D} IS NULL", 0), (f"{_D} < 1000000", 1), (f"{_D} < 1000000000", 2), (f"{_D} < 60000000000", 3), (f"{_D} < 3600000000000", 4)], 5), "time_bucket") + " FROM telemetry")
def q_time_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("row_idx", s.time_since_bucket().alias("time_bucket"))


@query("SELECT row_idx, event_time - proc_start_time AS age, " + b(LOG_BUCKET.format("(event_time - proc_start_time)"), "age_bucket") + " FROM telemetry")
def q_log_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = windows.process_age()
    return tel(spark, sf_dir).select("row_idx", age.alias("age"), s.log_bucket(age).alias("age_bucket"))


@query("SELECT row_idx, CASE WHEN coalesce(proc_cwd, '') = '' THEN '' WHEN ends_with(proc_cwd, '/') THEN lower(proc_cwd) ELSE lower(proc_cwd) || '/' END AS cwd FROM telemetry")
def q_cwd_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("row_idx", s.normal_cwd().alias("cwd"))


_TOKEN = (
    f"SELECT row_idx, CASE WHEN f = 'PROC_EXEC' THEN 'PROC_EXEC:' || q || '->' || p WHEN starts_with(f, 'NET_') THEN f || ':' || p || ':' || ip || ':' || port "
    f"WHEN starts_with(f, 'FILE_') THEN f || ':' || p || ':' || pc ELSE f || ':' || p END AS token FROM (SELECT row_idx, {FAMILY} AS f, coalesce(nullif({BASE.format('proc_binary')}, ''), 'unknown') AS p, "
    f"coalesce(nullif({BASE.format('parent_binary')}, ''), 'unknown') AS q, {sql_path_category('chosen')} AS pc, {IP_CATEGORY} AS ip, {PORT_CATEGORY} AS port FROM (SELECT *, {CHOSEN} AS chosen, kp_sock_daddr AS a FROM telemetry))"
)


@query(f"SELECT row_idx, token, regexp_matches(token, '{vocab.RAW_IP}') OR regexp_matches(token, '{vocab.RAW_PATH}') AS leaks FROM ({_TOKEN})")
def q_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tel(spark, sf_dir).select(
        "row_idx",
        s.token(
            s.action_family(), s.basename_or_empty("proc_binary"), s.basename_or_empty("parent_binary"), s.path_category(s.path_to_classify()), py.ip_category("kp_sock_daddr"), s.port_category()
        ).alias("token"),
    )
    return t.withColumn("leaks", s.leaks_artifact("token"))


@query(
    "SELECT row_idx, " + ", ".join([
        b("coalesce(kp_fd_install_fd, -1)", "fd"), b(sql_sensitivity("kp_fd_install_path"), "fd_path"), b(sql_sensitivity("kp_mmap_path"), "mmap_path"), b("coalesce(kp_mmap_prot, 0)", "mmap_prot"),
        b("coalesce(kp_mprotect_prot, 0)", "mprotect_prot"), b("coalesce(kp_creds_uid <> proc_uid, false)", "uid_change"),
        b("kp_creds_caps IS NOT NULL AND len(kp_creds_caps) <> coalesce(len(proc_cap_effective), -1)", "cap_change"), b("coalesce(kp_sock_dport = 53, false)", "dns"),
    ]) + " FROM telemetry"
)
def q_kp_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.feature_columns(t := tel(spark, sf_dir))
    names = {
        "fd": "f_kp_fd_install_fd_int32", "fd_path": "f_kp_fd_install_path_sensitivity", "mmap_path": "f_kp_mmap_path_sensitivity", "mmap_prot": "f_kp_mmap_prot_uint",
        "mprotect_prot": "f_kp_mprotect_prot_uint", "uid_change": "f_kp_commit_creds_uid_change", "cap_change": "f_kp_commit_creds_cap_change", "dns": "f_kp_udp_sendmsg_dport_eq_53",
    }
    return t.select("row_idx", *[f[v].alias(k) for k, v in names.items()])


@query()
def q_hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, cwd = s.basename("proc_binary"), s.first_components("proc_cwd", 4)
    return tel(spark, sf_dir).select("row_idx", py.hash_bucket(base, 2048).alias("name_hash"), py.hash_bucket(base, 256).alias("bag_hash"), py.hash_bucket(cwd, 4096).alias("cwd_hash"))


@query(
    "SELECT row_idx, round(h, 6) AS entropy, " + b(case([("h IS NULL", 0), ("h < 2.0", 1), ("h < 3.5", 2), ("h < 4.5", 3), ("h < 5.5", 4)], 5), "bucket")
    + " FROM (SELECT row_idx, CASE WHEN proc_arguments <> '' THEN list_entropy(list_filter(string_split(proc_arguments, ''), lambda x: x <> '')) END AS h FROM telemetry)"
)
def q_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tel(spark, sf_dir).select("row_idx", py.entropy("proc_arguments").alias("h"))
    return t.select("row_idx", F.round("h", 6).alias("entropy"), s.entropy_bucket("h").alias("bucket"))


@query()
def q_gzip_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("row_idx", s.ratio_bucket(py.gzip_ratio("proc_arguments")).alias("bucket"))


@query(f"SELECT row_idx, {IP_CATEGORY} AS ip_category FROM (SELECT row_idx, kp_sock_daddr AS a FROM telemetry)")
def q_ip_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("row_idx", py.ip_category("kp_sock_daddr").alias("ip_category"))


@query()
def q_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build_features(_complete(tel(spark, sf_dir)), keep=("row_idx",))


_ENTROPY = "list_entropy(list_filter(string_split(proc_arguments, ''), lambda x: x <> ''))"
#: The features that need no BLAKE2b and no gzip, as SQL.
FEATURE_SQL = {
    "f_event_type": sql_vocab("event_type", vocab.EVENT_TYPES, 3, 3), "f_kprobe_function": sql_vocab("kprobe_function_name", vocab.KPROBE_FUNCTIONS, 12, 13),
    "f_kprobe_policy": sql_vocab("kprobe_policy_name", vocab.KPROBE_POLICIES, 6, 7), "f_kprobe_action": sql_vocab("kprobe_action", vocab.KPROBE_ACTIONS, 1, 2),
    "f_proc_uid_bucket": case([("proc_uid = 0", 0), ("proc_uid = 1000", 1), ("proc_uid BETWEEN 1 AND 99", 2), ("proc_uid BETWEEN 100 AND 999", 3)], 4), "f_dst_port_bucket": PORT_BUCKET,
    "f_args_length_bucket": case([(f"{_BYTES} = 0", 0), (f"{_BYTES} < 50", 1), (f"{_BYTES} < 200", 2), (f"{_BYTES} < 1000", 3), (f"{_BYTES} < 5000", 4)], 5),
    "f_cap_count_bucket": case([(f"{_CAPS} = 0", 0), (f"{_CAPS} <= 2", 1), (f"{_CAPS} <= 5", 2), (f"{_CAPS} <= 15", 3)], 4),
    "f_path_sens_cwd": sql_sensitivity("proc_cwd"), "f_path_sens_binary": sql_sensitivity(_DIR), "f_path_sens_kp": sql_sensitivity(KP_PATH),
    "f_in_init_tree": "coalesce(proc_in_init_tree, false)", "f_is_procfs_walk": "coalesce(proc_is_procfs_walk, false)", "f_uid_eq_parent": "coalesce(proc_uid = parent_uid, false)",
    "f_is_setuid_exec": "coalesce(event_type = 'process_exec', false) AND coalesce(len(proc_cap_effective), 0) > 0 AND coalesce(len(parent_cap_effective), 0) = 0", "f_args_truncated": "0",
    "f_cmdline_entropy": case([("coalesce(proc_arguments, '') = ''", 0), (f"{_ENTROPY} < 2.0", 1), (f"{_ENTROPY} < 3.5", 2), (f"{_ENTROPY} < 4.5", 3), (f"{_ENTROPY} < 5.5", 4)], 5),
    "f_time_since_parent_exec": case([(f"{_D} IS NULL", 0), (f"{_D} < 1000000", 1), (f"{_D} < 1000000000", 2), (f"{_D} < 60000000000", 3), (f"{_D} < 3600000000000", 4)], 5),
    "f_kp_fd_install_fd_int32": "coalesce(kp_fd_install_fd, -1)", "f_kp_fd_install_path_sensitivity": sql_sensitivity("kp_fd_install_path"), "f_kp_mmap_path_sensitivity": sql_sensitivity("kp_mmap_path"),
    "f_kp_mmap_prot_uint": "coalesce(kp_mmap_prot, 0)", "f_kp_mprotect_prot_uint": "coalesce(kp_mprotect_prot, 0)", "f_kp_commit_creds_uid_change": "coalesce(kp_creds_uid <> proc_uid, false)",
    "f_kp_commit_creds_cap_change": "kp_creds_caps IS NOT NULL AND len(kp_creds_caps) <> coalesce(len(proc_cap_effective), -1)", "f_kp_tcp_connect_dst_port_bucket": PORT_BUCKET,
    "f_kp_tcp_connect_sock_family": sql_vocab("kp_sock_family", vocab.SOCK_FAMILIES, 2, 3), "f_kp_udp_sendmsg_dport_eq_53": "coalesce(kp_sock_dport = 53, false)",
}


@query("SELECT row_idx, " + ", ".join(b(sql, name) for name, sql in FEATURE_SQL.items()) + " FROM telemetry")
def q_features_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded features that SQL can express too."""
    return features.build_features(_complete(tel(spark, sf_dir)), keep=("row_idx",)).select("row_idx", *FEATURE_SQL)


_RICH = {
    "f_action_family": sql_vocab("family", vocab.ACTION_FAMILIES, 14, 14), "f_lineage_depth": "coalesce(w.depth, 0)", "f_path_category": sql_vocab("pc", vocab.PATH_CATEGORIES, 9, 9),
    "f_dst_ip_category": sql_vocab("ip", vocab.IP_CATEGORIES, 5, 5), "f_dst_port_category": sql_vocab("port", vocab.PORT_CATEGORIES, 6, 6), "f_object_category": sql_vocab("oc", vocab.OBJECT_CATEGORIES, 6, 6),
    "f_process_age_log_bucket": LOG_BUCKET.format("(event_time - proc_start_time)"), "f_delta_t_log_bucket": LOG_BUCKET.format("greatest(delta, 0)"),
}
_LAST = "event_time - last_value(event_time IGNORE NULLS) OVER (PARTITION BY proc_exec_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "SELECT row_idx, " + ", ".join(b(sql, name) for name, sql in _RICH.items()) + ", coalesce(w.root, '') AS process_tree_root_exec_id, "
    "coalesce(r.basename, '') AS root_ancestor_basename FROM "
    f"(SELECT *, {FAMILY} AS family, {OBJECT} AS oc, {sql_path_category('chosen')} AS pc, {IP_CATEGORY} AS ip, {PORT_CATEGORY} AS port FROM (SELECT *, {CHOSEN} AS chosen, kp_sock_daddr AS a, {_LAST} AS delta FROM telemetry)) t "
    "LEFT JOIN walked w ON w.exec_id = t.proc_exec_id LEFT JOIN procs r ON r.exec_id = w.root",
    ("procs", "walk", "walked"),
)
def q_enriched_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour columns that SQL can express too, of the whole enriched table."""
    return QUERIES["q_enriched"](spark, sf_dir).select("row_idx", *_RICH, "process_tree_root_exec_id", "root_ancestor_basename")


def _complete(df: DataFrame) -> DataFrame:
    """The adapter's columns plus nulls for raw columns it lacks."""
    missing = {c: F.lit(None).cast(t) for c, t in schema.RAW_COLUMNS if c not in df.columns}
    return df.withColumns(missing)


# ---- parsing


_INUM = 1000001  # the monitored container of the adapter's lines


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter's rows written as event lines, with broken and foreign ones among them."""
    t = tel(spark, sf_dir)
    e = F.col("row_idx")
    inum = F.when(e % 19 == 7, F.lit(None)).when(e % 23 == 5, F.lit(77)).otherwise(F.lit(_INUM)).cast("bigint")
    process = F.struct(
        F.col("proc_exec_id").alias("exec_id"), F.col("proc_pid").alias("pid"), F.col("proc_uid").alias("uid"), F.col("proc_binary").alias("binary"), F.col("proc_cwd").alias("cwd"),
        F.when(e % 4 == 0, F.lit("execve procFS")).otherwise(F.lit("clone")).alias("flags"),
        F.struct(F.struct(inum.alias("inum"), (e % 31 == 3).alias("is_host")).alias("pid")).alias("ns"),
    )
    sock = F.struct(F.struct(F.col("kp_sock_family").alias("family"), F.col("kp_sock_daddr").alias("daddr"), F.col("kp_sock_dport").cast("string").alias("dport")).alias("sock_arg"))
    args = (
        F.when(F.col("kprobe_function_name") == "fd_install", F.concat(F.lit('[{"int_arg":'), F.col("kp_fd_install_fd").cast("string"), F.lit('},'), F.to_json(F.struct(F.struct(F.col("kp_fd_install_path").alias("path")).alias("file_arg"))), F.lit("]")))
        .when(F.col("kprobe_function_name").isin("tcp_connect", "udp_sendmsg"), F.concat(F.lit("["), F.to_json(sock), F.lit(',{"int_arg":"'), e.cast("string"), F.lit('"}]')))
        .otherwise(F.lit("[]"))
    )
    inner = F.when(
        F.col("event_type") == "process_kprobe",
        F.concat(F.lit('{"process":'), F.to_json(process), F.lit(',"function_name":'), F.coalesce(F.concat(F.lit('"'), F.col("kprobe_function_name"), F.lit('"')), F.lit("null")), F.lit(',"args":'), args, F.lit("}")),
    ).otherwise(F.concat(F.lit('{"process":'), F.to_json(process), F.lit(',"status":3}')))
    seconds = F.floor(F.col("event_time") / 10**9)
    stamp = F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.col("event_time") - seconds * 10**9).cast("string"), 9, "0"), F.lit("Z"))
    line = F.concat(F.lit('{"time":"'), stamp, F.lit('","'), F.col("event_type"), F.lit('":'), inner, F.lit("}"))
    value = F.when(e % 97 == 1, F.lit("not json")).when(e % 89 == 2, F.lit('{"other":{}}')).when(e % 83 == 3, F.lit("[1]")).otherwise(line)
    return t.select(value.alias("value"), F.lit("events.json").alias("_source_file"), e.alias("_source_line"))


_BAD = "row_idx % 97 = 1 OR row_idx % 89 = 2 OR row_idx % 83 = 3"
_OUT = f"({_BAD} OR row_idx % 31 = 3 OR row_idx % 19 = 7 OR row_idx % 23 = 5)"


@query(
    f"SELECT row_idx AS source_line, event_type, event_time, proc_exec_id, proc_pid, proc_uid, kprobe_function_name, kp_fd_install_path, CAST(kp_fd_install_fd AS BIGINT) AS kp_fd_install_fd, "
    f"CASE WHEN kprobe_function_name IN ('tcp_connect', 'udp_sendmsg') THEN kp_sock_daddr END AS kp_sock_daddr, CASE WHEN kprobe_function_name IN ('tcp_connect', 'udp_sendmsg') THEN kp_sock_dport END AS kp_sock_dport, "
    f"CASE WHEN kprobe_function_name = 'udp_sendmsg' THEN row_idx END AS kp_msg_length, CASE WHEN event_type = 'process_exit' THEN 3::BIGINT END AS exit_status, event_type = 'process_exec' AND row_idx % 4 = 0 AS procfs FROM telemetry WHERE NOT {_OUT}"
)
def q_parse_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = jsonl.parse_events(_json_lines(spark, sf_dir), jsonl.ParserConfig([_INUM]))
    return raw.select(
        F.col("_source_line").alias("source_line"), "event_type", "event_time", "proc_exec_id", "proc_pid", "proc_uid", "kprobe_function_name", "kp_fd_install_path", "kp_fd_install_fd",
        "kp_sock_daddr", "kp_sock_dport", "kp_msg_length", "exit_status", F.col("proc_is_procfs_walk").alias("procfs"),
    )


def _counted(name: str, cond: str) -> str:
    return f"SELECT '{name}' AS counter, count(*) FILTER (WHERE {cond}) AS n FROM telemetry"


_B1, _B2, _B3 = "row_idx % 97 = 1", "(row_idx % 89 = 2 OR row_idx % 83 = 3)", "row_idx % 31 = 3"
_GOOD = f"NOT ({_BAD})"


@query(" UNION ALL ".join([
    _counted("errors_json_parse", _B1), _counted("drop_wrong_event_type", f"NOT ({_B1}) AND {_B2}"), _counted("drop_no_process", "false"),
    _counted("drop_container_filter_is_host", f"{_GOOD} AND {_B3}"), _counted("drop_container_filter_no_inum", f"{_GOOD} AND NOT {_B3} AND row_idx % 19 = 7"),
    _counted("drop_container_filter_wrong_inum", f"{_GOOD} AND NOT {_B3} AND row_idx % 19 <> 7 AND row_idx % 23 = 5"), _counted("drop_sentinel_interval", "false"),
    _counted("lines_kept", f"NOT {_OUT}"), *[_counted(f"kept_{k}", f"NOT {_OUT} AND event_type = '{k}'") for k in vocab.EVENT_TYPES],
    _counted("tagged_procfs_walk_execs", f"NOT {_OUT} AND event_type = 'process_exec' AND row_idx % 4 = 0"), _counted("unparseable_event_time", "false"),
]))
def q_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.counters(_json_lines(spark, sf_dir), jsonl.ParserConfig([_INUM]))


# ---- lineage


def _walks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = tel(spark, sf_dir)
    return t, order.cut(lineage.process_map(t, ["row_idx"]))


@query("SELECT w.exec_id, CAST(w.depth AS BIGINT) AS depth, w.root, p.basename AS root_basename, w.cycle FROM walked w JOIN procs p ON p.exec_id = w.root", ("procs", "walk", "walked"))
def q_lineage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.ancestors(_walks(spark, sf_dir)[1])


@query(
    "SELECT t.row_idx, coalesce(w.depth, 0)::BIGINT AS lineage_depth, w.root AS root_ancestor_exec_id, proc_parent_exec_id IS NULL AND parent_exec_id IS NOT NULL AS fallback_used, "
    "(proc_parent_exec_id IS NULL AND parent_exec_id IS NULL) OR (coalesce(nullif(proc_parent_exec_id, ''), parent_exec_id) IS NOT NULL AND p.exec_id IS NULL) AS missing_parent, coalesce(w.cycle, false) AS cycle "
    "FROM telemetry t LEFT JOIN walked w ON w.exec_id = t.proc_exec_id LEFT JOIN procs p ON p.exec_id = coalesce(nullif(proc_parent_exec_id, ''), parent_exec_id)",
    ("procs", "walk", "walked"),
)
def q_lineage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lineage.with_lineage(*_walks(spark, sf_dir))
    return got.select(
        "row_idx", "lineage_depth", "root_ancestor_exec_id", F.col("lineage_parent_fallback_used").alias("fallback_used"), F.col("lineage_missing_parent").alias("missing_parent"), F.col("lineage_cycle_detected").alias("cycle")
    )


@query(
    f"SELECT pair, count(*) AS n FROM (SELECT CASE WHEN q = '' AND b = '' THEN '' ELSE q || '->' || b END AS pair FROM (SELECT coalesce(p.basename, {BASE.format('parent_binary')}) AS q, {BASE.format('proc_binary')} AS b "
    "FROM telemetry t LEFT JOIN procs p ON p.exec_id = nullif(coalesce(nullif(proc_parent_exec_id, ''), parent_exec_id), ''))) GROUP BY pair",
    ("procs",),
)
def q_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lineage.with_lineage(*_walks(spark, sf_dir))
    return got.groupBy(s.parent_child("parent_binary_basename", s.basename_or_empty("proc_binary")).alias("pair")).agg(F.count("*").alias("n"))


@query()
def q_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _complete(tel(spark, sf_dir))
    return features.build_behaviour(t, ["row_idx"], keep=("row_idx",))


# ---- windows and deltas


@query(
    "SELECT row_idx, CASE WHEN d < 0 THEN 0 ELSE d END AS delta, coalesce(d < 0, false) AS negative FROM (SELECT row_idx, late_time - last_value(late_time IGNORE NULLS) OVER "
    "(PARTITION BY proc_exec_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM telemetry)"
)
def q_delta_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windows.delta_previous(tel(spark, sf_dir), ["row_idx"], time="late_time")
    return got.select("row_idx", F.col("delta_t_prev_ns").alias("delta"), F.col("negative_delta").alias("negative"))


@query("SELECT row_idx, event_time - proc_start_time AS age FROM telemetry")
def q_process_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("row_idx", windows.process_age().alias("age"))


@query("SELECT w AS window_idx, max(score) AS score FROM win GROUP BY w", (*SCORES, "win"))
def q_window_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_max(scored(spark, sf_dir), n_rows(spark, sf_dir))


@query("SELECT w AS window_idx, max(score) AS score, bool_or(is_attack) AS is_attack FROM win GROUP BY w", (*SCORES, "win"))
def q_window_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_max_any(scored(spark, sf_dir), n_rows(spark, sf_dir))


@query("SELECT w AS window_idx, round(quantile_cont(score, 0.5), 9) AS score FROM win GROUP BY w", (*SCORES, "win"))
def q_window_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_median(scored(spark, sf_dir), n_rows(spark, sf_dir)).withColumn("score", F.round("score", 9))


_PAIR = "((row_idx * 31 + {w} * 17) % 101) / 100.0::DOUBLE"


@query(
    f"SELECT t.row_idx, coalesce(m.s, (SELECT min(s) FROM (SELECT max({_PAIR.format(w='w')}) AS s FROM win GROUP BY row_idx))) AS score FROM telemetry t LEFT JOIN (SELECT row_idx, max({_PAIR.format(w='w')}) AS s FROM win GROUP BY row_idx) m USING (row_idx)",
    (*SCORES, "win"),
)
def q_event_max_over_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tel(spark, sf_dir).select("row_idx")
    each = windows.to_windows(t, n_rows(spark, sf_dir)).withColumn("score", ((F.col("row_idx") * 31 + F.col("window_idx") * 17) % 101) / F.lit(100.0))
    return windows.event_scores(each, t)


@query(
    "SELECT part, count(*) AS n, min(row_idx) AS first_row, max(row_idx) AS last_row FROM (SELECT row_idx, CASE WHEN event_time < (SELECT event_time FROM telemetry WHERE row_idx = (SELECT CAST(floor((1 - 0.2) * count(*)) AS BIGINT) FROM telemetry)) - 450000000000 THEN 'train' "
    "WHEN event_time >= (SELECT event_time FROM telemetry WHERE row_idx = (SELECT CAST(floor((1 - 0.2) * count(*)) AS BIGINT) FROM telemetry)) + 450000000000 THEN 'validation' END AS part FROM telemetry) WHERE part IS NOT NULL GROUP BY part"
)
def q_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = windows.carve(tel(spark, sf_dir).select("row_idx", "event_time"))
    both = c.train.withColumn("part", F.lit("train")).union(c.validation.withColumn("part", F.lit("validation")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))


@query("SELECT row_idx, event_time, row_number() OVER (ORDER BY event_time DESC, row_idx) - 1 AS place FROM telemetry")
def q_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.with_row_index(tel(spark, sf_dir).select("row_idx", "event_time"), F.col("event_time").desc(), F.col("row_idx"), name="place")


@query("SELECT proc_exec_id, row_idx, row_number() OVER (PARTITION BY proc_exec_id ORDER BY row_idx) = 1 AS starts FROM telemetry")
def q_group_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.group_starts(tel(spark, sf_dir).select("proc_exec_id", "row_idx"), "proc_exec_id", ["row_idx"])


# ---- labels


@query("SELECT row_idx, is_attack, technique_id FROM labelled", LABELS)
def q_label_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tel(spark, sf_dir)
    return intervals.label_events(t, adapter.intervals(t)).select("row_idx", "is_attack", "technique_id")


@query("SELECT row_idx, trial_idx FROM labelled", LABELS)
def q_trial_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("row_idx", "trial_idx")


@query("SELECT row_idx, late_time FROM telemetry t WHERE late_time IS NULL OR NOT EXISTS (SELECT 1 FROM intervals i WHERE t.late_time BETWEEN i.start_ns AND i.end_ns)", ("intervals",))
def q_sentinel_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tel(spark, sf_dir)
    return intervals.drop_sentinels(t.select("row_idx", "late_time"), adapter.intervals(t), time="late_time")


@query("SELECT row_idx FROM labelled WHERE NOT is_attack", LABELS)
def q_benign_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.benign(labelled(spark, sf_dir)).select("row_idx")


@query(
    "SELECT row_idx, kprobe_function_name FROM telemetry WHERE CASE kprobe_function_name WHEN 'security_mmap_file' THEN coalesce(kp_mmap_prot, 0) & 4 <> 0 "
    "WHEN 'security_file_mprotect' THEN coalesce(kp_mprotect_prot, 0) & 4 <> 0 WHEN 'udp_sendmsg' THEN coalesce(kp_sock_dport = 53, false) ELSE true END"
)
def q_policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.policy_selected(tel(spark, sf_dir)).select("row_idx", "kprobe_function_name")


# ---- metrics


@query("SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round(sum(pos * (n - fp + neg / 2.0)) / (max(p) * max(n)), 9) AS auroc FROM curve", CURVE)
def q_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(histogram(spark, sf_dir)).withColumn("auroc", F.round("auroc", 9))


@query("SELECT round(sum(pos / p * tp / (tp + fp)), 9) AS ap FROM curve", CURVE)
def q_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(histogram(spark, sf_dir)).withColumn("ap", F.round("ap", 9))


@query(
    "SELECT x AS fpr_target, round(coalesce((SELECT max(tp / p) FROM curve WHERE fp / n <= x AND (pos2 IS NULL OR pos <> pos2 OR neg <> neg2)), 0), 9) AS tpr FROM (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.3::DOUBLE)) AS v(x)", CURVE
)
def q_tpr_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tpr_at_fpr(histogram(spark, sf_dir), [0.01, 0.05, 0.3]).withColumn("tpr", F.round("tpr", 9))


@query(
    "SELECT technique_id, count(*) AS n_attack, CASE WHEN count(*) >= 50 THEN round(sum(n - fp + neg / 2.0) / (count(*) * max(n)), 9) END AS auroc, count(*) < 50 AS skipped FROM scored JOIN curve USING (score) WHERE is_attack GROUP BY technique_id", CURVE
)
def q_per_technique_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_technique_auroc(order.cut(scored(spark, sf_dir))).withColumn("auroc", F.round("auroc", 9))


@query(
    "SELECT sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, round(sum(CASE WHEN y = 1 THEN below + tie / 2.0 END) / (sum(y) * sum(1 - y)), 9) AS auroc FROM (SELECT *, sum(1 - y) OVER (ORDER BY score) - sum(1 - y) OVER (PARTITION BY score) AS below, sum(1 - y) OVER (PARTITION BY score) AS tie "
    "FROM (SELECT w, max(score) AS score, max(is_attack::INT) AS y FROM win GROUP BY w))",
    (*SCORES, "win"),
)
def q_per_window_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_window_auroc(scored(spark, sf_dir), n_rows(spark, sf_dir)).withColumn("auroc", F.round("auroc", 9))


@query(
    "SELECT technique_id, count(*) AS n_attack, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std, round(quantile_cont(score, 0.5), 6) AS score_p50, round(quantile_cont(score, 0.95), 6) AS score_p95, "
    "max(score) AS score_max, round((SELECT quantile_cont(score, 0.5) FROM scored WHERE NOT is_attack), 6) AS benign_p50, round((SELECT quantile_cont(score, 0.95) FROM scored WHERE NOT is_attack), 6) AS benign_p95 FROM scored WHERE is_attack GROUP BY technique_id",
    SCORES,
)
def q_technique_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.technique_distribution(order.cut(scored(spark, sf_dir)))
    return got.select("technique_id", "n_attack", *[F.round(c, 6).alias(c) for c in ("score_mean", "score_std", "score_p50", "score_p95")], "score_max", *[F.round(c, 6).alias(c) for c in ("benign_p50", "benign_p95")])


@query()
def q_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = metrics.bootstrap_auroc(order.cut(histogram(spark, sf_dir)))
    return spark.createDataFrame([(low, high)], "low double, high double")


@query("SELECT round(a, 9) AS auroc, CASE WHEN a >= 0.85 THEN 'strong' WHEN a >= 0.71 THEN 'mixed' ELSE 'weak' END AS branch FROM (SELECT sum(pos * (n - fp + neg / 2.0)) / (max(p) * max(n)) AS a FROM curve)", CURVE)
def q_decision_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = metrics.auroc(histogram(spark, sf_dir))
    return a.select(F.round("auroc", 9).alias("auroc"), metrics.decision_branch(F.col("auroc")).alias("branch"))


@query(
    "SELECT row_idx, is_attack, trial_idx, round(CASE WHEN is_attack THEN max(CASE WHEN fold = trial_idx THEN s END) ELSE avg(s) END, 9) AS score FROM (SELECT row_idx, is_attack, trial_idx, fold, score + fold / 10.0::DOUBLE AS s FROM scored, generate_series(0, 3) AS g(fold)) GROUP BY row_idx, is_attack, trial_idx", SCORES
)
def q_loocv_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = scored(spark, sf_dir).select("row_idx", "is_attack", "trial_idx", "score", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("fold"))
    return metrics.stitch_folds(folds.withColumn("score", F.col("score") + F.col("fold") / F.lit(10.0))).withColumn("score", F.round("score", 9))


@query("SELECT round(sum(sc * k) / sum(k), 9) AS mean, round(sum(k * sc * sc) / sum(k) - pow(sum(sc * k) / sum(k), 2), 9) AS variance, round(exp(least(sum(sc * k) / sum(k), 50)), 9) AS perplexity, sum(k)::BIGINT AS n FROM (SELECT score AS sc, 1 AS k FROM scored)", SCORES)
def q_nll_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.nll_summary(scored(spark, sf_dir), "score")
    return got.select(*[F.round(c, 9).alias(c) for c in ("mean", "variance", "perplexity")], "n")


# ---- sampling and order


@query("SELECT row_idx, row_number() OVER (PARTITION BY proc_exec_id ORDER BY event_time, row_idx) - 1 AS place FROM telemetry")
def q_place_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tel(spark, sf_dir).select("row_idx", "event_time", "proc_exec_id")
    return order.place_in_group(t, "proc_exec_id", ["event_time", "row_idx"]).select("row_idx", F.col("place").cast("bigint").alias("place"))


@query("SELECT row_idx, event_time FROM telemetry ORDER BY event_time, row_idx LIMIT 500")
def q_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("row_idx", "event_time").orderBy("event_time", "row_idx").limit(500)


@query("SELECT row_idx, part FROM (SELECT row_idx, CASE WHEN row_idx >= (SELECT count(*) - greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) FROM telemetry) THEN 'validation' ELSE 'train' END AS part FROM telemetry)")
def q_validation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = windows.validation_tail(tel(spark, sf_dir).select("row_idx"), n_rows(spark, sf_dir))
    return a.withColumn("part", F.lit("train")).union(c.withColumn("part", F.lit("validation")))


@query("SELECT row_idx FROM telemetry ORDER BY CAST('0x' || substr(md5('42:' || row_idx), 1, 15) AS BIGINT), row_idx LIMIT 200")
def q_uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.sample_rows(tel(spark, sf_dir).select("row_idx"), 200, in_order=True)


_STEP = "((SELECT count(*) FROM telemetry) - 1) / 99.0::DOUBLE"


@query(
    f"SELECT row_idx FROM telemetry WHERE (SELECT count(*) FROM telemetry) <= 100 OR (round(row_idx / ({_STEP})) < 100 AND floor(round(row_idx / ({_STEP})) * ({_STEP})) = row_idx)"
)
def q_evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.evenly_spaced(tel(spark, sf_dir).select("row_idx"), n_rows(spark, sf_dir), 100)


@query("SELECT technique_id FROM labelled WHERE technique_id IS NOT NULL GROUP BY technique_id", LABELS)
def q_distinct_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where("technique_id is not null").select("technique_id").distinct()


@query("SELECT row_idx, score FROM scored ORDER BY score DESC, row_idx LIMIT 5", SCORES)
def q_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("row_idx", "score").orderBy(F.col("score").desc(), "row_idx").limit(5)


@query("SELECT row_idx, event_time, CAST(CAST(score AS FLOAT) AS DOUBLE) AS score, is_attack, nullif(technique_id, '') AS technique_id FROM scored".replace("row_idx, ", "", 1), SCORES)
def q_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_table(scored(spark, sf_dir))


# ---- n-grams


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.concat(F.coalesce("event_type", F.lit("None")), F.lit(":"), F.coalesce("kprobe_function_name", F.lit("")))
    return labelled(spark, sf_dir).select("row_idx", "event_time", "proc_exec_id", "is_attack", token.alias("token"))


@query(
    "SELECT '1' AS size, '' AS prefix, w, count(*) AS n FROM bseq GROUP BY ALL UNION ALL SELECT '2', p1, w, count(*) FROM bseq WHERE p1 IS NOT NULL GROUP BY ALL UNION ALL SELECT '3', p2 || ' ' || p1, w, count(*) FROM bseq WHERE p2 IS NOT NULL GROUP BY ALL",
    (*LABELS, "bseq"),
)
def q_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ngram.fit(_tokens(spark, sf_dir))
    one = m.one.select(F.lit("1").alias("size"), F.lit("").alias("prefix"), "w", F.col("n_w").alias("n"))
    two = m.two.select(F.lit("2").alias("size"), F.col("prev1").alias("prefix"), "w", F.col("n_pw").alias("n"))
    three = m.three.select(F.lit("3").alias("size"), F.concat_ws(" ", "prev2", "prev1").alias("prefix"), "w", F.col("n_ppw").alias("n"))
    return one.union(two).union(three)


_NG = """, t3 AS (SELECT p2, p1, w, count(*) AS c FROM bseq WHERE p2 IS NOT NULL GROUP BY ALL), t2 AS (SELECT p1, w, count(*) AS c FROM bseq WHERE p1 IS NOT NULL GROUP BY ALL),
t1 AS (SELECT w, count(*) AS c FROM bseq GROUP BY ALL), s3 AS (SELECT p2, p1, sum(c) AS c FROM t3 GROUP BY ALL), s2 AS (SELECT p1, sum(c) AS c FROM t2 GROUP BY ALL), z AS (SELECT sum(c) AS n, count(*) AS v FROM t1)
SELECT row_idx, level, round(-ln(p), 6) AS nll FROM (SELECT q.row_idx, CASE WHEN s3.c > 0 THEN 'trigram' WHEN s2.c > 0 THEN 'bigram' ELSE 'unigram' END AS level,
CASE WHEN s3.c > 0 THEN (coalesce(t3.c, 0) + 1) / (s3.c + v) WHEN s2.c > 0 THEN 0.4 * (coalesce(t2.c, 0) + 1) / (s2.c + v)
ELSE CASE WHEN q.p1 IS NULL AND q.p2 IS NULL THEN 1.0 WHEN q.p1 IS NULL THEN 0.4 ELSE 0.4 * 0.4 END * (coalesce(t1.c, 0) + 1) / (n + v) END::DOUBLE AS p
FROM seq q CROSS JOIN z LEFT JOIN t3 ON t3.p2 = q.p2 AND t3.p1 = q.p1 AND t3.w = q.w LEFT JOIN s3 ON s3.p2 = q.p2 AND s3.p1 = q.p1
LEFT JOIN t2 ON t2.p1 = q.p1 AND t2.w = q.w LEFT JOIN s2 ON s2.p1 = q.p1 LEFT JOIN t1 ON t1.w = q.w)"""


@query(_NG, (*LABELS, "seq", "bseq"))
def q_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order.cut(_tokens(spark, sf_dir))
    return ngram.score(t, ngram.fit(t)).select("row_idx", "level", F.round("nll", 6).alias("nll"))


_NG_RATES = ", ".join(f"round(avg((level = '{x}')::INT), 6) AS {x}_rate" for x in ("trigram", "bigram", "unigram"))


@query(
    _NG.replace("SELECT row_idx, level, round(-ln(p), 6) AS nll FROM (", f"SELECT count(*) AS n, round(exp(avg(-ln(p))), 6) AS perplexity, {_NG_RATES} FROM (", 1), (*LABELS, "seq", "bseq")
)
def q_ngram_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order.cut(_tokens(spark, sf_dir))
    got = ngram.diagnostics(ngram.score(t, ngram.fit(t)))
    return got.select("n", *[F.round(c, 6).alias(c) for c in got.columns if c != "n"])


# ---- models


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _complete(labelled(spark, sf_dir))
    return order.cut(features.build_behaviour(t, ["row_idx"], keep=("row_idx",)).join(t.select(F.col("row_idx").alias("_i"), "is_attack", "technique_id", "trial_idx"), F.col("row_idx") == F.col("_i")).drop("_i"))


def _forest_scores(t: DataFrame, feature_set: str) -> DataFrame:
    """Scores of a forest grown on benign rows. Labels of a table without any tell nothing apart: it is taken as unlabelled, with a warning."""
    label = "is_attack" if t.where("NOT is_attack").head(1) else None
    if label is None:
        warnings.warn("no benign rows: the forest is grown on a sample of all rows", stacklevel=2)
    return forest.score(t, forest.fit(t, schema.model_columns(feature_set), label)).select("row_idx", "score")


@query()
def q_iforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest_scores(_model_rows(spark, sf_dir), "rich")


@query()
def q_iforest_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest_scores(_model_rows(spark, sf_dir), "flat")


@query()
def q_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _model_rows(spark, sf_dir)
    return boosted.fit(t, schema.model_columns("flat")).score(t).select("row_idx", "score")


def _network(spark: SparkSession, sf_dir: str, objective: str, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """Scores of every place of every window, and the events."""
    t = _model_rows(spark, sf_dir)
    each = windows.to_windows(t, t.count())
    columns = list(dict.fromkeys([*schema.model_columns("flat"), *seqnet.FIELDS, *seqnet.FLAGS]))
    w = seqnet.random_weights(objective, d_model=16, d_state=4, layers=2, feature_set="flat")
    return seqnet.score_windows(seqnet.window_rows(each, columns), w, objective, "flat", mode, chunk=64), t.select("row_idx")


def _event_scores(scored: DataFrame, events: DataFrame) -> DataFrame:
    at = (F.col("window_idx") * windows.STRIDE + F.col("pos")).alias("row_idx")
    return windows.event_scores(scored.select(at, "score"), events)


@query()
def q_mem_fa_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_scores(*_network(spark, sf_dir, "mem-fa"))


@query()
def q_mem_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_scores(*_network(spark, sf_dir, "mem", "random"))


@query()
def q_nll_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_scores(*_network(spark, sf_dir, "nll"))


# ---- files and streams


@query("SELECT row_idx, CASE WHEN d < 0 THEN 0 ELSE d END AS delta_t_prev_ns FROM (SELECT row_idx, event_time - lag(event_time) OVER (PARTITION BY proc_exec_id ORDER BY row_idx) AS d FROM telemetry)")
def q_stream_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry written as files and read again as a stream until it is used up."""
    import uuid

    base = f"{order.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    given = tel(spark, sf_dir).select("row_idx", "proc_exec_id", "event_time")
    tables.write_table(given, f"{base}/in")
    source = spark.readStream.schema(given.schema).parquet(f"{base}/in")
    run = stream_delta(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("row_idx", "delta_t_prev_ns")


@query("SELECT proc_exec_id, count(*) AS n, max(event_time) AS last_time FROM telemetry GROUP BY proc_exec_id")
def q_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read again through the table sink and source."""
    import uuid

    path = f"{order.shared_folder(spark)}/table-{uuid.uuid4().hex}"
    tables.write_table(tel(spark, sf_dir).select("row_idx", "proc_exec_id", "event_time"), path)
    return tables.read_events(spark, path).groupBy("proc_exec_id").agg(F.count("*").alias("n"), F.max("event_time").alias("last_time"))
