"""Optional filters that repeat, on stored events, what collection policies select in the kernel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROT_EXEC = 4  # fixed value: the bit of an executable mapping


def executable(prot: str | Column) -> Column:
    """Whether a protection mask asks for execution."""
    c = F.col(prot) if isinstance(prot, str) else prot
    return F.coalesce(c.cast("bigint").bitwiseAND(F.lit(PROT_EXEC)) != 0, F.lit(False))


def outside_host(flag: str = "proc_ns_pid_is_host") -> Column:
    return ~F.coalesce(F.col(flag), F.lit(False))


def policy_selected(events: DataFrame) -> DataFrame:
    """Events a policy would have let through: memory probes that ask for execution, datagrams to port 53, all others."""
    fn = F.col("kprobe_function_name")
    keep = (
        F.when(fn == "security_mmap_file", executable("kp_mmap_prot"))
        .when(fn == "security_file_mprotect", executable("kp_mprotect_prot"))
        .when(fn == "udp_sendmsg", F.coalesce(F.col("kp_sock_dport") == 53, F.lit(False)))
        .otherwise(F.lit(True))
    )
    return events.where(keep)
