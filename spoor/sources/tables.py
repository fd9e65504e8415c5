"""Readers of event and feature tables, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.operators.order import with_row_index
from spoor.sources import schema


def read_events(spark: SparkSession, paths: str | list[str], recursive: bool = False, source: str | None = None) -> DataFrame:
    """Parquet files of events; nanosecond timestamps as bigint, microseconds turned into nanoseconds, ``__`` columns dropped.

    With ``source``, a folder, ``source_path`` holds the path of each row's file below it."""
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    df = reader.parquet(*([paths] if isinstance(paths, str) else paths))
    kept = df.drop(*[c for c in df.columns if c.startswith("__")])
    if source is not None:
        below = F.substring_index("_metadata.file_path", f"{source.rstrip('/')}/", -1)
        kept = kept.withColumn("source_path", F.regexp_replace(below, r"\.parquet$", ""))
    return normal_times(kept)


def normal_times(df: DataFrame) -> DataFrame:
    """Timestamp columns as bigint nanoseconds."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            out[f.name] = F.unix_micros(f.name) * 1000
        elif isinstance(f.dataType, T.TimestampNTZType):
            out[f.name] = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(f.name)) * 1000
    return df.withColumns(out) if out else df


def sorted_events(df: DataFrame, *ties: str) -> DataFrame:
    """Events with ``row_idx`` in order of time, then ``ties``."""
    return with_row_index(df, "event_time", *ties)


def feature_matrix(df: DataFrame, columns: list[str] | None = None, extra: tuple[str, ...] = ("event_time",)) -> DataFrame:
    """``extra`` columns and ``x``, the model columns as an array of float."""
    return df.select(*extra, F.array(*[F.col(c).cast("float") for c in columns or schema.model_columns()]).alias("x"))


def token_stream(df: DataFrame) -> DataFrame:
    return df.select("event_time", "proc_exec_id", "token", *([] if "row_idx" not in df.columns else ["row_idx"]))


def write_table(df: DataFrame, path: str, rows_per_file: int = 5_000_000, partition: list[str] | None = None) -> None:
    """Snappy Parquet; zero rows give a table with a schema."""
    w = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_csv(df: DataFrame, path: str, decimals: int = 6) -> None:
    """A small table with a header, numbers to six places."""
    cols = [F.format_string(f"%.{decimals}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
