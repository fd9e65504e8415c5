"""Shared pieces: word splitting, lineage cuts and expression bindings."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, [\x20\x09-\x0D].
WHITESPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one the session names, or one of our own on a single machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spoor-checkpoint-")
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; no words for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITESPACE[1:], " " * (len(WHITESPACE) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are in ``chars``."""
    return F.length(text) - F.length(without(text, chars))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def source_columns(df: DataFrame, *needed: str) -> DataFrame:
    """Only the columns an operator works on, so other columns cannot clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in needed])


def stored(df: DataFrame) -> DataFrame:
    """The rows written as compressed Parquet to the shared checkpoint folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spoor-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
