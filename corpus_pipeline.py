"""A cleaning pipeline over ``documents``: quality rules, line dedup, near-dedup, mixing, packing.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor.llm import line_dedup, mixing, packing, quality_rules, similar
from spoor.llm.common import shared_folder

_NULL_ID = -(1 << 63)
#: Documents packed together: four periods of the mixing schedule.
RUN = 4 * mixing.BLOCK * (sum(mixing.WEIGHTS.values()) + 1)


def _rows(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns a stage works on, and all others in one struct, so that none can clash with the stage's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*rest, F.lit(0).alias("_")).alias("_row"))


def _restored(rows: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    return rows.select(*[F.col(c) if c in needed else F.col("_row")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rule or lie above a fence of their language and source."""
    stats = quality_rules.statistics(_rows(docs, "text", "lang", "source"))
    judged = quality_rules.judge(stats, quality_rules.sketches(stats))
    return _restored(judged.where("kept"), docs, "text", "lang", "source")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the later copies of repeated line runs out of the texts; every document stays."""
    cut = line_dedup.dedup_lines(_rows(docs, "doc_id", "text"))
    kept = _restored(cut, docs, "doc_id", "text")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id (none counts as the smallest) of each group of near-duplicates.

    Groups are of distinct texts, linked where they share 0.8 of their shingles of five words (see ``similar``);
    where ids are equal, a hash of the text decides, so an id never removes another text.
    """
    keyed = _rows(docs, "doc_id", "text").withColumns({"_k": F.coalesce("doc_id", F.lit(_NULL_ID)), "_t": similar.node(F.col("text"))})
    found = similar.similar(keyed.select(F.col("_t").alias("node"), "text"))
    each = keyed.groupBy("_t").agg(F.min("_k").alias("_k"))  # a row per text, so copies do not meet in one task
    group = each.join(found, F.col("_t") == F.col("node"), "left").withColumn("_g", F.coalesce("component", "_t"))
    first = group.groupBy("_g").agg(F.min(F.struct("_k", "_t")).alias("m")).select("m._k", "m._t")
    once = F.row_number().over(Window.partitionBy("_k", "_t").orderBy("text"))
    kept = keyed.join(first, ["_k", "_t"], "left_semi").withColumn("_n", once).where("_n = 1")
    return _restored(kept, docs, "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings all documents into the order of the sources' schedule."""
    placed = mixing.schedule(_rows(docs, "doc_id", "source", "text"), text="text")
    ordered = placed.orderBy("mix.slot", "mix.source", "mix.place")
    return _restored(ordered, docs, "doc_id", "source", "text")


def _places(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_place``: how many rows stand before each, file by file as they were written."""
    spark = docs.sparkSession
    try:
        at = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # not read from files: as the rows come
        each = docs.withColumn("_id", F.monotonically_increasing_id())
        at = each.withColumns({"_file": F.lpad(F.shiftright("_id", 33).cast("string"), 12, "0"), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    files = at.groupBy("_file").agg(F.max("_row").alias("n")).collect()  # a row per file
    start, rows = 0, []
    for r in sorted(files):
        rows.append((r["_file"], start))
        start += r["n"] + 1
    starts = F.broadcast(spark.createDataFrame(rows, "_file string, _start long"))
    return at.join(starts, "_file").withColumn("_place", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every token into sequences of at most 1024, run after run of ``RUN`` documents in the order they have.

    Mixing has ordered them, and a run of whole periods has its target weights, so the sequences keep them from run to run.
    """
    run = F.floor(F.col("_place") / RUN).cast("long")
    return packing.pack_runs(_places(docs.select("doc_id", "text")).withColumn("run", run))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("source mixing", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the session's shared folder and read again."""
    root = f"{shared_folder(spark)}/spoor-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs


#: Tokenising is beyond SQL; the tests compare every stage with a brute-force version.
ORACLE_SQL = None
