"""The queries of this subpackage and their SQL, for the table of contents in the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import classifier, embeddings, htmltext, licenses, line_dedup, mixing, packing, quality_rules, simhash, suffix_tree
from spoor.llm.common import materialize, table, total


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.get("fps", 0)), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = materialize(quality_rules.statistics(docs).select("doc_id", "stats"))
    judged = quality_rules.judge(stats, quality_rules.sketches(stats))
    return judged.select("doc_id", *[f"stats.{c}" for c in [*quality_rules.BASE, "base_failed"]], "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    notices = F.array_join(F.transform("notices", lambda s: F.concat_ws(":", s["line"].cast("string"), s["license"])), ",")
    return found.select("doc_id", "digest", "license", F.size("notices").cast("long").alias("n_notices"), notices.alias("notices"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0, cut=0.3)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.col("removed_lines")
    return cut.select(
        "doc_id", "text", F.size(gone).cast("long").alias("n_removed"), total(gone).alias("removed_sum")
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "mix.*")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"), folds=7, held=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash, op2_quality_rules, op3_license_scan, op4_quality_classifier, op5_best_fit_packing, op6_embedding_near_dedup,
        op7_line_dedup, op8_source_mixing, op9_html_extraction, op10_lm_scoring,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.oracle(),
        "op3_license_scan": licenses.oracle(),
        "op7_line_dedup": line_dedup.oracle(),
        "op8_source_mixing": mixing.oracle(),
    }
