"""Command line: parse logs, build tables, fit a scorer on one table and evaluate it on another.

    python -m spoor parse --input LOGS --output RAW [--config FILE]
    python -m spoor features --input RAW --output TABLE [--mirror]
    python -m spoor enrich --input RAW --output TABLE [--seed RAW ...]
    python -m spoor evaluate --model ngram|iforest|iforest-flat|boosted --train TABLE --test TABLE --labels CSV --output DIR
    python -m spoor loocv --train TABLE --test TABLE --labels CSV --output DIR [--rounds N] [--depth N]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.operators import boosted, forest, intervals, metrics, ngram
from spoor.operators.order import cut
from spoor.plans import evaluate, features
from spoor.sources import jsonl, schema, tables

#: Row order of a raw table as it was parsed.
ORDER = ["_source_file", "_source_line"]


def _parse(spark: SparkSession, a: argparse.Namespace) -> None:
    config = jsonl.ParserConfig.from_yaml(a.config) if a.config else jsonl.ParserConfig()
    lines = jsonl.read_lines(spark, a.input)
    tables.write_table(jsonl.parse_events(lines, config), a.output[0])
    for r in [*jsonl.file_counters(spark, a.input).collect(), *jsonl.counters(lines, config).collect()]:
        print(r["counter"], r["n"])


def _features(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.mirror:
        events = tables.read_events(spark, a.input, recursive=True, source=a.input[0])
        tables.write_table(features.build_features(events, keep=("source_path",)), a.output[0], partition=["source_path"])
    else:
        tables.write_table(features.build_features(tables.read_events(spark, a.input, recursive=True)), a.output[0])


def _enrich(spark: SparkSession, a: argparse.Namespace) -> None:
    seeds = tables.read_events(spark, a.seed, recursive=True) if a.seed else None
    tables.write_table(features.build_behaviour(tables.read_events(spark, a.input, recursive=True), ORDER, seeds), a.output[0])


def labelled(spark: SparkSession, path: list[str], labels: DataFrame) -> DataFrame:
    return cut(intervals.label_events(tables.sorted_events(tables.read_events(spark, path, recursive=True), "proc_exec_id"), labels))


def scores(model: str, train: DataFrame, test: DataFrame) -> DataFrame:
    if model == "ngram":
        return ngram.score(test, ngram.fit(train))
    columns = schema.model_columns("flat" if model.endswith("flat") else "rich")
    if model.startswith("iforest"):
        return forest.score(test, forest.fit(train, columns))
    return boosted.fit(train, columns).score(test)


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    labels = intervals.read_intervals(spark, a.labels)
    train, test = labelled(spark, a.train, labels), labelled(spark, a.test, labels)
    scored = cut(scores(a.model, train, test).select("row_idx", "event_time", "score", "is_attack", "technique_id"))
    out = a.output[0]
    tables.write_table(evaluate.score_table(scored), f"{out}/scores")
    tables.write_csv(metrics.technique_distribution(scored), f"{out}/techniques")
    evaluate.evaluate(scored, a.model, scored.count()).write(f"{out}/evaluation.json")


def _loocv(spark: SparkSession, a: argparse.Namespace) -> None:
    """Holds out every trial of the test table in turn; benign rows of the training table and all other trials' attacks train."""
    labels = intervals.read_intervals(spark, a.labels, trials=True)
    train, test = labelled(spark, a.train, labels), cut(intervals.trial_membership(labelled(spark, a.test, labels), labels))
    settings = {**boosted.FOLD_SETTINGS, **{k: v for k, v in (("maxIter", a.rounds), ("maxDepth", a.depth)) if v}}
    folds = boosted.held_out_trials(train.where(~F.col("is_attack")), test, schema.model_columns("flat"), **settings)
    keys = ["row_idx", "event_time", "technique_id"]
    scored = cut(metrics.stitch_folds(folds, keys=keys).select(*keys, "score", "is_attack"))
    out = a.output[0]
    tables.write_table(evaluate.score_table(scored), f"{out}/scores")
    evaluate.evaluate(scored, "loocv", scored.count()).write(f"{out}/evaluation.json")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="spoor", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, run, wanted in (("parse", _parse, ["input", "output"]), ("features", _features, ["input", "output"]), ("enrich", _enrich, ["input", "output"]), ("evaluate", _evaluate, ["train", "test", "output"]), ("loocv", _loocv, ["train", "test", "output"])):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for w in wanted:
            c.add_argument(f"--{w}", nargs="+", required=True)
        if name == "parse":
            c.add_argument("--config")
        if name == "enrich":
            c.add_argument("--seed", nargs="*")
        if name == "features":
            c.add_argument("--mirror", action="store_true", help="a folder per input file, by its path below the first input")
        if name in ("evaluate", "loocv"):
            c.add_argument("--labels", required=True)
        if name == "loocv":
            c.add_argument("--rounds", type=int)
            c.add_argument("--depth", type=int)
        if name == "evaluate":
            c.add_argument("--model", choices=["ngram", "iforest", "iforest-flat", "boosted"], required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("spoor").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
