"""Command line: run a description, single steps, statistics and summaries."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession

from weftline.functions.hashing import SegmentHasher
from weftline.operators import analysis, steps
from weftline.plans.config import dump, load
from weftline.plans.pipeline import FilterPipeline
from weftline.plans.runner import Runner
from weftline.sources import text


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="weftline")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run the steps of a YAML file")
    run.add_argument("config")
    run.add_argument("--overwrite", action="store_true")
    run.add_argument("--last", type=int)
    run.add_argument("--single", type=int)
    run.add_argument("--n-jobs", type=int, help="accepted for compatibility; Spark decides")
    step = sub.add_parser("step", help="run one step from parameters in JSON")
    step.add_argument("type")
    step.add_argument("parameters", type=json.loads)
    step.add_argument("--outputdir", default=".")
    step.add_argument("--overwrite", action="store_true")
    dup = sub.add_parser("duplicates", help="statistics of duplicate lines")
    dup.add_argument("files", nargs="+")
    dup.add_argument("--overlap", nargs="+")
    dup.add_argument("--lowercase", action="store_true")
    dup.add_argument("--letters-only", action="store_true")
    scores = sub.add_parser("scores", help="summaries of a score file")
    scores.add_argument("what", choices=("list", "describe", "corr", "hist", "values"))
    scores.add_argument("file")
    scores.add_argument("--column")
    scores.add_argument("--bins", type=int, default=20)
    test = sub.add_parser("test", help="how many lines each filter of a step removes")
    test.add_argument("config")
    test.add_argument("files", nargs="+")
    test.add_argument("--step", type=int, default=1)
    auto = sub.add_parser("autogen", help="a filter step for these files")
    auto.add_argument("files", nargs="+")
    auto.add_argument("--method", choices=("defaults", "percentiles", "clustering"), default="defaults")
    auto.add_argument("--percentile", type=float, default=0.01)
    auto.add_argument("--sample-size", type=int, default=100_000)
    dot = sub.add_parser("diagram", help="a graph of the steps in the DOT language")
    dot.add_argument("config")
    return parser


def _config(path: str) -> dict[str, Any]:
    with text.open_text(path) as file:
        return load(file.read())


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(arguments)
    if a.command == "diagram":
        print(analysis.diagram(_config(a.config)["steps"]))
        return 0
    spark = spark or SparkSession.builder.appName("weftline").getOrCreate()
    if a.command == "run":
        runner = Runner(spark, _config(a.config))
        runner.run_one(a.single, a.overwrite) if a.single is not None else runner.run(a.overwrite, a.last)
    elif a.command == "step":
        Runner(spark, {"common": {"output_directory": a.outputdir}, "steps": [{"type": a.type, "parameters": a.parameters}]}).run(a.overwrite)
    elif a.command == "duplicates":
        hasher = SegmentHasher(lowercase=a.lowercase, letters_only=a.letters_only)
        other = text.read_parallel(spark, *a.overlap, strip=False) if a.overlap else None
        steps.duplicate_statistics(text.read_parallel(spark, *a.files, strip=False), other, hasher).show(truncate=False)
    elif a.command == "scores":
        flat = steps.flatten(text.read_json_lines(spark, a.file))
        if a.what == "list":
            print("\n".join(c for c in flat.columns if c != "idx"))
        else:
            {"describe": lambda: analysis.describe(flat), "corr": lambda: analysis.correlations(flat), "hist": lambda: analysis.histogram(flat, a.column, a.bins).orderBy("bin"), "values": lambda: flat.orderBy("idx").select(f"`{a.column}`")}[a.what]().show(1000, truncate=False)
    elif a.command == "test":
        FilterPipeline.of(_config(a.config)["steps"][a.step - 1]["parameters"]["filters"]).removed(text.read_parallel(spark, *a.files)).show(truncate=False)
    else:
        chosen = [("LengthFilter", {}), ("LengthRatioFilter", {"unit": "word"}), ("LongWordFilter", {}), ("AverageWordLengthFilter", {}), ("AlphabetRatioFilter", {}), ("NonZeroNumeralsFilter", {})]
        if a.method == "defaults":
            filters = analysis.default_config()
        else:
            corpus = text.read_parallel(spark, *a.files)
            sample = steps.subset(corpus, a.sample_size, seed=1)
            filters = analysis.percentile_config(sample, chosen, a.percentile) if a.method == "percentiles" else analysis.cluster_config(sample, [("LengthRatioFilter", {"unit": "char"}), ("AlphabetRatioFilter", {}), ("NonZeroNumeralsFilter", {}), ("TerminalPunctuationFilter", {})], a.sample_size)
        print(dump({"steps": [{"type": "filter", "parameters": {"inputs": a.files, "outputs": [f"{f}.filtered" for f in a.files], "filters": filters}}]}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
