"""Summaries of score tables, and configurations derived from them: by default arguments, percentiles or clusters."""

from __future__ import annotations

import inspect
import math
from collections.abc import Sequence
from functools import reduce
from typing import Any

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.corpus import ParallelCorpus
from weftline.functions.quantiles import quantiles
from weftline.operators.filters import BETWEEN, HIGH, LOW, REGISTRY, Filter
from weftline.operators.steps import flatten, remove_duplicates, subset
from weftline.plans.pipeline import FilterPipeline, make


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _names(scores: DataFrame) -> list[str]:
    return [c for c in scores.columns if c != "idx"]


def describe(scores: DataFrame, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row a score: count, mean, std (sample), min, percentiles, max."""
    names = _names(scores)
    found = quantiles(scores, {n: list(percentiles) for n in names})
    parts = [F.struct(F.lit(n).alias("score"), F.count(_q(n)).alias("count"), F.avg(_q(n)).alias("mean"), F.stddev_samp(_q(n)).alias("std"), F.min(_q(n)).alias("min"), F.array(*(F.lit(x).cast("double") for x in found[n])).alias("percentiles"), F.max(_q(n)).alias("max")) for n in names]
    one = scores.agg(*(p.alias(f"c{i}") for i, p in enumerate(parts)))
    flat = one.select(F.explode(F.array(*(f"c{i}" for i in range(len(names))))).alias("r")).select("r.*")
    shown = [F.get("percentiles", F.lit(i)).alias(f"{100 * p:g}%") for i, p in enumerate(percentiles)]
    return flat.select("score", "count", "mean", "std", "min", *shown, "max")


def correlations(scores: DataFrame) -> DataFrame:
    """a, b and Pearson's correlation of all pairs of scores."""
    names = _names(scores)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    one = scores.agg(*(F.corr(_q(a), _q(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def histogram(scores: DataFrame, name: str, bins: int = 20) -> DataFrame:
    """bin, low and n over equal widths from the least to the greatest finite value."""
    value = _q(name).cast("double")
    finite = scores.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != math.inf)).select(value.alias("v"))
    row = finite.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    if row["a"] is None:
        return finite.select(F.lit(0).alias("bin"), F.col("v").alias("low"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (row["b"] - row["a"]) / bins or 1.0
    at = F.least(F.floor((F.col("v") - row["a"]) / width).cast("int"), F.lit(bins - 1))
    return finite.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(row["a"]) + F.col("bin") * width).alias("low"), "n")


def defaults(name: str) -> dict[str, Any]:
    """Default arguments of a filter."""
    import weftline.operators.models  # noqa: F401

    found = {}
    for kind in reversed(inspect.getmro(REGISTRY[name])) if inspect.isclass(REGISTRY[name]) else [REGISTRY[name]]:
        for key, p in inspect.signature(kind.__init__ if inspect.isclass(kind) else kind).parameters.items():
            if p.default is not inspect.Parameter.empty:
                found[key] = p.default
    return {k: v for k, v in found.items() if k not in ("name", "workdir")}


def default_config(names: Sequence[str] = ("LengthFilter", "LengthRatioFilter", "LongWordFilter", "HtmlTagFilter", "AverageWordLengthFilter", "AlphabetRatioFilter", "TerminalPunctuationFilter", "NonZeroNumeralsFilter")) -> list[dict[str, Any]]:
    """A configuration of the filters that can be made with their defaults."""
    return [{n: defaults(n)} for n in names if _usable(n)]


def _usable(name: str) -> bool:
    try:
        make(name, defaults(name))
    except Exception:  # noqa: BLE001 - whatever a filter refuses, it isn't usable by defaults
        return False
    return True


def threshold_keys(name: str, width: int) -> Any:
    """Names of a filter's thresholds for scores of ``width`` values; a pair for filters with two bounds; none if unknown."""
    keys = set(defaults(name))
    if {"min_length", "max_length"} <= keys and REGISTRY[name].direction == BETWEEN:
        return "min_length", "max_length"
    for key in ("threshold", "thresholds"):
        if key in keys:
            return key
    return None


def _next(scores: DataFrame, name: str, value: float, up: bool) -> float:
    """The value itself's first neighbour in the data beyond ``value``, so that some rows stay; itself at the end."""
    c = _q(name).cast("double")
    at = scores.agg((F.min(F.when(c >= value, c)) if up else F.max(F.when(c <= value, c))).alias("at")).first()["at"]
    at = value if at is None else at
    beyond = scores.agg((F.min(F.when(c > at, c)) if up else F.max(F.when(c < at, c))).alias("b")).first()["b"]
    return float(at if beyond is None else beyond)


def percentile_parameters(kind: type[Filter], scores: DataFrame, excluded: float = 0.01) -> Any:
    """Thresholds that exclude about this share of rows: a value or list, or (lows, highs) for filters with two bounds."""
    names = _names(scores)
    constant = scores.agg(*(F.count_distinct(_q(n)).alias(f"c{i}") for i, n in enumerate(names))).first()
    single = [constant[f"c{i}"] <= 1 for i in range(len(names))]
    shares = [excluded / 2, 1 - excluded / 2, excluded, 1 - excluded]
    found = quantiles(scores, {n: shares for n in names})
    quantile = lambda n, q: float(found[n][shares.index(q)])
    unpack = lambda v: v[0] if len(v) == 1 else v
    if kind.direction == BETWEEN:
        lows, highs = [], []
        for n, one in zip(names, single, strict=True):
            lows.append(kind.accept_threshold[0] if one else _next(scores, n, quantile(n, excluded / 2), False))
            highs.append(kind.accept_threshold[1] if one else _next(scores, n, quantile(n, 1 - excluded / 2), True))
        return unpack(lows), unpack(highs)
    up = kind.direction == LOW
    share = 1 - excluded if up else excluded
    return unpack([kind.accept_threshold if one else _next(scores, n, quantile(n, share), up) for n, one in zip(names, single, strict=True)])


def percentile_config(corpus: ParallelCorpus, filters: Sequence[tuple[str, dict[str, Any]]], excluded: float = 0.01) -> list[dict[str, Any]]:
    """Filters with thresholds from the corpus's own scores; those without adjustable thresholds keep their arguments."""
    out = []
    for name, parameters in filters:
        own, new = make(name, parameters), {**defaults(name), **parameters}
        scores = flatten(FilterPipeline([own]).score(corpus)).persist()
        keys = threshold_keys(name, len(_names(scores)))
        if keys and own.direction in (LOW, HIGH, BETWEEN):
            found = percentile_parameters(type(own), scores, excluded)
            new.update(zip(keys, found, strict=True) if isinstance(keys, tuple) else {keys: found})
        out.append({name: new})
        scores.unpersist()
    return out


class ScoreClusters:
    """k-means over standardised scores; the noisy cluster is the one of the highest mean, and its centre gives thresholds."""

    def __init__(self, scores: DataFrame, k: int = 2, seed: int = 0) -> None:
        self.names = _names(scores)
        self.signs = np.array([1.0 if REGISTRY[n.split(".")[0]].direction == LOW else -1.0 for n in self.names])
        sums = [f(_q(n).cast("double")).alias(f"{p}{i}") for i, n in enumerate(self.names) for p, f in (("m", F.avg), ("d", F.stddev_pop))]
        row = scores.agg(*sums).first()
        self.mean = np.array([row[f"m{i}"] for i in range(len(self.names))])
        self.deviation = np.array([row[f"d{i}"] or 1.0 for i in range(len(self.names))])
        columns = [((_q(n).cast("double") - float(m)) * float(s / d)).alias(f"x{i}") for i, (n, m, d, s) in enumerate(zip(self.names, self.mean, self.deviation, self.signs, strict=True))]
        self.inputs = [f"x{i}" for i in range(len(self.names))]
        data = VectorAssembler(inputCols=self.inputs, outputCol="features").transform(scores.select("idx", *columns)).persist()
        self.model = KMeans(k=k, seed=seed).fit(data)
        self.data = self.model.transform(data)
        centres = np.array(self.model.clusterCenters())
        self.noisy = int(centres.mean(axis=1).argmax())
        self.centres = centres * self.signs * self.deviation + self.mean

    def labels(self) -> DataFrame:
        return self.data.select("idx", F.col("prediction").alias("label"))

    def thresholds(self, digits: int = 6) -> dict[str, float]:
        return dict(zip(self.names, np.round(self.centres[self.noisy], digits).tolist(), strict=True))

    def rejects(self, seed: int = 1, share: float = 0.1) -> dict[str, bool]:
        """Scores whose permutation lowers a random forest's accuracy by less than a tenth of the mean."""
        rows = self.data.select(*self.inputs, F.col("prediction").cast("double").alias("label"), "features").persist()
        forest = RandomForestClassifier(numTrees=50, seed=seed, labelCol="label").fit(rows)
        right = lambda df: float(forest.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
        base, drops = right(rows), []
        for i in range(len(self.names)):
            # a permutation inside partitions of equal hash: each row takes a neighbour's value in a random order
            order = rows.select(*self.inputs, "label").withColumn("__r", F.rand(seed + i)).repartition("__r").sortWithinPartitions("__r")
            moved = order.mapInPandas(_shifted(self.inputs[i]), order.drop("__r").schema)
            drops.append(base - right(VectorAssembler(inputCols=self.inputs, outputCol="features").transform(moved)))
        return {n: bool(d < share * float(np.mean(drops))) for n, d in zip(self.names, drops, strict=True)}


def _shifted(column: str):
    def kernel(batches):
        for batch in batches:
            batch = batch.drop(columns="__r")
            batch[column] = np.roll(batch[column].to_numpy(), 1)
            yield batch

    return kernel


def cluster_config(corpus: ParallelCorpus, filters: Sequence[tuple[str, dict[str, Any]]], sample: int = 100_000, max_length: int = 150, k: int = 2) -> list[dict[str, Any]]:
    """Filters with thresholds from clusters of a sample's scores, after duplicates and long rows are removed; a filter all
    of whose scores are rejected is left out."""
    base = FilterPipeline.of([{"LengthFilter": {"max_length": max_length, "unit": "word"}}]).filter(remove_duplicates(corpus))
    base = subset(ParallelCorpus(base.df, base.n), sample, seed=1) if base.df.count() > sample else base
    pipeline = FilterPipeline.of([{n: p} for n, p in filters])
    clusters = ScoreClusters(flatten(pipeline.score(base)), k)
    limits, rejected, out = clusters.thresholds(), clusters.rejects(), []
    for (name, parameters), path in zip(filters, pipeline.paths(), strict=True):
        own = [n for n in limits if n == ".".join(path) or n.startswith(".".join(path) + ".")]
        key = threshold_keys(name, len(own))
        if not own or all(rejected[n] for n in own) or not isinstance(key, str):
            continue
        found = [REGISTRY[name].accept_threshold if rejected[n] else limits[n] for n in own]
        out.append({name: {**parameters, key: found if len(found) > 1 else found[0]}})
    return out


def diagram(steps: Sequence[dict[str, Any]]) -> str:
    """The steps' files and order as text in the DOT language."""
    ins, outs = ("inputs", "inputs_2", "input", "overlap", "data", "src_data", "training_scores", "scores"), ("outputs", "outputs_2", "output", "src_output", "tgt_output", "model")
    lines = ["digraph steps {"]
    for i, step in enumerate(steps):
        lines.append(f'  step{i} [shape=box label="{i + 1}: {step["type"]}"];')
        files = lambda keys: reduce(lambda a, b: a + b, ((v if isinstance(v, list) else [v]) for k in keys if (v := step.get("parameters", {}).get(k)) is not None), [])  # noqa: B023, E731
        lines += [f'  "{f}" -> step{i};' for f in files(ins) if isinstance(f, str)]
        lines += [f'  step{i} -> "{f}";' for f in files(outs) if isinstance(f, str)]
    return "\n".join([*lines, "}"])
