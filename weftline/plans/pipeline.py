"""Pipelines of filters as one logical plan: scores, decisions, and the rows accepted or rejected."""

from __future__ import annotations

import importlib
from collections import Counter
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.corpus import ParallelCorpus
from weftline.errors import ConfigurationError
from weftline.functions.text import all_of
from weftline.operators.filters import REGISTRY, Filter


def make(name: str, parameters: dict[str, Any] | None = None, module: str | None = None, **extra: Any) -> Filter:
    """A filter by its class name, from the registry or a module of one's own."""
    if module:
        try:
            kind = getattr(importlib.import_module(module), name)
        except (ImportError, AttributeError) as error:
            raise ConfigurationError(f"no {name} in {module}") from error
    else:
        import weftline.operators.models  # noqa: F401 - model-based filters register themselves

        if name not in REGISTRY:
            raise ConfigurationError(f"unknown filter: {name}")
        kind = REGISTRY[name]
    try:
        return kind(**{**(parameters or {}), **extra})
    except TypeError as error:
        raise ConfigurationError(f"{name}: {error}") from error


class FilterPipeline:
    """Filters in the order given. Native decisions are checked before Python ones, whatever the order: the result is equal."""

    def __init__(self, filters: Sequence[Filter]) -> None:
        self.filters = list(filters)

    @staticmethod
    def of(config: Sequence[dict[str, Any]], workdir: str = "") -> FilterPipeline:
        """From a list of {ClassName: parameters}, each perhaps with ``module``."""
        found = []
        for item in config:
            names = [k for k in item if k != "module"]
            if len(names) != 1:
                raise ConfigurationError(f"one filter expected: {item}")
            found.append(make(names[0], item[names[0]], item.get("module"), workdir=workdir))
        return FilterPipeline(found)

    def paths(self) -> list[tuple[str, ...]]:
        """Where each filter's score lies: its class, then its name or, if the class repeats, its number from 1."""
        classes = [type(f).__name__ for f in self.filters]
        total, seen, out = Counter(classes), Counter(), []
        for c, f in zip(classes, self.filters, strict=True):
            seen[c] += 1
            if f.name:
                out.append((c, f.name))
            else:
                out.append((c, str(seen[c])) if total[c] > 1 else (c,))
        if len(set(out)) < len(out):
            raise ConfigurationError("filters of one class need different names")
        return out

    def _nested(self, values: Sequence[Column]) -> Column:
        groups: dict[str, list[tuple[str | None, Column]]] = {}
        for path, value in zip(self.paths(), values, strict=True):
            groups.setdefault(path[0], []).append((path[1] if len(path) > 1 else None, value))
        fields = [
            (inner[0][1] if inner[0][0] is None else F.struct(*(v.alias(str(k)) for k, v in sorted(inner, key=lambda x: str(x[0]))))).alias(name)
            for name, inner in sorted(groups.items())
        ]
        return F.struct(*fields)

    def score(self, corpus: ParallelCorpus, decide: bool = False) -> DataFrame:
        """idx and ``score``: a struct by filter; with ``decide`` each score comes with whether it is accepted."""
        raw = [f.score(corpus.segments).alias(f"__{i}") for i, f in enumerate(self.filters)]
        scored = corpus.df.select("idx", *raw)
        values = [F.col(f"__{i}") for i in range(len(self.filters))]
        if decide:
            values = [F.struct(v.alias("scores"), f.accept(v).alias("accept")) for f, v in zip(self.filters, values, strict=True)]
        return scored.select("idx", self._nested(values).alias("score"))

    def _ordered(self) -> list[Filter]:
        return sorted(self.filters, key=lambda f: f.python)

    def accepts(self, segments: Sequence[Column]) -> Column:
        """Whether every filter accepts."""
        return all_of([f.decide(segments) for f in self._ordered()])

    def filter(self, corpus: ParallelCorpus) -> ParallelCorpus:
        # one condition a filter: rows that a native filter rejects never reach a Python worker
        for f in self._ordered():
            corpus = corpus.where(f.decide(corpus.segments))
        return corpus

    def filterfalse(self, corpus: ParallelCorpus) -> ParallelCorpus:
        """Rows that at least one filter rejects."""
        return corpus.where(~self.accepts(corpus.segments))

    def removed(self, corpus: ParallelCorpus) -> DataFrame:
        """One row a filter, each on all rows: how many it rejects, and its share; one pass for all."""
        names = [".".join(p) for p in self.paths()]
        counts = [F.sum((~f.decide(corpus.segments)).cast("long")).alias(f"c{i}") for i, f in enumerate(self.filters)]
        total = corpus.df.agg(F.count("*").alias("total"), *counts)
        rows = F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.coalesce(f"c{i}", F.lit(0)).alias("removed")) for i, n in enumerate(names))))
        one = total.select("total", rows.alias("r")).select("r.filter", "r.removed", "total")
        return one.withColumn("share", F.coalesce(F.try_divide("removed", "total"), F.lit(0.0)))
