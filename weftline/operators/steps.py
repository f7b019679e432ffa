"""Steps: operators from corpora to corpora, by line number, hash, score or content."""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.corpus import ParallelCorpus, numbered
from weftline.errors import ConfigurationError, CorpusError
from weftline.functions.hashing import SegmentHasher, below
from weftline.functions.text import strip


def _again(corpus: ParallelCorpus) -> ParallelCorpus:
    """The corpus with dense line numbers from 0."""
    return ParallelCorpus(numbered(corpus.df.withColumnRenamed("idx", "__old"), ["__old"]).select("idx", *corpus.names), corpus.n)


def concatenate(*corpora: ParallelCorpus) -> ParallelCorpus:
    """One after another."""
    if len({c.n for c in corpora}) != 1:
        raise CorpusError("corpora of different width")
    bounds = [c.df.agg(F.count("*"), F.min("idx"), F.max("idx"), F.count_distinct("idx")).first() for c in corpora[:-1]]
    if all(n == 0 or (low, high, kinds) == (0, n - 1, n) for n, low, high, kinds in bounds):
        # dense numbers: the lines before each corpus are added to its own
        before = accumulate((n for n, *_ in bounds), initial=0)
        moved = [c.df.withColumn("idx", F.col("idx") + k) for c, k in zip(corpora, before, strict=True)]
        return ParallelCorpus(reduce(DataFrame.unionByName, moved), corpora[0].n)
    parts = [c.df.withColumn("__file", F.lit(i)).withColumnRenamed("idx", "__old") for i, c in enumerate(corpora)]
    whole = reduce(DataFrame.unionByName, parts)
    return ParallelCorpus(numbered(whole, ["__file", "__old"]).select("idx", *corpora[0].names), corpora[0].n)


def head(corpus: ParallelCorpus, n: int) -> ParallelCorpus:
    """The first n lines: line numbers alone are sorted for the last of them, and a filter takes the lines."""
    last = corpus.df.select("idx").orderBy("idx").limit(n).agg(F.max("idx")).first()[0]
    return corpus.where(F.col("idx") <= last if last is not None else F.lit(False))


def tail(corpus: ParallelCorpus, n: int) -> ParallelCorpus:
    """The last n lines, likewise."""
    first = corpus.df.select("idx").orderBy(F.desc("idx")).limit(n).agg(F.min("idx")).first()[0]
    return corpus.where(F.col("idx") >= first if first is not None else F.lit(False))


def slice_lines(corpus: ParallelCorpus, start: int = 0, stop: int | None = None, step: int = 1) -> ParallelCorpus:
    """Lines from ``start`` up to ``stop``, each ``step``th; line numbers have to be dense."""
    if start < 0 or step < 1 or (stop is not None and stop < 0):
        raise ConfigurationError("slices can't be negative")
    inside = (F.col("idx") >= start) & ((F.col("idx") - start) % step == 0)
    return corpus.where(inside & (F.col("idx") < stop) if stop is not None else inside)


def subset(corpus: ParallelCorpus, size: int, seed: int | None = None, shuffle: bool = False) -> ParallelCorpus:
    """``size`` random lines in their order; with ``shuffle`` the other languages' lines are each drawn and ordered anew.

    Line numbers have to be dense. Positions are drawn by Python's generator, so a seed always draws the same lines. A
    corpus of fewer lines is returned as it is.
    """
    total, draw, spark = corpus.df.count(), random.Random(seed), corpus.df.sparkSession
    if total < size:
        return corpus
    picked = draw.sample(range(total), size)
    chosen = spark.createDataFrame([(i,) for i in sorted(picked)], "idx long")
    if not shuffle:
        return ParallelCorpus(corpus.df.join(chosen, "idx", "left_semi"), corpus.n)
    places = sorted(picked)
    out = corpus.df.join(chosen, "idx", "left_semi").select("idx", "s0")
    for i in range(1, corpus.n):
        order = list(places)
        draw.shuffle(order)
        moved = spark.createDataFrame(list(zip(places, order, strict=True)), "idx long, source long")
        own = corpus.df.select(F.col("idx").alias("source"), f"s{i}").join(moved, "source").select("idx", f"s{i}")
        out = out.join(own, "idx")
    return ParallelCorpus(out, corpus.n)


def split(corpus: ParallelCorpus, divisor: int, threshold: int = 1, hasher: SegmentHasher | None = None) -> tuple[ParallelCorpus, ParallelCorpus]:
    """(lines whose hash modulo ``divisor`` lies below ``threshold``, the others)."""
    hasher = hasher or SegmentHasher()
    if not 0 < threshold < divisor:
        raise ConfigurationError("threshold has to lie between 0 and divisor")
    inside = below(hasher.number(hasher.line_key(corpus.segments)), divisor, threshold)
    return corpus.where(inside), corpus.where(~inside)


def remove_duplicates(corpus: ParallelCorpus, hasher: SegmentHasher | None = None) -> ParallelCorpus:
    """The first line of each key. Keys are compared by their SHA-256, not by a short hash that could collide.

    First lines are found by a partial aggregation of (key digest, idx), which keeps hot keys small before the shuffle;
    texts travel once, to be joined by idx.
    """
    hasher = hasher or SegmentHasher()
    first = corpus.df.select("idx", F.sha2(hasher.line_key(corpus.segments), 256).alias("k")).groupBy("k").agg(F.min("idx").alias("idx"))
    return ParallelCorpus(corpus.df.join(first.select("idx"), "idx", "left_semi"), corpus.n)


def remove_overlap(corpus: ParallelCorpus, other: ParallelCorpus, hasher: SegmentHasher | None = None) -> ParallelCorpus:
    """Lines whose key doesn't occur in the other corpus; duplicates inside stay."""
    hasher = hasher or SegmentHasher()
    key = lambda c: F.sha2(hasher.line_key(c.segments), 256)
    seen = other.df.select(key(other).alias("__k")).distinct()
    return ParallelCorpus(corpus.df.withColumn("__k", key(corpus)).join(seen, "__k", "left_anti").drop("__k"), corpus.n)


def duplicate_statistics(corpus: ParallelCorpus, other: ParallelCorpus | None = None, hasher: SegmentHasher | None = None) -> DataFrame:
    """One row: total, unique (distinct keys), once, mean and max multiplicity; with another corpus its overlap."""
    hasher = hasher or SegmentHasher()
    counted = lambda c: c.df.select(F.sha2(hasher.line_key(c.segments), 256).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    mine = counted(corpus)
    columns = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("*").alias("unique"),
        F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)).alias("once"),
        F.avg("n").alias("mean"),
        F.max("n").alias("most"),
    ]
    if other is None:
        return mine.agg(*columns)
    both = mine.join(counted(other).select("k", F.lit(True).alias("there")), "k", "left")
    there = F.col("there").isNotNull()
    return both.agg(*columns, F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("overlap_total"), F.count(F.when(there, 1)).alias("overlap_unique"))


def product(corpora: Sequence[ParallelCorpus], skip_empty: bool = True, skip_duplicates: bool = True, k: int | None = None, seed: int | None = None) -> ParallelCorpus:
    """For each line all combinations of the languages' alternatives; ``k`` random ones of them.

    ``corpora`` has one corpus a language, whose segments are the alternatives. Skipping duplicates sorts the alternatives.
    The last language varies fastest. A line's sample depends on the seed and its number alone.
    """
    base = reduce(lambda a, b: a.join(b, "idx"), (c.df.select("idx", F.array(*c.segments).alias(f"a{i}")) for i, c in enumerate(corpora)))
    for i in range(len(corpora)):
        options = F.col(f"a{i}")
        if skip_empty:
            options = F.filter(options, lambda x: strip(x) != "")
        if skip_duplicates:
            options = F.array_sort(F.array_distinct(options))
        base = base.withColumn(f"a{i}", options)
    out = base
    for i in range(len(corpora)):
        out = out.select("*", F.posexplode(f"a{i}").alias(f"p{i}", f"s{i}"))
    order = ["idx", *(f"p{i}" for i in range(len(corpora)))]
    if k is not None:
        chance = F.xxhash64(F.lit(seed or 0), *order)
        pick = F.row_number().over(Window.partitionBy("idx").orderBy(chance, *order))  # a line's combinations alone
        out = out.withColumn("__pick", pick).where(F.col("__pick") <= k)
    names = [f"s{i}" for i in range(len(corpora))]
    flat = out.select(*(F.col(c).alias(f"__{c}") for c in order), *names)
    return ParallelCorpus(numbered(flat, [f"__{c}" for c in order]).select("idx", *names), len(corpora))


def unzip(lines: DataFrame, separator: str, n: int) -> ParallelCorpus:
    """A corpus from lines (idx, value) of ``n`` parts; another number of parts stops with the line's number."""
    parts = F.split("value", "\\Q" + separator + "\\E", -1)
    wrong = F.raise_error(F.concat(F.lit("line "), F.col("idx") + 1, F.lit(f" doesn't have {n} parts")))
    checked = lines.withColumn("__p", F.when(F.size(parts) == n, parts).otherwise(wrong))
    return ParallelCorpus(checked.select("idx", *(strip(F.get("__p", F.lit(i))).alias(f"s{i}") for i in range(n))), n)


_COMBINE = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "truediv": lambda a, b: F.try_divide(a, b), "min": F.least, "max": F.greatest}


def _item(key: str) -> Column:
    parsed = F.try_parse_json("value")
    paths = ["$"]
    for p in key.split("."):
        paths = [x + f".{p}" if not p.isdigit() else x + f"[{p}]" for x in paths] + ([x + f".{p}" for x in paths] if p.isdigit() else [])
    found = [F.try_variant_get(parsed, path, "string") for path in paths]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def values(lines: DataFrame, key: str | Sequence[str] | None = None, kind: str = "", combine: str | None = None) -> DataFrame:
    """idx and value: each line's JSON value under a dotted key, converted to ``kind`` (int, float, str or none).

    Several keys are folded by the operator ``combine`` (add, sub, mul, truediv, min, max). Without a key the line itself is
    the value: a number if all lines are numbers.
    """
    if key is None:
        return lines.select("idx", F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$", "double"), F.expr("try_cast(value AS DOUBLE)")).alias("value"))
    keys = [key] if isinstance(key, str) else list(key)
    if len(keys) > 1 and combine not in _COMBINE:
        raise ConfigurationError(f"combine_operator has to be one of {', '.join(_COMBINE)}: {combine}")
    kinds = {"": "double", "int": "long", "float": "double", "str": "string"}
    if kind not in kinds:
        raise ConfigurationError(f"unknown type: {kind}")
    items = [_item(k) if kind == "str" else _item(k).cast("double").cast(kinds[kind]) for k in keys]
    return lines.select("idx", reduce(_COMBINE.get(combine or "", lambda a, b: a), items).alias("value"))


def sort(corpus: ParallelCorpus, by: DataFrame, reverse: bool = False) -> ParallelCorpus:
    """Lines in the order of ``by`` (idx, value); ties stay in their order, reversed with the rest."""
    joined = corpus.df.withColumnRenamed("idx", "__old").join(by.select(F.col("idx").alias("__old"), F.col("value").alias("__v")), "__old")
    if reverse:
        return ParallelCorpus(numbered(joined, ["__v", "__old"], falling=True).select("idx", *corpus.names), corpus.n)
    return ParallelCorpus(numbered(joined, ["__v", "__old"]).select("idx", *corpus.names), corpus.n)


def join_scores(scores: Sequence[DataFrame], keys: Sequence[str | None] | None = None) -> DataFrame:
    """idx and ``score``: score tables side by side; a key nests its table there, without one its fields join the top."""
    keys = list(keys) if keys else [None] * len(scores)
    if len(keys) != len(scores):
        raise ConfigurationError("one key a score table")
    parts = [s.select("idx", F.col("score").alias(f"__{i}")) for i, s in enumerate(scores)]
    joined = reduce(lambda a, b: a.join(b, "idx"), parts)
    tree: dict[str, Any] = {}
    for i, (table, key) in enumerate(zip(scores, keys, strict=True)):
        kind = table.schema["score"].dataType
        if key is None:
            if not hasattr(kind, "fieldNames"):
                raise CorpusError("a table without key has to hold objects")
            for name in kind.fieldNames():
                tree[name] = _opened(F.col(f"__{i}")[name], kind[name].dataType)
        else:
            *way, last = key.split(".")
            at = tree
            for step in way:
                at[step] = at[step] if isinstance(at.get(step), dict) else {}
                at = at[step]
            at[last] = _opened(F.col(f"__{i}"), kind)
    return joined.select("idx", _closed(tree).alias("score"))


def _opened(value: Column, kind: Any) -> Any:
    return {n: _opened(value[n], kind[n].dataType) for n in kind.fieldNames()} if hasattr(kind, "fieldNames") else value


def _closed(tree: Any) -> Column:
    return F.struct(*(_closed(v).alias(k) for k, v in sorted(tree.items()))) if isinstance(tree, dict) else tree


def flatten(scores: DataFrame, column: str = "score") -> DataFrame:
    """idx and one column a leaf, named by its dotted way; list items by their numbers, as many as the longest list has, null
    where a row's list is shorter. A list that is empty in all rows has no columns."""
    leaves: list[tuple[Column, Any, str]] = [(F.col(column), scores.schema[column].dataType, "")]
    while any(hasattr(kind, "fieldNames") or hasattr(kind, "elementType") for _, kind, _ in leaves):
        lists = [value for value, kind, _ in leaves if hasattr(kind, "elementType")]
        row = scores.agg(*(F.max(F.size(v)) for v in lists)).first() if lists else ()
        widths, opened = iter(row), []
        for value, kind, way in leaves:
            if hasattr(kind, "fieldNames"):
                opened += [(value[n], kind[n].dataType, f"{way}.{n}" if way else n) for n in kind.fieldNames()]
            elif hasattr(kind, "elementType"):
                opened += [(F.get(value, F.lit(i)), kind.elementType, f"{way}.{i}") for i in range(max(0, next(widths) or 0))]
            else:
                opened.append((value, kind, way))
        leaves = opened
    return scores.select("idx", *(value.cast("double").alias(way) for value, _, way in leaves))
