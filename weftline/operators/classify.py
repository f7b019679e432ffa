"""A classifier of clean and noisy rows from their scores: labels by quantile cut-offs, penalised logistic regression by
Newton steps whose sums Spark computes, and a search for the cut-offs."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.errors import ConfigurationError
from weftline.functions.quantiles import quantiles as exact
from weftline.operators.filters import BETWEEN, FALSE, HIGH, LOW, REGISTRY, TRUE
from weftline.sources.text import read_json, write_json

_SIGN = {LOW: -1, FALSE: -1, HIGH: 1, TRUE: 1, BETWEEN: 1}


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def matched(columns: Sequence[str], features: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """Score columns that begin with a feature's key, with that feature's settings; the last key that fits counts."""
    out = {}
    for c in columns:
        for key, settings in features.items():
            if c.startswith(key):
                out[c] = settings or {}
    return out


def sign(column: str, settings: dict[str, Any]) -> int:
    """1 where high scores are clean, -1 where low ones are."""
    given = settings.get("clean-direction")
    if given is None:
        import weftline.operators.models  # noqa: F401

        kind = REGISTRY[column.split(".")[0]]
        given = getattr(kind, "direction", BETWEEN)
        given = FALSE if column.startswith("RegExpFilter") and given == LOW else given
    return _SIGN.get(given, 1)


@dataclass
class Standard:
    """Means, population deviations and signs of score columns."""

    mean: dict[str, float]
    deviation: dict[str, float]
    signs: dict[str, int]

    @staticmethod
    def of(scores: DataFrame, features: dict[str, dict[str, Any]]) -> Standard:
        names = list(features)
        sums = [f(_q(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("d", F.stddev_pop))]
        row = scores.agg(*sums).first()
        return Standard({n: row[f"m{i}"] for i, n in enumerate(names)}, {n: row[f"d{i}"] for i, n in enumerate(names)}, {n: sign(n, features[n]) for n in names})

    def column(self, name: str) -> Column:
        deviation = self.deviation[name]
        return (_q(name) - self.mean[name]) * (self.signs[name] / deviation) if deviation else F.lit(0.0)

    def apply(self, scores: DataFrame, *keep: str) -> DataFrame:
        return scores.select(*keep, *(self.column(n).alias(n) for n in self.mean))


@dataclass
class Classifier:
    """Logistic regression over standardised scores."""

    features: list[str]
    weights: list[float]
    intercept: float
    standard: Standard
    quantiles: dict[str, float] = field(default_factory=dict)

    def margin(self, standardised: bool = False) -> Column:
        terms = ((_q(n) if standardised else self.standard.column(n)) * w for n, w in zip(self.features, self.weights, strict=True))
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept)))

    def probability(self, standardised: bool = False) -> Column:
        return 1 / (1 + F.exp(-self.margin(standardised)))

    def classify(self, scores: DataFrame) -> DataFrame:
        """idx, label and probability of being clean."""
        return scores.select("idx", (self.margin() > 0).cast("int").alias("label"), self.probability().alias("probability"))

    def save(self, path: str) -> None:
        write_json(path, asdict(self))

    @staticmethod
    def load(path: str) -> Classifier:
        data = read_json(path)
        return Classifier(**{**data, "standard": Standard(**data["standard"])})


def fit(data: DataFrame, features: Sequence[str], penalty: float = 1.0, penalise_intercept: bool = True, rounds: int = 50) -> tuple[list[float], float]:
    """Weights and intercept of logistic regression on ``label``. Each round is one aggregation of k(k+3)/2 sums."""
    names, k = list(features), len(features) + 1
    x = [*(_q(n) for n in names), F.lit(1.0)]
    w, ridge = np.zeros(k), np.diag([penalty] * (k - 1) + [penalty if penalise_intercept else 0.0])
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-reduce(lambda a, b: a + b, (xi * float(wi) for xi, wi in zip(x, w, strict=True)))))
        sums = [F.sum(x[i] * (F.col("label") - F.col("__p"))).alias(f"g{i}") for i in range(k)]
        sums += [F.sum(x[i] * x[j] * F.col("__p") * (1 - F.col("__p"))).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        row = data.withColumn("__p", p).agg(*sums).first()
        g = np.array([row[f"g{i}"] for i in range(k)]) - ridge @ w
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return w[:-1].tolist(), float(w[-1])


class Trainer:
    """Finds quantile cut-offs, the labels they give, and a classifier by a criterion: AIC, BIC, SSE, CE or ROC_AUC."""

    def __init__(self, scores: DataFrame, features: dict[str, Any], dev: DataFrame | None = None, model_type: str | None = None, model_parameters: dict[str, Any] | None = None) -> None:
        if model_type not in (None, "LogisticRegression"):
            raise ConfigurationError(f"unknown model type: {model_type}")
        parameters = dict(model_parameters or {})
        self.penalise, self.penalty = parameters.pop("solver", "lbfgs") == "liblinear", 1.0 / float(parameters.pop("C", 1.0))
        self.raw, self.features = scores, matched([c for c in scores.columns if c != "idx"], features)
        if not self.features:
            raise ConfigurationError("no feature matches a score")
        self.standard = Standard.of(scores, self.features)
        self.data = self.standard.apply(scores).persist()
        self.dev = self.standard.apply(dev, "label").persist() if dev is not None else None
        self.n = self.data.count()
        self.known: dict[tuple[str, float], float] = {}

    def cutoffs(self, quantiles: dict[str, float], data: DataFrame | None = None) -> dict[str, float]:
        names = list(quantiles)
        missing = {n: [q for q in (quantiles[n],) if (n, q) not in self.known] for n in names} if data is None else {n: [quantiles[n]] for n in names}
        found = exact(self.data if data is None else data, missing) if any(missing.values()) else {}
        if data is not None:
            return {n: found[n][0] for n in names}
        self.known.update({(n, quantiles[n]): found[n][0] for n in names if missing[n]})
        return {n: self.known[n, quantiles[n]] for n in names}

    def labelled(self, cutoffs: dict[str, float]) -> DataFrame:
        low = reduce(lambda a, b: a | b, (_q(n) < F.lit(v) for n, v in cutoffs.items()), F.lit(False))
        return self.data.withColumn("label", F.when(low, 0).otherwise(1))

    def train(self, quantiles: dict[str, float]) -> tuple[Classifier, DataFrame] | None:
        active = {n: q for n, q in quantiles.items() if q != 0}
        data = self.labelled(self.cutoffs(active)) if active else self.data.withColumn("label", F.lit(1))
        kinds = data.agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
        if kinds["a"] == kinds["b"] or not active:
            return None
        weights, intercept = fit(data, list(active), self.penalty, self.penalise)
        return Classifier(list(active), weights, intercept, self.standard, dict(quantiles)), data

    def criterion(self, name: str, model: Classifier, data: DataFrame) -> float:
        p, k = model.probability(standardised=True), len(model.features)
        if name == "ROC_AUC":
            if self.dev is None:
                raise ConfigurationError("ROC_AUC needs development scores")
            return roc_auc(self.dev.select("label", p.alias("p")))
        if name == "SSE":
            wrong = F.pow(F.col("label") - (model.margin(standardised=True) > 0).cast("int"), 2)
            return float(data.agg(F.sum(wrong)).first()[0]) + 0.01
        clipped = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
        loss = float(data.agg(F.avg(-F.when(F.col("label") == 1, F.ln(clipped)).otherwise(F.ln(1 - clipped)))).first()[0])
        if name == "CE":
            return loss
        if name == "AIC":
            return 2 * k - 2 * math.log(loss)
        if name == "BIC":
            return self.n * math.log(loss / self.n) + k * math.log(self.n)
        raise ConfigurationError(f"unknown criterion: {name}")

    def bounds(self) -> tuple[list[tuple[float, float]], list[float]]:
        quantiles = [s.get("quantiles") or {} for s in self.features.values()]
        return [(q.get("min", 0), q.get("max", 1)) for q in quantiles], [q.get("initial", 0.1) for q in quantiles]

    def find(self, criterion: str = "CE", algorithm: str = "default", options: dict[str, Any] | None = None) -> tuple[Classifier, float, dict[str, float], dict[str, float]]:
        """(classifier, criterion's value, quantiles, their values in the raw scores)."""
        names, (bounds, start) = list(self.features), self.bounds()
        high = criterion == "ROC_AUC"

        def cost(vector: Sequence[float]) -> float:
            found = self.train(dict(zip(names, vector, strict=True)))
            if found is None:
                return math.inf
            value = self.criterion(criterion, *found)
            return -value if high else value

        if algorithm == "none":
            best = list(start)
        elif algorithm == "default":
            best = search(cost, start, bounds, **(options or {}))
        elif algorithm.lower() in ("nelder-mead", "powell"):
            best = coordinate_search(cost, start, bounds)
        else:
            raise ConfigurationError(f"unknown search: {algorithm}")
        quantiles = dict(zip(names, best, strict=True))
        found = self.train(quantiles)
        if found is None:
            raise ConfigurationError("these quantiles give all rows one label")
        return found[0], self.criterion(criterion, *found), quantiles, {n: v[0] for n, v in exact(self.raw, {n: [q] for n, q in quantiles.items()}).items()}


def search(cost: Callable[[Sequence[float]], float], start: Sequence[float], bounds: Sequence[tuple[float, float]], step_coef: float = 1.25) -> list[float]:
    """Divide or multiply one value at a time while that lowers the cost and stays inside the bounds."""
    now, least = list(start), cost(start)
    moved = True
    while moved:
        moved = False
        for i, (low, high) in enumerate(bounds):
            for value in (now[i] / step_coef, now[i] * step_coef):
                if low <= value <= high:
                    tried = [*now[:i], value, *now[i + 1 :]]
                    if (c := cost(tried)) < least:
                        now, least, moved = tried, c, True
                        break
    return now


def coordinate_search(cost: Callable[[Sequence[float]], float], start: Sequence[float], bounds: Sequence[tuple[float, float]], rounds: int = 3, points: int = 8) -> list[float]:
    """One coordinate at a time over a grid that narrows; a derivative-free stand-in for library optimisers."""
    now, least = list(start), cost(start)
    width = [high - low for low, high in bounds]
    for r in range(rounds):
        for i, (low, high) in enumerate(bounds):
            half = width[i] / (4**r) / 2
            for value in np.linspace(max(low, now[i] - half), min(high, now[i] + half), points):
                tried = [*now[:i], float(value), *now[i + 1 :]]
                if (c := cost(tried)) < least:
                    now, least = tried, c
    return now


def roc_auc(rows: DataFrame) -> float:
    """Area under the curve from ``label`` and ``p``: counts by distinct p, then running sums over blocks of them."""
    counts = rows.groupBy("p").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    width = F.floor(F.col("p") * 1000).cast("int")
    blocks = counts.withColumn("block", width)
    sums = blocks.groupBy("block").agg(F.sum("bad").alias("b"))
    before = F.coalesce(F.sum("b").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("block", before.alias("start"))  # at most 1001 rows
    inside = F.coalesce(F.sum("bad").over(Window.partitionBy("block").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = blocks.join(F.broadcast(starts), "block").withColumn("below", F.col("start") + inside)
    row = ranked.agg(F.sum(F.col("good") * (F.col("below") + F.col("bad") / 2)).alias("u"), F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    return float(row["u"]) / (row["g"] * row["b"]) if row["g"] and row["b"] else 0.5
