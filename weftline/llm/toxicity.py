"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon, nearness of its words to second-person words, capitals, punctuation and obfuscation rates.
The lexicon holds all words and word beginnings whose documents are labelled toxic far more often than others; it, the trees
and the calibration are fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of their id; every whole text is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.boost import Isotonic, Trees
from weftline.llm.common import keep, sample_ids, text_of
from weftline.llm.features import CHAR_NAMES, OBFUSCATED, char_features

#: Bound of the fit: labelled rows. Share of the rows for the calibration: 1/CALIBRATE.
SAMPLE, CALIBRATE = 40_000, 4
LEAST, MOST, NEAR, KEPT = 4, 8, 6, 500_000
SECOND = frozenset("you your yours yourself u ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ihnen tú ti usted ustedes vosotros vuestro".split())
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = str.maketrans("013457@$!+|", "oleastasiti")
NAMES = ("hits", "weight", "strongest", "many", "distinct", "near", "second", "obfuscated", "hidden", "words", *CHAR_NAMES)


def units(text: str) -> set[str]:
    """The text's lower-case words, and their beginnings of LEAST to MOST letters, marked by a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in range(LEAST, min(MOST, len(w)) + 1)}


class Lexicon(dict):
    """word -> number: 0 nothing, 1 second person, from 2 on an entry. Learns words as they come; bounded by ``trim``."""

    def __init__(self, entries: dict[str, float]) -> None:
        super().__init__()
        self.entries = sorted(entries)
        self.number = {e: i + 2 for i, e in enumerate(self.entries)}
        self.weights = np.array([0.0, 0.0, *(entries[e] for e in self.entries)])

    def __missing__(self, word: str) -> int:
        found = [self.number[u] for u in (word, *(word[:n] + "*" for n in range(LEAST, min(MOST, len(word)) + 1))) if u in self.number]
        best = max(found, key=lambda i: self.weights[i], default=int(word in SECOND))
        self[word] = best
        return best

    def __reduce__(self):
        return Lexicon, ({e: float(self.weights[i + 2]) for i, e in enumerate(self.entries)},)

    def trim(self) -> None:
        if len(self) > KEPT:
            self.clear()


def features(text: bytes, lexicon: Lexicon) -> list[float]:
    words = _WORD.findall(text.decode().lower())
    n = len(words)
    codes = np.fromiter(map(lexicon.__getitem__, words), np.int64, n)
    hits, second = np.flatnonzero(codes > 1), np.flatnonzero(codes == 1)
    weights = lexicon.weights[codes[hits]]
    near = 0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        before = hits - second[np.maximum(at - 1, 0)]
        after = second[np.minimum(at, len(second) - 1)] - hits
        near = int(np.count_nonzero(((before > 0) & (before <= NEAR)) | ((after > 0) & (after <= NEAR))))
    odd = OBFUSCATED.findall(text)
    hidden = sum(lexicon[w.decode("utf-8", "ignore").lower().translate(_PLAIN)] > 1 for w in odd) if odd else 0
    d = max(1, n)
    head = [len(hits) / d, float(weights.sum()) / d, float(weights.max()) if len(hits) else 0.0, math.log1p(len(hits)), float(len(np.unique(codes[hits])))]
    return [*head, near / d, len(second) / d, len(odd) / d, math.log1p(hidden), math.log1p(n), *char_features(text)]


def matrix(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    rows = []
    for text in texts.cast(pa.large_binary()):
        lexicon.trim()
        rows.append(features(text.as_py(), lexicon))
    return np.array(rows, np.float64).reshape(len(rows), len(NAMES))


def _count(wanted: frozenset[str] | None):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                found = units(text)
                counts.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["unit", "n"])

    return kernel


def _same_rows(unit: str, odds: dict, some: dict, other: dict) -> bool:
    """Whether a shorter beginning stands in the same documents, so that the unit adds nothing to it."""
    word = unit.rstrip("*")
    shorter = word[: min(MOST, len(word) - unit.endswith("*"))] + "*"
    return len(shorter) > LEAST and shorter in odds and (some[shorter], other.get(shorter)) == (some[unit], other.get(unit))


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees, curve: Isotonic) -> None:
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.curve(self.trees.margin(matrix(texts, self.lexicon)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled rows; ``docs`` has doc_id, text and ``labels`` doc_id, toxic. Null labels don't count."""
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    chosen = sample_ids(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = keep(rows, "sample")
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic <> 1")
    n_toxic, n_clean = toxic.count(), clean.count()
    schema = "unit string, n long"
    counted = toxic.select("text").mapInArrow(_count(None), schema).groupBy("unit").agg(F.sum("n").alias("n"))
    least = max(3, round(0.002 * n_toxic))
    some = {r["unit"]: r["n"] for r in counted.where(F.col("n") >= least).collect()}
    wanted = frozenset(some)
    others = clean.select("text").mapInArrow(_count(wanted), schema).groupBy("unit").agg(F.sum("n").alias("n")).collect()
    other = {r["unit"]: r["n"] for r in others}
    odds = {}
    for unit, a in some.items():
        b = other.get(unit, 0)
        value = math.log((a + 0.5) / (n_toxic - a + 0.5)) - math.log((b + 0.5) / (n_clean - b + 0.5))
        error = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if value - 1.5 * error > 1.0:
            odds[unit] = value
    lexicon = Lexicon({u: x for u, x in odds.items() if not _same_rows(u, odds, some, other)})
    lists = "array<double>"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["text"], lexicon)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], values], ["doc_id", "toxic", "x"])

    found = rows.select("doc_id", F.col("toxic").cast("int"), "text").select("doc_id", "toxic", "text").mapInArrow(kernel, f"doc_id long, toxic int, x {lists}").toArrow()
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)) if len(found) else np.zeros((0, len(NAMES)))
    y, ids = (found["toxic"].to_numpy() == 1).astype(float), found["doc_id"].to_numpy()
    order = np.lexsort((*x.T, ids))
    x, y, ids = x[order], y[order], ids[order]
    apart = (ids * 2654435761 >> 7) % CALIBRATE == 0
    trees = Trees().fit(x[~apart], y[~apart])
    return Model(lexicon, trees, Isotonic().fit(trees.margin(x[apart]), y[apart]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, held_out, score, predicted. Null texts count as empty and get the empty text's score.

    Rows are independent: repeats get equal scores, ids may be null (not held out), other columns are ignored; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.score(texts), pa.float64())

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.arrow_udf(scores, "double")(text_of(text_col)).alias("score"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``score`` by a model fitted on ``labels``. Without labels every score is 0.5."""
    return score(docs, fit(docs, labels, sample))
