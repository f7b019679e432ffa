"""Similarity of sentence embeddings, and exact nearest neighbours of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.errors import ConfigurationError
from weftline.operators.filters import HIGH, REGISTRY, Filter
from weftline.store import written

#: Vectors of a block; queries that are compared with one at a time.
BLOCK, ROWS = 50_000, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 where one has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _matrix(values: pa.Array) -> np.ndarray:
    n = len(values)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(n, -1) if n else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _tile(k: int):
    """Kernel: the k best stored vectors of a block for each query of a block; ties go to the smaller id."""

    def kernel(asked: pa.Table, stored: pa.Table) -> pa.Table:
        stored = stored.sort_by("neighbour")
        ids, own = stored["neighbour"].to_numpy(), asked["own"].to_numpy()
        base, vectors = _matrix(stored["there"].combine_chunks()), asked["here"].combine_chunks()
        take, out = min(k, len(ids)), []
        for at in range(0, len(own), ROWS):
            distance = 1 - _matrix(vectors.slice(at, ROWS)) @ base.T if take else np.zeros((len(own[at : at + ROWS]), 0))
            order = np.argsort(distance, axis=1, kind="stable")[:, :take]
            out.append((np.repeat(own[at : at + ROWS], take), ids[order].ravel(), np.take_along_axis(distance, order, 1).ravel()))
        columns = [np.concatenate([x[i] for x in out]) if out else [] for i in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["id", "neighbour", "distance"])

    return kernel


def nearest(queries: DataFrame, stored: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """id, neighbour, distance: the k stored vectors of least cosine distance for each query, exactly.

    Both have ``id`` and ``vector``. Queries and stored vectors are cut into blocks by hash; each pair of blocks is a task of
    its own, which keeps the best k, and the blocks' bests are merged. Nothing passes through the driver. Ties go to the
    smaller id.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    rows, columns = max(1, -(-queries.count() // block)), stored.count()
    columns = max(1, -(-columns // block), min(cores, -(-columns // ROWS)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # names of their own, as both tables may come from one
    asked = queries.select(F.col("id").alias("own"), F.col("vector").alias("here"), part(rows).alias("q"), every(columns).alias("s"))
    given = stored.select(F.col("id").alias("neighbour"), F.col("vector").alias("there"), every(rows).alias("q"), part(columns).alias("s"))
    best = asked.groupBy("q", "s").cogroup(given.groupBy("q", "s")).applyInArrow(_tile(k), "id long, neighbour long, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))  # k rows a block for each query
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbour", "distance")


def margins(pairs: DataFrame, stored: Sequence[DataFrame], k: int = 4) -> DataFrame:
    """id and score: cosine similarity over the mean distance to the k nearest vectors of the other language."""
    sums = []
    for side in (0, 1):
        near = nearest(pairs.select("id", F.col(f"v{side}").alias("vector")), stored[1 - side], k)
        sums.append(near.groupBy("id").agg(F.sum("distance").alias(f"d{side}")))
    joined = pairs.join(sums[0], "id").join(sums[1], "id")
    return joined.select("id", F.try_divide(2 * k * cosine(F.col("v0"), F.col("v1")), F.col("d0") + F.col("d1")).alias("score"))


class SentenceEmbeddingFilter(Filter):
    """Cosine similarity of all pairs of segments' embeddings.

    ``embed`` maps (list of texts, language) to a matrix; without it a library is needed. With ``nn_model`` (a folder of
    ``train_nearest_neighbors``), similarities are divided by mean distances to neighbours: see ``score_frame``.
    """

    direction, accept_threshold, reject_threshold, python = HIGH, 0, 1 + 10**-6, True

    def __init__(self, languages: Sequence[str] | None = None, threshold: float = 0.5, nn_model: str | None = None, chunksize: int = 200, embed: Callable[[list[str], str], np.ndarray] | None = None, **rest: Any) -> None:
        super().__init__(**rest)
        if not languages:
            raise ConfigurationError("languages are needed")
        if embed is None:
            try:
                from laserembeddings import Laser
            except ImportError as error:
                raise ConfigurationError("an embedding function is needed where the library is missing") from error
            own = Laser()
            embed = lambda texts, language: own.embed_sentences(texts, language)
        self.languages, self.threshold, self.chunk, self.embed, self.nn_model = list(languages), threshold, chunksize, embed, nn_model
        self.set_based = nn_model is not None

    def vectors(self, segments: Sequence[Column]) -> list[Column]:
        def vector(segment: Column, language: str) -> Column:
            embed, chunk = self.embed, self.chunk

            def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for batch in batches:
                    texts = batch.to_pylist()
                    rows = [v.tolist() for i in range(0, len(texts), chunk) for v in np.asarray(embed(texts[i : i + chunk], language), np.float64)]
                    yield pa.array(rows, pa.list_(pa.float64()))

            return F.arrow_udf(kernel, "array<double>")(segment)

        return [vector(s, x) for s, x in zip(segments, self.languages, strict=True)]

    def score(self, segments: Sequence[Column]) -> Column:
        return F.array(*(cosine(a, b) for a, b in combinations(self.vectors(segments), 2)))

    def score_frame(self, corpus: Any) -> DataFrame:
        """idx and score by neighbours, for two segments."""
        if corpus.n != 2:
            raise ConfigurationError("neighbours are compared for two segments")
        spark, (a, b) = corpus.df.sparkSession, self.vectors(corpus.segments)
        stored = spark.read.parquet(self.nn_model)
        k = stored.select("k").first()[0]
        sides = [stored.where(F.col("lang") == x).select("id", "vector") for x in self.languages]
        pairs = written(corpus.df.select(F.col("idx").alias("id"), a.alias("v0"), b.alias("v1")), "pairs")
        return margins(pairs, sides, k).select(F.col("id").alias("idx"), F.array("score").alias("score"))

    def accept(self, score: Column) -> Column:
        return F.forall(score, lambda x: x >= F.lit(float(self.threshold)))


def train_nearest_neighbors(corpus: Any, languages: Sequence[str], path: str, embed: Callable[[list[str], str], np.ndarray], n_neighbors: int = 4) -> None:
    """Embeddings of every language's segments as a Parquet table: lang, id, vector, k."""
    own = SentenceEmbeddingFilter(languages, embed=embed)
    vectors = own.vectors(corpus.segments)
    fields = [F.struct(F.lit(x).alias("lang"), F.col("idx").alias("id"), v.alias("vector"), F.lit(n_neighbors).alias("k")) for x, v in zip(languages, vectors, strict=True)]
    corpus.df.select(F.explode(F.array(*fields)).alias("e")).select("e.*").write.mode("overwrite").parquet(path)


REGISTRY["SentenceEmbeddingFilter"] = SentenceEmbeddingFilter
