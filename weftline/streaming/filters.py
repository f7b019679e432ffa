"""Row-local operators on streams: filters and preprocessors are column functions, so a stream takes them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.corpus import ParallelCorpus
from weftline.errors import ConfigurationError
from weftline.functions.hashing import SegmentHasher
from weftline.plans.pipeline import FilterPipeline


def filtered(stream: DataFrame, n: int, pipeline: FilterPipeline, rejected: bool = False) -> DataFrame:
    """Accepted (or rejected) rows of a stream with s0, s1, ...; filters that depend on all rows are refused."""
    if any(getattr(f, "set_based", False) for f in pipeline.filters):
        raise ConfigurationError("a filter that depends on all rows can't work on a stream")
    segments = [F.coalesce(F.col(f"s{i}"), F.lit("")) for i in range(n)]
    good = pipeline.accepts(segments)
    return stream.where(~good if rejected else good)


def first_seen(stream: DataFrame, n: int, time: str, delay: str, hasher: SegmentHasher | None = None) -> DataFrame:
    """Rows whose key hasn't been seen within the watermark's delay; state is dropped as the watermark passes."""
    hasher = hasher or SegmentHasher()
    key = F.sha2(hasher.line_key([F.coalesce(F.col(f"s{i}"), F.lit("")) for i in range(n)]), 256)
    marked = stream.withColumn("__key", key).withWatermark(time, delay)
    return marked.dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def corpus_of(batch: DataFrame, n: int) -> ParallelCorpus:
    """A micro-batch as a corpus, for ``foreachBatch``."""
    return ParallelCorpus.of(batch, [f"s{i}" for i in range(n)], F.monotonically_increasing_id())
