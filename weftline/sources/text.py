"""Line-aligned text files, JSON lines, values and labels: reading with line numbers, writing one file in order."""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import os
import shutil
import tempfile
import urllib.request
from collections.abc import Iterator, Sequence
from functools import reduce
from pathlib import Path
from typing import IO, Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.corpus import ParallelCorpus, numbered
from weftline.errors import CorpusError
from weftline.functions.text import rstrip

_OPENERS = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}


def open_text(path: str, mode: str = "r") -> IO[str]:
    """A text file, compressed by what its name ends with; folders are made for writing."""
    if "w" in mode and os.path.dirname(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return _OPENERS.get(Path(path).suffix, open)(path, mode if "t" in mode else mode + "t", encoding="utf-8")


def _xz_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of xz files, streamed from each file's bytes."""
    for batch in batches:
        for content in batch["content"]:
            lines: list[str] = []
            first = 0
            with lzma.open(pa.BufferReader(content.as_buffer()), "rt", encoding="utf-8") as file:
                for line in file:
                    lines.append(line.rstrip("\n"))
                    if len(lines) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines)], ["idx", "value"])
                        first, lines = first + len(lines), []
            yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["idx", "value"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """idx (line number from 0) and value of one file; plain, gz, bz2 or xz."""
    if path.endswith(".xz"):
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_xz_lines, "idx long, value string")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    return numbered(lines, ["__block", "__row"]).select("idx", "value")


def read_parallel(spark: SparkSession, *paths: str, strip: bool = True) -> ParallelCorpus:
    """Files side by side by line number, as far as the shortest; trailing white space goes unless ``strip`` is false."""
    value = rstrip(F.col("value")) if strip else F.col("value")
    parts = [read_lines(spark, p).select("idx", value.alias(f"s{i}")) for i, p in enumerate(paths)]
    return ParallelCorpus(reduce(lambda a, b: a.join(b, "idx"), parts), len(parts))


def write_lines(df: DataFrame, column: str, path: str, order: str = "idx") -> None:
    """One column in order as one text file, its last line ended too; streamed through the driver, a partition at a time."""
    rows = df.select(F.col(order).alias("__o"), F.col(column).cast("string").alias("__v")).orderBy("__o").select("__v")
    with open_text(path, "w") as file:
        for row in rows.toLocalIterator(prefetchPartitions=True):
            file.write((row[0] or "") + "\n")


def write_parts(df: DataFrame, column: str, path: str, order: str = "idx") -> None:
    """The same as a folder of part files whose names keep the order: the way for corpora of many gigabytes."""
    df.orderBy(order).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_parallel(corpus: ParallelCorpus, paths: Sequence[str]) -> None:
    if len(paths) != corpus.n:
        raise CorpusError(f"{len(paths)} outputs for {corpus.n} segments")
    for i, path in enumerate(paths):
        write_lines(corpus.df, f"s{i}", path)


_BARE = r'(?<=[:\[, ])"(-?Infinity|NaN)"(?=[,\]} ]|$)'


def to_json_lines(scores: DataFrame, column: str = "score") -> DataFrame:
    """idx and value: JSON objects, with infinities as bare words."""
    return scores.select("idx", F.regexp_replace(F.to_json(column), _BARE, "$1").alias("value"))


def write_json_lines(scores: DataFrame, path: str, column: str = "score") -> None:
    write_lines(to_json_lines(scores, column), "value", path)


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """idx and ``score`` parsed from JSON lines; the schema is inferred over the whole file where none is given."""
    lines = read_lines(spark, path)
    if schema is None:
        schema = spark.read.option("allowNonNumericNumbers", "true").json(lines.select("value").rdd.map(lambda r: r[0])).schema.simpleString()
    return lines.select("idx", F.from_json("value", schema, {"mode": "FAILFAST", "allowNonNumericNumbers": "true"}).alias("score"))


def read_values(spark: SparkSession, path: str, key: str | Sequence[str] | None = None, kind: str = "", combine: str | None = None) -> DataFrame:
    """idx and value of a file of values: a JSON value a line, else the line; see ``weftline.operators.steps.values``."""
    from weftline.operators.steps import values

    return values(read_lines(spark, path), key, kind, combine)


def count_lines(spark: SparkSession, path: str) -> int:
    return read_lines(spark, path).count() if path.endswith(".xz") else spark.read.text(path).count()


def write_literal(path: str, data: Any) -> None:
    """Data as a file: text as it is, else its string."""
    with open_text(path, "w") as file:
        file.write(data if isinstance(data, str) else str(data))


def download(url: str, path: str, block: int = 1 << 20) -> None:
    """A file from a URL, in blocks, moved into place when it is whole."""
    if os.path.dirname(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    with urllib.request.urlopen(url) as source, tempfile.NamedTemporaryFile(dir=os.path.dirname(path) or ".", delete=False) as target:
        shutil.copyfileobj(source, target, block)
    os.replace(target.name, path)


def write_json(path: str, value: Any) -> None:
    with open_text(path, "w") as file:
        json.dump(value, file, sort_keys=True)


def read_json(path: str) -> Any:
    with open_text(path) as file:
        return json.load(file)
