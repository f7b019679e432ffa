"""Line-aligned corpora as DataFrames: ``idx`` and one string column per language, s0, s1, ..."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.errors import CorpusError
from weftline.store import written


@dataclass(frozen=True)
class ParallelCorpus:
    """``df`` has idx (long, rising in line order) and s0 to s{n-1} without nulls."""

    df: DataFrame
    n: int

    @staticmethod
    def of(df: DataFrame, columns: Sequence[str], order: str | Column = "idx") -> ParallelCorpus:
        """A corpus from any table; null segments become empty lines."""
        key = F.col(order) if isinstance(order, str) else order
        segments = [F.coalesce(F.col(c), F.lit("")).alias(f"s{i}") for i, c in enumerate(columns)]
        return ParallelCorpus(df.select(key.cast("long").alias("idx"), *segments), len(columns))

    @staticmethod
    def from_lines(spark: SparkSession, *files: Sequence[str]) -> ParallelCorpus:
        """A corpus from lists of lines; it ends with the shortest."""
        rows = [(i, *line) for i, line in enumerate(zip(*files, strict=False))]
        schema = ", ".join(["idx long", *(f"s{i} string" for i in range(len(files)))])
        return ParallelCorpus(spark.createDataFrame(rows, schema), len(files))

    @property
    def names(self) -> list[str]:
        return [f"s{i}" for i in range(self.n)]

    @property
    def segments(self) -> list[Column]:
        return [F.col(c) for c in self.names]

    def where(self, condition: Column) -> ParallelCorpus:
        return ParallelCorpus(self.df.where(condition), self.n)

    def map(self, function: Callable[[Column, int], Column]) -> ParallelCorpus:
        """Each segment replaced by a function of itself and its number."""
        return ParallelCorpus(self.df.select("idx", *(function(F.col(c), i).alias(c) for i, c in enumerate(self.names))), self.n)

    def select(self, *numbers: int) -> ParallelCorpus:
        """The chosen languages."""
        if any(not 0 <= i < self.n for i in numbers):
            raise CorpusError(f"no such segment: {numbers}")
        return ParallelCorpus(self.df.select("idx", *(F.col(f"s{i}").alias(f"s{k}") for k, i in enumerate(numbers))), len(numbers))

    def lines(self) -> list[list[str]]:
        """Every language's lines in order; for small corpora."""
        rows = self.df.orderBy("idx").collect()
        return [[r[c] for r in rows] for c in self.names]


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "idx", falling: bool = False) -> DataFrame:
    """``df`` with dense numbers from 0 in the given order (rising, or all keys falling), without a window over all rows.

    Rows are range-partitioned, sorted and written to the shared folder, so that both readers see the same partitions; each
    is counted, and the counts' running sums (one row a partition) are joined back. Equal keys keep no particular order.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    part, at, first = "__part", "__at", "__first"
    held = df.withColumns({f"__k{i}": k for i, k in enumerate(keys)})
    names = [f"__k{i}" for i in range(len(keys))]
    by = [F.desc(n) if falling else F.asc(n) for n in names]
    cut = held.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    cut = written(cut.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(*names), "numbered")
    counts = cut.groupBy(part).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(part), before.alias(first))  # one row for each partition
    return cut.join(F.broadcast(starts), part).withColumn(name, F.col(at) + F.col(first)).drop(part, at, first)


def lines_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """idx and s0: the lines of all texts, numbered densely by ``key`` and place; null texts are one empty line.

    Only keys and numbers of lines are sorted and written; their running sums join the texts again, which travel once at most.
    Where keys repeat, the lines themselves are sorted instead.
    """
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    by, n, at, part, first = F.col("__key"), "__n", "__at", "__part", "__first"
    counts = df.select(F.col(key).alias("__key"), F.size(parts).alias(n)).repartitionByRange(by).sortWithinPartitions(by).withColumn(at, F.monotonically_increasing_id())
    counts = written(counts.withColumn(part, F.shiftright(at, 33)), "counts")
    sums = counts.groupBy(part).agg(F.sum(n).alias("__sum"), F.count("*").alias("__rows"), F.count_distinct(F.struct("__key")).alias("__keys"))
    if not sums.where("__rows <> __keys").isEmpty():
        split = df.select(F.col(key).alias("__d"), F.posexplode(parts).alias("__p", "s0"))
        return numbered(split, ["__d", "__p"]).select("idx", "s0")
    before = lambda column, window: F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(part, before("__sum", Window.orderBy(part)).alias("__start"))  # one row for each partition
    inside = counts.withColumn(first, before(n, Window.partitionBy(part).orderBy(at)))
    offsets = inside.join(F.broadcast(starts), part).select("__key", (F.col(first) + F.col("__start")).alias(first))
    joined = df.join(offsets, F.col(key).eqNullSafe(by))
    return joined.select(first, F.posexplode(parts).alias("__p", "s0")).select((F.col(first) + F.col("__p")).alias("idx"), "s0")
