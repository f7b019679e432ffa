"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators understand it.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none, and runs in one process, a temporary folder is used and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = chosen.get() if chosen.isDefined() else None
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def keep(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weftline/{uuid.uuid4().hex}/{name}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and nothing reads any more."""
    for table in tables:
        jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
        place = jvm.org.apache.hadoop.fs.Path(table.kept_at)
        place.getFileSystem(session.sessionState().newHadoopConf()).delete(place.getParent(), True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of narrow tables that may be broadcast, after they have been counted.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> bool:
    """Whether a written table has few enough rows to be broadcast."""
    return df.count() <= BROADCAST_ROWS


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release() -> None:
    """Give memory that a kernel no longer needs back to the machine: workers are used again, for other kernels too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def text_of(column: str = "text") -> F.Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def block_of(n: int, *columns: str) -> F.Column:
    """A block number below ``n`` that depends on the row's content alone, so a recomputed task agrees with the lost one."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def spread(spark: SparkSession, df: DataFrame, rows: int = 1000) -> DataFrame:
    """Repartition a table of few partitions, so that all cores share the work on it."""
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(texts: pa.Array, size: int = 8 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, whole texts) of runs of rows with about ``size`` bytes together."""
    part: list[bytes] = []
    first = total = 0
    for i, text in enumerate(texts.cast(pa.large_binary())):
        part.append(text.as_py())
        total += len(part[-1])
        if total >= size:
            yield first, part
            part, total, first = [], 0, i + 1
    if part:
        yield first, part


def sample_ids(ids: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most about ``most`` rows, by a hash of the id: all of them where there are fewer."""
    n = ids.count()
    if n <= most:
        return ids
    bound = int(most / n * 2**32)
    return ids.where(F.crc32(F.concat(F.lit("s"), F.col(id_col).cast("string"))) < bound)


def is_key(docs: DataFrame, id_col: str) -> bool:
    """Whether each row has an id of its own."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    seen = ids.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.max(F.col("doc_id").isNull().cast("int")).alias("absent")).first()
    return (seen["most"] or 0) <= 1 and not seen["absent"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, text. The id is the key where it is one; else rows get numbers in a written copy of the table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    if is_key(docs, id_col):
        return rows.withColumn("key", F.col("doc_id"))
    return keep(rows.withColumn("key", F.monotonically_increasing_id()), "rows")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that is reachable.

    Alternates large-star and small-star contraction (each a pair of aggregations and joins) until no edge changes; the
    edges are written in each round. A node's many neighbours are aggregated to a minimum before they are joined back.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        before = now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = keep(large, "star")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        new = keep(small.where("a <> b").select("a", "b").distinct(), "star")
        changed = not new.join(now, ["a", "b"], "left_anti").isEmpty() or not now.join(new, ["a", "b"], "left_anti").isEmpty()
        now = new
        discard(before, large)
        if not changed:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
