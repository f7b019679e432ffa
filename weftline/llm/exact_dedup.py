"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. One scan writes per row its fingerprint, SHA-256 and row number to a table in the shared folder (some 50 bytes a row).
2. Each block of at most ``BLOCK`` rows sends its sorted distinct fingerprints, Golomb-coded, to the owners of the hash
   ranges. A hot text counts once per block, so owners see no skew.
3. Owners answer with a bitmap per block: which fingerprints another block sent too. Together with repeats inside the
   block these are the suspects.
4. Only suspects' texts are read again and grouped byte by byte, with partial aggregation before the shuffle.
5. The groups' answers travel back by (block, text), at most one row per block and text, so hot groups stay split.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import golomb
from weftline.llm.common import SPACE, fresh, keep, text_of

#: Rows of a block, as a power of two, and the fingerprints that an owner holds on average.
BLOCK_BITS, OWNED = 17, 4_000_000
#: Suspects up to this many are broadcast (8 bytes each) to fetch their texts; beyond it, a shuffle join does.
BROADCAST_ROWS = 500_000

_MESSAGE = "owner int, block long, n int, width int, unary binary, rest binary"
_ANSWER = "block long, owner int, bits binary"


def normalised(column: str = "text") -> F.Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(text_of(column), SPACE, " ")


def _distinct(h: pa.ChunkedArray, bits: int) -> np.ndarray:
    return h.to_numpy().view(np.uint64) >> np.uint64(64 - bits)


def send(owners: int, bits: int):
    """Kernel: the coded messages of one block."""

    def kernel(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        values = np.unique(_distinct(table["h"], bits))
        first, rows = golomb.bounds(owners, bits), []
        for owner, a, b in golomb.split(values, owners, bits):
            rows.append((owner, block, b - a, *golomb.encode(values[a:b], int(first[owner]))))
        names = ["owner", "block", "n", "width", "unary", "rest"]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return kernel


def answer(owners: int, bits: int):
    """Kernel: one owner's bitmaps, set where more than one block sent the fingerprint."""

    def kernel(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        first = golomb.bounds(owners, bits)
        sets = [golomb.decode(r["n"], int(first[r["owner"]]), r["width"], r["unary"], r["rest"]) for r in rows]
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = (counts > 1)[inverse]
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        return pa.table(
            {
                "block": pa.array([r["block"] for r in rows], pa.int64()),
                "owner": pa.array([r["owner"] for r in rows], pa.int32()),
                "bits": pa.array([golomb.bitmap(x) for x in np.split(shared, cuts)], pa.binary()),
            }
        )

    return kernel


def suspects(owners: int, bits: int):
    """Kernel: the rows of one block with the flag whether their fingerprint occurs twice or more anywhere."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        values, inverse, counts = np.unique(_distinct(left["h"], bits), return_inverse=True, return_counts=True)
        flag = counts > 1
        bitmaps = dict(zip(right["owner"].to_pylist(), right["bits"].to_pylist(), strict=True))
        for owner, a, b in golomb.split(values, owners, bits):
            flag[a:b] |= golomb.flags(bitmaps[owner], b - a)
        return left.append_column("suspect", pa.array(flag[inverse]))

    return kernel


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are (``normalised``). The row with the smallest id stays; rows with a
    null id stay only in groups without any other, and of rows with equal id and text, or of null ids, one arbitrary
    row stays. Null texts count as empty and form one group with texts that are empty. Other columns are ignored; an
    empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = docs.count()
    owners = max(1, math.ceil(n / OWNED), docs.sparkSession.sparkContext.defaultParallelism)
    bits = min(63, max(40, n.bit_length() + 20))
    norm = docs.select("doc_id", normalised().alias("norm"))
    prints = keep(
        norm.select(
            "doc_id",
            F.xxhash64("norm").alias("h"),
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("block", F.shiftright("row", BLOCK_BITS)),
        "prints",
    )
    messages = prints.select("block", "h").groupBy("block").applyInArrow(send(owners, bits), _MESSAGE)
    answers = messages.groupBy("owner").applyInArrow(answer(owners, bits), _ANSWER)
    schema = "doc_id long, h long, sha binary, row long, block long, suspect boolean"
    flagged = keep(
        prints.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(suspects(owners, bits), schema),
        "flagged",
    )
    some = flagged.where("suspect").select("doc_id", "h", "sha", "row", "block")
    # Bytes decide: texts of suspects, grouped as they are. A collision of fingerprints separates here.
    wanted = some.select(F.col("doc_id").alias("wanted")).distinct()
    if some.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    texts = texts.select(normalised().alias("norm"))
    verified = texts.groupBy("norm").agg(F.count("*").alias("copies"))
    verified = verified.select(F.unhex(F.sha2("norm", 256)).alias("sha"))
    verified = verified.groupBy("sha").agg(F.count("*").alias("texts"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row"))
    partly = some.groupBy("sha", "block").agg(first.alias("first"), F.count("*").alias("size"))
    groups = partly.groupBy("sha").agg(F.min("first").alias("first"), F.sum("size").alias("size"))
    groups = groups.join(verified, "sha").select(
        "sha",
        # two texts of one SHA-256 would need another class number; that has never been seen, so it stops the job
        F.when(F.col("texts") == 1, F.col("first")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).alias("first"),
        "size",
    )
    by_block = partly.select("sha", "block").join(groups, "sha")
    done = some.join(by_block, ["sha", "block"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("first.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    alone = flagged.where("not suspect").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return alone.unionByName(done)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, as ``exact_groups`` decides.

    Of rows that repeat both id and text, one stays.
    """
    groups = keep(exact_groups(docs), "groups")
    lost = groups.where("not kept").select("doc_id", "keep_id", "text_sha256")
    again = not lost.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty()
    gone = lost if not again else lost.where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    sha, who, what = fresh(docs, "__sha"), fresh(docs, "__id"), fresh(docs, "__gone")
    gone = gone.select(F.col("doc_id").alias(who), F.col("text_sha256").alias(what)).distinct()
    if gone.count() <= BROADCAST_ROWS // 4:
        gone = F.broadcast(gone)
    rows = docs.withColumn(sha, F.sha2(normalised(), 256))
    rows = rows.join(gone, (F.col(sha) == F.col(what)) & F.col("doc_id").eqNullSafe(F.col(who)), "left_anti")
    if again:
        rows = rows.dropDuplicates(["doc_id", sha])
    return rows.drop(sha)
