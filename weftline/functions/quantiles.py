"""Exact quantiles of columns by ranks, without all values in one place."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.store import written


def quantiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """For each column its values at the wanted shares, linear between neighbours; nulls don't count, None without values.

    Values are counted, range-partitioned with their column's number and written; ranks follow from the partitions' sums (one
    row for a column and a partition), and only the rows at the wanted ranks come to the driver.
    """
    names = list(wanted)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"`{n}`").cast("double").alias("v")) for i, n in enumerate(names))))
    counts = df.select(each.alias("e")).select("e.c", "e.v").where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    cut = counts.repartitionByRange("c", "v").sortWithinPartitions("c", "v").withColumn("at", F.monotonically_increasing_id())
    cut = written(cut.withColumn("part", F.shiftright("at", 33)), "values")
    sums: dict[int, list[tuple[int, int]]] = {}
    for r in cut.groupBy("c", "part").agg(F.sum("n").alias("n")).orderBy("c", "part").collect():
        sums.setdefault(r["c"], []).append((r["part"], r["n"]))
    ranks, starts = {}, {}
    for c, parts in sums.items():
        before = 0
        for part, n in parts:
            starts[c, part] = before
            before += n
        for q in wanted[names[c]]:
            place = q * (before - 1)
            ranks[c, q] = (math.floor(place), math.ceil(place), place - math.floor(place))
    if not ranks:
        return {n: [None] * len(wanted[n]) for n in names}
    spark = df.sparkSession
    first = spark.createDataFrame([(c, p, n) for (c, p), n in starts.items()], "c int, part long, first long")
    needed = spark.createDataFrame(sorted({(c, r) for (c, _), (a, b, _) in ranks.items() for r in (a, b)}), "c int, rank long")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.withColumn("inside", inside).join(F.broadcast(first), ["c", "part"]).withColumn("low", F.col("inside") + F.col("first"))
    hit = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("n"))
    found = {(r["c"], r["rank"]): r["v"] for r in ranked.join(F.broadcast(needed), "c").where(hit).select("c", "rank", "v").collect()}
    out: dict[str, list[float | None]] = {}
    for c, name in enumerate(names):
        out[name] = []
        for q in wanted[name]:
            a, b, part = ranks.get((c, q), (None, None, 0.0))
            low, high = found.get((c, a)), found.get((c, b))
            out[name].append(low if low is None or low == high else low + (high - low) * part)
    return out
