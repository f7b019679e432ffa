"""Repeated passages by a compacted de Bruijn graph of token k-mers.

A window of ``WINDOW`` words is repeated if its words also start anywhere else. Any window's least k-mer (by hash) is the same
wherever the window occurs, so those least k-mers, about a tenth of all places, stand for the text:

1. They are the graph's edges, in document order. Edges that occur once can't lie in a repeated window and go.
2. Spark aggregates what follows and precedes each remaining edge; a step from which every occurrence goes on, and into
   which every occurrence comes, doesn't branch. Joining that back, each document's run of such steps is one compacted
   path, named by its first edge. All occurrences of a path hold the same words, as consecutive edges overlap or touch.
3. Source coordinates verify: the words of each path's occurrences are hashed again (128 bits) and compared. Windows that
   lie in no single path but have a repeated edge are compared as windows (128 bits). Nothing is sampled or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, keep, keyed, release, slices, small

WINDOW, K = 35, 18
KEPT = 1 << 18
_B1, _B2, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Word -> 64-bit hash; bounded by ``hashes``."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


@lru_cache(maxsize=1)
def _known() -> _Words:
    return _Words()


def hashes(words: list[bytes]) -> np.ndarray:
    known = _known()
    if len(known) > KEPT:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def forget() -> None:
    """Free what ``hashes`` keeps."""
    _known().clear()
    release()


def rolled(values: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Mixed hash of the ``n`` values from each place on; places too near the end are left out."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, size, power, power_size = None, 0, base, 1
        block = values  # hash of ``power_size`` values from each place on
        rest = n
        while rest:
            if rest & 1:
                if out is None:
                    out, size = block, power_size
                else:  # the blocks taken so far, then this one
                    m = len(values) - size - power_size + 1
                    out, size = out[:m] * power + block[size : size + m], size + power_size
            rest >>= 1
            if rest:
                m = len(block) - power_size
                block = block[:m] * power + block[power_size : power_size + m]
                power, power_size = power * power, 2 * power_size
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return out ^ (out >> np.uint64(29))


def _extreme(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest of ``n`` values from each place on."""
    out, size = values, 1
    while size < n:
        step = min(size, n - size)
        out = pick(out[: len(out) - step], out[step:])
        size += step
    return out


def edges(values: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(least k-mer of each window, which is 0 where a window would cross a document's end; k-mers chosen by any window).

    ``values`` holds the documents' word hashes one after another and ``ends`` for each word its document's end.
    """
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kmers = np.maximum(rolled(values, k, _B1), np.uint64(1))
    least = _extreme(kmers, window - k + 1, np.minimum)
    least[np.arange(n) + window > ends[:n]] = 0
    w = window - k
    padded = np.concatenate([np.zeros(w, np.uint64), least, np.zeros(w, np.uint64)])
    chosen = np.flatnonzero(kmers == _extreme(padded, w + 1, np.maximum))
    return least, chosen


def _split(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, their hashes in one array, each text's first place, and each word's document end."""
    words = [t.split() for t in texts]  # bytes split at ASCII white space alone
    n = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(n) - n
    return words, hashes([w for ws in words for w in ws]), first, np.repeat(first + n, n)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def _mixed(h: np.ndarray, gap: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h ^ (gap.astype(np.uint64) * _B2)) * _MIX


def find_edges(window: int, k: int):
    """Kernel: per document with an edge, its edges: hash, place, and marks of the next and previous edge with their gaps."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch["text"]):
                _, values, first, ends = _split(texts)
                with np.errstate(over="ignore"):
                    kmers = np.maximum(rolled(values, k, _B1), np.uint64(1)) if len(values) >= k else np.zeros(0, np.uint64)
                _, chosen = edges(values, ends, window, k)
                doc = np.searchsorted(first, chosen, side="right") - 1
                h = kmers[chosen]
                gap = np.diff(chosen)
                same = doc[1:] == doc[:-1]
                after, before = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
                after[:-1] = np.where(same, _mixed(h[1:], gap), 0)
                before[1:] = np.where(same, _mixed(h[:-1], gap), 0)
                counts = np.bincount(doc, minlength=len(texts))
                has = np.flatnonzero(counts)
                counts = counts[has]
                columns = [batch["key"].slice(at, len(texts)).take(pa.array(has))]
                columns += [_lists(x.view(np.int64), counts, pa.int64()) for x in (h, after, before)]
                columns.append(_lists(chosen - first[doc], counts, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, ["key", "h", "after", "before", "place"])
        forget()

    return kernel


def compact(k: int):
    """Kernel: per document the compacted paths (head, start, end in words) from its repeated edges."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["edges"]
            counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            doc = np.repeat(np.arange(len(counts)), counts)
            number, h, place = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("number", "h", "place"))
            onward, inward = (flat.field(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("onward", "inward"))
            order = np.lexsort((number, doc))
            doc, number, h, place, onward, inward = (x[order] for x in (doc, number, h, place, onward, inward))
            linked = np.zeros(len(h), bool)
            linked[1:] = (doc[1:] == doc[:-1]) & (number[1:] == number[:-1] + 1) & onward[:-1] & inward[1:]
            heads = np.flatnonzero(~linked)
            tails = np.append(heads[1:], len(h))[: len(heads)] - 1
            per = np.bincount(doc[heads], minlength=len(counts))
            rows = pa.StructArray.from_arrays(
                [pa.array(h[heads]), pa.array(place[heads].astype(np.int32)), pa.array((place[tails] + k).astype(np.int32))], ["head", "start", "end"]
            )
            paths = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([batch["key"], paths], ["key", "paths"])

    return kernel


def _digest(data: bytes) -> tuple[int, int]:
    found = xxhash.xxh3_128_intdigest(data)
    return (found >> 64) - (1 << 63), (found & ((1 << 64) - 1)) - (1 << 63)


def look_up(window: int, k: int):
    """Kernel: checks of paths (head, hashes of an occurrence's words) and windows that no single path holds."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch["text"]):
                words, values, first, ends = _split(texts)
                least, _ = edges(values, ends, window, k)
                repeated = np.zeros(len(values) + 1, bool)  # k-mers of repeated edges, then places of windows
                inside = np.zeros(len(values) + 1, bool)
                heads, checks = [], []
                kmers = rolled(values, k, _B1) if len(values) >= k else np.zeros(0, np.uint64)
                kmers = np.maximum(kmers, np.uint64(1))
                for i in range(len(texts)):
                    base = int(first[i])
                    for path in batch["paths"][at + i].as_py():
                        a, b = base + path["start"], base + path["end"]
                        repeated[a : b - k + 1] = True
                        if path["sound"]:
                            heads.append(path["head"])
                            checks.append(_digest(b" ".join(words[i][path["start"] : path["end"]])))
                            inside[a : max(a, b - window + 1)] = True
                # a window counts where its least k-mer is that of a repeated edge
                n = len(least)
                some = np.zeros(n, bool)
                for j in range(window - k + 1):
                    some |= (kmers[j : j + n] == least) & repeated[j : j + n]
                some &= (least != 0) & ~inside[:n]
                places = np.flatnonzero(some)
                one, two = rolled(values, window, _B1), rolled(values, window, _B2)
                doc = np.searchsorted(first, places, side="right") - 1
                keys = batch["key"].slice(at, len(texts)).take(pa.array(doc))
                m = len(heads)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.nulls(m, keys.type), keys]),
                        pa.concat_arrays([pa.array(heads, pa.int64()), pa.nulls(len(places), pa.int64())]),
                        pa.concat_arrays([pa.array([c[0] for c in checks], pa.int64()), pa.array(one[places].view(np.int64))]),
                        pa.concat_arrays([pa.array([c[1] for c in checks], pa.int64()), pa.array(two[places].view(np.int64))]),
                        pa.concat_arrays([pa.nulls(m, pa.int32()), pa.array((places - first[doc]).astype(np.int32))]),
                    ],
                    ["key", "head", "one", "two", "place"],
                )
        forget()

    return kernel


def covered(n: int, paths: list | None, places: list | None, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a repeated window."""
    marks = np.zeros(n + 1, np.int64)
    for path in paths or ():
        if path["sound"] and path["end"] - path["start"] >= window:
            marks[path["start"]] += 1
            marks[path["end"]] -= 1
    if places:
        p = np.array(places)
        np.add.at(marks, p, 1)
        np.add.at(marks, p + window, -1)
    return np.cumsum(marks[:n]) > 0


def repeats(docs: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with their key, per key the ``paths`` and ``places`` whose windows are repeated)."""
    if not window // 2 < k <= window - 1 + (window == 1):
        raise ValueError("k must be over half the window and below it")
    rows = keyed(docs, id_col, text_col)
    found = rows.select("key", "text").mapInArrow(find_edges(window, k), "key long, h array<long>, after array<long>, before array<long>, place array<int>")
    found = keep(found, "edges")
    again = found.select(F.explode("h").alias("h")).groupBy("h").count().where("count > 1").select("h")
    each = found.select("key", F.posexplode(F.arrays_zip("h", "after", "before", "place")).alias("number", "e"))
    each = each.select("key", "number", "e.h", "e.after", "e.before", "e.place")
    each = keep(each.join(again, "h", "left_semi"), "repeated")
    steps = each.groupBy("h").agg(*(f(c).alias(f"{n}_{c}") for c in ("after", "before") for n, f in (("least", F.min), ("most", F.max))))
    steps = steps.select(
        "h",
        ((F.col("least_after") == F.col("most_after")) & (F.col("least_after") != 0)).alias("onward"),
        ((F.col("least_before") == F.col("most_before")) & (F.col("least_before") != 0)).alias("inward"),
    )
    edge = F.struct("number", "h", "place", "onward", "inward")
    whole = each.join(steps, "h").groupBy("key").agg(F.collect_list(edge).alias("edges"))
    paths = keep(whole.mapInArrow(compact(k), "key long, paths array<struct<head:long,start:int,end:int>>"), "paths")
    discard(found, each)
    sound = F.transform("paths", lambda p: F.struct(p["head"].alias("head"), p["start"].alias("start"), p["end"].alias("end"), F.lit(True).alias("sound")))
    paths = paths.select("key", sound.alias("paths"))
    schema = "key long, head long, one long, two long, place int"
    looked = keep(_texts(rows, paths).mapInArrow(look_up(window, k), schema), "looked")
    bad = looked.where("head is not null").groupBy("head").agg(F.min("one").alias("a"), F.max("one").alias("b"), F.min("two").alias("c"), F.max("two").alias("d"))
    bad = keep(bad.where("a <> b or c <> d").select("head"), "unsound")
    if not bad.isEmpty():  # k-mers of one hash and different words: those paths' windows are compared one by one
        flat = paths.select("key", F.explode("paths").alias("p")).select("key", "p.*").join(bad.withColumn("wrong", F.lit(True)), "head", "left")
        p = F.struct("head", "start", "end", F.col("wrong").isNull().alias("sound"))
        paths = keep(flat.groupBy("key").agg(F.collect_list(p).alias("paths")), "paths")
        looked = keep(_texts(rows, paths).mapInArrow(look_up(window, k), schema), "looked")
    windows = looked.where("head is null").select("key", "one", "two", "place")
    twice = windows.groupBy("one", "two").count().where("count > 1").select("one", "two")
    places = windows.join(twice, ["one", "two"], "left_semi").groupBy("key").agg(F.collect_list("place").alias("places"))
    long = F.filter("paths", lambda p: p["sound"] & (p["end"] - p["start"] >= window))
    return rows, paths.select("key", long.alias("paths")).where(F.size("paths") > 0).join(places, "key", "full")


def _some(rows: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows that may have a list, rows that have none or None if that isn't known), so that only texts with lists travel."""
    if not small(lists):
        return rows, None
    keys = F.broadcast(lists.select("key"))
    return rows.join(keys, "key", "left_semi"), rows.join(keys, "key", "left_anti")


def _texts(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return _some(rows.select("key", "text"), paths)[0].join(paths, "key").select("key", "text", "paths")


def without_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_words, n_removed and ``kept``, the words that stay joined by one space.

    Words lie between ASCII white space. Null and empty texts have no words, and texts below ``window`` words keep all.
    Each row is a document of its own, so repeated rows repeat each other's windows, and ids may be null; other columns are
    ignored; an empty table gives an empty result.
    """
    return _final(docs, window, k, id_col, text_col, False)


def digest(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """As ``without_repeats``, with a hash in place of the words."""
    return _final(docs, window, k, "doc_id", "text", True)


def _final(docs: DataFrame, window: int, k: int, id_col: str, text_col: str, hashed: bool) -> DataFrame:
    rows, found = repeats(docs, window, k, id_col, text_col)
    name = "kept_sha256" if hashed else "kept"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths, places = batch["doc_id"], batch["paths"], batch["places"]
            n_words, removed, kept = [], [], []
            for i, text in enumerate(batch["text"].cast(pa.large_binary())):
                words = text.as_py().split()
                n_words.append(len(words))
                removed.append(0)
                if paths[i].is_valid or places[i].is_valid:
                    gone = covered(len(words), paths[i].as_py(), places[i].as_py(), window)
                    removed[-1] = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(words)
                kept.append(hashlib.sha256(joined).hexdigest() if hashed else joined.decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", name])

    found = keep(found, "found")
    some, others = _some(rows, found)
    joined = some.join(found, "key", "left").select("doc_id", "text", "paths", "places")
    if others is not None:
        joined = joined.unionByName(others.select("doc_id", "text", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("paths", "places"))))
    return joined.mapInArrow(kernel, f"doc_id long, n_words long, n_removed long, {name} string")
