"""URL filters: host and path rules, and where no rule fits a character language-model ratio.

URLs that a rule allows or blocks train two variable-order Markov models, one a class. A character's probability backs off
through its contexts, longest first: ``P_k = (n(context, c) + MU * P_(k-1)) / (n(context) + MU)``. The length-normalised
difference of the two log-likelihoods, calibrated on labelled URLs that the models haven't seen, decides.

Counts cover every labelled URL and are summed by Spark, a row for each distinct gram in a table that grows with the data. A
gram's key holds its symbols themselves, 21 bits each, so no two grams share counts. URLs are scored in blocks: each block's
distinct grams are joined with the table, and the answers meet the block's rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import keep

ORDER, MU, BINS, HELD, BLOCK_BITS = 5, 2.0, 2000, 5, 13
START, END = 0x110000, 0x110001
#: A gram's key: six symbols of 21 bits, each more by one, so that shorter grams differ from longer ones; -1 for the totals.
KEY, WIDTH = pa.decimal128(38, 0), np.uint64(21)

#: (verdict, host and path)
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty for null and where there is none."""
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"\A[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, start = rule.partition("/")[0], rule[rule.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER start marks and before an end mark; and each text's first place."""
    n = np.array([len(t) for t in texts], np.int64) + ORDER + 1
    first = np.cumsum(n) - n
    out = np.full(int(n.sum()), START, np.uint64)
    real = np.ones(len(out), bool)
    for k in range(ORDER):
        real[first + k] = False
    real[first + n - 1] = False
    out[first + n - 1] = END
    out[real] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out, first


def _grams(symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length 1..ORDER + 1 which gram ends at each place (junk where it would start before 0), and the grams' keys.

    Keys are rows of a low and a high half of 64 bits, distinct within a length; a place's gram is a row number.
    """
    codes, sign = np.unique(symbols + np.uint64(1), return_inverse=True)
    low, high = codes[sign], np.zeros(len(symbols), np.uint64)
    which, out = sign, [(sign, np.stack([codes, np.zeros(len(codes), np.uint64)], axis=1))]
    for _ in range(ORDER):
        before = np.append(np.int64(0), which[:-1])
        high = (np.append(np.uint64(0), high[:-1]) << WIDTH) | (np.append(np.uint64(0), low[:-1]) >> np.uint64(64) - WIDTH)
        low = (np.append(np.uint64(0), low[:-1]) << WIDTH) | codes[sign]
        _, first, which = np.unique(before * len(codes) + sign, return_index=True, return_inverse=True)
        out.append((which, np.stack([low[first], high[first]], axis=1)))
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of keys, and each row's number among them."""
    order = np.lexsort((keys[:, 0], keys[:, 1]))
    new = np.append(True, (keys[order][1:] != keys[order][:-1]).any(axis=1))[: len(keys)]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return keys[order][new], number


def _to_arrow(keys: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(KEY, len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())])


def _from_arrow(keys: pa.Array) -> np.ndarray:
    return np.frombuffer(keys.buffers()[1], np.uint64, 2 * len(keys), 16 * keys.offset).reshape(-1, 2)


def _places(first: np.ndarray, n: int) -> np.ndarray:
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: a batch's counts as (slot, accepted, rejected); slot is a gram's key, and -1 holds the number of symbols."""
    for batch in batches:
        texts, blocked = batch["rest"].to_pylist(), np.array(batch["blocked"].to_pylist(), bool)
        keys, counts = [np.full((1, 2), 2**64 - 1, np.uint64)], [np.zeros((2, 1), np.int64)]
        for c in (0, 1):
            own = [t for t, b in zip(texts, blocked, strict=True) if b == c]
            if not own:
                continue
            symbols, first = _symbols(own)
            place = _places(first, len(symbols))
            counts[0][c] = len(symbols)
            for m, (which, grams) in enumerate(_grams(symbols)):
                n = np.zeros((2, len(grams)), np.int64)
                n[c] = np.bincount(which[place >= m], minlength=len(grams))
                keys.append(grams[n[c] > 0])
                counts.append(n[:, n[c] > 0])
        found, number = _distinct(np.concatenate(keys))
        both = np.zeros((len(found), 2), np.int64)
        np.add.at(both, number, np.concatenate(counts, axis=1).T)
        yield pa.RecordBatch.from_arrays([_to_arrow(found), pa.array(both[:, 0]), pa.array(both[:, 1])], ["slot", "accepted", "rejected"])


def ask_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: (block, slot) of the grams that a batch's rows need, each once."""
    for batch in batches:
        blocks, texts = batch["block"].to_numpy(), batch["rest"].to_pylist()
        for block in np.unique(blocks).tolist():
            symbols, first = _symbols([texts[i] for i in np.flatnonzero(blocks == block)])
            place = _places(first, len(symbols))
            keys = np.concatenate([grams[np.unique(which[place >= m])] for m, (which, grams) in enumerate(_grams(symbols))])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block, np.int64)), _to_arrow(keys)], ["block", "slot"])


def difference(texts: list[str], keys: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log-likelihood under accepted minus under rejected, per symbol. ``counts`` has a column for each of ``keys``."""
    if not texts:
        return np.zeros(0)
    symbols, first = _symbols(texts)
    grams, logs = _grams(symbols), []
    cuts = np.cumsum([len(keys), *(len(g) for _, g in grams)])
    found, number = _distinct(np.concatenate([keys, *(g for _, g in grams)]))
    table = np.zeros((2, len(found)))
    table[:, number[: len(keys)]] = counts
    at = [number[a + which] for a, (which, _) in zip(cuts[:-1], grams, strict=True)]
    for c in (0, 1):
        p = (table[c][at[0]] + MU / 1000) / (totals[c] + MU)
        for m in range(1, ORDER + 1):
            context = np.append(0.0, table[c][at[m - 1]][:-1])
            p = np.minimum(1.0, (table[c][at[m]] + MU * p) / (context + MU))
        logs.append(np.log(p))
    gain = logs[0] - logs[1]
    gain[_places(first, len(symbols)) < ORDER] = 0.0  # start marks
    return np.add.reduceat(gain, first) / (np.diff(np.append(first, len(symbols))) - ORDER)


def _score(totals: np.ndarray):
    """Kernel: a block's rows with ``d``, from its rows and the counts of its grams (repeated where two batches asked)."""

    def kernel(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros((0, 2), np.uint64), *(_from_arrow(c) for c in answers["slot"].chunks)])
        counts = np.stack([answers[c].to_numpy() for c in ("accepted", "rejected")])
        d = difference(rows["rest"].to_pylist(), keys, counts, totals)
        return rows.drop_columns(["block", "rest"]).append_column("d", pa.array(d, pa.float64()))

    return kernel


def fit_line(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through binned counts, both classes weighing the same."""
    if not good.sum() or not bad.sum():
        return 1.0, 0.0
    w = np.array([1.0, 0.0])
    weights = np.concatenate([good / good.sum(), bad / bad.sum()])
    features = np.stack([np.concatenate([x, x]), np.ones(2 * len(x))], axis=1)
    y = np.concatenate([np.ones(len(x)), np.zeros(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = features.T @ (weights * (p - y)) + 1e-4 * w
        hess = (features * (weights * p * (1 - p))[:, None]).T @ features + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score (calibrated probability of acceptance).

    A null url and one without ``://`` have empty host and path and are scored as an empty text. Without labelled URLs of
    both classes every score is 0.5 and what no rule decides is allowed. Repeated rows get equal answers; other columns
    are ignored; an empty table gives an empty result.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(rest_of(url), F.lit("")).alias("rest"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("held", F.crc32("rest") % HELD == 0)
    rows = keep(rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "urls")
    blocked = (verdict_of(F.col("rule"), rules) == "block").alias("blocked")
    counts = rows.where("rule is not null and not held").select("rest", blocked).mapInArrow(count_grams, "slot decimal(38,0), accepted long, rejected long")
    counts = keep(counts.groupBy("slot").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "grams")
    symbols = counts.where("slot = -1").first()
    totals = np.array([symbols["accepted"], symbols["rejected"]] if symbols else [0, 0])
    known = bool((totals > 0).all())
    slope, intercept = 1.0, 0.0
    scored = rows.drop("block", "rest").withColumn("d", F.lit(0.0))
    if known:
        asked = rows.select("block", "rest").mapInArrow(ask_grams, "block long, slot decimal(38,0)")
        answers = asked.join(counts, "slot").select("block", "slot", "accepted", "rejected")
        scored = keep(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(totals), scored.schema), "scored")
        at = F.floor(F.greatest(F.lit(-2.0), F.least(F.lit(1.999), F.col("d"))) * (BINS / 4)).cast("int")
        binned = scored.where("rule is not null and held").select(blocked, at.alias("bin")).groupBy("blocked", "bin").count().collect()
        hist = np.zeros((2, BINS))
        for r in binned:
            hist[int(r["blocked"]), r["bin"] + BINS // 2] += r["count"]
        slope, intercept = fit_line((np.arange(BINS) - BINS // 2 + 0.5) / (BINS / 4), hist[0], hist[1])
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("d") + F.lit(intercept))))
    return scored.withColumn("score", F.round(score, 9)).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"),
        "score",
    )
