"""Quality scores by co-training a text-content view and a page-metadata view.

Each view has its own boosted trees. In each round a view labels the unlabelled rows it is surest about, and the other view
learns them as if they were labelled. At the end each view is calibrated on labelled rows that neither learned, and a logistic
combination of the two calibrated views, fitted on the same rows, scores every document.

Of labelled rows the fit takes at most ``SAMPLE``, by a hash of their id. Every unlabelled row takes part in each round: its
features lie binned in the executors, cut-offs of sureness come from a histogram of all margins, and all rows beyond them are
learned, through histograms of gradients that Spark sums. Every row is scored on its whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.boost import BINS, Isotonic, WideTrees
from weftline.llm.common import keep, release, sample_ids, text_of
from weftline.llm.features import CHAR_NAMES, char_features

SAMPLE, ROUNDS, SHARE, CALIBRATE, KEEP_AT = 30_000, 4, 0.1, 4, 0.5
#: Weight of a pseudo-label; values of the number that breaks ties; unlabelled rows of a partition.
PSEUDO, TIES, PART = 0.3, 1 << 20, 500_000
#: Up to so many pseudo-labels are summed in the driver, which spares Spark's passes; the sums are the same.
NEAR = 60_000
WORD_NAMES = ("words", "word_length", "distinct", "commonest", "stutter", "marked", "bars", "short", "shouted", "line_length", "lines_again")


def text_features(data: bytes) -> list[float]:
    """Content view: kinds of characters, and how words and lines repeat."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * (len(WORD_NAMES) + len(CHAR_NAMES))
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:" for w in counts)
    lines = data.split(b"\n")
    return [
        float(np.log1p(n)),
        float(sizes.mean()),
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        stutter / n,
        marked / len(counts),
        counts.get(b"|", 0) / n,
        float(np.count_nonzero(sizes <= 3) / n),
        sum(w.isupper() and len(w) > 3 for w in counts) / len(counts),
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        *char_features(data),
    ]


class Metadata:
    """Metadata view: how good a source and a language have been, and what is missing, and the stated length."""

    def __init__(self, source: list, lang: list, y: np.ndarray) -> None:
        self.mean = float((y.sum() + 1) / (len(y) + 2))
        self.tables = [self._table(source, y), self._table(lang, y)]

    def _table(self, values: list, y: np.ndarray) -> dict:
        n, s = Counter(values), Counter()
        for v, good in zip(values, y.tolist(), strict=True):
            s[v] += good
        return {v: ((s[v] + 10 * self.mean) / (n[v] + 10), float(np.log1p(n[v]))) for v in n}

    def __call__(self, source: list, lang: list, n_chars: list) -> np.ndarray:
        new = (self.mean, 0.0)
        rows = [
            (*self.tables[0].get(s, new), *self.tables[1].get(v, new), -1.0 if c is None else float(np.log1p(max(0, c))), float(s is None), float(v is None))
            for s, v, c in zip(source, lang, n_chars, strict=True)
        ]
        return np.array(rows, np.float64).reshape(len(rows), 7)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.array([1.0, 0.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (p - y) + 1e-2 * (w - [1.0, 0.0, 0.0]))
    return w


def _code(values: np.ndarray) -> np.ndarray:
    """Integers in the values' order, equal for values that differ by less than about one part in 1,000."""
    bits = values.astype(np.float32).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) >> 13


def _value(codes: np.ndarray) -> np.ndarray:
    """The least value of each code."""
    bits = codes << 13
    return np.where(bits < 0, -((-bits).astype(np.int32).view(np.float32)), bits.astype(np.int32).view(np.float32)).astype(float)


def _quantiles(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    order = np.argsort(codes, kind="stable")
    codes, upto = codes[order], np.cumsum(counts[order])
    if not len(codes):
        return np.zeros(0)
    return _value(np.unique(codes[np.searchsorted(upto, upto[-1] * np.linspace(0, 1, BINS + 1)[1:-1])]))


_fits: dict = {}


def _gradients(trees: list[WideTrees], level: int, fit: tuple):
    """Each partition's sums for the level that grows. A worker keeps its margins for the next tree, where it meets the
    partition again; else it works them out from all trees."""

    def kernel(part: int, blocks: Iterator[list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[list[np.ndarray]]:
        for key in [k for k in _fits if k[0] != fit]:
            del _fits[key]
        for views in blocks:
            out = []
            for v, (tree, (bins, y)) in enumerate(zip(trees, views, strict=True)):
                done, f = _fits.get((fit, part, v), (0, None))
                f = tree.binned_margin(bins, done, f)
                _fits[fit, part, v] = len(tree.leaf), f
                out.append(tree.sums(bins, y, PSEUDO, f, level))
            yield out

    return kernel


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


def _boost(trees: list[WideTrees], views: list[np.ndarray], y: np.ndarray, more: RDD | None, counts: np.ndarray, fit: tuple) -> None:
    """Fit both views' trees side by side on the labelled rows and on ``more``, the pseudo-labelled; counts: by view and label."""
    near = more is not None and counts.sum() <= NEAR
    blocks = more.collect() if near else []
    held: list = [[None] * 2 for _ in blocks]
    for tree, n in zip(trees, counts, strict=True):
        tree.start(float(y.sum() + PSEUDO * n[1]), float(len(y) + PSEUDO * n.sum()))
    f = [np.full(len(y), t.base) for t in trees]
    for _ in range(trees[0].rounds):
        for level in range(trees[0].depth):
            sums = [np.zeros((2, v.shape[1], 1 << level, BINS)) + t.sums(v, y, 1.0, m, level) for t, v, m in zip(trees, views, f, strict=True)]
            for block, g in zip(blocks, held, strict=True):
                for v, (t, (b, have)) in enumerate(zip(trees, block, strict=True)):
                    g[v] = t.binned_margin(b, len(t.leaf) - (not level and g[v] is not None) if g[v] is not None else 0, g[v])
                    sums[v] = sums[v] + t.sums(b, have, PSEUDO, g[v], level)
            if more is not None and not near:
                sums = _add(sums, more.mapPartitionsWithIndex(_gradients(trees, level, fit)).reduce(_add))
            for tree, x in zip(trees, sums, strict=True):
                tree.add_level(x, level)
        f = [t.binned_margin(v, len(t.leaf) - 1, m) for t, v, m in zip(trees, views, f, strict=True)]


def _sure(codes: dict[int, int], share: float) -> tuple[int, float, int, float]:
    """Of all free rows' margins the cut-offs of sureness: bad below the first code and, at it, that part of the rows by the
    number that breaks ties; good above the second likewise."""
    n = int(sum(codes.values()) * SHARE)
    out: list = []
    for order, most, sign in ((1, int(n * (1 - share)), -1), (-1, int(n * share), 1)):
        at, part = (-1 if sign < 0 else 1) * (1 << 40), 0.0
        for code in sorted((c for c in codes if c * sign > 0), reverse=order < 0):
            at, part = code, min(1.0, most / codes[code])
            most -= codes[code]
            if most <= 0:
                break
        out += [at, part]
    return tuple(out)


def _labelled_by(trees: list[WideTrees], cuts: list[tuple]):
    """Each view labels the rows it is surest about for the other."""

    def label(block: tuple) -> tuple:
        views, tie, labels = block
        new = labels.copy()
        for mine in (0, 1):
            code, (low, below, high, above) = _code(trees[mine].binned_margin(views[mine])), cuts[mine]
            free, draw = labels[:, 1 - mine] < 0, tie / TIES
            new[free & ((code < low) | ((code == low) & (draw < below))), 1 - mine] = 0
            new[free & ((code > high) | ((code == high) & (draw < above))), 1 - mine] = 1
        return views, tie, new

    return label


def _margins(trees: list[WideTrees]):
    def count(block: tuple) -> list[Counter]:
        views, _, labels = block
        found = [np.unique(_code(trees[v].binned_margin(views[v][labels[:, 1 - v] < 0])), return_counts=True) for v in (0, 1)]
        return [Counter(dict(zip(c.tolist(), n.tolist(), strict=True))) for c, n in found]

    return count


class Model:
    """Two calibrated views and their combination."""

    def fit(self, texts: np.ndarray, meta: tuple[list, list, list], y: np.ndarray, ids: np.ndarray, free: DataFrame, rounds: int = ROUNDS) -> Model:
        """``y`` of labelled rows is 1 good, 0 bad; ``meta`` holds source, lang and n_chars; ``free`` has the features of all
        unlabelled rows."""
        apart = (ids * 2654435761 >> 9) % CALIBRATE == 0
        learn = ~apart
        pick = lambda values, mask: [v for v, m in zip(values, mask.tolist(), strict=True) if m]
        self.metadata = Metadata(pick(meta[0], learn), pick(meta[1], learn), y[learn])
        views = [texts, self.metadata(*meta)]
        mine, good = [v[learn] for v in views], y[learn]
        self.trees = [WideTrees(c, 40) for c in self._cuts(free, mine)]
        bins, counts = [t.bin(v) for t, v in zip(self.trees, mine, strict=True)], np.zeros((2, 2))
        state = self._spread(free) if rounds and learn.any() else None
        self.searched, more, fit = 0, None, id(self)
        for r in range(rounds + 1):
            _boost(self.trees, bins, good, more, counts, (fit, r))
            if r == rounds or state is None:
                break
            found = state.map(_margins(self.trees)).reduce(_add)
            self.searched = self.searched or sum(found[0].values())
            before, state = state, state.map(_labelled_by(self.trees, [_sure(c, float(good.mean())) for c in found])).persist(StorageLevel.MEMORY_AND_DISK)
            counts = state.map(lambda b: np.array([[np.count_nonzero(b[2][:, v] == k) for k in (0, 1)] for v in (0, 1)])).sum()
            before.unpersist()
            if more is not None:
                more.unpersist()
            more = state.map(lambda b: [(b[0][v][b[2][:, v] >= 0], b[2][b[2][:, v] >= 0, v].astype(float)) for v in (0, 1)]).persist(StorageLevel.MEMORY_AND_DISK)
        for rdd in (state, more):
            if rdd is not None:
                rdd.unpersist()
        margins = [t.margin(x[apart]) for t, x in zip(self.trees, views, strict=True)]
        self.curves = [Isotonic().fit(m, y[apart]) for m in margins]
        seen = np.stack([_logit(c(m)) for c, m in zip(self.curves, margins, strict=True)], axis=1)
        self.weights = _logistic(seen, y[apart]) if apart.any() else np.array([1.0, 0.0, 0.0])
        return self

    def _views(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        x = batch["x"].flatten().to_numpy().reshape(len(batch), -1)
        return [x, self.metadata(*(batch[c].to_pylist() for c in ("source", "lang", "n_chars")))]

    def _cuts(self, free: DataFrame, mine: list[np.ndarray]) -> list[list[np.ndarray]]:
        """Quantiles of every feature of both views, over all rows."""

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for j, x in enumerate(np.concatenate(self._views(batch), axis=1).T):
                    code, n = np.unique(_code(x), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), j)), pa.array(code), pa.array(n)], ["j", "code", "n"])

        found = free.mapInArrow(kernel, "j long, code long, n long").groupBy("j", "code").agg(F.sum("n").alias("n")).toArrow()
        js, codes, n = (found[c].to_numpy() for c in ("j", "code", "n"))
        own = _code(np.concatenate(mine, axis=1))
        cuts = [_quantiles(np.append(codes[js == j], c), np.append(n[js == j], np.ones(len(c)))) for j, c in enumerate(own.T)]
        return [cuts[: mine[0].shape[1]], cuts[mine[0].shape[1] :]]

    def _spread(self, free: DataFrame) -> RDD | None:
        """All unlabelled rows in the executors, a block a partition: binned views, numbers that break ties, labels so far."""

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                one, two = (t.bin(v).tobytes() for t, v in zip(self.trees, self._views(batch), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (one, two, batch["tie"].to_numpy().tobytes())], ["one", "two", "tie"])

        widths, n = [len(t.cuts) for t in self.trees], free.count()
        if not n:
            return None

        def block(rows: Iterator) -> Iterator[tuple]:
            rows = list(rows)
            join = lambda c, kind: np.frombuffer(b"".join(bytes(r[c]) for r in rows), kind)
            tie = join("tie", np.int64)
            yield [join(c, np.uint8).reshape(-1, w) for c, w in zip(("one", "two"), widths, strict=True)], tie, np.full((len(tie), 2), -1, np.int8)

        parts = max(free.sparkSession.sparkContext.defaultParallelism, -(-n // PART))
        return free.mapInArrow(kernel, "one binary, two binary, tie binary").rdd.coalesce(parts).mapPartitions(block).persist(StorageLevel.MEMORY_AND_DISK)

    def score(self, texts: np.ndarray, source: list, lang: list, n_chars: list) -> np.ndarray:
        views = [texts, self.metadata(source, lang, n_chars)]
        seen = np.stack([_logit(c(t.margin(x))) for c, t, x in zip(self.curves, self.trees, views, strict=True)], axis=1)
        return 1 / (1 + np.exp(-(seen @ self.weights[:2] + self.weights[2])))


def matrix(texts: pa.Array) -> np.ndarray:
    rows = [text_features(t.as_py()) for t in texts.cast(pa.large_binary())]
    return np.array(rows, np.float64).reshape(len(rows), len(WORD_NAMES) + len(CHAR_NAMES))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model from ``labels`` (doc_id, quality) and all rows without one. Null labels and ids don't count as labels."""
    usable = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    width, names = len(WORD_NAMES) + len(CHAR_NAMES), ["doc_id", "lang", "source", "n_chars", "tie"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["text"])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), values], [*names, "x"])
        release()

    tied = _rows(docs).withColumn("tie", F.pmod(F.xxhash64("doc_id", "text"), F.lit(TIES)))
    features = keep(tied.select(*names, "text").mapInArrow(kernel, "doc_id long, lang string, source string, n_chars long, tie long, x array<double>"), "features")
    found = features.join(F.broadcast(sample_ids(usable, sample)), "doc_id").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("n_chars", "ascending"), ("tie", "ascending")])
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, width) if len(found) else np.zeros((0, width))
    meta = tuple(found[c].to_pylist() for c in ("source", "lang", "n_chars"))
    free = features.join(usable.select("doc_id"), "doc_id", "left_anti")
    return Model().fit(x, meta, found["y"].to_numpy().astype(float), found["doc_id"].to_numpy(), free, rounds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, high is good) and ``kept`` (score of at least KEEP_AT), replacing such columns.

    Rows are independent: repeats get equal scores; null texts count as empty; null metadata is a value of its own; an empty
    table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, source, lang, n_chars in batches:
            yield pa.array(shared.value.score(matrix(text), source.to_pylist(), lang.to_pylist(), n_chars.to_pylist()), pa.float64())
        _fits.clear()
        release()

    given = (text_of(), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    return docs.withColumn("score", F.arrow_udf(scores, "double")(*given)).withColumn("kept", F.col("score") >= KEEP_AT)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """``score`` by a model co-trained on ``labels``. Without labels every row scores 0.5 and is kept."""
    return score(docs, fit(docs, labels, sample, rounds))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document doc_id, score, kept; null texts and metadata, repeats and missing labels as with ``score`` and ``quality``;
    an empty table gives an empty result."""
    return quality(docs.select("doc_id", "text", "lang", "source", "n_chars"), labels).select("doc_id", "score", "kept")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are."""
    names = docs.columns
    inner = docs.select(F.struct(*names).alias("row"), "doc_id", "text", "lang", "source", "n_chars")
    return quality(inner, labels).where("kept").select("row.*")
