"""Subword segmentation by byte-pair encoding of characters: learning merges from word counts, splitting and joining."""

from __future__ import annotations

import heapq
import random
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import ConfigurationError
from weftline.functions.text import words
from weftline.sources.text import open_text

END = "</w>"


def word_counts(text: DataFrame, column: str = "s0") -> DataFrame:
    """word and n over all lines; summed in each partition before the shuffle."""
    return text.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def learn(counts: dict[str, int], symbols: int = 10_000, min_frequency: int = 2) -> list[tuple[str, str]]:
    """Merges by falling pair frequency; ties go to the pair that sorts last. Pair counts are kept up to date by word, and a
    heap holds for each pair a count that is its own or was: a pair is pushed when its count has grown, or corrected when it
    comes up."""
    vocabulary = [((*w[:-1], w[-1] + END), n) for w, n in sorted(counts.items()) if w]
    pairs: Counter[tuple[str, str]] = Counter()
    where: dict[tuple[str, str], array] = defaultdict(lambda: array("q"))
    for i, (parts, n) in enumerate(vocabulary):
        for pair in zip(parts, parts[1:], strict=False):
            pairs[pair] += n
            where[pair].append(i)
    heap = [(-n, _falling(pair), pair) for pair, n in pairs.items()]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < symbols:
        n, key, best = heapq.heappop(heap)
        if pairs.get(best, 0) != -n:
            if best in pairs and pairs[best] < -n:
                heapq.heappush(heap, (-pairs[best], key, best))
            continue
        if -n < min_frequency:
            break
        out.append(best)
        grown, merged = set(), "".join(best)
        for i in sorted(set(where.pop(best, ()))):
            parts, n = vocabulary[i]
            new = _contract(parts, best)
            if len(new) == len(parts):
                continue
            before = list(zip(parts, parts[1:], strict=False))
            for pair in before:
                pairs[pair] -= n
                if pairs[pair] <= 0:
                    del pairs[pair]
            held = set(before)
            for pair in zip(new, new[1:], strict=False):
                pairs[pair] += n
                if merged in pair:
                    grown.add(pair)
                if pair not in held:
                    where[pair].append(i)
            vocabulary[i] = (new, n)
        pairs.pop(best, None)
        for pair in grown:
            if pair in pairs:
                heapq.heappush(heap, (-pairs[pair], _falling(pair), pair))
    return out


def _falling(pair: tuple[str, str]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """A key that puts pairs in the opposite of their own order."""
    return _opposite(pair[0]), _opposite(pair[1])


@lru_cache(maxsize=100_000)
def _opposite(part: str) -> tuple[int, ...]:
    return (*(-ord(c) for c in part), 1)


def _contract(parts: Sequence[str], pair: tuple[str, str]) -> tuple[str, ...]:
    out: list[str] = []
    i = 0
    while i < len(parts):
        if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
            out.append(parts[i] + parts[i + 1])
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return tuple(out)


def train(text: DataFrame, path: str, column: str = "s0", symbols: int = 10_000, min_frequency: int = 2) -> None:
    """Merges from a corpus's word types as a codes file. Counting is distributed; the word types have to fit the driver."""
    counts = {r["word"]: r["n"] for r in word_counts(text, column).toLocalIterator()}
    with open_text(path, "w") as file:
        file.write("#version: 0.2\n")
        file.writelines(f"{a} {b}\n" for a, b in learn(counts, symbols, min_frequency))


class Segmenter:
    """Applies a codes file. ``glossaries`` are patterns of parts that stay whole; a ``vocabulary`` limits the pieces."""

    def __init__(self, path: str, merges: int = -1, separator: str = "@@", vocabulary: str | None = None, glossaries: Sequence[str] | None = None, dropout: float = 0.0) -> None:
        try:
            with open_text(path) as file:
                lines = [line.rstrip("\r\n ") for line in file]
        except OSError as error:
            raise ConfigurationError(f"no codes file: {path}") from error
        codes = [tuple(line.split(" ")) for line in lines if line and not line.startswith("#version")]
        self.ranks = {pair: i for i, pair in reversed(list(enumerate(codes[: merges if merges >= 0 else None])))}
        self.separator, self.dropout = separator, dropout
        self.glossaries = [re.compile(f"({g})") for g in glossaries or ()]
        self.known = None
        if vocabulary:
            with open_text(vocabulary) as file:
                self.known = {line.split(" ")[0].strip() for line in file}
        self.reverse = {a + b: (a, b) for a, b in self.ranks}
        self.kept: dict[str, tuple[str, ...]] = {}

    def pieces(self, word: str) -> tuple[str, ...]:
        """Pieces of a word, without marks."""
        if not self.dropout and word in self.kept:
            return self.kept[word]
        parts: tuple[str, ...] = (*word[:-1], word[-1] + END)
        while len(parts) > 1:
            ranked = [(self.ranks[p], p) for p in zip(parts, parts[1:], strict=False) if p in self.ranks and not (self.dropout and random.random() < self.dropout)]
            if not ranked:
                break
            parts = _contract(parts, min(ranked)[1])
        last = parts[-1]
        parts = parts[:-1] if last == END else (*parts[:-1], last.removesuffix(END))
        if self.known is not None:
            parts = tuple(self._limited(parts))
        if len(self.kept) > 500_000:
            self.kept.clear()
        self.kept[word] = parts
        return parts

    def _limited(self, parts: Sequence[str]) -> Iterator[str]:
        for i, part in enumerate(parts):
            final = i == len(parts) - 1
            yield from self._split(part, final)

    def _split(self, part: str, final: bool) -> Iterator[str]:
        if (part if final else part + self.separator) in (self.known or ()) or len(part) == 1:
            yield part
            return
        a, b = self.reverse.get(part + END if final else part, (None, None))
        if a is None:
            yield part
            return
        yield from self._split(a, False)
        yield from self._split(b.removesuffix(END) if final else b, final)

    def _parts(self, word: str) -> list[str]:
        parts = [word]
        for g in self.glossaries:
            parts = [x for p in parts for x in (g.split(p) if not any(o.fullmatch(p) for o in self.glossaries) else [p]) if x]
        return parts

    def split(self, line: str) -> str:
        out = []
        for word in line.split():
            found = [x for p in self._parts(word) for x in ((p,) if any(g.fullmatch(p) for g in self.glossaries) else self.pieces(p))]
            out += [x + self.separator for x in found[:-1]] + found[-1:]
        lead, tail = line[: len(line) - len(line.lstrip(" \r\n"))], line[len(line.rstrip(" \r\n")) :] if line.strip(" \r\n") else ""
        return lead + " ".join(out) + tail


@lru_cache(maxsize=8)
def segmenter(path: str, merges: int, separator: str, vocabulary: str | None, glossaries: tuple[str, ...], dropout: float) -> Segmenter:
    return Segmenter(path, merges, separator, vocabulary, glossaries, dropout)


def bpe(text: Column, path: str, merges: int = -1, separator: str = "@@", vocabulary: str | None = None, glossaries: Sequence[str] | None = None, dropout: float = 0.0, reverse: bool = False) -> Column:
    """Split words into marked pieces, or join them again."""
    if reverse:
        return F.replace(text, F.lit(separator + " "), F.lit(""))
    Segmenter(path, merges, separator, vocabulary, glossaries, dropout)  # a wrong model fails here, not in a task
    args = (path, merges, separator, vocabulary, tuple(glossaries or ()), dropout)

    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = segmenter(*args)
        for batch in batches:
            yield pa.array([own.split(t) for t in batch.to_pylist()], pa.string())

    return F.arrow_udf(kernel, "string")(text)
