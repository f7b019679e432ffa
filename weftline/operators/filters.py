"""Filters: each gives a typed score column and a boolean that accepts it. Row-local filters stay inside code generation
wherever built-in functions can say them; the others run as Arrow-batched kernels."""

from __future__ import annotations

import difflib
import math
import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.errors import ConfigurationError
from weftline.functions.text import WHITE, WHITE_RE, all_of, alphabetic, any_of, count_outside, words

LOW, HIGH, BETWEEN, TRUE, FALSE = "low", "high", "between", "true", "false"
INF = math.inf


class Each:
    """An argument that is one value for all segments or a list with one a segment."""

    def __init__(self, value: Any, kinds: type | tuple[type, ...], name: str, choices: Sequence[Any] | None = None) -> None:
        self.many, self.value, self.name = isinstance(value, (list, tuple)), value, name
        for v in value if self.many else [value]:
            if not isinstance(v, kinds) or (isinstance(v, bool) and kinds is not bool):
                raise ConfigurationError(f"{name} has a value of a wrong type: {v!r}")
            if choices and v not in choices:
                raise ConfigurationError(f"{name} has to be one of {', '.join(map(str, choices))}: {v!r}")

    def __getitem__(self, i: int) -> Any:
        return self.value[i] if self.many else self.value

    @staticmethod
    def same_length(*arguments: Each) -> None:
        if len({len(a.value) for a in arguments if a.many}) > 1:
            raise ConfigurationError("lists of different lengths: " + ", ".join(a.name for a in arguments))

    def fits(self, n: int) -> None:
        if self.many and len(self.value) < n:
            raise ConfigurationError(f"{self.name} has {len(self.value)} values for {n} segments")


class Filter:
    """A score of a row's segments and a decision on it. Subclasses with ``python`` true come after native ones."""

    direction = LOW
    accept_threshold: Any = None
    reject_threshold: Any = None
    python = False

    def __init__(self, name: str | None = None, workdir: str = "", **ignored: Any) -> None:
        self.name, self.workdir, self.ignored = name, workdir, sorted(ignored)

    def score(self, segments: Sequence[Column]) -> Column:
        raise NotImplementedError

    def accept(self, score: Column) -> Column:
        """Never null where the score isn't."""
        raise NotImplementedError

    def decide(self, segments: Sequence[Column]) -> Column:
        return self.accept(self.score(segments))


_UNITS = ("word", "char", "character")
_NUMBER = (int, float)


def _length(segment: Column, unit: str) -> Column:
    return F.size(words(segment)) if unit == "word" else F.length(segment)


def _within(score: Column, low: Each, high: Each) -> Column:
    """Whether each item lies between its bounds; the bounds' lists may be longer than the score."""
    if not low.many and not high.many:
        return F.forall(score, lambda x: (x >= F.lit(low.value)) & (x <= F.lit(high.value)))
    n = len((low if low.many else high).value)
    item = lambda i: F.get(score, F.lit(i))
    return all_of([item(i).isNull() | ((item(i) >= F.lit(low[i])) & (item(i) <= F.lit(high[i]))) for i in range(n)])


def _each_item(score: Column, threshold: Each, test: Callable[[Column, Column], Column]) -> Column:
    if not threshold.many:
        return F.forall(score, lambda x: test(x, F.lit(threshold.value)))
    return all_of([F.get(score, F.lit(i)).isNull() | test(F.get(score, F.lit(i)), F.lit(t)) for i, t in enumerate(threshold.value)])


class LengthFilter(Filter):
    """Number of words or characters of each segment."""

    direction, accept_threshold, reject_threshold = BETWEEN, (0, INF), (INF, 0)

    def __init__(self, min_length: Any = 1, max_length: Any = 100, unit: Any = "word", pass_empty: bool = False, **rest: Any) -> None:
        super().__init__(**rest)
        self.min, self.max = Each(min_length, _NUMBER, "min_length"), Each(max_length, _NUMBER, "max_length")
        self.unit, self.pass_empty = Each(unit, str, "unit", _UNITS), pass_empty
        Each.same_length(self.min, self.max, self.unit)

    def score(self, segments: Sequence[Column]) -> Column:
        self.unit.fits(len(segments))
        return F.array(*(_length(s, self.unit[i]) for i, s in enumerate(segments)))

    def accept(self, score: Column) -> Column:
        found = _within(score, self.min, self.max)
        return found | F.forall(score, lambda x: x == 0) if self.pass_empty else found


class LengthRatioFilter(Filter):
    """Longest segment over shortest: 0 if all are empty, infinite if only some are."""

    direction, accept_threshold, reject_threshold = LOW, INF, 1

    def __init__(self, threshold: float = 3, unit: Any = "word", **rest: Any) -> None:
        super().__init__(**rest)
        self.threshold, self.unit = threshold, Each(unit, str, "unit", _UNITS)

    def score(self, segments: Sequence[Column]) -> Column:
        self.unit.fits(len(segments))
        lengths = F.array(*(_length(s, self.unit[i]) for i, s in enumerate(segments)))
        most, least = F.array_max(lengths), F.array_min(lengths)
        return F.when(most == 0, F.lit(0.0)).when(least == 0, F.lit(INF)).otherwise(F.try_divide(most.cast("double"), least.cast("double")))

    def accept(self, score: Column) -> Column:
        return score < F.lit(float(self.threshold))


class LongWordFilter(Filter):
    """Length of each segment's longest word."""

    direction, accept_threshold, reject_threshold = LOW, INF, 1

    def __init__(self, threshold: Any = 40, **rest: Any) -> None:
        super().__init__(**rest)
        self.threshold = Each(threshold, _NUMBER, "threshold")

    def score(self, segments: Sequence[Column]) -> Column:
        return F.array(*(F.coalesce(F.array_max(F.transform(words(s), F.length)), F.lit(0)) for s in segments))

    def accept(self, score: Column) -> Column:
        return _each_item(score, self.threshold, lambda x, t: x < t)


class AverageWordLengthFilter(Filter):
    """Mean length of each segment's words, 0 without words."""

    direction, accept_threshold, reject_threshold = BETWEEN, (0, INF), (INF, 0)

    def __init__(self, min_length: Any = 2, max_length: Any = 20, pass_empty: bool = False, **rest: Any) -> None:
        super().__init__(**rest)
        self.min, self.max, self.pass_empty = Each(min_length, _NUMBER, "min_length"), Each(max_length, _NUMBER, "max_length"), pass_empty
        Each.same_length(self.min, self.max)

    def score(self, segments: Sequence[Column]) -> Column:
        mean = lambda s: F.coalesce(F.try_divide(count_outside(s, WHITE).cast("double"), F.size(words(s)).cast("double")), F.lit(0.0))
        return F.array(*map(mean, segments))

    def accept(self, score: Column) -> Column:
        found = _within(score, self.min, self.max)
        return found | F.forall(score, lambda x: x == 0) if self.pass_empty else found


_PORTABLE = re.compile(r"(?:[^\\$.()\[\]{}&~]|\\[^\w\s]|\[\^?(?:[^\\\[\]&^]|\\[^\w\s])+\]|\{\d+(?:,\d*)?\})*")


class RegExpFilter(Filter):
    """Whether a pattern is found in each segment."""

    accept_threshold = reject_threshold = None

    def __init__(self, regexps: Any = None, accept_match: bool = False, **rest: Any) -> None:
        super().__init__(**rest)
        if regexps is None:
            raise ConfigurationError("RegExpFilter needs regexps")
        self.regexps, self.accept_match = Each(regexps, str, "regexps"), accept_match
        self.direction = TRUE if accept_match else FALSE
        patterns = regexps if self.regexps.many else [regexps]
        # patterns that both engines read alike run in the JVM
        self.native = [bool(_PORTABLE.fullmatch(p)) for p in patterns]
        self.python = not all(self.native)

    def score(self, segments: Sequence[Column]) -> Column:
        self.regexps.fits(len(segments))
        out = []
        for i, s in enumerate(segments):
            native = self.native[i if self.regexps.many else 0]
            out.append(s.rlike(self.regexps[i]) if native else _searches(self.regexps[i], s))
        return F.array(*out)

    def accept(self, score: Column) -> Column:
        return F.forall(score, lambda x: x if self.accept_match else ~x)


def _searches(pattern: str, segment: Column) -> Column:
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        own = regex.compile(pattern)
        for batch in batches:
            yield pa.array([own.search(t) is not None for t in batch.to_pylist()], pa.bool_())

    return F.arrow_udf(kernel, "boolean")(segment)


class AlphabetRatioFilter(Filter):
    """Share of alphabetic characters; 1 for an empty segment."""

    direction, accept_threshold, reject_threshold = HIGH, 0, 1 + 10**-6

    def __init__(self, threshold: Any = 0.75, exclude_whitespace: bool = False, **rest: Any) -> None:
        super().__init__(**rest)
        self.threshold, self.exclude = Each(threshold, _NUMBER, "threshold"), exclude_whitespace

    def score(self, segments: Sequence[Column]) -> Column:
        def share(s: Column) -> Column:
            base = F.regexp_replace(s, f"[{WHITE_RE}]+", "") if self.exclude else s
            return F.coalesce(F.try_divide(F.length(alphabetic(base)).cast("double"), F.length(base).cast("double")), F.lit(1.0))

        return F.array(*map(share, segments))

    def accept(self, score: Column) -> Column:
        return _each_item(score, self.threshold, lambda x, t: x >= t)


class CharacterScoreFilter(Filter):
    """Share of alphabetic characters in a script; 1 without alphabetic characters."""

    direction, accept_threshold, reject_threshold = HIGH, 0, 1 + 10**-6

    def __init__(self, scripts: Sequence[str] | None = None, thresholds: Sequence[float] | None = None, **rest: Any) -> None:
        super().__init__(**rest)
        if not scripts:
            raise ConfigurationError("CharacterScoreFilter needs scripts")
        self.scripts = list(scripts)
        self.thresholds = list(thresholds) if thresholds is not None else [1] * len(self.scripts)
        if len(self.thresholds) != len(self.scripts):
            raise ConfigurationError("thresholds and scripts differ in length")

    def score(self, segments: Sequence[Column]) -> Column:
        if len(segments) != len(self.scripts):
            raise ConfigurationError(f"{len(self.scripts)} scripts for {len(segments)} segments")

        def share(s: Column, script: str) -> Column:
            letters = alphabetic(s)
            own = F.regexp_replace(letters, f"\\P{{Is{script}}}", "")
            return F.coalesce(F.try_divide(F.length(own).cast("double"), F.length(letters).cast("double")), F.lit(1.0))

        return F.array(*(share(s, c) for s, c in zip(segments, self.scripts, strict=True)))

    def accept(self, score: Column) -> Column:
        return _each_item(score, Each(self.thresholds, _NUMBER, "thresholds"), lambda x, t: x >= t)


class TerminalPunctuationFilter(Filter):
    """Penalty for terminal punctuation that differs between two segments or occurs more than once; 0 is best."""

    direction, accept_threshold, reject_threshold = HIGH, 0, INF

    def __init__(self, threshold: float = -2, **rest: Any) -> None:
        super().__init__(**rest)
        self.threshold = threshold

    def score(self, segments: Sequence[Column]) -> Column:
        if len(segments) != 2:
            raise ConfigurationError("TerminalPunctuationFilter needs two segments")
        a, b = (F.length(F.regexp_replace(s, "[^.?!…]", "")) for s in segments)
        extra = lambda x: F.greatest(x - 1, F.lit(0))
        return -F.ln((F.abs(a - b) + extra(a) + extra(b) + 1).cast("double"))

    def accept(self, score: Column) -> Column:
        return score >= F.lit(float(self.threshold))


def _require(score: Column, test: Callable[[Column], Column], every: bool) -> Column:
    return F.forall(score, test) if every else F.exists(score, test)


def _pairwise(segments: Sequence[Column], function: Callable[[str, str], float]) -> Column:
    """Array of a Python function of all pairs of segments."""
    n = len(segments)

    def kernel(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = [c.to_pylist() for c in (batch if isinstance(batch, tuple) else (batch,))]
            yield pa.array([[function(row[i], row[j]) for i, j in combinations(range(n), 2)] for row in zip(*columns, strict=True)], pa.list_(pa.float64()))

    return F.arrow_udf(kernel, "array<double>")(*segments)


class NonZeroNumeralsFilter(Filter):
    """Similarity of the sequences of digits 1 to 9."""

    direction, accept_threshold, reject_threshold, python = HIGH, 0, 1 + 10**-6, True

    def __init__(self, threshold: float = 0.5, require_all: bool = True, **rest: Any) -> None:
        super().__init__(**rest)
        self.threshold, self.require_all = threshold, require_all

    def score(self, segments: Sequence[Column]) -> Column:
        # only digits travel to the kernel
        return _pairwise([F.regexp_replace(s, "[^1-9]+", "") for s in segments], lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())

    def accept(self, score: Column) -> Column:
        return _require(score, lambda x: x >= F.lit(float(self.threshold)), self.require_all)


def _common_part(a: str, b: str) -> float:
    short = min(len(a), len(b))
    return difflib.SequenceMatcher(None, a, b).find_longest_match().size / short if short else 0.0


class LongestCommonSubstringFilter(Filter):
    """Longest common substring over the shorter segment's length."""

    direction, accept_threshold, reject_threshold, python = LOW, 1 + 10**-6, 0, True

    def __init__(self, threshold: float = 0.9, require_all: bool = True, **rest: Any) -> None:
        super().__init__(**rest)
        self.threshold, self.require_all = threshold, require_all

    def score(self, segments: Sequence[Column]) -> Column:
        return _pairwise(segments, _common_part)

    def accept(self, score: Column) -> Column:
        return _require(score, lambda x: x < F.lit(float(self.threshold)), self.require_all)


def edit_similarity(a: Sequence[Any], b: Sequence[Any], weights: Sequence[int] = (1, 1, 1)) -> float:
    """1 minus the weighted edit distance (insert, delete, replace) over the largest that these lengths allow."""
    add, drop, change = weights
    n, m = len(a), len(b)
    whole = min(n * drop + m * add, min(n, m) * change + (n - m) * drop if n >= m else min(n, m) * change + (m - n) * add)
    if not whole:
        return 1.0
    row = [j * add for j in range(m + 1)]
    for i in range(n):
        last, row[0] = row[0], (i + 1) * drop
        for j in range(m):
            here = last if a[i] == b[j] else min(last + change, row[j + 1] + drop, row[j] + add)
            last, row[j + 1] = row[j + 1], here
    return 1.0 - row[m] / whole


class SimilarityFilter(Filter):
    """Normalised edit similarity of segments, by characters or words."""

    direction, accept_threshold, reject_threshold = LOW, 1 + 10**-6, 0

    def __init__(self, threshold: float = 0.9, weights: Sequence[int] = (1, 1, 1), unit: str = "char", lowercase: bool = False, require_all: bool = True, **rest: Any) -> None:
        super().__init__(**rest)
        Each(unit, str, "unit", _UNITS)
        self.threshold, self.weights, self.unit, self.lowercase, self.require_all = threshold, tuple(weights), unit, lowercase, require_all
        self.native = self.weights == (1, 1, 1) and unit != "word"
        self.python = not self.native

    def score(self, segments: Sequence[Column]) -> Column:
        used = [F.lower(s) for s in segments] if self.lowercase else list(segments)
        if self.native:
            most = lambda a, b: F.greatest(F.length(a), F.length(b)).cast("double")
            one = lambda a, b: F.coalesce(1 - F.try_divide(F.levenshtein(a, b).cast("double"), most(a, b)), F.lit(1.0))
            found = [one(a, b) for a, b in combinations(used, 2)]
            return F.array(*found) if found else F.array().cast("array<double>")
        split, weights = self.unit == "word", self.weights
        return _pairwise(used, lambda a, b: edit_similarity(a.split(), b.split(), weights) if split else edit_similarity(a, b, weights))

    def accept(self, score: Column) -> Column:
        return _require(score, lambda x: x < F.lit(float(self.threshold)), self.require_all)


#: Characters that are searched at once for repetitions.
_SPAN = 1 << 18


def repeated(texts: Sequence[str], times: int, longest: int) -> dict[int, list[tuple[int, int]]]:
    """For each text where a part of at most ``longest`` characters may follow itself ``times`` times, perhaps after spaces:
    ranges of places, counted without spaces, one of which holds its start.

    Without spaces such a text equals itself at a distance d of at most ``longest`` over ``times * d`` characters. So a gram
    of up to 8 of them recurs at that distance from one of any ``times * d - 7`` neighbouring places, and few places need a look.
    """
    bare = [t.replace(" ", "") for t in texts]
    ends = np.cumsum([len(t) for t in bare])
    codes = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32)
    z = (codes ^ (codes >> 8)).astype(np.uint8)  # characters that share a byte only cost a look
    found: dict[int, list[tuple[int, int]]] = {}
    grams = {w: np.ndarray(max(0, len(z) - w + 1), f"<u{w}", z, strides=(1,)) for w in (1, 2, 4, 8)}
    for d in range(1, longest + 1):
        run = times * d
        w = next(w for w in (8, 4, 2, 1) if w <= run)
        step, g = run - w + 1, grams[w]
        if len(g) <= d:
            break
        at = np.flatnonzero(g[:-d:step] == g[d::step]) * step
        if not len(at):
            continue
        text = np.searchsorted(ends, at, side="right")
        inside = at + d + w <= ends[text]
        for i, j in zip(text[inside].tolist(), at[inside].tolist(), strict=True):
            start = int(ends[i]) - len(bare[i])
            found.setdefault(i, []).append((max(0, j - step + 1 - start), j + 1 - start))
    return found


def repetitions(texts: Sequence[str], pattern: re.Pattern[str], times: int, longest: int) -> list[int]:
    """How often the part that ``pattern`` finds first follows itself in each text."""
    out = [0] * len(texts)
    for i, ranges in repeated(texts, times, longest).items():
        text, seen, place, bare = texts[i], -1, 0, 0  # the character at ``place`` has ``bare`` others before it that aren't spaces
        for a, b in sorted(ranges):
            for start in range(max(a, seen + 1), b):
                while text[place] == " " or bare < start:
                    bare += text[place] != " "
                    place += 1
                if match := pattern.match(text, place):
                    whole, part = match[0], match[1]
                    out[i] = (len(whole) - len(whole.replace(part, ""))) // len(part) - 1
                    break
            seen = max(seen, b - 1)
            if out[i]:
                break
    return out


class RepetitionFilter(Filter):
    """How often the first repeated part follows itself, over all segments."""

    direction, accept_threshold, reject_threshold, python = LOW, INF, 1, True

    def __init__(self, threshold: float = 2, min_length: int = 3, max_length: int = 100, **rest: Any) -> None:
        super().__init__(**rest)
        if min_length < 1:
            raise ConfigurationError(f"min_length has to be 1 or more: {min_length}")
        if threshold < 1:
            raise ConfigurationError(f"threshold has to be 1 or more: {threshold}")
        self.threshold, self.longest = threshold, max_length + 1
        # possessive, so long repetitions cost no memory; only \n ends what a dot matches
        self.pattern = None if threshold == INF else f"([^{WHITE_RE}].{{{min_length - 1},{max_length}}}?)(?: *\\1){{{int(threshold)},}}+"

    def score(self, segments: Sequence[Column]) -> Column:
        if self.pattern is None:
            return F.lit(0)
        source, times, longest = self.pattern, int(self.threshold), self.longest

        def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            pattern = re.compile(source)
            for batch in batches:
                texts, out, a = batch.to_pylist(), [], 0
                while a < len(texts):
                    b, n = a, 0
                    while b < len(texts) and n < _SPAN:
                        n += len(texts[b] or "")
                        b += 1
                    out += repetitions([t or "" for t in texts[a:b]], pattern, times, longest)
                    a = b
                yield pa.array([None if t is None else n for t, n in zip(texts, out, strict=True)], pa.int32())

        counts = [F.arrow_udf(kernel, "int")(s) for s in segments]
        return F.greatest(*counts) if len(counts) > 1 else counts[0]

    def accept(self, score: Column) -> Column:
        return score < F.lit(float(self.threshold)) if self.pattern else F.lit(True)


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found = True


def has_tag(text: str) -> bool:
    """Whether an HTML parser finds an element; text that breaks it has none."""
    parser = _Tags()
    try:
        parser.feed(text)
        parser.close()
    except (AssertionError, NotImplementedError, ValueError):
        return False
    return parser.found


def _tag_kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([t is not None and has_tag(t) for t in batch.to_pylist()], pa.bool_())


class HtmlTagFilter(Filter):
    """Whether each segment holds an HTML element."""

    direction, python = FALSE, True

    def score(self, segments: Sequence[Column]) -> Column:
        maybe = lambda s: F.when(s.rlike("<[a-zA-Z]"), s)  # noqa: E731 - others reach the kernel as null
        return F.array(*(F.arrow_udf(_tag_kernel, "boolean")(maybe(s)) for s in segments))

    def accept(self, score: Column) -> Column:
        return ~F.exists(score, lambda x: x)


#: Class name -> class; model-based filters add themselves.
REGISTRY: dict[str, type[Filter]] = {
    c.__name__: c
    for c in (
        LengthFilter, LengthRatioFilter, LongWordFilter, AverageWordLengthFilter, RegExpFilter, AlphabetRatioFilter, CharacterScoreFilter,
        TerminalPunctuationFilter, NonZeroNumeralsFilter, LongestCommonSubstringFilter, SimilarityFilter, RepetitionFilter, HtmlTagFilter,
    )
}
