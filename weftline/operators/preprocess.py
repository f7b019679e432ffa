"""Preprocessors: functions from segments to segments, and sentence splitting that changes the number of rows."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.corpus import ParallelCorpus, numbered
from weftline.errors import ConfigurationError, CorpusError
from weftline.functions.text import one_space
from weftline.operators.subwords import bpe
from weftline.sources.text import open_text


class Preprocessor:
    """``process`` maps a corpus to a corpus; most only map segments by ``segment``."""

    def __init__(self, workdir: str = "", **ignored: Any) -> None:
        self.workdir = workdir

    def segment(self, text: Column, number: int) -> Column:
        raise NotImplementedError

    def process(self, corpus: ParallelCorpus) -> ParallelCorpus:
        return corpus.map(self.segment)


class WhitespaceNormalizer(Preprocessor):
    """Runs of white space become one space, none at the ends."""

    def segment(self, text: Column, number: int) -> Column:
        return one_space(text)


_FLAGS = {"A": re.A, "I": re.I, "L": re.L, "M": re.M, "S": re.S, "U": re.U, "X": re.X}


#: Patterns that Python and the JVM read alike, with plain groups; replacements of text and references to groups.
_ALIKE = re.compile(r"(?:[^\\$.()\[\]{}&~]|\\[^\w\s]|\((?!\?)|\)|\[\^?(?:[^\\\[\]&^]|\\[^\w\s])+\]|\{\d+(?:,\d*)?\})*")
_PLAIN = re.compile(r"(?:[^\\$]|\\[1-9](?!\d))*")


def _native(pattern: str, replacement: str, count: int, flags: int) -> bool:
    """Whether a substitution comes out the same in the JVM: all places, no flags, no empty match."""
    return not count and not flags and bool(_ALIKE.fullmatch(pattern)) and bool(_PLAIN.fullmatch(replacement)) and not re.match(pattern, "")


class RegExpSub(Preprocessor):
    """Substitutions (pattern, replacement, count, flags) in order; ``lang_patterns`` override them for a segment's number.
    Where all patterns of a segment mean the same to the JVM, they run there."""

    def __init__(self, patterns: Sequence[Sequence[Any]] = (), lang_patterns: Any = None, **rest: Any) -> None:
        super().__init__(**rest)
        self.patterns = [self._checked(p) for p in patterns]
        given = lang_patterns or {}
        given = given.items() if isinstance(given, dict) else enumerate(given)
        self.own = {int(k): [self._checked(p) for p in v] for k, v in given}

    @staticmethod
    def _checked(given: Sequence[Any]) -> tuple[str, str, int, int]:
        if len(given) != 4:
            raise ConfigurationError(f"four values expected: {given}")
        pattern, replacement, count, flags = given
        number = 0
        for name in flags if isinstance(flags, (list, tuple)) else [flags] if flags else []:
            number |= name if isinstance(name, int) else int(getattr(re, str(name).removeprefix("re.").upper(), None) or _FLAGS[str(name).upper()])
        re.compile(pattern, number)
        return pattern, replacement, count, number

    def segment(self, text: Column, number: int) -> Column:
        steps = self.own.get(number, self.patterns)
        if not steps:
            return text
        if all(_native(*step) for step in steps):
            return reduce(lambda t, x: F.regexp_replace(t, x[0], re.sub(r"\\([1-9])", r"$\1", x[1])), steps, text)

        def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            compiled = [(re.compile(p, f), r, c) for p, r, c, f in steps]
            for batch in batches:
                yield pa.array([reduce(lambda t, x: x[0].sub(x[1], t, count=x[2]), compiled, t) for t in batch.to_pylist()], pa.string())

        return F.arrow_udf(kernel, "string")(text)


_ABBREVIATIONS = frozenset("mr mrs ms dr prof st no vs etc e.g i.e z.b bzw ca nr hr fr sr sra".split())
_SPLITS = [
    (re.compile(r"([^\w\s.'’`,\-])"), r" \1 "),
    (re.compile(r"(?<!\d)([,])|([,])(?!\d)"), r" \1\2 "),
    (re.compile(r"(?<!\w)(['’`]+)|(['’`]+)(?!\w)"), r" \1\2 "),
    (re.compile(r"(?<=\w)(['’])(?=\w)"), r" \1"),
    (re.compile(r"(\.{2,})"), r" \1 "),
]


def rule_tokens(text: str) -> str:
    """Words and punctuation apart, by rules alone: a final full stop is cut off unless an abbreviation precedes it."""
    for pattern, replacement in _SPLITS:
        text = pattern.sub(replacement, text)
    out = text.split()
    if out and out[-1].endswith(".") and len(out[-1]) > 1 and set(out[-1]) != {"."} and out[-1][:-1].lower() not in _ABBREVIATIONS:
        out[-1:] = [out[-1][:-1], "."]
    return " ".join(out)


def join_tokens(text: str) -> str:
    """Undo ``rule_tokens`` as far as rules can."""
    text = re.sub(r" ([.,;:?!%)\]}»”]+)(?= |$)", r"\1", text)
    text = re.sub(r"(^| )([(\[{«“¿¡]) ", r"\1\2", text)
    return re.sub(r" (['’]\w)", r"\1", text)


@lru_cache(maxsize=16)
def _tokenizer(kind: str, language: str, options: str, reverse: bool) -> Any:
    if kind in ("moses", "rules"):
        return join_tokens if reverse else rule_tokens
    if kind == "jieba":
        import jieba

        return (lambda t: t.replace(" ", "").replace("␣", " ")) if reverse else lambda t: " ".join(x if x != " " else "␣" for x in jieba.cut(t))
    import MeCab

    tagger = MeCab.Tagger("-Owakati")
    return (lambda t: t.replace(" ", "").replace("␣", " ")) if reverse else lambda t: tagger.parse(t.replace(" ", "␣")).strip()


def tokenized(text: Column, specification: Any, reverse: bool = False) -> Column:
    """Tokens joined by spaces. A specification is a name or (name, language); ``none`` leaves the text."""
    kind, language = (specification, "") if isinstance(specification, str) else (*specification, "")[:2]
    if kind in (None, "none"):
        return text
    if kind not in ("moses", "rules", "jieba", "mecab"):
        raise ConfigurationError(f"unknown tokenizer: {kind}")
    library = {"jieba": "jieba", "mecab": "MeCab"}.get(kind)
    if library and importlib.util.find_spec(library) is None:
        raise ConfigurationError(f"tokenizer {kind} needs the library {library}")

    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _tokenizer(kind, language, "", reverse)
        for batch in batches:
            yield pa.array([own(t) for t in batch.to_pylist()], pa.string())

    return F.arrow_udf(kernel, "string")(text)


class Tokenizer(Preprocessor):
    """Tokenizes each segment. ``moses`` is carried out by this package's own rules."""

    reverse = False

    def __init__(self, tokenizer: Any = "moses", languages: Sequence[str] | None = None, options: Any = None, **rest: Any) -> None:
        super().__init__(**rest)
        self.kinds = tokenizer if isinstance(tokenizer, (list, tuple)) else None
        self.kind, self.languages = tokenizer, languages

    def segment(self, text: Column, number: int) -> Column:
        kind = self.kinds[number] if self.kinds else self.kind
        return tokenized(text, (kind, self.languages[number] if self.languages else ""), self.reverse)


class Detokenizer(Tokenizer):
    """Joins tokens to plain text."""

    reverse = True


class BPESegmentation(Preprocessor):
    """Splits words by a codes file, or joins the pieces."""

    def __init__(self, model: str, merges: int = -1, separator: str = "@@", vocab: str | None = None, glossaries: Sequence[str] | None = None, dropout: float = 0.0, reverse: bool = False, **rest: Any) -> None:
        super().__init__(**rest)
        import os

        if not isinstance(model, str):
            raise ConfigurationError(f"a path is expected as model: {model}")
        path = lambda p: os.path.join(self.workdir, p) if p else None
        self.options = {"path": path(model), "merges": merges, "separator": separator, "vocabulary": path(vocab), "glossaries": glossaries, "dropout": dropout, "reverse": reverse}

    def segment(self, text: Column, number: int) -> Column:
        return bpe(text, **self.options)


class MorfessorSegmentation(Preprocessor):
    """Splits words by a Morfessor model; needs that library unless ``reverse`` only joins."""

    def __init__(self, model: str, separator: str = "@@", lowercase: bool = False, viterbi_max_len: int = 30, viterbi_smoothing: float = 0.0, reverse: bool = False, **rest: Any) -> None:
        super().__init__(**rest)
        import os

        if not reverse and importlib.util.find_spec("morfessor") is None:
            raise ConfigurationError("MorfessorSegmentation needs the library morfessor")
        self.path, self.separator, self.lower, self.limit, self.smoothing, self.reverse = os.path.join(self.workdir, model), separator, lowercase, viterbi_max_len, viterbi_smoothing, reverse

    def segment(self, text: Column, number: int) -> Column:
        if self.reverse:
            return F.replace(text, F.lit(self.separator + " "), F.lit(""))
        path, separator, lower, limit, smoothing = self.path, self.separator, self.lower, self.limit, self.smoothing

        def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import morfessor

            model = morfessor.MorfessorIO().read_any_model(path)
            word = lru_cache(1_000_000)(lambda w: (separator + " ").join(model.viterbi_segment(w, smoothing, limit)[0]))
            for batch in batches:
                yield pa.array([" ".join(word(w.lower() if lower else w) for w in t.split()) for t in batch.to_pylist()], pa.string())

        return F.arrow_udf(kernel, "string")(text)


class DummySegmentation(Preprocessor):
    """Leaves segments as they are."""

    def __init__(self, reverse: bool = False, **rest: Any) -> None:
        super().__init__(**rest)

    def segment(self, text: Column, number: int) -> Column:
        return text


def sentences(text: str, prefixes: frozenset[str] = _ABBREVIATIONS) -> list[str]:
    """Sentences of a paragraph: cut after final marks before a capital, digit or opening mark, but not after a prefix."""
    out, begin = [], 0
    for m in re.finditer(r"([.?!…]+[\"'”’»)\]]*)\s+(?=[\"'“‘«¿¡(\[]*[^\W_a-zà-öø-ÿ])", text):
        word = re.search(r"([\w.]+)$", text[begin : m.start()])
        stem = word[1].lower() if word else ""
        if m[1] == "." and (stem in prefixes or (len(stem) == 1 and stem.isalpha())):
            continue
        out.append(text[begin : m.end(1)].strip())
        begin = m.end()
    return [s for s in [*out, text[begin:].strip()] if s]


class MonolingualSentenceSplitter(Preprocessor):
    """One row a sentence. Segments of a row are padded to the longest; more than one needs ``enable_parallel``."""

    def __init__(self, language: str = "en", non_breaking_prefix_file: str | None = None, enable_parallel: bool = False, **rest: Any) -> None:
        super().__init__(**rest)
        self.prefixes, self.parallel = _ABBREVIATIONS, enable_parallel
        if non_breaking_prefix_file:
            with open_text(non_breaking_prefix_file) as file:
                self.prefixes = frozenset(line.split("#")[0].strip().lower().rstrip(".") for line in file if line.split("#")[0].strip())

    def process(self, corpus: ParallelCorpus) -> ParallelCorpus:
        if corpus.n > 1 and not self.parallel:
            raise CorpusError("sentence splitting of several segments has to be enabled")
        prefixes = self.prefixes

        def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([sentences(t, prefixes) or [""] for t in batch.to_pylist()], pa.list_(pa.string()))

        split = F.arrow_udf(kernel, "array<string>")
        lists = corpus.df.select("idx", *(split(c).alias(n) for c, n in zip(corpus.segments, corpus.names, strict=True)))
        zipped = lists.select(F.col("idx").alias("__old"), F.posexplode(F.arrays_zip(*corpus.names)).alias("__pos", "z"))
        flat = zipped.select("__old", "__pos", *(F.coalesce(F.col(f"z.{n}"), F.lit("")).alias(n) for n in corpus.names))
        return ParallelCorpus(numbered(flat, ["__old", "__pos"]).select("idx", *corpus.names), corpus.n)


REGISTRY: dict[str, type[Preprocessor]] = {c.__name__: c for c in (WhitespaceNormalizer, RegExpSub, Tokenizer, Detokenizer, BPESegmentation, MorfessorSegmentation, DummySegmentation, MonolingualSentenceSplitter)}


class PreprocessorPipeline:
    def __init__(self, steps: Sequence[Preprocessor]) -> None:
        self.steps = list(steps)

    @staticmethod
    def of(config: Sequence[dict[str, Any]], workdir: str = "") -> PreprocessorPipeline:
        out = []
        for item in config:
            name = next(k for k in item if k != "module")
            kind = getattr(importlib.import_module(item["module"]), name) if "module" in item else REGISTRY.get(name)
            if kind is None:
                raise ConfigurationError(f"unknown preprocessor: {name}")
            out.append(kind(**{**(item[name] or {}), "workdir": workdir}))
        return PreprocessorPipeline(out)

    def process(self, corpus: ParallelCorpus) -> ParallelCorpus:
        return reduce(lambda c, s: s.process(c), self.steps, corpus)
