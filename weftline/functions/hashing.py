"""Keys and hashes of segments, and unsigned arithmetic on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.errors import ConfigurationError
from weftline.functions.text import words

METHODS = ("xxh32", "xxh64", "xxh128", "xxh3_64", "xxh3_128", "xx_64", "xx_32")
_ALIASES = {"xx_64": "xxh64", "xx_32": "xxh32"}
NATIVE_SEED = 42


class SegmentHasher:
    """Normalises chosen segments of a row into one key and hashes it.

    ``compare`` is "all" or a list of segment numbers. Letter words are words that hold a letter; letters only drops all else.
    The key joins segments by a newline after newlines inside them are escaped, so different rows can't give one key.
    """

    def __init__(
        self,
        compare: str | Sequence[int] = "all",
        method: str | None = "xxh64",
        hashseed: int = 0,
        lowercase: bool = False,
        letters_only: bool = False,
        letter_words_only: bool = False,
        tokenize: Callable[[Column, int], Column] | None = None,
    ) -> None:
        if compare != "all" and (isinstance(compare, str) or not all(isinstance(i, int) and i >= 0 for i in compare)):
            raise ConfigurationError(f"compare has to be 'all' or a list of segment numbers: {compare}")
        self.compare = None if compare == "all" else sorted(compare)
        self.method = _ALIASES.get(method, method) if method else None
        if method and method not in METHODS:
            raise ConfigurationError(f"unknown hash {method}; known are {', '.join(METHODS)}")
        self.seed, self.lowercase, self.letters_only, self.letter_words_only = hashseed, lowercase, letters_only, letter_words_only
        self.tokenize = tokenize

    def normalised(self, segment: Column, number: int = 0) -> Column:
        if self.letter_words_only:
            segment = self.tokenize(segment, number) if self.tokenize else segment
            segment = F.array_join(F.filter(words(segment), lambda w: w.rlike(r"\p{L}")), " ")
        if self.letters_only:
            segment = F.regexp_replace(segment, r"\P{L}+", "")
        if self.lowercase:
            segment = F.lower(segment)
        return F.replace(segment, F.lit("\n"), F.lit("\\n"))

    def key(self, segments: Sequence[Column]) -> Column:
        """The string that is compared or hashed."""
        chosen = range(len(segments)) if self.compare is None else self.compare
        if any(i >= len(segments) for i in chosen):
            raise ConfigurationError(f"compare {self.compare} doesn't fit {len(segments)} segments")
        return F.concat_ws("\n", *(self.normalised(segments[i], i) for i in chosen))

    def line_key(self, lines: Sequence[Column]) -> Column:
        """The key of lines, each with the newline that ends it."""
        return self.key([F.concat(line, F.lit("\n")) for line in lines])

    def number(self, key: Column) -> Column:
        """Unsigned hash of a key as decimal(38): xxh64 of seed 42 inside the JVM, others in Arrow batches."""
        if self.method is None:
            raise ConfigurationError("a hash method is needed here")
        if self.method == "xxh64" and self.seed == NATIVE_SEED:
            return unsigned(F.xxhash64(F.encode(key, "UTF-16LE")))
        return digits(key, self.method, self.seed).cast("decimal(38,0)")


def digits(key: Column, method: str, seed: int) -> Column:
    """Decimal digits of a hash of the key's UTF-16LE bytes."""

    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        function = getattr(xxhash, f"{method}_intdigest")
        for batch in batches:
            yield pa.array([None if k is None else str(function(k.encode("utf-16-le"), seed=seed)) for k in batch.to_pylist()], pa.string())

    return F.arrow_udf(kernel, "string")(key)


def unsigned(value: Column) -> Column:
    """A signed 64-bit number read as an unsigned one."""
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide)


def below(value: Column, divisor: int, threshold: int) -> Column:
    """Whether an unsigned number's remainder lies below the threshold."""
    return (value % F.lit(divisor).cast("decimal(20,0)")) < threshold
