"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces of binary lengths, the largest first: as many of the window as fit, then one piece
for each bit of the rest. Every piece is a sequence of its own, so no sequence crosses documents and none needs padding;
sequences of equal length form a bucket, which the low four bits of ``sequence_id`` name.

A tokenizer works on what white space separates, so a worker encodes each distinct chunk once and joins the kept ids. Chunks
of letters before punctuation, most of a text, are split there, as this kind of tokenizer does itself; their words go to it
many at a time. Texts are cut in numpy, and Arrow numbers their distinct parts and joins the ids, so Python sees each distinct
part of a slice once. The bounded dictionaries change the speed only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import release, text_of

KEPT, SLICE, BATCH = 1_000_000, 1 << 20, 500

#: Lower-case words of ASCII and Latin-1 letters: none changes under NFC.
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Classes of bytes: white space, those of the letters above, ASCII punctuation, all else (such as first bytes of other characters).
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c")] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK
#: Bytes of a word in lower case: second bytes of Latin-1 letters differ by 32 too.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(65, 91), *range(0x80, 0x97), *range(0x98, 0x9F)]] += 32
#: What a tokenizer must be for chunks to be split: its words are runs of letters, and tokens mark a word's end.
_LETTERS, _END = "[\\p{L}]+", "</w>"


def cuts(data: np.ndarray, offsets: np.ndarray, simple: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of texts begin: chunks and the white space between them; and the texts.

    Where ``simple``, punctuation after a word is a part too, and words are in lower case. ``offsets`` are the texts' own,
    from 0 to the length of ``data``; each is a cut.
    """
    kind = _CLASS[data]
    sign = np.flatnonzero((data == 0x97) | (data == 0xB7))  # multiplication and division signs lie among the letters
    kind[sign[data[sign - 1] == 0xC3]] = _OTHER
    begins = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    texts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[texts] = True
    at = np.flatnonzero(begins)
    of = kind[at]
    opens = of == _SPACE  # runs that open a chunk or the white space after one
    opens[1:] |= of[:-1] == _SPACE
    opens[np.searchsorted(at, texts)] = True
    if simple:
        mark = np.zeros(len(at), bool)
        mark[1:] = (of[1:] == _MARK) & ~opens[1:] & (of[:-1] == _LETTER) & opens[:-1]
        mark[:-1] &= opens[1:]
        opens |= mark
        word = (of == _LETTER) & opens
        word[:-1] &= opens[1:]
        data = np.where(np.repeat(word, np.diff(at, append=len(data))), _LOWER[data], data)
    return at[opens], data


class Chunks:
    """Ids of chunks, as little-endian unsigned 32-bit integers, by a tokenizer file."""

    def __init__(self, path: str, simple: bool, ends: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.simple, self.ends = Tokenizer.from_file(path), simple, np.frombuffer(ends, bool)
        self.kept: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _alone(self, parts: list[bytes]) -> None:
        for i in range(0, len(parts), BATCH):
            part = parts[i : i + BATCH]
            found = self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)
            self.kept.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(part, found, strict=True))

    def _together(self, words: list[bytes]) -> None:
        for i in range(0, len(words), BATCH):
            part = words[i : i + BATCH]
            found = self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)
            ids = np.array(found[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(part):
                data, upto = ids.tobytes(), [0, *(4 * last).tolist()]
                self.kept.update((w, data[a:b]) for w, a, b in zip(part, upto, upto[1:], strict=False))
            else:
                self._alone(part)

    def _learn(self, new: list[bytes]) -> None:
        words, other = [], []
        for p in new:
            if p.isspace():
                self.kept[p] = b""
            else:
                (words if self.simple and (p.isalpha() or _WORD.fullmatch(p)) else other).append(p)
        self._together(words)
        self._alone(other)

    def _ids(self, parts: list[bytes], most: int) -> list[bytes]:
        if len(self.kept) > most // 2:  # what is met from now on stays, the rest goes the next time
            self.kept, self.before = {}, self.kept
        found = list(map(self.kept.get, parts))
        lost = [i for i, x in enumerate(found) if x is None]
        if self.before:
            again = {p: self.before[p] for i in lost if (p := parts[i]) in self.before}
            self.kept.update(again)
            self._learn([p for i in lost if (p := parts[i]) not in again])
        else:
            self._learn([parts[i] for i in lost])
        for i in lost:
            found[i] = self.kept[parts[i]]
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray, most: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many come before each text and at the end.

        Only ASCII white space separates: what else counts as such stays inside its chunk, and the tokenizer sees it.
        """
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        at, data = cuts(data, offsets, self.simple)
        bounds = pa.py_buffer(np.append(at, len(data)))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self._ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist(), most), pa.large_binary()).take(parts.indices)
        upto = np.frombuffer(ids.buffers()[1], np.int64)[: len(at) + 1] // 4
        joined = np.frombuffer(ids.buffers()[2], "<u4", upto[-1]) if upto[-1] else np.zeros(0, "<u4")
        return joined, upto[np.searchsorted(at, offsets)]


def rules_of(path: str) -> tuple[bool, bytes]:
    """Whether a tokenizer's chunks can be split, and for each id whether its token ends a word. Read once, in the driver."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    rules = json.loads(own.to_str())
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    simple = bool(
        steps
        and _LETTERS in str(steps[0].get("pattern", {}).get("Regex", "")).split("|")
        and rules["model"].get("end_of_word_suffix") == _END
        and any(n.get("type") == "Lowercase" for n in (rules.get("normalizer") or {}).get("normalizers", []))
        and not rules.get("post_processor")
    )
    vocabulary = own.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith(_END)]] = True
    return simple, ends.tobytes()


@lru_cache(maxsize=2)
def chunks(path: str, simple: bool, ends: bytes) -> Chunks:
    return Chunks(path, simple, ends)


def lengths(n: int, window: int) -> list[int]:
    """Piece lengths of a document of ``n`` tokens; ``window`` is a power of two."""
    rest = n % window
    return [window] * (n // window) + [1 << b for b in range(window.bit_length() - 2, -1, -1) if rest >> b & 1]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows whose texts have about ``SLICE`` bytes together."""
    texts = batch["text"].cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = min(len(texts), int(np.searchsorted(offsets, offsets[first] + SLICE)))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", most: int = KEPT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null texts count as empty, and every document ends with ``end_id``, so an empty one is a single piece of length 1.
    Rows are independent: repeated rows are packed once each, ids may be null, other columns are ignored; an empty table
    gives an empty result. ``most`` bounds the parts that a worker keeps between slices, which changes speed and memory only.
    """
    if window & (window - 1) or not 1 <= window <= 1 << 15:
        raise ValueError("window must be a power of two up to 32768")
    simple, ends = rules_of(path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunks(path, simple, ends)
        for batch in batches:
            for first, text, at in _slices(batch):
                ids, upto = own.encode(text, at, most)
                ids = np.insert(ids, upto[1:], end_id)
                tokens = np.diff(upto) + 1
                pieces = [lengths(n, window) for n in tokens.tolist()]
                per_doc = np.array([len(p) for p in pieces])
                length = np.array([n for p in pieces for n in p], np.int64)
                after = np.cumsum(length)
                starts = after - length - np.repeat(np.cumsum(tokens) - tokens, per_doc)
                offsets = pa.py_buffer(np.append(0, after * 4))
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, offsets, pa.py_buffer(ids)])
                who = batch["doc_id"].slice(first, len(tokens)).take(pa.array(np.repeat(np.arange(len(tokens)), per_doc)))
                columns = [who, pa.array(starts), pa.array(length), data.cast(pa.binary()), pa.array(np.repeat(tokens, per_doc))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = rows.mapInArrow(kernel, "doc_id long, start long, length long, ids binary, doc_tokens long")
    bucket = F.round(F.log2("length")).cast("long")
    return pieces.select(
        "*",
        # unique without a shuffle: partition and row number, then the bucket
        (F.shiftleft(F.monotonically_increasing_id(), 4) + bucket).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def digest(docs: DataFrame, path: str, most: int = KEPT) -> DataFrame:
    """The pieces with a checksum in place of their ids; null texts, ids, other columns and empty tables as with ``pack``."""
    return pack(docs, path, most=most).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
