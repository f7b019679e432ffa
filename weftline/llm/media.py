"""Media columns: signature sniffing with structural validation, carving, and a lossless store of bytes as 8-bit samples.

An Aho-Corasick automaton finds all magic bytes of a blob, and the marks that end some formats, in one pass; a format's
validator then walks its structure and lengths from there. What fails the walk is no media. A file that starts the blob
decides its type, whatever was declared; valid files further inside are carved. Validators find marks by bisection and
remember what a walk from a place came to, so that many false magic bytes don't make them go over a blob again and again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_of

UNIT, RATE = 64, 8000
#: Types that the query declares for its stored form, by the text.
DECLARED = ("audio/wav", "application/octet-stream", "text/plain", "image/bmp")


class Blob:
    """Bytes, the places of all marks in them, and what walks from a place came to."""

    def __init__(self, data: bytes) -> None:
        self.data, self.marks, self.ends = data, defaultdict(list), {}
        for last, mark in _automaton().iter(data.decode("latin-1")):
            self.marks[mark].append(last - len(mark) + 1)
        self._zips: dict[int, int] | None = None
        self._zeros: np.ndarray | None = None

    def zero(self, at: int) -> int:
        """The first zero byte from ``at`` on; the end where there is none."""
        if self._zeros is None:
            self._zeros = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 0)
        i = int(np.searchsorted(self._zeros, at))
        return int(self._zeros[i]) if i < len(self._zeros) else len(self.data)

    def next(self, mark: bytes, at: int) -> int:
        """The first place of a mark from ``at`` on; past the end where there is none."""
        places = self.marks[mark]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else len(self.data)

    def last(self, mark: bytes, at: int, end: int) -> int:
        """The last place of a mark from ``at`` on and before ``end``, or -1."""
        places = self.marks[mark]
        i = bisect_left(places, end) - 1
        return places[i] if i >= 0 and places[i] >= at else -1

    def walk(self, kind: str, i: int, step: Callable[[bytes, int], tuple[int | None, bool]]) -> int | None:
        """Where the chain of parts from ``i`` on ends. ``step`` gives a part's end, or None, and whether it is the last."""
        seen, end = [], None
        while True:
            if (kind, i) in self.ends:
                end = self.ends[kind, i]
                break
            seen.append(i)
            found, done = step(self.data, i)
            if found is None or done:
                end = found
                break
            i = found
        self.ends.update({(kind, x): end for x in seen})
        return end

    def zips(self) -> dict[int, int]:
        """Start and end of each archive, as the end records tell; the longest of one start."""
        if self._zips is None:
            self._zips = {}
            for end in self.marks[b"PK\5\6"]:
                if end + 22 <= len(self.data):
                    size, offset, note = struct.unpack_from("<IIH", self.data, end + 12)
                    start = end - size - offset
                    if start >= 0 and self.data[start + offset : start + offset + 4] == b"PK\1\2" and end + 22 + note <= len(self.data):
                        self._zips[start] = end + 22 + note
        return self._zips


def _png_part(d: bytes, i: int) -> tuple[int | None, bool]:
    if i + 12 > len(d):
        return None, True
    n, kind = struct.unpack_from(">I4s", d, i)
    end = i + 12 + n
    if end > len(d) or kind == b"IHDR" or zlib.crc32(memoryview(d)[i + 4 : i + 8 + n]) != struct.unpack_from(">I", d, i + 8 + n)[0]:
        return None, True
    return end, kind == b"IEND"


def _png(b: Blob, at: int) -> int | None:
    d, i = b.data, at + 8
    if i + 25 > len(d) or d[i : i + 8] != b"\0\0\0\rIHDR" or zlib.crc32(d[i + 4 : i + 21]) != struct.unpack_from(">I", d, i + 21)[0]:
        return None
    return b.walk("png", i + 25, _png_part)


def _jpeg(b: Blob, at: int) -> int | None:
    def part(d: bytes, i: int) -> tuple[int | None, bool]:
        if i + 4 > len(d) or d[i] != 0xFF:
            return None, True
        kind, n = d[i + 1], struct.unpack_from(">H", d, i + 2)[0]
        if kind in (0x00, 0xFF, 0xD8, 0xD9) or n < 2 or i + 2 + n > len(d):
            return None, True
        i += 2 + n
        if kind != 0xDA:
            return i, False
        end = b.next(b"\xff\xd9", i)
        return (end + 2 if end < len(d) else None), True

    return b.walk("jpeg", at + 2, part)


def _gif_part(d: bytes, i: int) -> tuple[int | None, bool]:
    if i >= len(d):
        return None, True
    if d[i] == 0x3B:
        return i + 1, True
    if d[i] == 0x21:
        i += 2
    elif d[i] == 0x2C and i + 10 < len(d):
        i += 11 + (3 << ((d[i + 9] & 7) + 1) if d[i + 9] & 0x80 else 0)
    else:
        return None, True
    while i < len(d) and d[i]:
        i += 1 + d[i]
    return (i + 1 if i < len(d) else None), False


def _gif(b: Blob, at: int) -> int | None:
    d = b.data
    if at + 13 > len(d):
        return None
    i = at + 13 + (3 << ((d[at + 10] & 7) + 1) if d[at + 10] & 0x80 else 0)
    return b.walk("gif", i, _gif_part) if d[i : i + 1] != b"\x3b" else None


def _riff(form: bytes) -> Callable[[Blob, int], int | None]:
    def walk(b: Blob, at: int) -> int | None:
        d = b.data
        if at + 12 > len(d) or d[at + 8 : at + 12] != form:
            return None
        end, i, parts = at + 8 + struct.unpack_from("<I", d, at + 4)[0], at + 12, 0
        if end > len(d):
            return None
        while i + 8 <= end:
            i, parts = i + 8 + (n := struct.unpack_from("<I", d, i + 4)[0]) + n % 2, parts + 1
        return end if i == end and parts else None

    return walk


def _bmp(b: Blob, at: int) -> int | None:
    d = b.data
    if at + 30 > len(d):
        return None
    size, zero, data, head = struct.unpack_from("<IIII", d, at + 2)
    fits = 26 <= data <= size and at + size <= len(d) and zero == 0
    return at + size if fits and head in (12, 40, 52, 56, 108, 124) and 14 + head <= data else None


def _pdf(b: Blob, at: int) -> int | None:
    """From the header to the last end mark before another header, as updates add end marks."""
    if b.data[at + 5 : at + 7] not in (b"1.", b"2."):
        return None
    end = b.last(b"%%EOF", at, b.next(b"%PDF-", at + 1))
    return end + 5 if end >= 0 and b.next(b"startxref", at) < end else None


def _zip(b: Blob, at: int) -> int | None:
    return b.zips().get(at)


def _gzip(b: Blob, at: int) -> int | None:
    d, flags, i = b.data, b.data[at + 3] if at + 18 <= len(b.data) else 0xFF, at + 10
    if flags & 0xE0:
        return None
    if flags & 4:
        i += 2 + int.from_bytes(d[i : i + 2], "little")
    for flag in (8, 16):  # name, comment
        if flags & flag:
            i = b.zero(i) + 1
    i += flags & 2
    more, sum32, size = zlib.decompressobj(-15), 0, 0
    try:
        while not more.eof:
            part = more.unconsumed_tail or d[i : i + (1 << 14)]
            i += 0 if more.unconsumed_tail else len(part)
            if not part:
                return None
            found = more.decompress(part, 1 << 20)
            sum32, size = zlib.crc32(found, sum32), size + len(found)
    except zlib.error:
        return None
    i -= len(more.unused_data)
    return i + 8 if d[i : i + 8] == struct.pack("<II", sum32, size & 0xFFFFFFFF) else None


def _ogg_part(d: bytes, i: int) -> tuple[int | None, bool]:
    if d[i : i + 4] != b"OggS" or i + 27 > len(d):
        return i, True
    end = i + 27 + d[i + 26] + sum(d[i + 27 : i + 27 + d[i + 26]])
    return (end, False) if end <= len(d) else (None, True)


def _ogg(b: Blob, at: int) -> int | None:
    end = b.walk("ogg", at, _ogg_part)
    return end if end is not None and end > at else None


def _table(poly: int, bits: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1) ^ (poly if x >> (bits - 1) & 1 else 0)
        out.append(x & ((1 << bits) - 1))
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _flac_frame(d: bytes, i: int) -> tuple[int, int] | None:
    """(samples of the frame whose header is at ``i``, bytes of the header), if the header's check sum fits."""
    if i + 6 > len(d) or d[i] != 0xFF or d[i + 1] & 0xFC != 0xF8 or d[i + 3] & 1 or d[i + 2] & 15 == 15 or not d[i + 2] >> 4:
        return None
    lead, at = d[i + 4], i + 5
    at += max(0, f"{lead:08b}".index("0") - 1) if lead < 0xFF else 7
    size, rate = d[i + 2] >> 4, d[i + 2] & 15
    known = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
    samples = known.get(size) or int.from_bytes(d[at : at + size - 5], "big") + 1
    at += {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    sum8 = 0
    for x in d[i:at]:
        sum8 = _CRC8[sum8 ^ x]
    return (samples, at + 1 - i) if at < len(d) and sum8 == d[at] else None


def _flac(b: Blob, at: int) -> int | None:
    """Metadata, then frames from header to header; the last, known by the number of samples, ends where its sum fits."""
    d, i, last, total = b.data, at + 4, False, 0
    while not last:
        if i + 4 > len(d):
            return None
        last, kind, n = bool(d[i] & 0x80), d[i] & 0x7F, int.from_bytes(d[i + 1 : i + 4], "big")
        if (i == at + 4) != (kind == 0) or (kind == 0 and n != 34):
            return None
        if kind == 0:
            total = int.from_bytes(d[i + 17 : i + 22], "big") & ((1 << 36) - 1)
        i += 4 + n
    done, frame = 0, _flac_frame(d, i)
    while frame is not None:
        done, sum16 = done + frame[0], 0
        for j in range(i, len(d)):
            sum16 = ((sum16 << 8) & 0xFFFF) ^ _CRC16[(sum16 >> 8) ^ d[j]]
            if sum16 or j < i + frame[1] + 1:
                continue
            after = _flac_frame(d, j + 1)
            if after is not None and (not total or done < total):
                i, frame = j + 1, after
                break
            if done >= total:
                return j + 1
        else:
            return None
    return None


def _mp4_part(d: bytes, i: int) -> tuple[int | None, bool]:
    n, kind = struct.unpack_from(">I4s", d, i) if i + 8 <= len(d) else (0, b"")
    return (i, True) if n < 8 or i + n > len(d) or not kind.isalnum() else (i + n, False)


def _mp4(b: Blob, at: int) -> int | None:
    if at < 4 or at + 4 > len(b.data):
        return None
    first = at - 4 + struct.unpack_from(">I", b.data, at - 4)[0]
    if first < at + 4 or first > len(b.data):
        return None
    end = b.walk("mp4", first, _mp4_part)
    return end if end is not None and end > first else None


#: magic bytes -> (type, bytes of the file before the magic, validator: (blob, at) -> end or None)
FORMATS: dict[bytes, list[tuple[str, int, Callable[[Blob, int], int | None]]]] = {
    b"\x89PNG\r\n\x1a\n": [("image/png", 0, _png)],
    b"\xff\xd8\xff": [("image/jpeg", 0, _jpeg)],
    b"GIF87a": [("image/gif", 0, _gif)],
    b"GIF89a": [("image/gif", 0, _gif)],
    b"RIFF": [("audio/wav", 0, _riff(b"WAVE")), ("image/webp", 0, _riff(b"WEBP")), ("video/avi", 0, _riff(b"AVI "))],
    b"BM": [("image/bmp", 0, _bmp)],
    b"%PDF-": [("application/pdf", 0, _pdf)],
    b"PK\3\4": [("application/zip", 0, _zip)],
    b"\x1f\x8b\x08": [("application/gzip", 0, _gzip)],
    b"OggS": [("audio/ogg", 0, _ogg)],
    b"fLaC": [("audio/flac", 0, _flac)],
    b"ftyp": [("video/mp4", 4, _mp4)],
}
#: Marks that validators look for, those that a format can't do without, and formats whose every part starts with the magic.
MARKS, PARTED = (b"%%EOF", b"startxref", b"PK\5\6", b"\xff\xd9"), ("audio/ogg",)
NEEDED = {b"%PDF-": b"%%EOF", b"PK\3\4": b"PK\5\6", b"\xff\xd8\xff": b"\xff\xd9"}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in (*FORMATS, *MARKS):
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def locate(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of each valid file in ``data`` by start; files inside others are listed too."""
    out: list[tuple[str, int, int]] = []
    blob = Blob(data)
    for magic, formats in FORMATS.items():
        if NEEDED.get(magic, magic) not in blob.marks:
            continue
        for kind, before, validate in formats:
            beyond = 0
            for at in blob.marks.get(magic, ()):
                if at >= beyond and (end := validate(blob, at)) is not None:
                    out.append((kind, at - before, end))
                    beyond = end if kind in PARTED else 0
    return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


def sniff(data: bytes | None) -> tuple[str, list[tuple[str, int, int]]]:
    """The type of a blob (application/octet-stream where no format fits at its start) and the files carved from inside."""
    found = locate(data or b"")
    whole = next((x for x in found if x[1] == 0), None)
    return (whole[0] if whole else "application/octet-stream"), [x for x in found if x is not whole]


def to_wav(payload: bytes) -> bytes:
    """A mono 8-bit WAV file whose samples are the payload's bytes."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def from_wav(data: bytes) -> bytes:
    """The samples of an 8-bit WAV file, found by walking its chunks."""
    i, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    while i + 8 <= end:
        kind, n = struct.unpack_from("<4sI", data, i)
        if kind == b"data":
            return data[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    raise ValueError("no data chunk")


def payload_of(text: bytes) -> bytes:
    """The text's bytes with zeros up to a positive multiple of ``UNIT``."""
    return text + b"\0" * (-len(text) % UNIT or (0 if text else UNIT))


def inspect(rows: DataFrame, data_col: str = "data", declared_col: str = "declared") -> DataFrame:
    """``rows`` with ``media``: struct<type, corrected, carved array<struct<type, start, length>>> of a binary column.

    ``corrected`` says that the declared type differs from the found one; a null declaration counts as differing. Null
    and empty blobs are application/octet-stream. Other columns stay; one named ``media`` is replaced.
    """
    kind = "struct<type:string,carved:array<struct<type:string,start:bigint,length:bigint>>>"
    arrow = pa.struct([("type", pa.string()), ("carved", pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))])

    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for blobs in batches:
            found = [sniff(x.as_py()) for x in blobs]
            yield pa.array([{"type": t, "carved": [{"type": k, "start": a, "length": b - a} for k, a, b in c]} for t, c in found], arrow)

    out = rows.withColumn("media", F.arrow_udf(kernel, kind)(F.col(data_col)))
    differs = ~F.col("media.type").eqNullSafe(F.col(declared_col))
    return out.withColumn("media", F.struct("media.type", differs.alias("corrected"), "media.carved"))


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``data`` (a WAV file of the text's payload) and ``declared``; null texts count as empty."""

    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([to_wav(payload_of(x.as_py())) for x in texts.cast(pa.large_binary())], pa.binary())

    return docs.withColumn("data", F.arrow_udf(kernel, "binary")(text_of(text_col))).withColumn("declared", F.lit("audio/wav"))


def feature(payload: bytes, kind: str, carved: list[tuple[str, int, int]]) -> str:
    """Type, carved files, mean, root mean square about the middle and crossings of the middle of 8-bit samples."""
    samples = np.frombuffer(payload, np.uint8)
    centred = samples.astype(np.int16) - 128
    crossings = int(np.count_nonzero(np.diff(centred >= 0)))
    parts = "|".join(f"{k}@{a}+{b - a}" for k, a, b in carved)
    rms = float(np.sqrt(np.mean(centred.astype(np.float64) ** 2)))
    return f"{kind};carved={parts};mean={samples.mean():.6f};rms={rms:.6f};crossings={crossings}"


def digest(docs: DataFrame) -> DataFrame:
    """Per document the sizes and hashes of its payload and stored form, read back, the feature, the type declared for the
    stored form, the found one and whether that corrects it. What is declared depends on the text alone and is often wrong.
    Null texts count as empty; ids may be null or repeat; other columns are ignored; an empty table gives an empty result."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, type string, corrected boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.bool_()]

    def row(text: bytes) -> tuple:
        stored = to_wav(payload_of(text))
        kind, carved = sniff(stored)
        back = from_wav(stored)
        tail, declared = zlib.crc32(back[-UNIT:]), DECLARED[zlib.crc32(text) % len(DECLARED)]
        about = feature(back, kind, carved), declared, kind, kind != declared
        return len(text), len(back), hashlib.sha256(back).hexdigest(), tail, len(stored), hashlib.sha256(stored).hexdigest(), *about

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(x.as_py()) for x in batch["text"].cast(pa.large_binary())]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(kernel, schema)
