"""Golomb-Rice coded sets of fingerprints, exchanged between blocks of rows and owners of hash ranges.

A block sends to each owner the sorted fingerprints that fall in that owner's range, as coded gaps: about
``bits - log2(set size) + 1.5`` bits each. The owner answers with bitmaps in the same order. The unary quotients and
the remainders are two streams, so numpy can code and decode them without a loop over the items.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 19


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    shifts = np.arange(width, dtype=np.uint64)
    parts = []
    for i in range(0, len(values), CHUNK):  # CHUNK is a multiple of 8: chunks end on whole bytes
        bits = (values[i : i + CHUNK, None] >> shifts) & np.uint64(1)
        parts.append(np.packbits(bits.astype(np.uint8).ravel()).tobytes())
    return b"".join(parts)


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if not width:
        return out
    raw = np.frombuffer(data, np.uint8)
    for i in range(0, n, CHUNK):
        m = min(CHUNK, n - i)
        bits = np.unpackbits(raw[i * width // 8 :][: (m * width + 7) // 8])[: m * width].reshape(m, width)
        for j in range(width):
            out[i : i + m] |= bits[:, j].astype(np.uint64) << np.uint64(j)
    return out


def encode(values: np.ndarray, base: int) -> tuple[int, bytes, bytes]:
    """Remainder width, unary stream and remainder stream of ascending distinct ``values``, all at least ``base``."""
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=np.uint64(base))
    width = max(0, int(float(gaps.mean()) * 0.7).bit_length() - 1)
    ends = np.cumsum((gaps >> np.uint64(width)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    return width, np.packbits(unary).tobytes(), _pack(gaps & np.uint64((1 << width) - 1), width)


def decode(n: int, base: int, width: int, unary: bytes, rest: bytes) -> np.ndarray:
    """Inverse of ``encode``."""
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    gaps = (quotients << np.uint64(width)) | _unpack(rest, n, width)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)


def bounds(owners: int, bits: int) -> np.ndarray:
    """First fingerprint of each owner."""
    return np.array([(o << bits) // owners for o in range(owners)], np.uint64)


def split(values: np.ndarray, owners: int, bits: int) -> list[tuple[int, int, int]]:
    """(owner, from, to) of each non-empty part of ascending ``values``."""
    cuts = np.searchsorted(values, bounds(owners, bits))
    ends = np.append(cuts[1:], len(values))
    return [(o, int(a), int(b)) for o, (a, b) in enumerate(zip(cuts, ends, strict=True)) if b > a]


def bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))[:n].astype(bool)
