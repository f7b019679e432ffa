"""Dense features of whole texts, from bytes and words."""

from __future__ import annotations

import re

import numpy as np

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True  # lead bytes count for their letters
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MARKS = [ord(c) for c in "!?*%$#&|.,@-"]
#: letters with digits or marks inside or before them, as in w0rd, w*rd, @bout
OBFUSCATED = re.compile(rb"[A-Za-z]+[0-9@$*!+|][A-Za-z0-9@$*!+|]*[A-Za-z]")

CHAR_NAMES = ("length", "capitals", "digits", "punctuation", "spaces", *(f"mark_{chr(c)}" for c in _MARKS), "runs")


def char_features(data: bytes) -> list[float]:
    """Rates of kinds of characters per byte, and of bytes that repeat twice in a row."""
    if not data:
        return [0.0] * len(CHAR_NAMES)
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256)
    n, letters = len(raw), max(1, int(counts[_LETTER].sum()))
    runs = int(np.count_nonzero((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]))) if n > 2 else 0
    return [
        float(np.log1p(n)),
        float(counts[_UPPER].sum() / letters),
        float(counts[_DIGIT].sum() / n),
        float(counts[_PUNCT].sum() / n),
        float(counts[_SPACE].sum() / n),
        *(float(counts[c] / n) for c in _MARKS),
        runs / n,
    ]
