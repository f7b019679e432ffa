"""Merges against a plain version that counts all pairs anew, and how their time grows."""

import random
import time
from collections import Counter

from weftline.operators import subwords


def plain(counts, symbols, least):
    parts, out = {w: (*w[:-1], w[-1] + subwords.END) for w in counts}, []
    while len(out) < symbols:
        pairs = Counter()
        for w, p in parts.items():
            for pair in zip(p, p[1:], strict=False):
                pairs[pair] += counts[w]
        best = max(pairs, key=lambda p: (pairs[p], p), default=None)
        if best is None or pairs[best] < least:
            break
        out.append(best)
        parts = {w: subwords._contract(p, best) for w, p in parts.items()}
    return out


def test_merges():
    for seed in range(200):
        draw = random.Random(seed)
        words = {"".join(draw.choice("ab" if seed % 2 else "abcé\U0001f600") for _ in range(draw.randint(1, 12))): draw.randint(1, 5) for _ in range(25)}
        least = draw.randint(1, 3)
        assert subwords.learn(words, 60, least) == plain(words, 60, least)


def test_a_pair_that_grows_in_a_word_that_had_it():
    words = {"abcxabc": 3, "abc": 1, "bcab": 2}
    assert subwords.learn(words, 20, 1) == plain(words, 20, 1)


def test_many_merges_take_seconds():
    draw, began = random.Random(1), time.process_time()
    words = {"".join(draw.choice("abcdefghijklmnopqrstuvwxyzäöüß") for _ in range(draw.randint(3, 12))): draw.randint(1, 50) for _ in range(20_000)}
    assert len(subwords.learn(words, 5_000)) == 5_000 and time.process_time() - began < 60
