"""Repetitions against the pattern's own search, on texts full of them."""

import random
import re

import pytest

from weftline.operators import filters as f


def plain(own, text):
    match = re.search(own.pattern, text)
    return (len(match[0]) - len(match[0].replace(match[1], ""))) // len(match[1]) - 1 if match else 0


@pytest.mark.parametrize("options", [{}, {"threshold": 1}, {"threshold": 3.5, "min_length": 1}, {"min_length": 2, "max_length": 7}, {"threshold": 4, "min_length": 5, "max_length": 12}])
def test_random_texts(options):
    own = f.RepetitionFilter(**options)
    for seed in range(400):
        draw = random.Random(seed)
        pick = lambda n, draw=draw: "".join(draw.choice(draw.choice(["ab  ", "abc ", "é\U0001f600a\t", "a\xa0b "])) for _ in range(n))
        texts = []
        for _ in range(12):
            part = pick(draw.randint(1, 120 if draw.random() < 0.3 else 12))
            texts.append(pick(draw.randint(0, 15)) + "".join(part + " " * draw.choice([0, 0, 1, 2]) for _ in range(draw.randint(1, 5))) + pick(draw.randint(0, 15)))
        assert f.repetitions(texts, re.compile(own.pattern), int(own.threshold), own.longest) == [plain(own, t) for t in texts]


def test_few_places_are_looked_at():
    draw = random.Random(1)
    texts = [" ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 9))) for _ in range(5_000))] + ["same line"] * 50
    found = f.repeated(texts, 2, 101)
    assert sum(b - a for ranges in found.values() for a, b in ranges) < len(texts[0]) / 10


def test_nulls(spark):
    own = f.RepetitionFilter()
    rows = spark.createDataFrame([(0, None), (1, "ab ab"), (2, "x abcabc abc abc y")], "idx long, s0 string")
    assert [r[0] for r in rows.orderBy("idx").select(own.score([rows.s0])).collect()] == [None, 0, 3]
