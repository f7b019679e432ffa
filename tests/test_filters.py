"""Filters on literal segments: scores and decisions."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.corpus import ParallelCorpus
from weftline.errors import ConfigurationError
from weftline.operators import filters as f
from weftline.plans.pipeline import FilterPipeline, make


def judged(spark, own, rows):
    rows = [r if isinstance(r, (tuple, list)) else (r,) for r in rows]
    corpus = ParallelCorpus.from_lines(spark, *zip(*rows, strict=True))
    found = corpus.df.select("idx", own.score(corpus.segments).alias("x")).select("idx", "x", own.accept(F.col("x")).alias("ok"))
    return [(r.x, r.ok) for r in found.orderBy("idx").collect()]


CASES = [
    (f.LengthFilter(2, 3), ["a", "a dog", "a dog went out"], [([1], False), ([2], True), ([4], False)]),
    (f.LengthFilter([2, 8], [4, 15], ["word", "char"]), [("table", "pyödällä"), ("kitchen table", "keittiöpöydällä")], [([1, 8], False), ([2, 15], True)]),
    (f.LengthFilter(3, 9, pass_empty=True), [("", ""), ("", "a b c")], [([0, 0], True), ([0, 3], False)]),
    (f.LengthFilter(), ["天　地", "a\x1cb c", ""], [([2], True), ([3], True), ([0], False)]),
    (f.LengthRatioFilter(2), [("", ""), ("", "x"), ("a b", "c"), ("a b c", "c d e")], [(0.0, True), (math.inf, False), (2.0, False), (1.0, True)]),
    (f.LongWordFilter(4), ["", "abc de", "abcde f"], [([0], True), ([3], True), ([5], False)]),
    (f.AverageWordLengthFilter(2, 3), ["", "ab abcd", "abcd abcd"], [([0.0], False), ([3.0], True), ([4.0], False)]),
    (f.RegExpFilter(["[0-9]", "a^"]), [("aaa", "b"), ("hi123!", "b")], [([False, False], True), ([True, False], False)]),
    (f.RegExpFilter("^[ a-z]*$", accept_match=True), ["aaa", "123", ""], [([True], True), ([False], False), ([True], True)]),
    (f.RegExpFilter(r"\bx(?=y)"), ["a xy", "axy"], [([True], False), ([False], True)]),
    (f.AlphabetRatioFilter(0.5), ["", "ab12", "a123"], [([1.0], True), ([0.5], True), ([0.25], False)]),
    (f.AlphabetRatioFilter(1, exclude_whitespace=True), ["a b", "a 1"], [([1.0], True), ([0.5], False)]),
    (f.CharacterScoreFilter(["Latin", "Cyrillic"], [1, 0.5]), [("abc1", "фыв"), ("abф", "a"), ("12", "")], [([1.0, 1.0], True), ([pytest.approx(2 / 3), 0.0], False), ([1.0, 1.0], True)]),
    (f.TerminalPunctuationFilter(), [("a.", "b."), ("a", "b..."), ("a...", "b???!!!!!!")], [(0.0, True), (pytest.approx(-math.log(6)), True), (pytest.approx(-math.log(17)), False)]),
    (f.NonZeroNumeralsFilter(), [("a 12", "b 21 0"), ("", ""), ("1", "")], [([0.5], True), ([1.0], True), ([0.0], False)]),
    (f.LongestCommonSubstringFilter(0.8), [("abcd", "abcd"), ("abcd", "cdgh"), ("", ""), ("abcd ", " abcd")], [([1.0], False), ([0.5], True), ([0.0], True), ([0.8], False)]),
    (f.LongestCommonSubstringFilter(0.75, require_all=False), [("abcd", "abcd", "efgh")], [([1.0, 0.0, 0.0], True)]),
    (f.SimilarityFilter(0.7), [("abcd", "ABCD"), ("big hat.", "pig cat."), ("", "")], [([0.0], True), ([0.75], False), ([1.0], False)]),
    (f.SimilarityFilter(0.7, unit="word", lowercase=True), [("big hat.", "Big Hat."), ("big hat.", "hat big.")], [([1.0], False), ([0.0], True)]),
    (f.RepetitionFilter(2, 3, 50), [("abc abc", "abcd"), ("abc abc abc", "b"), ("abc", "bcde bcde bcde bcde")], [(1 * 0, True), (2, False), (3, False)]),
    (f.RepetitionFilter(1, 3, 50), ["aaaa aaaa bbbb aaaa aaaa bbbb", "abc", "abc abcabc"], [(1, False), (0, True), (2, False)]),
    (f.RepetitionFilter(math.inf), ["abc abc abc"], [(0, True)]),
    (f.HtmlTagFilter(), [("aa <br> bee", "c"), ("<p>a</p>", "<b"), ("a br> <1", "")], [([True, False], False), ([True, False], False), ([False, False], True)]),
]


@pytest.mark.parametrize("own,rows,want", CASES, ids=[f"{type(c[0]).__name__}-{i}" for i, c in enumerate(CASES)])
def test_scores_and_decisions(spark, own, rows, want):
    assert judged(spark, own, rows) == want


def test_long_repetition_does_not_overflow(spark):
    assert judged(spark, f.RepetitionFilter(), ["abc " * 20_000])[0][1] is False


def test_wrong_arguments():
    for wrong in (
        lambda: f.LengthFilter([1, 2], [3]),
        lambda: f.LengthFilter(unit="page"),
        lambda: f.LengthFilter("1"),
        lambda: f.RegExpFilter(),
        lambda: f.CharacterScoreFilter(["Latin"], [1, 1]),
        lambda: f.RepetitionFilter(0.5),
        lambda: f.RepetitionFilter(min_length=0),
        lambda: make("NoSuchFilter"),
        lambda: make("LangidFilter", {"languages": ["en"]}),
        lambda: make("CrossEntropyFilter"),
    ):
        with pytest.raises(ConfigurationError):
            wrong()


def test_names_of_scores():
    own = FilterPipeline.of([{"LengthFilter": {}}, {"LengthFilter": {"unit": "char"}}, {"LongWordFilter": {}}, {"LengthRatioFilter": {"name": "words"}}])
    assert own.paths() == [("LengthFilter", "1"), ("LengthFilter", "2"), ("LongWordFilter",), ("LengthRatioFilter", "words")]
    with pytest.raises(ConfigurationError):
        FilterPipeline.of([{"LengthFilter": {"name": "x"}}, {"LengthFilter": {"name": "x"}}]).paths()


def test_filter_and_filterfalse_part_the_rows(spark):
    corpus = ParallelCorpus.from_lines(spark, ["a b", "", "a" * 50, "x. y. z.", "<p>"], ["a b", "", "b", "x", "p"])
    own = FilterPipeline.of([{"LengthFilter": {}}, {"LongWordFilter": {}}, {"HtmlTagFilter": {}}, {"LengthRatioFilter": {}}])
    kept, lost = own.filter(corpus).lines(), own.filterfalse(corpus).lines()
    assert kept[0] == ["a b"] and sorted(kept[0] + lost[0]) == sorted(corpus.lines()[0])
    scored = own.score(corpus, decide=True).orderBy("idx").collect()
    assert [all(x.accept for x in r.score) for r in scored] == [True, False, False, False, False]
    assert {r["filter"]: r.removed for r in own.removed(corpus).collect()}["HtmlTagFilter"] == 1
