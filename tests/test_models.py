"""Classifier, summaries, language models, alignment, embeddings."""

import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.corpus import ParallelCorpus
from weftline.operators import alignment, analysis, classify, embeddings, language_id, language_models
from weftline.operators import filters as f

KEYS = ["CharacterScoreFilter.0", "CharacterScoreFilter.1", "LanguageIDFilter.cld2.0", "LanguageIDFilter.cld2.1", "LanguageIDFilter.langid.0", "LanguageIDFilter.langid.1", "LongWordFilter"]
FEATURES = {k: {"clean-direction": "high", "quantiles": {"min": 0, "max": 0.1, "initial": 0.02}} for k in ("CharacterScoreFilter", "LanguageIDFilter", "LongWordFilter")}


def frame(spark, names, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "idx long, " + ", ".join(f"`{n}` double" for n in names))


def test_classifier_values(spark):
    trainer = classify.Trainer(frame(spark, KEYS, [[v] * 7 for v in range(1, 6)]), FEATURES, model_parameters={"solver": "liblinear"})
    quantiles = dict.fromkeys(KEYS, 0.26)
    model, data = trainer.train(quantiles)
    assert model.intercept == pytest.approx(0.31536332, abs=1e-6)
    assert trainer.criterion("AIC", model, data) == pytest.approx(17.25174505, abs=1e-5)
    assert trainer.criterion("BIC", model, data) == pytest.approx(-4.91048680, abs=1e-5)
    assert trainer.criterion("SSE", model, data) == pytest.approx(0.01)


def test_standard(spark):
    rows = list(zip([3, 4, 3, 6, 3, 7, 3], [0, 1, 2, 3, 4, 5, 6], [1] * 7, strict=True))
    scores = frame(spark, ["c1", "c4", "c5"], rows)
    own = classify.Standard.of(scores, {k: {"clean-direction": "high"} for k in ("c1", "c4", "c5")})
    got = own.apply(scores, "idx").orderBy("idx").collect()
    assert got[0]["c1"] == pytest.approx(-0.73646, abs=1e-5) and got[6]["c4"] == pytest.approx(1.5) and got[6]["c5"] == 0
    with pytest.raises(KeyError):
        classify.sign("UnknownFilter", {})


def test_search_and_files(spark, tmp_path):
    draw = np.random.default_rng(1)
    scores = frame(spark, ["LongWordFilter", "AlphabetRatioFilter"], np.stack([draw.normal(10, 3, 60), draw.random(60)], axis=1))
    trainer = classify.Trainer(scores, {"LongWordFilter": {"quantiles": {"min": 0.1, "max": 0.5, "initial": 0.2}}, "AlphabetRatioFilter": {"quantiles": {"min": 0.1, "max": 0.3, "initial": 0.2}}})
    model, value, quantiles, _ = trainer.find("CE", options={"step_coef": 2})
    assert value > 0 and all(0.1 <= q <= 0.5 for q in quantiles.values())
    model.save(str(tmp_path / "m"))
    again = classify.Classifier.load(str(tmp_path / "m"))
    assert [r.label for r in again.classify(scores).orderBy("idx").collect()] == [r.label for r in model.classify(scores).orderBy("idx").collect()]
    labelled = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1)], "label int, p double")
    assert classify.roc_auc(labelled) == pytest.approx(3.5 / 4)


def test_percentiles_keep_some_rows(spark):
    rows = ParallelCorpus.from_lines(spark, ["a b c", "a b", "a", "a b c d"] * 5, ["x", "x y", "x y z", "x"] * 5)
    config = analysis.percentile_config(rows, [("LengthFilter", {}), ("LengthRatioFilter", {"unit": "word"}), ("LongWordFilter", {}), ("TerminalPunctuationFilter", {})], 0.2)
    assert analysis.FilterPipeline.of(config).filter(rows).df.count() > 0
    assert [next(iter(c)) for c in analysis.default_config()][:2] == ["LengthFilter", "LengthRatioFilter"]


def test_clusters(spark):
    draw = np.random.default_rng(0)
    rows = np.concatenate([np.stack([draw.normal(1.2, 0.1, 50), draw.normal(0.9, 0.02, 50)], 1), np.stack([draw.normal(4, 0.3, 20), draw.normal(0.3, 0.05, 20)], 1)])
    own = analysis.ScoreClusters(frame(spark, ["LengthRatioFilter", "AlphabetRatioFilter"], rows))
    limits = own.thresholds()
    assert limits["LengthRatioFilter"] == pytest.approx(4, abs=0.3) and limits["AlphabetRatioFilter"] == pytest.approx(0.3, abs=0.1)
    assert own.labels().where(F.col("label") == own.noisy).count() == 20 and set(own.rejects()) == set(limits)


@pytest.mark.parametrize(
    "options,want",
    [
        ({}, "<s> <w> a b <w> c <w> </s>"),
        ({"wb": "", "mb": "^#"}, "<s> a #b c </s>"),
        ({"wb": "", "mb": "+$"}, "<s> a+ b c </s>"),
        ({"segmentation": {"type": "none"}}, "<s> <w> ab <w> c <w> </s>"),
    ],
)
def test_tokens_of_language_models(options, want):
    assert " ".join(language_models.Tokenizer(**options)("ab c")) == want


def test_arpa_scores(tmp_path):
    (tmp_path / "m.arpa").write_text("\\data\\\nngram 1=4\nngram 2=1\n\n\\1-grams:\n-1.0\t<UNK>\n-0.5\ta\t-0.3\n-0.7\tb\n-99\t<s>\t-0.2\n-0.6\t</s>\n\n\\2-grams:\n-0.1\ta b\n\n\\end\\\n")
    own = language_models.Arpa(str(tmp_path / "m.arpa"))
    assert own.log(["a"], "b") == pytest.approx(-0.1) and own.log(["b"], "a") == pytest.approx(-0.5) and own.log(["a"], "a") == pytest.approx(-0.8)


def test_language_models_prefer_their_own(spark, tmp_path):
    one, two = ["abba baab abab"] * 20 + ["aabb"], ["xyzzy zyx yyxz"] * 20 + ["xxz"]
    paths = [str(tmp_path / n) for n in ("one", "two")]
    for rows, path in zip((one, two), paths, strict=True):
        language_models.train(ParallelCorpus.from_lines(spark, rows).df, path, order=3)
    models = {n: {"filename": p} for n, p in zip(("one", "two"), paths, strict=True)}
    own = language_models.LMClassifierFilter(["one"], {k: {**v, "include_unks": True} for k, v in models.items()})
    rows = ParallelCorpus.from_lines(spark, ["abab", "xyz", ""])
    got = [r[0][0] for r in rows.df.orderBy("idx").select(own.score(rows.segments)).collect()]
    assert got[0] > 0.9 and got[1] < 0.1 and got[2] == 1.0
    difference = language_models.CrossEntropyDifferenceFilter([{**models["one"], "include_unks": True}], [{**models["two"], "include_unks": True}])
    kept = rows.where(difference.decide(rows.segments)).lines()[0]
    assert "abab" in kept and "xyz" not in kept


def test_language_identifier(spark, tmp_path):
    rows = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "de"), ("x", None)] * 3, "text string, lang string")
    language_id.train_identifier(rows, str(tmp_path / "m.json"))
    own = language_id.LangidFilter(["en"], [0.5], model=str(tmp_path / "m.json"))
    got = ParallelCorpus.from_lines(spark, ["the dog", "die Katze und", ""])
    assert [r.ok for r in got.df.orderBy("idx").select(own.decide(got.segments).alias("ok")).collect()] == [True, False, True]
    assert json.load(open(tmp_path / "m.json")).keys() == {"en", "de"}


def test_alignment_prefers_translations(spark):
    a = ["the house", "the book", "a book", "a house", "the dog", "a dog", "the cat", "a cat"] * 4 + ["the dog", "the dog", ""]
    b = ["das haus", "das buch", "ein buch", "ein haus", "der hund", "ein hund", "die katze", "ein katze"] * 4 + ["ein buch", "der hund", ""]
    own = alignment.WordAlignFilter(5, 5)
    rows = own.score_frame(ParallelCorpus.from_lines(spark, a, b)).orderBy("idx").collect()
    assert rows[32].score[0] > rows[33].score[0] and rows[34].score == [-100, -100]


def test_embeddings(spark, tmp_path):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = embeddings.nearest(rows.where("id < 5"), rows, 3, block=17).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: set(np.argsort(1 - unit[i] @ unit.T)[:3].tolist()) for i in range(5)}
    assert {i: {r.neighbour for r in got if r.id == i} for i in range(5)} == want
    embed = lambda texts, language: np.array([[len(t) + 1.0, t.count("a")] for t in texts])
    both = ParallelCorpus.from_lines(spark, ["aa", "bbbb", "a"], ["aa", "aaaa", "b"])
    own = embeddings.SentenceEmbeddingFilter(["en", "de"], 0.9, embed=embed)
    assert [r.ok for r in both.df.orderBy("idx").select(own.decide(both.segments).alias("ok")).collect()] == [True, False, False]
    embeddings.train_nearest_neighbors(both, ["en", "de"], str(tmp_path / "nn"), embed, 2)
    near = embeddings.SentenceEmbeddingFilter(["en", "de"], 0.9, nn_model=str(tmp_path / "nn"), embed=embed)
    assert near.score_frame(both).count() == 3


def test_edit_similarity():
    assert f.edit_similarity("kitten", "sitting") == pytest.approx(1 - 3 / 7) and f.edit_similarity("", "") == 1.0
    assert f.edit_similarity("ab", "cd", (1, 1, 2)) == 0.0


class FakeHeliport:
    """Answers as the library does: three-letter codes and costs."""

    def identify(self, text, ignore_confidence):
        assert not ignore_confidence
        return {"hei": "fin", "hello": "eng"}.get(text, "und")

    def identify_with_score(self, text, ignore_confidence):
        return self.identify(text, ignore_confidence), 1.5

    def identify_topk_with_score(self, text, k):
        return [("fin", 2.0), ("eng", 3.0), ("swe", 7.0)][:k]


def test_heliport_filters_compare_two_letter_codes(spark, monkeypatch):
    import types

    from weftline.operators import language_id

    fake = types.ModuleType("heliport")
    fake.Identifier = FakeHeliport
    monkeypatch.setitem(sys.modules, "heliport", fake)
    monkeypatch.setattr(language_id.importlib.util, "find_spec", lambda name: True)
    own, texts = FakeHeliport(), ["hei", "hello", "?"]
    judged = lambda kind, language, **more: [kind([language], **more).judge(own, t, language) for t in texts]
    assert judged(language_id.HeliportSimpleFilter, "fi") == [1.0, 0.0, 0.5]
    assert judged(language_id.HeliportConfidenceFilter, "fi") == [1.5, 0.0, 1.5]
    assert judged(language_id.HeliportRawScoreFilter, "en") == [3.0] * 3 and judged(language_id.HeliportRawScoreFilter, "de") == [7.0] * 3
    assert judged(language_id.HeliportRawScoreFilter, "en", topk=1) == [7.0] * 3
    p = judged(language_id.HeliportProbabilityFilter, "fi")[0]
    assert abs(p - 1 / 1.1) < 1e-12 and judged(language_id.HeliportProbabilityFilter, "sv") == [0.0] * 3
    limits = {k: (getattr(language_id, k).accept_threshold, getattr(language_id, k).reject_threshold) for k in ("LangidFilter", "Cld2Filter", "FastTextFilter", "LinguaFilter", "HeliportSimpleFilter")}
    assert set(limits.values()) == {(-1, 1)}
    assert (language_id.HeliportConfidenceFilter.accept_threshold, language_id.HeliportConfidenceFilter.reject_threshold) == (-1, 7)
    assert (language_id.HeliportRawScoreFilter.accept_threshold, language_id.HeliportRawScoreFilter.reject_threshold) == (7 + 1e-6, 0)
    assert (language_id.HeliportProbabilityFilter.accept_threshold, language_id.HeliportProbabilityFilter.reject_threshold) == (-1e-9, 1)
    assert len(language_id._CODES) > 180 and all(len(k) == 3 and len(v) == 2 for k, v in language_id._CODES.items())


def test_damped_counts():
    from weftline.plans.runner import log_count

    assert [log_count(x) for x in (1, 2, 3, 4, 8, 10, 16, 19, 31)] == [1, 2, 2, 2, 3, 3, 4, 4, 5]


def test_quantiles(spark):
    from weftline.functions.quantiles import quantiles

    draw = np.random.default_rng(3)
    values = [None if i % 11 == 0 else float(round(x, 1)) for i, x in enumerate(draw.normal(size=400))]
    rows = spark.createDataFrame([(v, float(i % 3), None) for i, v in enumerate(values)], "`a.b` double, c double, d double")
    shares = [0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = quantiles(rows, {"a.b": shares, "c": shares, "d": [0.5]})
    assert np.allclose(found["a.b"], np.quantile([v for v in values if v is not None], shares))
    assert np.allclose(found["c"], np.quantile([float(i % 3) for i in range(400)], shares)) and found["d"] == [None]
