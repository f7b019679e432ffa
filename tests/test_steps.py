"""Steps, files, hashes, variables and the runner on small inputs."""

import json
import lzma
import os

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.corpus import ParallelCorpus, numbered
from weftline.errors import ConfigurationError
from weftline.functions.hashing import SegmentHasher
from weftline.operators import preprocess, steps, subwords
from weftline.plans.config import Var, VarStr, dump, expand, load, substeps
from weftline.plans.pipeline import FilterPipeline
from weftline.plans.runner import Runner
from weftline.sources import text
from weftline.streaming.filters import filtered, first_seen


def corpus(spark, *columns):
    return ParallelCorpus.from_lines(spark, *columns)


SENTS = ([f"Sent_{i}" for i in range(6)], [f"sent_{i}" for i in range(6)])


@pytest.mark.parametrize("more,want", [({}, {1, 2, 5}), ({"hashseed": 123}, {1}), ({"compare": [0]}, {3, 4}), ({"compare": [1]}, {2, 4, 5})])
def test_split(spark, more, want):
    divisor = 2 if more.get("hashseed") is None else 2
    one, two = steps.split(corpus(spark, *SENTS), divisor, 1, SegmentHasher(**more))
    assert {int(x[-1]) for x in one.lines()[0]} | {int(x[-1]) for x in two.lines()[0]} == set(range(6))
    if "hashseed" not in more:
        assert {int(x[-1]) for x in one.lines()[0]} == want


def test_split_thirds_and_native_seed(spark):
    one, _ = steps.split(corpus(spark, *SENTS), 10, 3)
    assert {int(x[-1]) for x in one.lines()[0]} == {1, 3, 5}
    hasher, other = SegmentHasher(hashseed=42), SegmentHasher(method="xxh64", hashseed=42)
    rows = corpus(spark, ["x", "ü", "", "abc " * 50]).df
    import xxhash

    from weftline.functions.hashing import digits

    got = rows.select("s0", hasher.number(F.col("s0")).cast("string").alias("a"), digits(F.col("s0"), "xxh64", 42).alias("b")).collect()
    assert all(r.a == r.b == str(xxhash.xxh64_intdigest(r.s0.encode("utf-16-le"), seed=42)) for r in got) and other.method == "xxh64"


def test_remove_duplicates(spark):
    both = corpus(spark, list("abcdeabbf"), list("ABCDEABFC"))
    assert steps.remove_duplicates(both).lines()[0] == list("abcdebf")
    assert steps.remove_duplicates(both, SegmentHasher([0])).lines()[0] == list("abcdef")
    assert steps.remove_duplicates(both, SegmentHasher([1])).lines()[0] == list("abcdeb")
    odd = corpus(spark, ["a", "b", "c", "B", "b?", "B!"])
    assert steps.remove_duplicates(odd, SegmentHasher(letters_only=True, lowercase=True)).lines()[0] == list("abc")
    other = corpus(spark, list("bde"), list("BDE"))
    assert steps.remove_overlap(both, other).lines()[0] == list("acabf")
    row = steps.duplicate_statistics(both, other).first()
    assert (row.total, row.unique, row.once, row.most, row.overlap_total) == (9, 7, 5, 2, 4)
    with pytest.raises(ConfigurationError):
        steps.remove_duplicates(both, SegmentHasher([2]))


def test_keys_cannot_be_fooled(spark):
    pairs = corpus(spark, ["a\nb", "a"], ["c", "b\nc"])
    keys = [r[0] for r in pairs.df.select(SegmentHasher().key(pairs.segments)).collect()]
    assert len(set(keys)) == 2


def test_head_tail_slice_concatenate(spark):
    four = corpus(spark, ["3", "4", "2", "1"])
    assert steps.head(four, 2).lines() == [["3", "4"]] and steps.tail(four, 2).lines() == [["2", "1"]]
    assert steps.slice_lines(four, 1, None, 2).lines() == [["4", "1"]]
    assert steps.concatenate(four, steps.head(four, 1)).lines() == [["3", "4", "2", "1", "3"]]


def test_sort_and_values(spark):
    four = corpus(spark, ["Sentence3", "Sentence4", "Sentence2", "Sentence1"])
    plain = corpus(spark, ["0.5", "0", "2", "10"]).df.withColumnRenamed("s0", "value")
    assert [x[-1] for x in steps.sort(four, steps.values(plain)).lines()[0]] == list("4321")
    assert [x[-1] for x in steps.sort(four, steps.values(plain), reverse=True).lines()[0]] == list("1234")
    nested = corpus(spark, [json.dumps({"My": {"tgt": v, "l": [0, v]}, "n": 1}) for v in (0.5, 0, 2, 10)]).df.withColumnRenamed("s0", "value")
    for key in ("My.tgt", "My.l.1"):
        assert [x[-1] for x in steps.sort(four, steps.values(nested, key)).lines()[0]] == list("4321")
    assert [r.value for r in steps.values(nested, ["My.tgt", "n"], "", "add").orderBy("idx").collect()] == [1.5, 1, 3, 11]
    with pytest.raises(ConfigurationError):
        steps.values(nested, ["n", "n"])


def test_product(spark):
    a, b, c = corpus(spark, ["a", "e"], ["A", ""], ["ä", "e"]), corpus(spark, ["1", "2"], ["I", "2"]), corpus(spark, ["-", "-"])
    assert list(zip(*steps.product([a, b, c]).lines(), strict=True)) == [(x, y, "-") for x in "Aaä" for y in "1I"] + [("e", "2", "-")]
    assert steps.product([a, b, c], skip_empty=False, skip_duplicates=False).df.count() == 12
    assert steps.product([a, b, c], k=3, seed=1).df.count() == 4


def test_subset(spark):
    many = corpus(spark, [f"sent_{i}" for i in range(100)], [f"sent_{i}" for i in range(100)])
    one = steps.subset(many, 50, seed=3).lines()
    assert one[0] == one[1] and len(one[0]) == 50 and one[0] == sorted(one[0], key=lambda x: int(x[5:]))
    assert steps.subset(many, 50, seed=3).lines() == one
    mixed = steps.subset(many, 20, seed=3, shuffle=True).lines()
    assert sorted(mixed[0]) == sorted(mixed[1]) and mixed[0] != mixed[1]
    assert steps.subset(many, 200).lines() == many.lines()


def test_unzip_and_join(spark):
    rows = corpus(spark, ["Sentence1\tsentence1 ", "a\tb"]).df.withColumnRenamed("s0", "value")
    assert steps.unzip(rows, "\t", 2).lines() == [["Sentence1", "a"], ["sentence1", "b"]]
    with pytest.raises(Exception, match="line [12] doesn't have 3 parts"):
        steps.unzip(rows, "\t", 3).lines()
    scores = spark.createDataFrame([(0, (1.0, 2.0))], "idx long, score struct<x double, y double>")
    ranks = spark.createDataFrame([(0, 7)], "idx long, score int")
    joined = steps.join_scores([scores, ranks, ranks], [None, "misc.rank", "x"])
    assert json.loads(joined.select(F.to_json("score")).first()[0]) == {"misc": {"rank": 7}, "x": 7, "y": 2.0}


def test_numbered_is_dense(spark):
    rows = numbered(spark.range(1000).repartition(7).withColumn("k", F.col("id") * 3), ["k"])
    assert sorted((r.id, r.idx) for r in rows.collect()) == [(i, i) for i in range(1000)]


def test_files(spark, tmp_path):
    lines = ["a b  ", "", "ü x", "last"]
    for name in ("plain", "x.gz", "x.bz2", "x.xz"):
        with text.open_text(str(tmp_path / name), "w") as file:
            file.write("\n".join(lines))
        assert text.read_parallel(spark, str(tmp_path / name)).lines() == [["a b", "", "ü x", "last"]], name
    assert lzma.open(tmp_path / "x.xz").read()
    short = text.read_parallel(spark, str(tmp_path / "plain"), str(tmp_path / "x.gz"))
    text.write_parallel(short, [str(tmp_path / "out/a"), str(tmp_path / "out/b.gz")])
    assert open(tmp_path / "out/a").read() == "a b\n\nü x\nlast\n"
    own = FilterPipeline.of([{"LengthRatioFilter": {}}, {"LengthFilter": {}}])
    scores = own.score(corpus(spark, ["a", ""], ["", ""]))
    text.write_json_lines(scores, str(tmp_path / "scores.jsonl"))
    assert open(tmp_path / "scores.jsonl").read().splitlines()[0] == '{"LengthFilter":[1,0],"LengthRatioFilter":Infinity}'
    flat = steps.flatten(text.read_json_lines(spark, str(tmp_path / "scores.jsonl")))
    assert set(flat.columns) == {"idx", "LengthFilter.0", "LengthFilter.1", "LengthRatioFilter"}


def test_variables():
    given = load("common: {constants: {x: 1}}\nsteps:\n- type: head\n  parameters: {n: !var x, inputs: [!varstr 'f.{lang}']}\n  variables: {lang: [en, sv]}\n")
    assert [p["inputs"] for p in substeps(given["steps"][0], given["common"]["constants"])] == [["f.en"], ["f.sv"]]
    assert load(dump(given)) == given
    with pytest.raises(ConfigurationError):
        expand(Var("y"), {})
    with pytest.raises(ConfigurationError):
        expand(VarStr("{y}"), {})
    with pytest.raises(ConfigurationError):
        list(substeps({"variables": {"a": [1], "b": [1, 2]}}, {}))


def test_runner(spark, tmp_path, capsys):
    for lang, rows in {"a": ["one two", "x", "one two", "", "three four five"], "b": ["eins zwei", "y z", "eins zwei", "", "drei"]}.items():
        (tmp_path / f"in.{lang}").write_text("\n".join(rows) + "\n")
    names = lambda stem: [f"{stem}.a", f"{stem}.b"]
    description = {
        "common": {"output_directory": str(tmp_path)},
        "steps": [
            {"type": "remove_duplicates", "parameters": {"inputs": names("in"), "outputs": names("dd")}},
            {"type": "filter", "parameters": {"inputs": names("dd"), "outputs": names("ok"), "filters": [{"LengthFilter": {}}, {"LengthRatioFilter": {"threshold": 3}}]}},
            {"type": "score", "parameters": {"inputs": names("dd"), "output": "s.jsonl", "filters": [{"LengthFilter": {"unit": "char"}}]}},
            {"type": "sort", "parameters": {"inputs": names("dd"), "outputs": names("so"), "values": "s.jsonl", "key": "LengthFilter.1", "reverse": True}},
            {"type": "preprocess", "parameters": {"inputs": names("ok"), "outputs": names("pp"), "preprocessors": [{"RegExpSub": {"patterns": [["o", "0", 1, []]]}}, {"WhitespaceNormalizer": {}}]}},
            {"type": "write", "parameters": {"output": "w.txt", "data": "hello\n"}},
            {"type": "train_bpe", "parameters": {"input": "in.a", "model": "codes", "symbols": 5}},
            {"type": "score", "parameters": {"inputs": names("in"), "output": "t.jsonl", "filters": [{"LengthFilter": {"unit": "char"}}, {"LongWordFilter": {}}]}},
            {"type": "train_classifier", "parameters": {"training_scores": "t.jsonl", "model": "c.json", "criterion": "CE", "features": {"LengthFilter": {"quantiles": {"initial": 0.3}}}, "optimization": {"algorithm": "none"}}},
            {"type": "classify", "parameters": {"model": "c.json", "scores": "t.jsonl", "output_labels": "labels", "output_probabilities": "probs"}},
            {"type": "train_ngram", "parameters": {"data": "in.a", "model": "lm.arpa", "parameters": {"norder": 3}}},
        ],
    }
    Runner(spark, description).run()
    read = lambda n: (tmp_path / n).read_text().splitlines()
    assert read("dd.a") == ["one two", "x", "", "three four five"] and read("ok.a") == ["one two", "x"] and read("so.b")[0] == "eins zwei"
    assert read("pp.a") == ["0ne two", "x"] and read("w.txt") == ["hello"] and read("codes")[0] == "#version: 0.2"
    assert "\\3-grams:" in read("lm.arpa") and set(read("labels")) <= {"0", "1"} and len(read("probs")) == 5
    own = FilterPipeline.of([{"CrossEntropyFilter": {"lm_params": [{"filename": "lm.arpa"}]}}], str(tmp_path))
    known, odd = (r.score[0][0] for r in own.score(corpus(spark, ["one two", "qqqq zzzz"])).orderBy("idx").collect())
    assert 0 < known < 60 and odd >= 0
    (tmp_path / "config.yaml").write_text(dump(description))
    assert cli.main(["diagram", str(tmp_path / "config.yaml")]) == 0 and "digraph" in capsys.readouterr().out
    assert cli.main(["duplicates", str(tmp_path / "in.a")], spark) == 0 and cli.main(["scores", "list", str(tmp_path / "s.jsonl")], spark) == 0
    with pytest.raises(ConfigurationError):
        Runner(spark, {"common": {"output_directory": str(tmp_path)}, "steps": [{"type": "head", "parameters": {"inputs": [], "outputs": [], "n": 1, "x": 2}}]}).run()
    assert os.path.exists(tmp_path / "w.txt")


def test_preprocessors(spark):
    one = lambda own, rows: own.process(corpus(spark, rows)).lines()[0]
    assert one(preprocess.WhitespaceNormalizer(), [" a　 b\x1c", ""]) == ["a b", ""]
    assert one(preprocess.RegExpSub([[r"(\w)-(\w)", r"\1\2", 0, ["I"]]]), ["a-b-c"]) == ["ab-c"]
    assert one(preprocess.Tokenizer(), ["Hello, world. It's (1,000) etc. ok."]) == ["Hello , world. It 's ( 1,000 ) etc. ok ."]
    assert one(preprocess.MonolingualSentenceSplitter(), ["Dr. Smith came. He left! Why?", ""]) == ["Dr. Smith came.", "He left!", "Why?", ""]
    with pytest.raises(Exception, match="enabled"):
        preprocess.MonolingualSentenceSplitter().process(corpus(spark, ["a"], ["b"]))


def test_subwords(tmp_path):
    codes = subwords.learn({"low": 5, "lower": 2, "newest": 6, "widest": 3}, 10)
    assert codes[0] in {("s", "t</w>"), ("e", "s"), ("t", "</w>")} or codes[0][0] in "esw"
    (tmp_path / "codes").write_text("#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in codes))
    own = subwords.Segmenter(str(tmp_path / "codes"))
    assert own.split("newest lowest").replace("@@ ", "") == "newest lowest" and "".join(own.pieces("zebra")) == "zebra"


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.createDataFrame([("a b", "c d", 0), ("a b", "c d", 1), ("", "x", 2)], "s0 string, s1 string, t long").withColumn("at", F.timestamp_seconds("t"))
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    out = first_seen(filtered(stream, 2, FilterPipeline.of([{"LengthFilter": {}}])), 2, "at", "1 hour")
    q = out.writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 1


def test_flatten_takes_the_longest_list(spark):
    rows = spark.createDataFrame([(0, ([1.0], {"x": [[1], [2, 3]]})), (1, ([1.0, 2.0, 3.0], None)), (2, None)], "idx long, score struct<A: array<double>, B: struct<x: array<array<int>>>>")
    flat = steps.flatten(rows)
    assert flat.columns == ["idx", "A.0", "A.1", "A.2", "B.x.0.0", "B.x.1.0", "B.x.1.1"]
    assert [tuple(r) for r in flat.orderBy("idx").collect()] == [(0, 1.0, None, None, 1.0, 2.0, 3.0), (1, 1.0, 2.0, 3.0, None, None, None), (2, *[None] * 6)]
    assert steps.flatten(rows.where("idx < 0")).columns == ["idx"]


def test_head_and_tail_of_sparse_numbers(spark):
    sparse = corpus(spark, [f"l{i}" for i in range(20)]).where(F.col("idx") % 3 == 1)
    assert steps.head(sparse, 2).lines() == [["l1", "l4"]] and steps.tail(sparse, 2).lines() == [["l16", "l19"]]
    assert steps.head(sparse, 99).lines() == sparse.lines() and steps.head(sparse, 0).lines() == steps.tail(sparse, 0).lines() == [[]]


def test_concatenate_sparse_and_dense_numbers(spark):
    dense, sparse = corpus(spark, ["a", "b"]), corpus(spark, list("wxyz")).where("idx % 2 = 1")
    for parts, want in (((dense, sparse), list("abxz")), ((sparse, dense), list("xzab")), ((dense, dense, sparse), list("ababxz"))):
        whole = steps.concatenate(*parts)
        assert whole.lines() == [want]
        assert whole.df.select("idx").distinct().count() == len(want)


def test_lines_are_numbered_by_sums(spark):
    from weftline.corpus import lines_of

    texts = [(3, "c\nd"), (1, "a"), (None, None), (2, "\nb\n")]
    for rows, want in ((texts, ["", "a", "", "b", "", "c", "d"]), ([*texts, (3, "c\nd")], ["", "a", "", "b", ""])):
        found = sorted(tuple(r) for r in lines_of(spark.createDataFrame(rows, "id long, text string"), "id").collect())
        assert [i for i, _ in found] == list(range(len(found))) and [s for _, s in found][: len(want)] == want


def test_substitutions_are_the_same_in_the_jvm(spark):
    patterns = [["([a-z]+) ([0-9]+)", r"\2-\1", 0, []], ["[äÄ]", "a", 0, []], [" +", " ", 0, []], ["a|b\\.", "$x", 0, []]]
    lines_in = ["abc 12  x", "Äb. ä 9", "", "a b", "b.b a$"]
    native = [preprocess._native(*preprocess.RegExpSub._checked(p)) for p in patterns]
    assert native == [True, True, True, False]
    assert not preprocess._native("x*", "", 0, 0) and not preprocess._native("a", "b", 1, 0) and not preprocess._native(r"\d", "", 0, 0) and not preprocess._native("(?i)a", "", 0, 0)
    import re

    for some in (patterns[:3], patterns):
        want = lines_in
        for p, r, _, _ in some:
            want = [re.sub(p, r, t) for t in want]
        assert preprocess.RegExpSub(some).process(corpus(spark, lines_in)).lines() == [want]
