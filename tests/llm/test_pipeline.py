"""The pipeline's stages, one by one, against plain implementations on their own inputs."""

import random
import re
from collections import Counter

import public_tokenizers
from cases import no_docs, odd_docs
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import quality, secrets, similar
from weftline.llm.common import keep

SF = "/root/testdata/sf0.001"


def plain_components(pairs):
    from test_similar import plain

    return {i for i, _, _, c in plain(pairs) if i == c}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        given = {r.doc_id: r for r in docs.collect()}
        out = keep(stage(spark, docs, SF), "out")
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        if name == "quality classifier":
            good = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).where("kept").collect()}
            assert {r.doc_id for r in rows} == good
        elif name == "exact dedup":
            normal, least = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), {}
            for r in given.values():
                least[normal(r)] = min(r.doc_id, least.get(normal(r), r.doc_id))
            assert {r.doc_id for r in rows} == set(least.values())
        elif name == "n-gram Jaccard join":
            assert {r.doc_id for r in rows} == plain_components([(r.doc_id, r.text) for r in given.values()])
        elif name == "secret scans":
            assert {r.doc_id for r in rows} == set(given)
            for r in rows:
                spans = secrets.scan(given[r.doc_id].text or "")
                assert r.text == secrets._redact(given[r.doc_id].text, [(a, b) for _, a, b in spans], "[secret]") if spans else r.text == given[r.doc_id].text
                assert r.n_chars == len(r.text)
        else:
            from tokenizers import Tokenizer

            own, total = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
            for r in rows:
                total[r.doc_id] = total.get(r.doc_id, 0) + r.length
            assert total == {i: len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in given.items()}
        docs = out


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "ids_crc32" in out.columns


def test_odd_tables(spark):
    """Rows with null and repeated ids, null texts and copies: each stage's rows are compared with a plain version of it."""
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        given = docs.collect()
        out = keep(stage(spark, docs, SF), "out")
        rows, texts = out.collect(), Counter(r.text for r in given)
        if name == "quality classifier":
            assert not Counter(map(tuple, rows)) - Counter(map(tuple, given))
            docs = docs if not rows else out  # the model may reject them all; later stages get rows in any case
            continue
        if name == "exact dedup":
            normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            assert sorted(normal(r.text) for r in rows) == sorted({normal(t) for t in texts})
            assert not Counter(map(tuple, rows)) - Counter(map(tuple, given))
        elif name == "n-gram Jaccard join":
            from test_similar import plain

            found = plain([(n, r.text) for n, r in enumerate(given)])
            assert len(rows) == len({c for _, _, _, c in found}) and not Counter(map(tuple, rows)) - Counter(map(tuple, given))
        elif name == "secret scans":
            assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r.doc_id) for r in given)
        else:
            assert sum(r.length for r in rows if r.start == 0) > 0 and len({r.sequence_id for r in rows}) == len(rows)
        docs = out


def test_near_copies_stage_pairs_no_chance_pairs(spark, monkeypatch):
    """Stage 3 verified every pair of texts that shares one rare shingle; their number grows as the square of the input."""
    draw = random.Random(6)
    texts = [[f"w{draw.randrange(60)}" for _ in range(60)] for _ in range(300)]
    texts += [[*t[:50], f"v{i}", *t[51:]] for i, t in enumerate(texts[:20])] + [[*t[:20], *t[32:]] for t in texts[20:40]]
    pairs, seen = [(i, " ".join(t)) for i, t in enumerate(texts)], []

    def kept(df, name, *more):
        out = keep(df, name, *more)
        if name == "pairs":
            seen.append(out.count())
        return out

    monkeypatch.setattr(similar, "keep", kept)
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.unlike_documents(spark, docs, SF).collect()} == plain_components(pairs)
    assert len(seen) == 1 and seen[0] < 50


def test_empty_tables(spark):
    docs = no_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), "out")
        assert docs.count() == 0


def test_stages_keep_other_columns(spark):
    """Columns of any name stay as they are."""
    names = ("score", "kept", "spans", "sig", "key", "__sha", "__chars_before", "component_id", "group_size", "row")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, SF), "out")
        assert docs.columns[-len(names) :] == list(names), name
        assert all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in docs.collect()), name
