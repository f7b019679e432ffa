"""Extra columns whose names clash with those that the operators make, and odd ids."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, exact_dedup, media, packing, quality, queries, secrets, similar, substrings, toxicity, urls

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
NAMES = (
    "key", "n", "sig", "ids", "decoded", "n_tokens", "spans", "score", "kept", "held_out", "predicted", "toxic", "start", "length", "sequence_id", "offset", "doc_tokens", "feature", "media",
    "data", "declared", "component_id", "n_similar", "n_shingles", "group_size", "keep_id", "row", "block", "h", "sha", "norm", "paths", "places", "tie", "x", "wanted", "item", "chunk", "copies", "special",
)
OPERATORS = {
    "op1": lambda d, spark: bpe.digest(d, BYTES, public_tokenizers.PATTERN),
    "op2": lambda d, spark: secrets.digest(d),
    "op3": lambda d, spark: toxicity.toxicity(d, spark.read.parquet(f"{SF}/labels.parquet")),
    "op4": lambda d, spark: packing.digest(d, WORDS).drop("sequence_id"),
    "op5": lambda d, spark: media.digest(d),
    "op6": lambda d, spark: similar.similar(d),
    "op8": lambda d, spark: exact_dedup.exact_groups(d),
    "op9": lambda d, spark: substrings.digest(d),
    "op10": lambda d, spark: quality.digest(d, spark.read.parquet(f"{SF}/labels.parquet")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_clashing_columns_change_nothing(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs
    for i, n in enumerate(NAMES):
        more = more.withColumn(n, F.lit(f"clash {i}"))
    one, two = (sorted(map(repr, OPERATORS[name](d, spark).collect())) for d in (docs, more))
    assert one == two


def test_urls_with_odd_ids(spark):
    """Null and repeated page ids, clashing columns: rows are judged one by one."""
    given = [(None, "http://a.org/x"), (1, "http://a.org/x"), (1, "http://b.com/de/x"), (1, "http://a.org/x"), (None, None), (2, "http://c.com/fr/x")]
    pages = spark.createDataFrame([(*r, "clash", "clash", 3) for r in given], "page_id long, url string, rest string, verdict string, block int")
    out = urls.judge(pages).collect()
    assert sorted((repr(r.page_id), r.host, repr(r.rule)) for r in out) == sorted(
        (repr(i), "" if u is None else u.split("/")[2], repr({"a.org": "org/", "b.com": "com/de/", "c.com": "com/fr/"}.get((u or "//").split("/")[2]))) for i, u in given
    )


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
