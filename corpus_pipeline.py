"""A training-data pipeline over ``documents``: quality, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. ``run`` writes each result as Parquet
in the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, packing, quality, secrets, similar
from weftline.llm.common import discard, fresh, keep, read, spread


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; null texts count as empty, rows are judged one by one."""
    return quality.good(docs, read(spark, sf_dir, "labels"))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of the smallest id, nulls last; null texts count as empty."""
    return exact_dedup.drop_copies(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents, and all without words; null and repeated ids are allowed."""
    return similar.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mask; n_chars follows the text. Null texts and n_chars stay null."""
    before = fresh(docs, "__chars_before")
    masked = secrets.redact(docs.withColumn(before, F.length("text")))
    moved = F.coalesce(F.length("text") - F.col(before), F.lit(0))
    return masked.withColumn("n_chars", (F.col("n_chars") + moved).cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by power-of-two lengths; a null or empty text is one piece."""
    return packing.digest(spread(spark, docs), public_tokenizers.path("word_bpe_49k.json"), KEPT)


#: Chunks that a worker keeps while it packs: workers have done other stages before, and hold some memory already.
KEPT = 200_000

STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", first_copies),
    ("n-gram Jaccard join", unlike_documents),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: SQL can't express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = last = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"stage_{number}")
        if number:
            discard(last)
        last = docs
    return docs
