"""A corpus pipeline: quality, near duplicates, benchmark passages, personal data, tokens.

Null, empty and blank texts are rejected by the first stage.  Rows with a null
id pass every stage that their text passes.  Of a group of near copies the rows
with the least id stay, repeated rows of that id too.  Other columns pass
through unchanged, n_chars follows the text, and columns named as a result of
the last stage (n_tokens, ids, decoded_ok) are replaced by it.  An empty table
gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordwave.llm import decontaminate, jaccard_join, pii, quality, sentencepiece_trie
from wordwave.llm.common import read_table, shared_folder
from wordwave.llm.queries import SENTENCEPIECE_MODEL


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8 or more)."""
    return jaccard_join.keep_one_of_each(docs, width=5, threshold=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows."""
    masked = pii.redact(docs, pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def add_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, ids and decoded_ok to the documents."""
    with open(SENTENCEPIECE_MODEL, "rb") as f:
        model = f.read()
    # the executors still hold what the stages before have left: less cache, a tenth more time
    return sentencepiece_trie.encode_decode(docs, model, keep=tuple(docs.columns), cache_words=150_000, slice_chars=1 << 20)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal),
    ("tokens", add_tokens),
]

#: The stages hold trained models and dynamic programs; tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = f"{shared_folder(spark)}-{uuid.uuid4().hex[:6]}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
