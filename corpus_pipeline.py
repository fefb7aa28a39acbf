"""A training corpus from `documents`: filter, deduplicate at three levels, pack.

Each stage takes (spark, docs, sf_dir) and returns the documents that it leaves, in the columns of documents; the last returns the
pieces of packed sequences. A null doc_id counts as greater than all others; of rows that repeat a doc_id and tie in a stage any one stays.
Texts are taken whole, however long; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curvelake.llm import shared
from curvelake.llm.exact_dedup import exact_dedup
from curvelake.llm.jaccard_join import near_dedup
from curvelake.llm.packing import pack
from curvelake.llm.quality_classifier import keep_good
from curvelake.llm.substring_dedup import drop_repeats


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labels, doesn't reject; null and empty texts have the score of its bias."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of equal texts; null and empty texts are one group."""
    return exact_dedup(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each component of near copies: five-word shingles, Jaccard of 0.8 or more. Texts without a word stay."""
    return near_dedup(docs, k=5, num=80, den=100)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that one of smaller doc_id has; emptied documents go, a null text becomes an empty one."""
    return drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; an empty text is its end token alone."""
    return pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("n-gram jaccard join", distinct_contents),
    ("substring dedup", distinct_passages),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and reread, and goes when the next one is written."""
    ws = shared.Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.write(stage(spark, docs, sf_dir), str(i))
        if i:
            ws.drop(str(i - 1))
    return docs
