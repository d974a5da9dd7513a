"""A corpus pipeline: five stages over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from verdikt.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from verdikt.llm.common import table, written
from verdikt.llm.queries import tokenizer_file, toxicity_model


#: Most bytes of an Arrow batch.  Spark's 10,000 rows of texts make batches of 20 MB and more, of which an executor holds several at
#: once outside its heap, beside the Python workers' copies.
BATCH_BYTES = 2 << 20


def small_batches(stage):
    """The stage, with batches of ``BATCH_BYTES`` at most in its session from then on (its result is read later)."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go.  The model learns from the whole labelled table that may be learned from."""
    return toxicity.reject(docs, toxicity_model(spark, sf_dir, table(spark, sf_dir, "documents")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar lines one stays."""
    return line_dedup.dedup_documents(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents (shingles of five words, 80 % or more) the first stays."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, packed into windows."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end=1)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_windows),
]
STAGES = [(name, small_batches(stage)) for name, stage in STAGES]

#: Learned weights, MinHash and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
