"""Corpus pipeline: the stages a training corpus goes through, each one an operator of newsprism.llm.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the
documents that the next stage reads, with the columns of ``documents``; the last returns the packed
pieces. :func:`run` applies them in order, each stage's result written as parquet below
``spark.checkpoint.dir`` and read again. SQL cannot express the stages, so there is no oracle; the
tests hold every stage against a brute-force version.

Results for odd rows: a null doc_id or text passes every filter that has no reason to reject it
(the quality score of a null text is the model's intercept), has no near duplicates and no personal
data; rows repeated with one doc_id are copies of each other, and one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.llm import decontamination, ngram_join, packing, pii, quality
from newsprism.llm.common import read_table, stored
from newsprism.llm.queries import WORD_TOKENIZER, vocabulary_file


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. The model is fitted on labelled rows of the
    documents table, and every row of ``docs`` is scored where it is read."""
    source, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.keep_accepted(spark, docs, source, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by shingle similarity >= 0.75."""
    return ngram_join.keep_one(spark, docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(spark, docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        length = F.coalesce(F.length("text").cast(kind), F.col("n_chars"))
        masked = masked.withColumn("n_chars", length)
    return masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack(spark, docs, tokenizer=vocabulary_file(WORD_TOKENIZER))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", mask_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
