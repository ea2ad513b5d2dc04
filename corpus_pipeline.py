"""A corpus cleaning pipeline made of the operators of corpusmill.llm.

Each stage takes all documents that the stage before kept and returns documents: quality
rejects go, one document of each group of near duplicates stays (five-word shingles,
similarity 0.8), contaminated documents go, personal data is replaced by its kind, and the
rest is encoded.  Stages are written as Parquet between each other, in the shared folder.
Each stage begins by giving back what the driver has freed since the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import DOCUMENT_COLUMNS, discard, release_driver, stored, table
from corpusmill.llm.op1_decontaminate import decontaminate
from corpusmill.llm.op2_bpe import bpe_round_trip
from corpusmill.llm.op3_jaccard import one_of_each
from corpusmill.llm.op9_quality import fit_quality, keep_quality
from corpusmill.llm.op10_pii import fit_pii, redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of all documents."""
    release_driver(spark)
    model = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return keep_quality(docs.select(*DOCUMENT_COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_driver(spark)
    return one_of_each(docs.select(*DOCUMENT_COLUMNS))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_driver(spark)
    return decontaminate(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; n_chars follows the text."""
    release_driver(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    clean = redact(docs, fit_pii(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    release_driver(spark)
    return bpe_round_trip(docs, ["doc_id", "lang", "source", "n_chars"], with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", contamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encoding),
]
#: Trained models and hashed shingles are beyond SQL: tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "stage")
            discard(before)  # the table of the stage before, but not the input
    return docs
