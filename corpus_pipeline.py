"""From raw documents to token ids: the stages of the text pipeline, each on all that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``, extra ones included, whatever their names. An empty table passes through every stage. Rows with a null text are kept by the
filters (they can't be judged) and have null ids of pieces in the end; rows with a null id are judged by their text. Of rows that share an
id, or a text without an id, one stays. Very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellframe.llm import decontaminate, minhash, secrets, sentencepieces, toxicity
from cellframe.llm._text import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id, and one row of each document."""
    return minhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_ids, exact``."""
    return sentencepieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the classifier, MinHash or the alignment; a test holds run() against independent brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written once, as Parquet under the checkpoint folder, and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
