"""The corpus pipeline: documents through five operators of convomill.llm, each stage written before the next reads it.

Every stage reads doc_id and text (the classifier lang and source too), keeps
all columns whatever their names, and works on all rows. An empty table stays
empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from convomill.llm import decontam, jaccard, packing, pii, quality
from convomill.llm.storage import table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are judged as pages without words, repeated rows alike; without labels, or where all are alike, all stay."""
    return quality.accepted_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document of the smallest identifier stays. Null and empty texts and null identifiers belong to no group; rows that share an identifier stay or go together."""
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other parameters, go. Null and empty texts hold none; copies go alike."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to placeholders. Null texts stay null, and no row goes."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens. A null text is an end token alone; repeated rows each have their pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, seq_len=2048)


STAGES = [("quality", classify), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("pii", redact), ("packing", pack)]

#: No stage after the first can be expressed in SQL without the classifier's scores; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
