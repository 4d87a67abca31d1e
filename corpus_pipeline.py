"""A cleaning pipeline over documents: five stages, each written and read again before the next.

quality: documents that the classifier rejects go. duplicates: of each group of near copies the document with the
smallest id stays. decontamination: documents that hold enough of a benchmark go. personal data: spans are
redacted. tokens: texts are encoded, decoded again, and their ids appended.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.llm import bpe, decontaminate, near_duplicates, pii, quality
from motionlake.llm.common import holdout, shared_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more. Null and empty texts are scored like any other; repeated rows are judged each by its
    own text; without labels every score is 0.5 and all stay. An empty table stays empty."""
    model, _ = quality.train(docs, table(spark, sf_dir, "labels"), ~holdout("doc_id", 3, 1))
    return quality.keep(docs, model)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id. Rows without an id, and texts without words, are near to
    nothing and stay; of the rows of a repeated id one stays."""
    return near_duplicates.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated. Each row is judged by its own text, with or without an id; a null text holds
    nothing; an empty benchmark removes nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced. A null text stays null; where there is nothing to learn from, base
    patterns alone are redacted."""
    return pii.redact(docs, pii.train(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids; one whose ids don't decode to its text would stop the job."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, verify=True)
    return coded.withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", personal_data_stage),
    ("byte-level BPE", tokens_stage),
]

#: The trained stages have no SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written and read again. Other columns go along; an empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
