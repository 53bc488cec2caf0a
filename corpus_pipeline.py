"""From documents to tokens in five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of ``documents``.  Scores come from trained models, so no SQL gives the same rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm import bpe, decontaminate, pii, quality_net, shingles
from findery.llm.common import scratch, unused, written
from findery.llm.queries import quality_model

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are scored like any other.

    Texts are read whole, however long; equal texts stay or go together; no documents give none.
    """
    model = spark.sparkContext.broadcast(quality_model(spark, docs, sf_dir))
    return docs.where(quality_net.score_column(model, docs["text"]) >= quality_net.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays.

    Texts without words are copies of each other; a group without a doc_id keeps one row, and so do rows alike in doc_id and text.
    """
    return shingles.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; a document without text has none and stays."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in brackets, and n_chars follows; null texts stay null.

    Texts are searched whole, however long; every row stays, repeated ones too; no documents give none.
    """
    found, clean = unused(docs, "found", "clean")
    rows = docs.withColumn(found, pii.found_in(docs["text"], spark))
    rows = rows.withColumn(clean, pii.redacted(F.col("text"), F.concat(f"{found}.base", f"{found}.added")))
    own = {c: F.col(f"`{c}`") for c in docs.columns}
    if "n_chars" in docs.columns:
        changed = (F.size(f"{found}.base") > 0) | (F.size(f"{found}.added") > 0)
        own["n_chars"] = F.when(changed, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    own["text"] = F.col(clean).alias("text")
    return rows.select(*own.values())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them, and the ids themselves, of every row; a null text counts as empty."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-pair encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), scratch(spark, name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
