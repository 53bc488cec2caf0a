"""Ingestion in batches: files to blocks to chunks under several policies, to the keyword index and embeddings.

Every table below a path is partitioned by batch.  A batch writes its own partitions and no others, so
earlier batches stay, and a batch that is run again replaces itself.  Where a document comes in several
batches, the last one that could read it counts: ``current`` gives the rows that do.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findery.functions.vectors import stand_in_embeddings
from findery.operators.chunking import CHUNK_SCHEMA, POLICIES, Policy, block_rows, chunk_frame, chunk_rows
from findery.operators.keyword import chunk_lengths, index_statistics, postings
from findery.sources.files import extract

TABLES = ("documents", "blocks", "chunks", "embeddings", "postings", "lengths")


def _put(df: DataFrame, path: str, table: str, batch: str, *by: str) -> DataFrame:
    own = df.withColumn("batch", F.lit(batch))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(f"{path}/{table}")
    return df.sparkSession.read.schema(own.schema).parquet(f"{path}/{table}").where(F.col("batch") == batch)


def _chunks(blocks: DataFrame, policies: list[Policy]) -> DataFrame:
    """Chunks under all policies, each document's blocks gathered once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = block_rows(pdf)
        return chunk_frame([r for p in policies for r in chunk_rows(int(pdf.document_id.iloc[0]), held, p)])

    made = blocks.groupBy("document_id").applyInPandas(run, CHUNK_SCHEMA)
    return made.withColumn("chunk_id", F.xxhash64("document_id", "policy", "chunk_seq"))


def ingest(files: DataFrame, path: str, batch: str, profile: str = "stand_in", dimension: int = 64, policies: list[Policy] | None = None) -> DataFrame:
    """Write a batch of (document_id, path, file_ext, content) below ``path``; its documents with status and counts.

    (document_id, path, extraction_status, error, block_count, chunk_count, batch): a file that cannot be
    read is a row with its error and stops nothing.  Each stage reads what the one before wrote.
    """
    ids = files.select("path", "document_id")
    blocks = _put(extract(files).join(ids, "path"), path, "blocks", batch)
    chunks = _put(_chunks(blocks.where("extraction_status = 'succeeded'"), policies or list(POLICIES.values())), path, "chunks", batch, "policy")
    embedded = chunks.select("document_id", "chunk_id", F.lit(profile).alias("profile"), stand_in_embeddings(F.col("chunk_text"), profile, dimension).alias("embedding"))
    _put(embedded, path, "embeddings", batch, "profile")
    with_document = chunks.select("chunk_id", "document_id")
    _put(postings(chunks, "chunk_text", policy=F.col("policy")).join(with_document, "chunk_id"), path, "postings", batch, "policy")
    _put(chunk_lengths(chunks, "chunk_text", policy=F.col("policy")).join(with_document, "chunk_id"), path, "lengths", batch, "policy")
    states = blocks.groupBy("document_id", "path").agg(F.first("extraction_status").alias("extraction_status"), F.first("error").alias("error"), F.count("block_seq").alias("block_count"))
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    rows = states.join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    return _put(rows, path, "documents", batch)


def current(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of a table that count: of each document those of its last batch that could read it."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}; known: {', '.join(TABLES)}")
    documents = spark.read.parquet(f"{path}/documents")
    last = Window.partitionBy("document_id").orderBy((F.col("extraction_status") == "failed").asc(), F.col("batch").desc())
    latest = documents.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")
    if table == "documents":
        return latest
    rows = spark.read.parquet(f"{path}/{table}")
    return rows.join(latest.select("document_id", "batch"), ["document_id", "batch"], "left_semi")


def refreshed_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Write and read the statistics of the keyword index over all current postings."""
    found = index_statistics(current(spark, path, "postings"), current(spark, path, "lengths"))
    found.write.mode("overwrite").partitionBy("policy").parquet(f"{path}/statistics")
    return spark.read.parquet(f"{path}/statistics")


def pending_embeddings(spark: SparkSession, path: str, profiles: DataFrame) -> DataFrame:
    """(chunk_id, profile) of current chunks that a profile of ``profiles`` has no vector of: the jobs to queue."""
    wanted = current(spark, path, "chunks").select("chunk_id").distinct().crossJoin(F.broadcast(profiles.select("profile")))  # a handful of profiles
    return wanted.join(current(spark, path, "embeddings").select("chunk_id", "profile"), ["chunk_id", "profile"], "left_anti")
