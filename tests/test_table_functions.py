import pytest
from pyspark.sql import functions as F

from findery.functions import table_functions
from findery.operators import chunking

SAMPLE = "# Guide\n\nFirst line\nsecond line.\n\n## Setup\n\n```sh\npip install x\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nlast words " + "again " * 700


def rows(df, drop=()):
    return sorted(map(str, df.drop(*drop).collect()))


@pytest.mark.parametrize("reader", ["markdown", "lines"])
def test_sql_gives_the_chunks_of_chunk_documents(spark, reader):
    table_functions.register(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, SAMPLE), (10**6 + 1, None), (10**6 + 2, "")], "doc_id long, text string"))
    docs.repartition(4).createOrReplaceTempView("own_documents")
    blocks = spark.sql(f"SELECT d.doc_id AS document_id, b.* FROM own_documents d, LATERAL text_blocks(d.text, '{reader}') b")
    assert rows(blocks) == rows(chunking.parse(docs, reader, "doc_id"))
    blocks.createOrReplaceTempView("own_blocks")
    for policy in ("heading_512_64", "heading_1000_200"):
        found = spark.sql(f"SELECT * FROM block_chunks(TABLE(SELECT * FROM own_blocks) PARTITION BY document_id ORDER BY (block_seq), '{policy}')")
        assert rows(found) == rows(chunking.chunk_documents(docs, [chunking.POLICIES[policy]], reader, "doc_id"))
    assert spark.sql("SELECT * FROM block_chunks(TABLE(SELECT * FROM own_blocks WHERE document_id < 0) PARTITION BY document_id ORDER BY (block_seq), 'heading_512_64')").count() == 0


def test_few_columns_do(spark):
    table_functions.register(spark)
    spark.range(3).select(F.lit(7).cast("long").alias("document_id"), F.col("id").alias("block_seq"), F.lit("paragraph").alias("block_type"), F.concat(F.lit("words "), F.col("id")).alias("block_text")).createOrReplaceTempView("bare_blocks")
    got = spark.sql("SELECT * FROM block_chunks(TABLE(SELECT * FROM bare_blocks) PARTITION BY document_id ORDER BY (block_seq), 'heading_512_64')").collect()
    assert [(r.document_id, r.chunk_text, r.block_seqs) for r in got] == [(7, "words 0\n\nwords 1\n\nwords 2", [0, 1, 2])]
