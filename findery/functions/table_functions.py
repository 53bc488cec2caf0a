"""Table functions for SQL: documents to blocks, and blocks to chunks in order within each document.

After ``register(spark)``:

    SELECT d.doc_id, b.* FROM documents d, LATERAL text_blocks(d.text, 'lines') b
    SELECT c.* FROM block_chunks(TABLE(SELECT ... FROM blocks) PARTITION BY document_id ORDER BY (block_seq), 'heading_512_64') c
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from findery.operators.chunking import BLOCK_FIELDS, CHUNK_SCHEMA, POLICIES, READERS, chunk_rows

_BLOCK = [f.split()[0] for f in BLOCK_FIELDS.split(", ")]
_CHUNK = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]


@udtf(returnType=BLOCK_FIELDS)
class TextBlocks:
    """text_blocks(text, reader): the blocks of a text, none of a null one."""

    def eval(self, text: str | None, reader: str) -> Iterator[tuple]:
        for b in READERS[reader](text) if text is not None else []:
            yield tuple(b[c] for c in _BLOCK)


@udtf(returnType=CHUNK_SCHEMA)
class BlockChunks:
    """block_chunks(TABLE(...) PARTITION BY document_id ORDER BY (block_seq), policy): the chunks of each document.

    The table has document_id and the columns of a block, any of which may be missing but type, text and seq; a
    document's blocks are held in memory, as overlap makes each cut depend on the one before.
    """

    def __init__(self) -> None:
        self.document, self.policy, self.blocks = None, None, []

    def eval(self, row: Row, policy: str) -> None:
        own = row.asDict()
        self.document, self.policy = own["document_id"], policy
        self.blocks.append({c: own.get(c) for c in _BLOCK} | {"heading_path": own.get("heading_path") or []})

    def terminate(self) -> Iterator[tuple]:
        if self.blocks and self.document is not None:
            for chunk in chunk_rows(self.document, self.blocks, POLICIES[self.policy]):
                yield tuple(chunk[c] for c in _CHUNK)


def register(spark: SparkSession) -> None:
    """Make both functions known to the session's SQL."""
    spark.udtf.register("text_blocks", TextBlocks)
    spark.udtf.register("block_chunks", BlockChunks)
