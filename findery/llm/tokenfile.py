"""Token files: ids of many documents in as few bits as the vocabulary needs, with random access.

A file is ``FTOK`` + one byte (bits an id), then blocks of BLOCK_IDS ids, least significant bit first,
each padded to whole bytes, then the index: doc ids (8 bytes each), null flags (1 byte), ids a document
(8 bytes), block offsets (8 bytes, one more than blocks), and last 3 counts of 8 bytes: documents,
blocks, offset of the index.  Numbers are little-endian.  Any block can be read and unpacked alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm.bpe import codec
from findery.llm.common import small_batches, written

MAGIC = b"FTOK"
BLOCK_IDS = 1 << 16


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, each in ``bits`` bits; whole bytes an id need no shifting."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1, axis=None, bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The inverse of pack()."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def bits_for(vocabulary: int) -> int:
    """The least number of bits that holds every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


class TokenFileWriter:
    """Appends documents; holds one block and the index in memory."""

    def __init__(self, out, bits: int) -> None:
        self._out, self._bits, self._at = out, bits, out.write(MAGIC + bytes([bits]))
        self._rest: list[np.ndarray] = []
        self._held = 0
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self._offsets = [self._at]

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(len(ids))
        self._rest.append(ids)
        self._held += len(ids)
        if self._held >= BLOCK_IDS:
            flat = np.concatenate(self._rest)
            for k in range(0, len(flat) - BLOCK_IDS + 1, BLOCK_IDS):
                self._block(flat[k : k + BLOCK_IDS])
            self._rest = [flat[len(flat) // BLOCK_IDS * BLOCK_IDS :]]
            self._held = len(self._rest[0])

    def _block(self, ids: np.ndarray) -> None:
        self._at += self._out.write(pack(ids, self._bits))
        self._offsets.append(self._at)

    def close(self) -> None:
        if self._held:
            self._block(np.concatenate(self._rest))
        n = len(self.keys)
        self._out.write(np.array([k or 0 for k in self.keys], "<i8").tobytes())
        self._out.write(np.array([k is None for k in self.keys], np.uint8).tobytes())
        self._out.write(np.array(self.counts, "<i8").tobytes())
        self._out.write(np.array(self._offsets, "<i8").tobytes())
        self._out.write(np.array([n, len(self._offsets) - 1, self._at], "<i8").tobytes())
        self._out.close()


class TokenFile:
    """Reads a file: documents in turn, one block at a time, or any document alone."""

    def __init__(self, source) -> None:
        self._in = source
        size = source.size()
        n, blocks, at = np.frombuffer(source.read_at(24, size - 24), "<i8").tolist()
        index = source.read_at(size - 24 - at, at)
        self.bits = source.read_at(5, 0)[4]
        keys, null = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n)
        self.keys: list[int | None] = [None if x else k for k, x in zip(keys.tolist(), null.tolist(), strict=True)]
        self.counts = np.frombuffer(index, "<i8", n, 9 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self._offsets = np.frombuffer(index, "<i8", blocks + 1, 17 * n).tolist()

    def block(self, k: int) -> np.ndarray:
        a, b = self._offsets[k : k + 2]
        return unpack(self._in.read_at(b - a, a), min(BLOCK_IDS, int(self.starts[-1]) - k * BLOCK_IDS), self.bits)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, from its own blocks only."""
        a, b = int(self.starts[k]), int(self.starts[k + 1])
        parts = [self.block(x) for x in range(a // BLOCK_IDS, -(-b // BLOCK_IDS))] if b > a else [np.empty(0, "<u4")]
        return np.concatenate(parts)[a % BLOCK_IDS : a % BLOCK_IDS + b - a]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, start, ids) of each document in turn."""
        held, base, following = np.empty(0, "<u4"), 0, 0
        for k, (a, b) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)):
            if b > base + len(held):
                parts, base = [held[a - base :]], a
                while following * BLOCK_IDS < b:
                    parts.append(self.block(following))
                    following += 1
                held = np.concatenate(parts)
            yield self.keys[k], a, held[a - base : b - base]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


#: Where null doc_ids stand: before all others.
NULL_KEY = -(1 << 63)


def _range_bounds(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(parts, upper bounds of all but the last): ranges of doc_ids with about the same number of rows.

    A doc_id with many rows is the bound of several parts, and its rows are dealt out to them.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit((k + 1) / parts) for k in range(parts - 1)])
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY))
    found = docs.agg(F.percentile_approx(key, shares, 20 * parts).alias("q")).first().q if parts > 1 else None
    bounds = np.array(found or [], np.int64)
    return len(bounds) + 1, bounds


def _parts_of(keys: np.ndarray, bounds: np.ndarray, at: int) -> np.ndarray:
    """The part of each key; ``at`` rows of the task came before, by whose number a key with several parts takes turns."""
    first, beyond = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    return (first + (at + np.arange(len(keys))) % np.maximum(beyond - first, 1)).astype(np.int32)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all documents' ids, each with ``end_id`` after it, to files below ``out`` in ascending doc_id order.

    Returns the manifest (file, part, n_docs, n_ids), a row for each file.  A null text counts as
    empty (its end id alone is written), null doc_ids come first, rows with one doc_id follow each other in
    no stated order; an empty table gives an empty manifest; other columns may have any names.  Texts are
    read whole.  Ranges of doc_ids come from quantiles of the
    ids alone, so each text is read and encoded once and its ids are shuffled once; every attempt of a
    task writes a file of its own name and only the manifest's files count.
    """
    spark = docs.sparkSession
    bits = bits_for(max(codec(tokenizer, 2, False).table.size, end_id + 1))
    tail = np.array([end_id], "<u4")
    width = 2 if bits <= 16 else 4

    parts, bounds = _range_bounds(docs)
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, at = codec(tokenizer, width, False, 600_000), 0
        for batch in batches:
            keys = batch.column(0)
            part = _parts_of(keys.fill_null(NULL_KEY).to_numpy(), bounds, at)
            at += len(part)
            ids = pa.array(c.encode_batch(batch.column(1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part), keys, ids], names=["part", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(out)
        task, writer, total = TaskContext.get(), None, 0
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        for batch in batches:
            for key, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    writer = TokenFileWriter(files.open_output_stream(f"{root}/{name}"), bits)
                writer.add(key, np.concatenate([np.frombuffer(ids, f"<u{width}").astype("<u4"), tail]))
        if writer is not None:
            writer.close()
            total = sum(writer.counts)
            yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([task.partitionId()], pa.int64()), "n_docs": pa.array([len(writer.keys)], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    encoded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "part int, doc_id long, ids binary")
    ordered = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    return written(ordered.mapInArrow(write, "file string, part long, n_docs long, n_ids long"), f"{out}/manifest")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, a task for each file.

    Only the manifest, a row for each file, comes to the driver, to add up where each file starts.
    """
    manifest = spark.read.schema("file string, part long, n_docs long, n_ids long").parquet(f"{out}/manifest")
    rows, at = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        rows.append((r.file, at))
        at += r.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(out)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{root}/{name}") as source:
                    found = [(key, base + start, len(ids), zlib.crc32(np.ascontiguousarray(ids))) for key, start, ids in TokenFile(source).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*found, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
