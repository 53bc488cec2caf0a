"""Compression of vectors to short codes: a codebook for each of four parts, fitted in whole numbers.

Components become integers and a vector is cut into equal parts.  Equal parts of a position become one row with a
weight, so a vector that very many rows share is worked on once.  Each round assigns the distinct parts to their
nearest entries and moves the entries to the weighted means; codes and errors are joined back at the end.  All
arithmetic is on whole numbers: the result depends neither on partitions nor on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.common import scratch, small_batches, written

PARTS = 4
#: Entries of a codebook: two hex digits name one.
ENTRIES = 256
ROUNDS = 4
#: A component x counts as floor(SCALE * x).
SCALE = 1024
#: Components count as at most this many steps from zero, so that errors of up to 8,192 dimensions fit in a long.
FURTHEST = 1 << 24
_BLOCK = 4096


@dataclass
class Codebooks:
    """entries[p] has the entries of part position p in its rows, as whole numbers."""

    entries: list[np.ndarray]

    def sha256(self) -> str:
        """Digest of all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()

    def decoded(self, code: str) -> list[float]:
        """The vector that a code stands for: the middle of each step."""
        at = bytes.fromhex(code)
        return [(x + 0.5) / SCALE for p, book in enumerate(self.entries) for x in book[at[p]].tolist()]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x`` the nearest entry and its squared distance, the first of equally near ones; exact.

    Doubles hold every whole number in the matrix product while they stay below 2 to the 53; larger
    components are subtracted entry by entry in longs.
    """
    code, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    x, book = x.astype(np.int64), book.astype(np.int64)
    for k in range(0, len(x), _BLOCK):
        own = x[k : k + _BLOCK]
        most = int(max(np.abs(own).max(initial=0), np.abs(book).max(initial=0)))
        if 4 * own.shape[1] * most**2 < 1 << 53:
            d = (own**2).sum(1)[:, None] - 2 * (own.astype(np.float64) @ book.T.astype(np.float64)) + (book**2).sum(1)
        else:
            d = np.stack([((own - entry) ** 2).sum(1) for entry in book], 1)
        at = d.argmin(1)
        code[k : k + _BLOCK], far[k : k + _BLOCK] = at, d[np.arange(len(own)), at].astype(np.int64)
    return code, far


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of finite vectors, their parts as 32-bit whole numbers in bytes."""
    for batch in batches:
        ids, labels, lists = batch.columns
        rows: dict[int, np.ndarray] = {}
        lengths = np.array(lists.value_lengths().fill_null(0))
        values = np.array(lists.flatten().cast(pa.float64()).fill_null(np.nan))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        for n in np.unique(lengths[(lengths > 0) & (lengths % PARTS == 0)]).tolist():
            at = np.flatnonzero(lengths == n)
            x = values[starts[at][:, None] + np.arange(n)]
            good = np.isfinite(x).all(1)
            whole = np.clip(np.floor(x[good] * SCALE), -FURTHEST, FURTHEST).astype("<i4")
            rows |= dict(zip(at[good].tolist(), whole, strict=True))
        at = sorted(rows)
        packed = [rows[k].tobytes() for k in at]
        cut = [[v[p * len(v) // PARTS : (p + 1) * len(v) // PARTS] for v in packed] for p in range(PARTS)]
        columns = [ids.take(pa.array(at, pa.int64())), labels.take(pa.array(at, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.binary()) for c in cut)], names=["vec_id", "label", *_PARTS])


_PARTS = [f"p{k}" for k in range(PARTS)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Parts of one length as rows of whole numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1)


def _assigned(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each batch (pos, part, n) and position: the rows, their parts, codes and distances."""
    for batch in batches:
        pos = np.array(batch.column(0))
        for p in np.unique(pos).tolist():
            own = batch.filter(pa.array(pos == p))
            x = _matrix(own.column(1))
            yield p, own, x, *nearest(x, books.entries[p])


def _moved(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the floor of its parts' weighted mean; an unused entry stays."""
    width = books.entries[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, ENTRIES, width + 1), np.int64)
        for p, own, x, code, _ in _assigned(batches, books):
            n = np.array(own.column(2))
            order = np.argsort(code, kind="stable")
            used, first = np.unique(code[order], return_index=True)
            weighted = np.concatenate([x.astype(np.int64) * n[:, None], n[:, None]], 1)
            total[p, used] += np.add.reduceat(weighted[order], first, 0)
        pos, code = np.nonzero(total[:, :, width])
        columns = [pa.array(pos, pa.int32()), pa.array(code, pa.int32()), *(pa.array(c) for c in total[pos, code].T)]
        yield pa.RecordBatch.from_arrays(columns, names=["pos", "code", *(f"s{k}" for k in range(width + 1))])

    columns = [f"s{k}" for k in range(width + 1)]
    partial = distinct.mapInArrow(sums, f"pos int, code int, {', '.join(f'{c} long' for c in columns)}")
    moved = [book.copy() for book in books.entries]
    for r in partial.groupBy("pos", "code").agg(*(F.sum(c).alias(c) for c in columns)).collect():  # PARTS * ENTRIES rows at most
        moved[r.pos][r.code] = [r[c] // r[columns[-1]] for c in columns[:-1]]
    return Codebooks(moved)


@dataclass
class VectorCodes:
    """rows: (vec_id, label, code string, error long) of every kept vector; books: what the codes stand for."""

    rows: DataFrame
    books: Codebooks


def compress(vectors: DataFrame) -> VectorCodes:
    """Codes of all usable rows of ``vectors`` (vec_id, embedding, label).

    Rows are dropped whose vector is null, empty, holds a null or non-finite component, can't be cut into four
    equal parts, or is of another length than that of the first kept row by vec_id.  Codebooks start as the
    parts of the ENTRIES smallest vec_ids, of fewer rows if there are no more; null ids come last and rows that
    share an id go by their parts.  Repeated rows each get their row, an empty table gives an empty one, and
    other columns may have any names.  Components beyond FURTHEST steps count as that many.

    The vectors are written once as whole numbers, the distinct parts once with their weights.  Every round
    reads the distinct parts; the driver gets PARTS * ENTRIES sums.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    label = vectors.schema["label"].dataType.simpleString()
    own = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>"))
    kept = own.mapInArrow(_whole, f"vec_id long, label {label}, {', '.join(f'{p} binary' for p in _PARTS)}").withColumn("row", F.monotonically_increasing_id())
    kept = written(kept, scratch(spark, "whole"))
    order = [F.asc_nulls_last("vec_id"), *_PARTS]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return VectorCodes(kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), Codebooks([np.zeros((0, 0), np.int64)] * PARTS))
    kept = kept.where(F.length(_PARTS[0]) == len(first[0][_PARTS[0]]))
    seeds = kept.orderBy(*order).limit(ENTRIES).select(*_PARTS).collect()
    books = Codebooks([np.stack([np.frombuffer(r[p], "<i4") for r in seeds]).astype(np.int64) for p in _PARTS])

    each = kept.select("row", "vec_id", "label", F.posexplode(F.array(*_PARTS)).alias("pos", "part"))
    distinct = written(each.groupBy("pos", "part").agg(F.count("*").alias("n")), scratch(spark, "parts"))
    for _ in range(ROUNDS):
        books = _moved(distinct, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, _, code, far in _assigned(batches, books):
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(code), pa.array(far)], names=["pos", "part", "code", "error"])

    codes = distinct.mapInArrow(coded, "pos int, part binary, code long, error long")
    whole = F.sum(F.col("code") * F.element_at(F.array(*(F.lit(256**k) for k in range(PARTS))), -1 - F.col("pos")))
    joined = each.join(codes, ["pos", "part"]).groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), whole.alias("code"), F.sum("error").alias("error"))
    rows = joined.select("vec_id", "label", F.lower(F.lpad(F.hex("code"), 2 * PARTS, "0")).alias("code"), "error")
    return VectorCodes(rows, books)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` of ``compress`` with label_error: the error summed over equal labels, nulls together.

    Sums are made in the tasks before they are shuffled, so a label of a third of the rows is no burden.
    """
    rows = written(rows, scratch(rows.sparkSession, "codes"))
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
