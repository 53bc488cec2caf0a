"""Near-duplicates by SimHash: fingerprints of word shingles, linked by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.llm.common import scratch, small_batches, space_words, unused, written
from findery.llm.components import components

BITS = 64
SEED = 42


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """The 64-bit SimHash of a text's ``size``-word shingles, repeats included; 0 if it has no word."""
    words = space_words(text.lower() if text else None)
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - size + 1].tolist()
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of some 64-bit hashes; 0 if there are none."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; bytes.lower() changes A-Z only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _masks(radius: int) -> list[int]:
    """All signed 64-bit values with at most ``radius`` bits."""
    found = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def ball(fp: Column, distance: int = 2) -> Column:
    """All values within half of ``distance`` bits of a fingerprint: two within the distance share one of them."""
    if distance not in (0, 2, 4):
        raise ValueError("distance is 0, 2 or 4 bits: balls of radius 0, 1 or 2")
    return F.transform(F.lit(_masks(distance // 2)), lambda m: fp.bitwiseXOR(m))


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) links that join all of the distinct fingerprints ``fp`` differing in at most ``distance`` (0, 2 or 4) bits.

    Two fingerprints within 2 * r bits share a value within r bits of each, so each emits its ball of
    radius r = distance // 2 (1, 65 or 2,081 values) and values are the only shuffle key.  Members of a
    value's bucket, as many as a ball has values at most, are within the distance of each other, so each is
    linked with the bucket's least one, never with all others.  Pairs are deduplicated and verified by
    their differing bits.
    """
    balls = distinct.select("fp", F.explode(ball(F.col("fp"), distance)).alias("value"))
    least = F.min("fp").over(Window.partitionBy("value"))
    pairs = balls.select("fp", least.alias("a")).where("a <> fp").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance).select("a", F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id, root): component_id is the smallest doc_id reachable by links, its own
    included; root is the smallest fingerprint there.

    Copies share a fingerprint and are joined before any link is sought, so groups of copies of any size
    cost no pairs.  Texts without words (null, empty, white space) have fingerprint 0 and are linked like
    any other.  Null doc_ids count as larger than all others: they get a component_id only from rows
    that have one.  Texts are read whole, however long.  Repeated rows stay; an empty table gives an empty
    one; other columns may have any names.
    """
    spark = docs.sparkSession
    own = written(fingerprints(docs, size), scratch(spark, "fingerprints"))
    first = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), scratch(spark, "first"))
    return grouped(own, first, links(first.select("fp"), distance))


def grouped(own: DataFrame, first: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root) of the rows ``own`` (doc_id, fp), by links (a, b) of their fingerprints.

    ``first``: (fp, least), the smallest doc_id of each fingerprint.
    """
    spark = own.sparkSession
    roots = components(linked)
    by_root = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = written(by_root, scratch(spark, "grouped"))
    ids = written(by_root.groupBy("root").agg(F.min("least").alias("component_id")), scratch(spark, "ids"))
    by_fp = written(by_root.join(ids, "root").select("fp", "component_id", "root"), scratch(spark, "by_fp"))
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """All columns of one row of each group of near-duplicates: the one with the smallest doc_id.

    Where no row of a group has a doc_id one with the smallest fingerprint stays, and of rows alike in
    doc_id and fingerprint one stays.  Rows are written once with their fingerprints, which all later steps
    read, and shuffled once, by (doc_id, fingerprint).
    """

    @F.arrow_udf("long")
    def fp_of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, size) for t in texts.to_pylist()], np.uint64).view(np.int64))

    small_batches(docs.sparkSession)
    fp = unused(docs, "fp")
    held = written(docs.withColumn(fp, fp_of(F.col("text").cast("binary"))), scratch(docs.sparkSession, "held"))
    own = held.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"))
    first = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), scratch(docs.sparkSession, "first"))
    return first_rows(held, grouped(own, first, links(first.select("fp"), distance)), F.col(fp)).drop(fp)


def first_rows(held: DataFrame, near: DataFrame, fp: Column) -> DataFrame:
    """All columns of the first row of each group in ``near``; ``fp`` gives a row's fingerprint."""
    id_, fp_, own_, n_ = unused(held, "id", "fp", "own", "n")
    first = near.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("component_id").isNotNull() | (F.col("fp") == F.col("root"))))
    counted = written(first.groupBy(F.col("doc_id").alias(id_), F.col("fp").alias(fp_)).agg(F.count("*").alias("n")), scratch(held.sparkSession, "first"))
    repeated = counted.where("n > 1").limit(1).count()

    own = held.withColumn(own_, fp)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own_) == F.col(fp_))
    # keys are hashed and texts stream by: sorting the texts of a partition would hold many of them in memory
    kept = own.join(counted.drop("n").hint("shuffle_hash"), same, "left_semi")
    if repeated:
        k = F.row_number().over(Window.partitionBy("doc_id", own_).orderBy(F.xxhash64("text")))
        kept = kept.withColumn(n_, k).where(F.col(n_) == 1).drop(n_)
    return kept.drop(own_)
