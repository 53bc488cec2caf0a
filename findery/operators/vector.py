"""Exact nearest neighbours by cosine, inner product or distance, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.functions.vectors import is_finite, is_valid
from findery.operators.keyword import top_k
from findery.sources.tables import upserted

METRICS = ("cosine", "inner_product", "l2")
#: Bytes of query vectors in one block, and query results held in a task; more queries are searched block by block.
BLOCK_BYTES, HELD_RESULTS = 32 << 20, 2 << 20
#: Scores of one product of vectors and queries in a task.
PRODUCT = 4 << 20
#: Digits of a score; scores that agree in them are ties.
DIGITS = 6


def _similarity(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows by queries; the greater the nearer.  A zero vector has no cosine (NaN)."""
    product = x @ q.T
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return product / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :])
    if metric == "l2":
        return -np.sqrt(np.maximum((x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * product, 0))
    return product


@dataclass(frozen=True)
class Profile:
    """An embedding profile: how long its vectors are and in which precision they are kept."""

    name: str
    dimension: int
    storage: str = "float"

    def __post_init__(self) -> None:
        if not self.name.strip() or self.dimension < 1 or self.storage not in ("float", "half"):
            raise ValueError("a profile needs a name, a dimension of 1 or more, and storage float or half")


# The known profiles.
PROFILES = {p.name: p for p in (Profile("kure_v1_1024", 1024), Profile("bge_m3_1024", 1024), Profile("qwen3_4b_1000", 1000), Profile("qwen3_4b_2560", 2560, "half"))}


def profile(name: str) -> Profile:
    """The known profile of that name, or an error."""
    if name.strip() not in PROFILES:
        raise ValueError(f"unknown embedding profile {name!r}; known: {', '.join(PROFILES)}")
    return PROFILES[name.strip()]


def stored_embeddings(current: DataFrame, incoming: DataFrame, own: Profile) -> DataFrame:
    """(chunk_id, embedding) after incoming vectors replaced those of their chunks; one of another length or not finite is an error when read."""
    wrong = F.raise_error(F.concat(F.lit(f"{own.name} takes {own.dimension} finite numbers; chunk "), F.col("chunk_id").cast("string")))
    checked = incoming.select("chunk_id", F.when(is_valid(F.col("embedding"), own.dimension), F.col("embedding")).otherwise(wrong.cast(incoming.schema["embedding"].dataType)).alias("embedding"))
    return upserted(current.select("chunk_id", "embedding"), checked, ["chunk_id"])


class _Best:
    """The first k of each query by (score, id), over vectors that come in any order and any batches."""

    def __init__(self, q: np.ndarray, k: int, metric: str) -> None:
        self.q, self.k, self.metric = q, k, metric
        self.scores = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, PRODUCT // max(1, len(self.q)))
        for k in range(0, len(ids), step):
            scores = np.round(_similarity(self.metric, self.q, x[k : k + step]), DIGITS).T
            scores = np.where(np.isfinite(scores), scores, -np.inf)
            new = (scores >= self.scores[:, -1:]).any(0)
            if not new.any():
                continue
            s = np.concatenate([self.scores, scores[:, new]], axis=1)
            i = np.concatenate([self.ids, np.broadcast_to(ids[k : k + step][new], (len(s), int(new.sum())))], axis=1)
            first = np.lexsort((i, -s), axis=-1)[:, : self.k]
            self.scores, self.ids = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """Ranked (query_id, chunk_id, score, distance, rank) over (query_id, embedding) and (chunk_id, embedding).

    Every task multiplies its vectors with a broadcast block of queries and passes on its own first k of
    each query, so the shuffle carries k rows a query and task, however many vectors there are.  A score is
    rounded once, to DIGITS digits, and that one value ranks within tasks and among them; ties go to the
    smaller chunk_id, so the answer does not depend on partitions.  Rows with a null id, a null vector, or
    null or infinite elements are no candidates and no queries; a vector meets queries of its own length
    only; a zero vector has no cosine and is no result.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    if not 1 <= k <= 100:
        raise ValueError("k is 1 to 100")
    spark = vectors.sparkSession
    rows = queries.where(F.col("query_id").isNotNull() & is_finite(F.col(vector))).select(F.col("query_id").cast("long"), F.col(vector).cast("array<double>").alias("v"))
    count, size = rows.agg(F.count("*"), F.sum(F.size("v")) * 8).first()
    found = None
    for b in range(blocks := max(1, -(-(size or 0) // BLOCK_BYTES), -(-count * k // HELD_RESULTS))):
        by_length: dict[int, list] = {}
        for r in rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect():
            by_length.setdefault(len(r.v), []).append(r)
        shared = spark.sparkContext.broadcast({d: (np.array([r.query_id for r in own], np.int64), np.array([r.v for r in own], np.float64)) for d, own in by_length.items()})

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: _Best(q, k, metric) for d, (_, q) in shared.value.items()}
            for batch in batches:
                lists = batch.column(1)
                lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
                starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
                ids = batch.column(0).to_numpy()
                for d, own in best.items():
                    at = np.flatnonzero(lengths == d)
                    if len(at):
                        own.add(ids[at], flat[starts[at][:, None] + np.arange(d)])
            for d, own in best.items():
                some = np.isfinite(own.scores)
                query = np.broadcast_to(shared.value[d][0][:, None], own.ids.shape)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(query[some]), "chunk_id": pa.array(own.ids[some]), "score": pa.array(own.scores[some])})

        usable = vectors.where(F.col(key).isNotNull() & is_finite(F.col(vector)))
        part = usable.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(search, "query_id long, chunk_id long, score double")
        found = part if found is None else found.union(part)
    ranked = top_k(found, k)
    return ranked.withColumn("distance", F.round((1 - F.col("score")) if metric == "cosine" else -F.col("score"), DIGITS))


def with_embeddings(chunks: DataFrame, embed, text: str = "text") -> DataFrame:
    """chunks with ``embedding`` from a model: ``embed`` takes a text column and gives an array column."""
    return chunks.withColumn("embedding", embed(F.col(text)))
