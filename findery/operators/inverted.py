"""Approximate nearest neighbours: a coarse quantiser, inverted lists as partitions, exact scores in the lists probed.

Centroids are fitted in numpy on a bounded sample; every vector is stored in the partition of its nearest one.  How many
lists a query must probe is measured on the same sample: clustered vectors need few, vectors without clusters many.  A
search reads the partitions of the centroids next to its queries and no others, and scores what it reads exactly.  With
all lists probed the result is that of ``vector_topk``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions.vectors import is_finite
from findery.operators.keyword import top_k
from findery.operators.vector import BLOCK_BYTES, DIGITS, HELD_RESULTS, _Best

#: Vectors that the centroids are fitted on at most, the first by a hash of their id.
SAMPLE = 20_000
#: Lists at most; there are as many as the root of the number of vectors.
LISTS = 4096
#: Rounds of k-means.
ROUNDS = 12
#: The share of the ten nearest of sampled queries that the lists probed must hold, and how many queries are sampled.
RECALL, TRIED = 0.95, 400
#: The list of vectors of another length than the centroids', and of zero vectors, which have no cosine; it is always read.
REST = -1


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _placed(vector: list[float], metric: str) -> bool:
    return metric != "cosine" or any(vector)


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Of each row the ``n`` nearest centroids, nearest first; ties go to the smaller number."""
    d = (centroids * centroids).sum(1)[None, :] - 2 * (x @ centroids.T)
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by k-means from evenly spaced rows of the sample; a centroid that loses all its vectors takes the farthest one."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([nearest_lists(sample[k : k + 4096], centroids, 1)[:, 0] for k in range(0, len(sample), 4096)])
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        far = np.argsort(-((sample - centroids[own]) ** 2).sum(1), kind="stable")
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        empty = np.flatnonzero(counts == 0)
        centroids[empty] = sample[far[: len(empty)]]
    return centroids


def fitted_probes(sample: np.ndarray, centroids: np.ndarray) -> int:
    """The fewest lists whose vectors hold RECALL of the ten nearest of sampled queries, themselves left out.

    Neighbours within a sample are farther than those among all vectors, so the number is rather too large.
    """
    own = np.concatenate([nearest_lists(sample[k : k + 4096], centroids, 1)[:, 0] for k in range(0, len(sample), 4096)])
    tried = np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)
    near = (sample * sample).sum(1)[None, :] - 2 * (sample[tried] @ sample.T)
    near[np.arange(len(tried)), tried] = np.inf
    near = np.argsort(near, axis=1, kind="stable")[:, : min(10, len(sample) - 1)]
    place = np.argsort(nearest_lists(sample[tried], centroids, len(centroids)), axis=1)  # of each list in each query's order
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1 if len(needed) else 1


def build(vectors: DataFrame, path: str, metric: str = "cosine", key: str = "chunk_id", vector: str = "embedding") -> None:
    """Write ``vectors`` below ``path`` by list, and the centroids.

    Rows with a null id, a null vector or elements that are null or not finite are left out.  The centroids have the
    length of the first sampled vector; vectors of other lengths, and under cosine zero vectors, are kept in a list of their own.
    The driver gets the sample, SAMPLE vectors at most; the vectors are read twice and shuffled once, into lists.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric is cosine or l2")
    spark = vectors.sparkSession
    usable = vectors.where(F.col(key).isNotNull() & is_finite(F.col(vector))).select(F.col(key).cast("long").alias("chunk_id"), F.col(vector).cast("array<double>").alias("embedding"))
    drawn = [r.embedding for r in usable.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).collect()]
    dimension = len(drawn[0]) if drawn else 0
    fitting = [v for v in drawn if len(v) == dimension and _placed(v, metric)]
    sample = np.array(fitting, np.float64).reshape(len(fitting), dimension)
    many = min(LISTS, max(1, int(usable.count() ** 0.5)), max(1, len(np.unique(sample, axis=0))))
    centroids = fit(_unit(sample, metric), many) if len(sample) else np.zeros((0, dimension))
    probes = fitted_probes(_unit(sample, metric), centroids) if len(sample) else 1
    shared = spark.sparkContext.broadcast(centroids)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = batch.column(1).to_pylist()
            fits = np.array([len(v) == c.shape[1] and _placed(v, metric) for v in x], bool) if len(c) else np.zeros(len(x), bool)
            own = np.full(len(x), REST, np.int32)
            if fits.any():
                own[fits] = nearest_lists(_unit(np.array([v for v, f in zip(x, fits, strict=True) if f]), metric), c, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], names=["chunk_id", "embedding", "list"])

    rows = usable.mapInArrow(listed, "chunk_id long, embedding array<double>, list int")
    rows.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    head = [(k, metric, probes, c.tolist()) for k, c in enumerate(centroids)] or [(REST, metric, probes, [])]
    spark.createDataFrame(head, "list int, metric string, probes int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def _centroids(spark: SparkSession, path: str) -> tuple[str, int, np.ndarray]:
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r.list)  # LISTS rows at most
    own = [r.centroid for r in rows if r.list != REST]
    return rows[0].metric, rows[0].probes, np.array(own, np.float64).reshape(len(own), len(own[0]) if own else 0)


def search(queries: DataFrame, path: str, k: int, probes: int | str = "fitted", vector: str = "embedding") -> DataFrame:
    """Ranked (query_id, chunk_id, score, distance, rank) from the lists next to each query, as ``vector_topk`` ranks.

    ``probes`` is how many lists a query probes, "fitted" for the number measured when the index was built, or "all".

    Queries come in blocks of bounded size, with the lists that each probes; a task keeps k results of each query and
    list.  Queries of another length than the centroids meet the vectors of their own length only.
    """
    if not 1 <= k <= 100:
        raise ValueError("k is 1 to 100")
    spark = queries.sparkSession
    metric, fitted, centroids = _centroids(spark, path)
    n = min({"fitted": fitted, "all": len(centroids)}.get(probes, probes), len(centroids))
    stored = spark.read.schema("chunk_id long, embedding array<double>, list int").parquet(f"{path}/lists")
    rows = queries.where(F.col("query_id").isNotNull() & is_finite(F.col(vector))).select(F.col("query_id").cast("long"), F.col(vector).cast("array<double>").alias("v"))
    count, size = rows.agg(F.count("*"), F.sum(F.size("v")) * 8).first()
    found = None
    for b in range(blocks := max(1, -(-(size or 0) // BLOCK_BYTES), -(-count * k * (n + 1) // HELD_RESULTS))):
        by_list: dict[tuple[int, int], list] = {}
        for r in rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect():
            q = np.array(r.v)
            fits = len(centroids) and len(q) == centroids.shape[1] and _placed(r.v, metric)
            own = nearest_lists(_unit(q[None, :], metric), centroids, n)[0].tolist() if fits else []
            for x in [*own, REST]:
                by_list.setdefault((x, len(q)), []).append((r.query_id, q))
        shared = spark.sparkContext.broadcast({at: (np.array([i for i, _ in own], np.int64), np.array([q for _, q in own])) for at, own in by_list.items()})

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], _Best] = {}
            for batch in batches:
                lists, ids = np.array(batch.column(2)), np.array(batch.column(0))
                column = batch.column(1)
                lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
                starts = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
                for at, (_, q) in shared.value.items():
                    rows = np.flatnonzero((lists == at[0]) & (lengths == at[1]))
                    if len(rows):
                        own = best.setdefault(at, _Best(q, k, metric))
                        own.add(ids[rows], flat[starts[rows][:, None] + np.arange(at[1])])
            for at, own in best.items():
                some = np.isfinite(own.scores)
                query = np.broadcast_to(shared.value[at][0][:, None], own.ids.shape)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(query[some]), "chunk_id": pa.array(own.ids[some]), "score": pa.array(own.scores[some])})

        wanted = stored.where(F.col("list").isin(sorted({x for x, _ in by_list})))
        part = wanted.select("chunk_id", "embedding", "list").mapInArrow(probe, "query_id long, chunk_id long, score double")
        found = part if found is None else found.union(part)
    return top_k(found, k).withColumn("distance", F.round((1 - F.col("score")) if metric == "cosine" else -F.col("score"), DIGITS))
