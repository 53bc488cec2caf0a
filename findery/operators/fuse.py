"""Fusion and reranking of ranked lists, strategies, thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findery.functions.text import words

RRF_K = 60
MAX_TOP_K = 100
#: Candidates, each with its query's text, up to which they are broadcast.
BROADCAST_CANDIDATES = 200_000


def candidate_depth(top_k: int) -> int:
    """How many candidates each source gives for a fused or reranked list."""
    return min(MAX_TOP_K, top_k * 4)


def reciprocal_rank_fusion(vector: DataFrame, keyword: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, vector_rank, keyword_rank, vector_score, keyword_score, source_count, rank).

    The score sums 1 / (rrf_k + rank) over both lists; ties go to the better vector rank, then keyword
    rank (a missing one counts as 101), then the smaller chunk_id.
    """
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    w = keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score"))
    part = lambda c: F.coalesce(1 / (F.col(c) + rrf_k), F.lit(0.0))
    fused = v.join(w, ["query_id", "chunk_id"], "full_outer").withColumns(
        {
            "score": F.round(part("vector_rank") + part("keyword_rank"), 9),
            "source_count": (F.col("vector_rank").isNotNull().cast("long") + F.col("keyword_rank").isNotNull().cast("long")),
        }
    )
    order = [F.col("score").desc(), F.coalesce("vector_rank", F.lit(MAX_TOP_K + 1)), F.coalesce("keyword_rank", F.lit(MAX_TOP_K + 1)), F.col("chunk_id")]
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k)


def lexical_rerank(candidates: DataFrame, queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, source_score, source_rank, rank): the share of query words found, and a little of the source score.

    Ties go to the better source rank, then the smaller chunk_id.  Texts are joined to candidates only.
    """
    own = F.array_distinct(words(F.col("query_text")))
    found = F.size(F.array_intersect(own, words(F.col("text")))) / F.greatest(F.lit(1), F.size(own))
    clamped = F.least(F.greatest(F.col("source_score"), F.lit(0.0)), F.lit(1.0))
    rows = candidates.select("query_id", "chunk_id", F.col("score").alias("source_score"), F.col("rank").alias("source_rank"))
    asked = queries.select("query_id", "query_text")
    many = asked.count()
    # with few queries the candidates, MAX_TOP_K a query at most, go to the texts and not the texts to them
    side = F.broadcast if many * MAX_TOP_K <= BROADCAST_CANDIDATES else (lambda df: df)
    scored = side(rows.join(side(asked), "query_id")).join(texts.select("chunk_id", "text"), "chunk_id")
    scored = scored.select("query_id", "chunk_id", "source_score", "source_rank", F.round(found + 0.001 * clamped, 9).alias("score"))
    order = [F.col("score").desc(), F.col("source_rank"), F.col("chunk_id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def rerank_candidates(results: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, candidate_key, rank, text, source_profile_name, source_score, chunk_id) of results, as a reranker gets them.

    The key is profile:chunk; a key that a query has twice is an error when the rows are read.
    """
    named = results.withColumn("candidate_key", F.concat_ws(":", "profile_name", F.col("chunk_id").cast("string")))
    times = F.count("*").over(Window.partitionBy("query_id", "candidate_key"))
    key = F.when(times > 1, F.raise_error(F.concat(F.lit("candidates must be unique: "), F.col("candidate_key"))).cast("string")).otherwise(F.col("candidate_key"))
    rows = named.withColumn("checked", key).join(texts.select("chunk_id", "text"), "chunk_id")
    return rows.select("query_id", F.col("checked").alias("candidate_key"), "rank", "text", F.col("profile_name").alias("source_profile_name"), F.col("score").alias("source_score"), "chunk_id")


def threshold_summary(results: DataFrame, threshold: float) -> DataFrame:
    """(query_id, result_count, excluded_count, max_score, mean_score): results below the threshold are left out of the scores."""
    kept = F.col("score") >= threshold
    return results.groupBy("query_id").agg(
        F.count_if(kept).alias("result_count"),
        F.count_if(~kept).alias("excluded_count"),
        F.max(F.when(kept, F.col("score"))).alias("max_score"),
        F.round(F.avg(F.when(kept, F.col("score"))), 6).alias("mean_score"),
    )


@dataclass(frozen=True)
class Strategy:
    name: str
    stages: tuple[str, ...]
    threshold: bool
    default_k: int = 10
    max_k: int = MAX_TOP_K


STRATEGIES = {
    s.name: s
    for s in (
        Strategy("vector_cosine", ("vector",), True),
        Strategy("bm25_keyword", ("keyword",), True),
        Strategy("hybrid_keyword_vector", ("vector", "keyword", "fuse"), False),
        Strategy("reranked_vector_cosine", ("vector", "rerank"), True),
        Strategy("vector_exact", ("vector",), True),
    )
}


def validate_strategy(name: str, k: int | None = None, threshold: float | None = None) -> Strategy:
    """The strategy, or an error for an unknown name, a depth out of bounds or a threshold where none applies."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(sorted(STRATEGIES))}")
    found = STRATEGIES[name]
    if k is not None and not 1 <= k <= found.max_k:
        raise ValueError(f"k is 1 to {found.max_k}")
    if threshold is not None and not found.threshold:
        raise ValueError(f"{name} takes no threshold")
    return found
