"""Search comparison: several strategies over one set of queries, as one table."""

from __future__ import annotations

import time
from functools import cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.operators import fuse
from findery.operators.keyword import bm25_topk
from findery.operators.vector import vector_topk

COLUMNS = ["query_id", "profile_name", "rank", "chunk_id", "strategy", "score", "source_score", "reranker_score", "vector_score", "keyword_score", "source_count"]

RESULTS = "query_id long, profile_name string, rank long, chunk_id long, strategy string, score double, source_score double, reranker_score double, vector_score double, keyword_score double, source_count long"


def _shaped(df: DataFrame, profile: str, strategy: str) -> DataFrame:
    """All result columns in one order; those a strategy lacks are null."""
    have = df.withColumns({"profile_name": F.lit(profile), "strategy": F.lit(strategy)})
    kinds = {"source_count": "long"}
    return have.select(*[F.col(c) if c in have.columns else F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in COLUMNS])


def compare(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int, strategies: list[str] | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Results of every strategy for every query (query_id, query_text, embedding).

    Strategies are checked before anything is planned, so that an unknown one fails alone and early.
    ``candidates`` (chunk_id) restricts results, not the corpus statistics.
    """
    chosen = [fuse.validate_strategy(s, k).name for s in strategies or ["vector_cosine", "bm25_keyword", "hybrid_keyword_vector", "reranked_vector_cosine"]]
    depth = fuse.candidate_depth(k)
    if candidates is not None:
        vectors = vectors.join(candidates, "chunk_id", "left_semi")
    vector = cache(lambda: vector_topk(queries.select("query_id", "embedding"), vectors, depth))
    keyword = cache(lambda: bm25_topk(queries, chunks, depth, candidates=candidates))
    plans = {
        "vector_cosine": lambda: _shaped(vector().where(F.col("rank") <= k), "vector_cosine", "vector"),
        "vector_exact": lambda: _shaped(vector().where(F.col("rank") <= k), "vector_exact", "vector"),
        "bm25_keyword": lambda: _shaped(keyword().where(F.col("rank") <= k), "bm25_keyword", "bm25"),
        "hybrid_keyword_vector": lambda: _shaped(fuse.reciprocal_rank_fusion(vector(), keyword(), k), "hybrid_keyword_vector", "hybrid"),
        "reranked_vector_cosine": lambda: _shaped(fuse.lexical_rerank(vector(), queries, chunks, k), "reranked_vector_cosine", "reranked"),
    }
    return reduce(DataFrame.unionByName, [plans[s]() for s in chosen])


def vector_profile(chosen: str | None, profiles: list[str], known: list[str]) -> str:
    """The vector profile behind a hybrid or reranked search: the one asked for, else the first vector profile compared, else the first known."""
    own = chosen or next((p for p in profiles if p in known), known[0] if known else None)
    if own not in known:
        raise ValueError(f"no ready vector profile {own!r}; known: {', '.join(known) or 'none'}")
    return own


def run_compare(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int, profiles: list[str], out: str, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, profiles): each profile searched and written below ``out`` on its own, so that one that fails leaves the others whole.

    profiles: (profile_name, status, error, elapsed_ms, result_count), a row for each in the order asked for.
    """
    spark, rows = queries.sparkSession, []
    for name in profiles:
        started = time.monotonic()
        try:
            found = compare(queries, chunks, vectors, k, [name], candidates)
            found.write.mode("overwrite").parquet(f"{out}/results/profile={name}")
            rows.append((name, "succeeded", None, int(1000 * (time.monotonic() - started)), spark.read.parquet(f"{out}/results/profile={name}").count()))
        except Exception as e:  # a profile fails alone, whatever the reason
            rows.append((name, "failed", f"{type(e).__name__}: {e}"[:500], int(1000 * (time.monotonic() - started)), 0))
    log = spark.createDataFrame(rows, "profile_name string, status string, error string, elapsed_ms long, result_count long")
    log.write.mode("overwrite").parquet(f"{out}/profiles")
    done = [r[0] for r in rows if r[1] == "succeeded"]
    nothing = spark.createDataFrame([], RESULTS)
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{out}/results/profile={name}") for name in done], nothing), log
