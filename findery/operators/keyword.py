"""BM25 keyword index and search.

Postings and statistics are ordinary tables; a search takes any number of queries at once and shuffles
terms and scores only: texts are joined to the few ranked rows afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.functions.text import half_even, tokenizer

K1, B = 1.2, 0.75
#: (query, term) rows up to which the terms of all queries and their statistics are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 200_000


def postings(chunks: DataFrame, text: str = "text", key: str = "chunk_id", policy: Column | None = None, tokens: str = "unicode_words") -> DataFrame:
    """(policy, chunk_id, term, term_frequency) of all chunks; chunks without terms have no rows."""
    terms = chunks.select(
        (F.lit("all") if policy is None else policy).alias("policy"), F.col(key).alias("chunk_id"), F.explode(tokenizer(tokens)(F.col(text))).alias("term")
    )
    return terms.groupBy("policy", "chunk_id", "term").agg(F.count("*").alias("term_frequency"))


def chunk_lengths(chunks: DataFrame, text: str = "text", key: str = "chunk_id", policy: Column | None = None, tokens: str = "unicode_words") -> DataFrame:
    """(policy, chunk_id, document_length) of every chunk, with 0 for those without terms; no shuffle."""
    length = F.coalesce(F.size(tokenizer(tokens)(F.col(text))), F.lit(0)).cast("long")
    return chunks.select((F.lit("all") if policy is None else policy).alias("policy"), F.col(key).alias("chunk_id"), F.greatest(length, F.lit(0)).alias("document_length"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    """(policy, corpus_chunk_count, average_document_length): all chunks count, the average has 4 digits, ties to even."""
    return lengths.groupBy("policy").agg(
        F.count("*").alias("corpus_chunk_count"), half_even(F.avg("document_length"), 4).alias("average_document_length")
    )


def index_statistics(terms: DataFrame, lengths: DataFrame) -> DataFrame:
    """(policy, term, document_frequency, corpus_chunk_count, average_document_length) of a whole index."""
    frequency = terms.groupBy("policy", "term").agg(F.count("*").alias("document_frequency"))
    return frequency.join(corpus_statistics(lengths), "policy")


def text_statistics(chunks: DataFrame, text: str = "text", key: str = "chunk_id", policy: Column | None = None, tokens: str = "unicode_words") -> DataFrame:
    """``index_statistics`` straight from texts: each chunk's distinct terms are counted, and no posting is made."""
    own = (F.lit("all") if policy is None else policy).alias("policy")
    frequency = chunks.select(own, F.explode(F.array_distinct(tokenizer(tokens)(F.col(text)))).alias("term")).groupBy("policy", "term").agg(F.count("*").alias("document_frequency"))
    # a row for each policy
    return frequency.join(F.broadcast(corpus_statistics(chunk_lengths(chunks, text, key, policy, tokens))), "policy")


def refresh_index(chunks: DataFrame, path: str, policy: Column | None = None, text: str = "text", key: str = "chunk_id", tokens: str = "unicode_words") -> None:
    """Write postings, lengths and statistics below ``path``, by policy; only the policies in ``chunks`` are replaced."""
    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("policy").parquet(f"{path}/{name}")

    terms, lengths = postings(chunks, text, key, policy, tokens), chunk_lengths(chunks, text, key, policy, tokens)
    put(terms, "postings")
    put(lengths, "lengths")
    spark = chunks.sparkSession
    own = lambda df, name: spark.read.schema(df.schema).parquet(f"{path}/{name}").join(F.broadcast(names), "policy", "left_semi")
    names = chunks.select((F.lit("all") if policy is None else policy).alias("policy")).distinct()
    put(index_statistics(own(terms, "postings"), own(lengths, "lengths")), "statistics")


def stored_topk(queries: DataFrame, path: str, k: int, policy: str = "all", candidates: DataFrame | None = None, tokens: str = "unicode_words") -> DataFrame:
    """``bm25_topk`` over the stored index of one policy: the queries' terms select postings, no text is read."""
    spark = queries.sparkSession
    of = lambda table: spark.read.parquet(f"{path}/{table}").where(F.col("policy") == policy)
    return top_k(bm25_scores(query_terms(queries, tokens=tokens), of("postings"), of("lengths"), candidates, of("statistics")), k)


def refresh_indexes(chunks: DataFrame, path: str, policies: list[str], policy: str = "policy", text: str = "text", tokens: str = "unicode_words", go_on: bool = True) -> DataFrame:
    """Refresh the index of each policy, one after the other: (policy, tokenizer, status, error, chunk_count, term_rows, statistic_rows, average_document_length).

    A policy that fails is a row with its error and the others go on, unless ``go_on`` is false; one
    without chunks succeeds with zeros.  The driver holds a row for each policy.
    """
    spark = chunks.sparkSession
    tokenizer(tokens)
    rows = []
    for name in policies:
        try:
            own = chunks.where(F.col(policy) == name)
            refresh_index(own, path, F.col(policy), text, tokens=tokens)
            of = lambda table: spark.read.parquet(f"{path}/{table}").where(F.col("policy") == name)  # noqa: B023, E731
            n, average = of("lengths").agg(F.count("*"), half_even(F.avg("document_length"), 4)).first()
            rows.append((name, tokens, "succeeded", None, n, of("postings").count(), of("statistics").count(), average or 0.0))
        except Exception as e:  # whatever a policy fails by, the others are still refreshed
            if not go_on:
                raise
            rows.append((name, tokens, "failed", f"{type(e).__name__}: {e}"[:500], 0, 0, 0, 0.0))
    return spark.createDataFrame(rows, "policy string, tokenizer string, status string, error string, chunk_count long, term_rows long, statistic_rows long, average_document_length double")


def query_terms(queries: DataFrame, text: str = "query_text", key: str = "query_id", tokens: str = "unicode_words") -> DataFrame:
    """(query_id, term, query_frequency); a query without terms has no rows and so no results."""
    return queries.select(F.col(key).alias("query_id"), F.explode(tokenizer(tokens)(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("query_frequency"))


def bm25_scores(terms: DataFrame, index: DataFrame, lengths: DataFrame, candidates: DataFrame | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, matched_term_count, document_length) of every match in an index.

    ``candidates`` (chunk_id) restricts results alone; frequencies and the average stay those of the whole
    corpus: those of ``statistics`` where they are stored.  Terms and their statistics are broadcast if
    the queries' (query, term) rows are few enough.
    """
    side = F.broadcast if terms.count() <= BROADCAST_TERMS else (lambda df: df)
    asked = side(terms.select("term").distinct())
    if statistics is None:
        frequency = index.join(asked, "term", "left_semi").groupBy("policy", "term").agg(F.count("*").alias("document_frequency"))
        statistics = frequency.join(F.broadcast(corpus_statistics(lengths)), "policy")  # a row for each policy
    wanted = index.join(side(terms), "term")
    if candidates is not None:
        wanted = wanted.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
    scored = wanted.join(side(statistics.join(asked, "term", "left_semi")), ["policy", "term"]).join(lengths, ["policy", "chunk_id"])
    return scored.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(_part(F.col("query_frequency"))), 6).alias("score"), F.count("*").alias("matched_term_count"), F.first("document_length").alias("document_length")
    )


def top_k(scores: DataFrame, k: int, *order: Column) -> DataFrame:
    """With rank, the first ``k`` rows of each query; Spark drops other rows before it shuffles."""
    order = order or (F.col("score").desc_nulls_last(), F.col("chunk_id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def _part(qf: Column) -> Column:
    """What a term adds to a score."""
    n, df, tf, average = F.col("corpus_chunk_count"), F.col("document_frequency"), F.col("term_frequency"), F.col("average_document_length")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.when(average > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.try_divide(F.col("document_length"), average))) * qf).otherwise(0.0)


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int, text: str = "text", key: str = "chunk_id", candidates: DataFrame | None = None, tokens: str = "unicode_words") -> DataFrame:
    """Ranked (query_id, chunk_id, score, matched_term_count, document_length, rank) over chunks without a stored index.

    Terms no query has are dropped before anything is shuffled.  One pass over the texts gives the corpus
    size, the mean length and the frequencies of the queries' terms; another gives matches, which are
    shuffled once, by chunk, and scored where they arrive.  ``candidates`` (chunk_id) restricts results alone.
    """
    terms = query_terms(queries, tokens=tokens)
    few = terms.count() <= BROADCAST_TERMS
    side = F.broadcast if few else (lambda df: df)
    wanted = side(terms.select("term").distinct().withColumn("wanted", F.lit(True)))
    cut = chunks.select(F.col(key).alias("chunk_id"), tokenizer(tokens)(F.col(text)).alias("tokens"))
    length = F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0)).cast("long")

    # a row without a term for each chunk, and one for each of its distinct terms
    seen = cut.select(length.alias("length"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>")))).alias("term"))
    counted = seen.join(wanted, "term", "left").where("term IS NULL OR wanted").groupBy("term").agg(F.count("*").alias("document_frequency"), F.avg("length").alias("mean"))
    whole = Window.partitionBy()  # over the terms of queries only
    chunk_row = F.col("term").isNull()
    statistics = counted.select(
        "term", "document_frequency",
        F.max(F.when(chunk_row, F.col("document_frequency"))).over(whole).alias("corpus_chunk_count"), half_even(F.max(F.when(chunk_row, F.col("mean"))).over(whole), 4).alias("average_document_length"),
    ).where("term IS NOT NULL")

    found = cut.select("chunk_id", length.alias("document_length"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    matches = found.repartition("chunk_id").groupBy("chunk_id", "document_length", "term").agg(F.count("*").alias("term_frequency"))
    if candidates is not None:
        matches = matches.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
    scored = matches.join(side(statistics), "term").join(side(terms), "term").groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(_part(F.col("query_frequency"))), 6).alias("score"), F.count("*").alias("matched_term_count"), F.first("document_length").alias("document_length")
    )
    return top_k(scored, k)
