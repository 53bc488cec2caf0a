"""All queries over the testdata, each with the DuckDB SQL that gives the same rows where SQL can.

The testdata stands in for the engine's own tables: documents are chunks (language as policy or group),
embeddings are one profile whose vec_id joins doc_id and item_id, benchmark items are questions, events
are logs and jobs, region > nation > customer is an organisation, orders are queued jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findery.functions import table_functions
from findery.functions import text as tx
from findery.functions.shared import scratch
from findery.functions.vectors import stand_in_embeddings
from findery.operators import history as answers_history
from findery.operators import answers, blockmax, chunking, coverage, evaluate, fuse, inverted, keyword, logs, ops, permission, sketches, temporal, vector
from findery.plans import search
from findery.sources import entities, files, metrics, tables
from findery.streaming import jobs as job_stream
from findery.streaming import machine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: One "now" for all queries that look back, after the last event.
AS_OF = "2024-01-31 00:00:00"


def query(sql: str | None = None) -> Callable:
    """Register a function (read) -> DataFrame under its name; ``read`` gives a table by name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# Fragments of the SQL side: folded tokens, BM25 over all benchmark items, cosine over the same.
_TOKENS = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')"
_BM25_CTE = f"""
tok AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id, coalesce(len({_TOKENS}), 0) AS dl FROM documents),
st AS (SELECT count(*) AS n, round_even(avg(dl), 4) AS av FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
bm AS (
    SELECT query_id, doc_id AS chunk_id, count(*) AS matched_term_count, first(dl) AS document_length,
        round(sum(CASE WHEN av > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)) * qf ELSE 0 END), 6) AS score
    FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY ALL
),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm)"""
_BM25_CTE = _BM25_CTE.replace("GROUP BY ALL\n),\nkw", "GROUP BY query_id, doc_id\n),\nkw")
_COSINE_CTE = """
vs AS (
    SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label,
        round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])
            / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) AS score
    FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings e
),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs)"""
_FUSED_CTE = f"""{_BM25_CTE},{_COSINE_CTE},
fused AS (
    SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, v.rank AS vector_rank, v.score AS vector_score,
        k.rank AS keyword_rank, k.score AS keyword_score, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0), 9) AS score,
        (v.rank IS NOT NULL)::BIGINT + (k.rank IS NOT NULL)::BIGINT AS source_count
    FROM (SELECT * FROM vr WHERE rank <= 40) v
    FULL JOIN (SELECT kw.* FROM kw JOIN embeddings q ON q.vec_id = kw.query_id WHERE rank <= 40) k ON v.query_id = k.query_id AND v.chunk_id = k.chunk_id
),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(vector_rank, 101), coalesce(keyword_rank, 101), chunk_id) AS rank FROM fused)"""


def _items(read) -> DataFrame:
    return read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _chunks(read) -> DataFrame:
    return read("documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def _vectors(read) -> DataFrame:
    return read("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _vector_queries(read) -> DataFrame:
    """Benchmark items that have a vector; there are few items, however large the corpus."""
    return _vectors(read).select(F.col("chunk_id").alias("query_id"), "embedding").join(F.broadcast(_items(read)), "query_id")


# --- as-of and interval joins ---


def _order_times(read) -> DataFrame:
    """Orders as prices of users: placed in the month of the events, one every few minutes."""
    minutes = (F.col("o_orderkey") * 37) % 43_200
    return read("orders").select((F.col("o_custkey") % 150).alias("user_id"), F.timestamp_seconds(F.lit(1_704_067_200) + 60 * minutes).alias("placed_at"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("price"))


_ORDER_TIMES = "o AS (SELECT o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01' + to_minutes((o_orderkey * 37) % 43200) AS placed_at, o_orderkey AS order_id, o_totalprice AS price FROM orders)"


@query(
    f"WITH {_ORDER_TIMES}, u AS (SELECT user_id, placed_at, max(order_id) AS order_id, arg_max(price, order_id) AS price FROM o GROUP BY ALL)"
    " SELECT event_id, e.user_id, order_id, price FROM events e ASOF LEFT JOIN u ON e.user_id = u.user_id AND e.ts >= u.placed_at"
)
def latest_order(read):
    """Each event with the latest order of its user at that time."""
    found = temporal.as_of(read("events"), _order_times(read), ["user_id"], "ts", "placed_at", ["order_id", "price"], "order_id")
    return found.select("event_id", "user_id", "order_id", "price")


@query(
    f"WITH {_ORDER_TIMES}, w AS (SELECT *, placed_at + to_minutes((order_id % 7) * (order_id % 11) * 40) AS until_at FROM o)"
    " SELECT order_id, count(*) AS events, min(event_id) AS first_event FROM events e JOIN w ON e.user_id = w.user_id AND e.ts >= placed_at AND e.ts < until_at GROUP BY 1"
)
def events_during_orders(read):
    """Events of a user while an order is open: from none to over two days, by its number."""
    minutes = (F.col("order_id") % 7) * (F.col("order_id") % 11) * 40
    windows = _order_times(read).withColumn("until_at", F.timestamp_seconds(F.unix_seconds("placed_at") + 60 * minutes))
    found = temporal.interval_join(read("events"), windows, ["user_id"], "ts", "placed_at", "until_at")
    return found.groupBy("order_id").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


# --- keyword and vector search, fusion ---


@query(f"WITH {_BM25_CTE} SELECT query_id, chunk_id, score, matched_term_count, document_length, rank FROM kw WHERE rank <= 10")
def bm25_topk(read):
    return keyword.bm25_topk(_items(read), _chunks(read), 10)


@query(
    f"WITH {_BM25_CTE} SELECT query_id, chunk_id, score, matched_term_count, document_length, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank"
    " FROM bm JOIN documents ON doc_id = chunk_id WHERE lang = 'en' QUALIFY rank <= 10"
)
def bm25_topk_filtered(read):
    return keyword.bm25_topk(_items(read), _chunks(read), 10, candidates=_chunks(read).where("lang = 'en'"))


def _kept_index(read) -> str:
    """An index of all documents after three batches: a fifth came with another text first, and copies under other ids came and went."""
    docs = _chunks(read).select("chunk_id", "text")
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "index")
    stale = docs.withColumn("text", F.when(F.col("chunk_id") % 5 == 0, F.concat(F.substring("text", 1, 40), F.lit(" of an older version"))).otherwise(F.col("text")))
    passing = docs.where("chunk_id % 7 = 0").select((-1 - F.col("chunk_id")).alias("chunk_id"), "text")
    blockmax.apply_batch(spark, path, 0, stale.where("chunk_id % 3 > 0").union(passing))
    blockmax.apply_batch(spark, path, 1, stale.where("chunk_id % 3 = 0"), passing.select("chunk_id"))
    blockmax.apply_batch(spark, path, 2, docs.where("chunk_id % 5 = 0"))
    return path


@query(f"WITH {_BM25_CTE} SELECT query_id, chunk_id, score, matched_term_count, document_length, rank FROM kw WHERE rank <= 10")
def bm25_stored_topk(read):
    """``bm25_topk`` from a stored index with block-max pruning; no text is read once the index is there."""
    return blockmax.search(_items(read), _kept_index(read), 10).rows


@query(
    f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
l AS (SELECT count(*) AS corpus_chunk_count, round_even(avg(coalesce(len({_TOKENS}), 0)), 4) AS average_document_length FROM documents)
SELECT term, count(DISTINCT doc_id) AS document_frequency, corpus_chunk_count, average_document_length FROM t, l GROUP BY ALL
"""
)
def bm25_incremental_stats(read):
    """Statistics as sums of the changes of three batches, equal to those of a rebuild."""
    return blockmax.statistics(read("documents").sparkSession, _kept_index(read))


@query(
    f"""
WITH t AS (SELECT lang AS policy, doc_id, unnest({_TOKENS}) AS term FROM documents),
l AS (SELECT lang AS policy, count(*) AS corpus_chunk_count, round_even(avg(coalesce(len({_TOKENS}), 0)), 4) AS average_document_length FROM documents GROUP BY 1)
SELECT policy, term, count(DISTINCT doc_id) AS document_frequency, corpus_chunk_count, average_document_length FROM t JOIN l USING (policy) GROUP BY ALL
"""
)
def bm25_index_stats(read):
    return keyword.text_statistics(_chunks(read), policy=F.col("lang"))


@query(f"SELECT 'all' AS policy, doc_id AS chunk_id, term, count(*) AS term_frequency FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL")
def bm25_postings(read):
    return keyword.postings(_chunks(read))


def _inverted(read) -> str:
    path = scratch(read("embeddings").sparkSession, "lists")
    inverted.build(_vectors(read), path)
    return path


@query()
def ann_topk(read):
    """Approximate neighbours from the lists next to each query; tests measure recall against ``vector_topk``."""
    return inverted.search(_vector_queries(read), _inverted(read), 10)


@query(f"WITH {_COSINE_CTE} SELECT query_id, chunk_id, score, round(1 - score, 6) AS distance, rank FROM vr WHERE rank <= 10")
def ann_topk_all_lists(read):
    """The exact way of the same index: all lists are probed."""
    return inverted.search(_vector_queries(read), _inverted(read), 10, probes="all")


@query(f"WITH {_COSINE_CTE} SELECT query_id, chunk_id, score, round(1 - score, 6) AS distance, rank FROM vr WHERE rank <= 10")
def vector_topk(read):
    return vector.vector_topk(_vector_queries(read), _vectors(read), 10)


@query(
    f"WITH {_COSINE_CTE} SELECT query_id, chunk_id, score, round(1 - score, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs WHERE label = 3 QUALIFY rank <= 5"
)
def vector_topk_filtered(read):
    return vector.vector_topk(_vector_queries(read), _vectors(read).where("label = 3"), 5)


@query(
    """
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(0 - sqrt(greatest(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), 0)), 6) AS score
    FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings e)
SELECT query_id, chunk_id, score, 0 - score AS distance, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5
"""
)
def vector_topk_l2(read):
    found = vector.vector_topk(_vector_queries(read), _vectors(read), 5, metric="l2")
    # a vector's distance from itself is rounding noise
    return found.withColumns({c: F.when(F.abs(c) < 1e-5, F.lit(0.0)).otherwise(F.col(c)) for c in ("score", "distance")})


@query(f"WITH {_FUSED_CTE} SELECT query_id, chunk_id, score, vector_rank, keyword_rank, vector_score, keyword_score, source_count, rank FROM rrf WHERE rank <= 10")
def hybrid_rrf(read):
    q = _vector_queries(read)
    found = fuse.reciprocal_rank_fusion(vector.vector_topk(q, _vectors(read), 40), keyword.bm25_topk(q, _chunks(read), 40), 10)
    return found.select("query_id", "chunk_id", "score", "vector_rank", "keyword_rank", "vector_score", "keyword_score", "source_count", "rank")


@query(
    f"""
WITH {_BM25_CTE},
q AS (SELECT item_id AS query_id, list_distinct({_TOKENS}) AS own FROM benchmark),
d AS (SELECT doc_id AS chunk_id, {_TOKENS} AS w FROM documents),
s AS (
    SELECT query_id, chunk_id, score AS source_score, rank AS source_rank,
        round(len(list_intersect(own, w)) / greatest(1, len(own))::DOUBLE + 0.001 * least(greatest(score, 0), 1), 9) AS score
    FROM kw JOIN q USING (query_id) JOIN d USING (chunk_id) WHERE rank <= 40
)
SELECT query_id, chunk_id, source_score, source_rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_rank, chunk_id) AS rank FROM s QUALIFY rank <= 10
"""
)
def lexical_rerank(read):
    found = keyword.bm25_topk(_items(read), _chunks(read), 40)
    return fuse.lexical_rerank(found, _items(read), _chunks(read), 10).select("query_id", "chunk_id", "source_score", "source_rank", "score", "rank")


@query(
    f"""WITH {_BM25_CTE} SELECT query_id, count(*) FILTER (WHERE score >= 12) AS result_count, count(*) FILTER (WHERE score < 12) AS excluded_count,
    max(score) FILTER (WHERE score >= 12) AS max_score, round(avg(score) FILTER (WHERE score >= 12), 6) AS mean_score FROM kw WHERE rank <= 20 GROUP BY query_id"""
)
def threshold_summary(read):
    return fuse.threshold_summary(keyword.bm25_topk(_items(read), _chunks(read), 20), 12.0)


@query(
    f"""
WITH {_FUSED_CTE},
own AS (SELECT item_id AS query_id, list_distinct({_TOKENS}) AS own FROM benchmark), dw AS (SELECT doc_id AS chunk_id, {_TOKENS} AS w FROM documents),
rs AS (SELECT query_id, chunk_id, score AS source_score, rank AS source_rank, round(len(list_intersect(own, w)) / greatest(1, len(own))::DOUBLE + 0.001 * least(greatest(score, 0), 1), 9) AS s FROM vr JOIN own USING (query_id) JOIN dw USING (chunk_id) WHERE rank <= 40),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source_rank, chunk_id) AS rank FROM rs)
SELECT query_id, 'vector_cosine' AS profile_name, rank, chunk_id, 'vector' AS strategy, score, NULL::DOUBLE AS source_score, NULL::DOUBLE AS reranker_score, NULL::DOUBLE AS vector_score, NULL::DOUBLE AS keyword_score, NULL::BIGINT AS source_count FROM vr WHERE rank <= 10
UNION ALL SELECT kw.query_id, 'bm25_keyword', rank, chunk_id, 'bm25', score, NULL, NULL, NULL, NULL, NULL FROM kw JOIN embeddings ON vec_id = kw.query_id WHERE rank <= 10
UNION ALL SELECT query_id, 'hybrid_keyword_vector', rank, chunk_id, 'hybrid', score, NULL, NULL, vector_score, keyword_score, source_count FROM rrf WHERE rank <= 10
UNION ALL SELECT query_id, 'reranked_vector_cosine', rank, chunk_id, 'reranked', s, source_score, NULL, NULL, NULL, NULL FROM rk WHERE rank <= 10
"""
)
def search_compare(read):
    return search.compare(_vector_queries(read), _chunks(read), _vectors(read), 10)


@query()
def mock_embeddings(read):
    return read("documents").select("doc_id", stand_in_embeddings(F.col("text"), "stand_in", 16).alias("embedding"))


@query(
    """WITH h AS (SELECT doc_id, k, sha256('stand_in' || chr(10) || text || chr(0) || chr(0) || chr(0) || chr(k)) AS d FROM documents, (VALUES (0), (1)) b(k)),
e AS (SELECT doc_id, k * 8 + i AS p, ('0x' || d[i * 8 + 1:i * 8 + 8])::BIGINT / 2147483648.0::DOUBLE - 1 AS x FROM (SELECT *, unnest(range(8)) AS i FROM h))
SELECT doc_id, round(max(x) FILTER (WHERE p = 0) / sqrt(sum(x * x)), 9) AS first_number, round(max(x) FILTER (WHERE p = 15) / sqrt(sum(x * x)), 9) AS last_number FROM e GROUP BY 1"""
)
def mock_embedding_ends(read):
    e = stand_in_embeddings(F.col("text"), "stand_in", 16)
    return read("documents").select("doc_id", e.alias("e")).select("doc_id", F.round(F.element_at("e", 1), 9).alias("first_number"), F.round(F.element_at("e", -1), 9).alias("last_number"))


@query(
    """SELECT vec_id, len(embedding)::BIGINT AS dimension, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding) = 64 AS is_valid FROM embeddings"""
)
def vector_dimensions(read):
    from findery.functions.vectors import dot, is_valid

    e = F.col("embedding")
    return read("embeddings").select("vec_id", F.size(e).cast("long").alias("dimension"), F.round(F.sqrt(dot(e, e)), 6).alias("norm"), is_valid(e, 64).alias("is_valid"))


# --- evaluation ---

_EVAL_CTE = f"""{_COSINE_CTE},
tg AS (
    SELECT DISTINCT b.item_id AS question_id, l.doc_id AS chunk_id, l.quality AS grade, l.toxic = 1 AS hidden
    FROM benchmark b JOIN embeddings e ON e.label = b.item_id % 10 JOIN labels l ON l.doc_id = e.vec_id
),
ideal AS (
    SELECT question_id, count(*) AS visible_count, sum(CASE WHEN p <= 10 THEN (2 ** g - 1) / log2(p + 1) END) AS idcg
    FROM (SELECT question_id, grade AS g, row_number() OVER (PARTITION BY question_id ORDER BY grade DESC, chunk_id) AS p FROM tg WHERE grade > 0 AND NOT hidden) GROUP BY 1
),
rs AS (SELECT query_id AS question_id, chunk_id, rank FROM vr WHERE rank <= 10),
found AS (
    SELECT question_id, count(*) AS result_count, count(*) FILTER (WHERE g > 0) AS matched_count, min(rank) FILTER (WHERE g > 0) AS first_rank,
        sum(CASE WHEN g > 0 THEN (2 ** g - 1) / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (WHERE coalesce(hidden, false)) AS hidden_violation_count
    FROM (SELECT rs.*, CASE WHEN hidden THEN 0 ELSE grade END AS g, hidden FROM rs LEFT JOIN tg USING (question_id, chunk_id)) GROUP BY 1
),
qm AS (
    SELECT item_id AS question_id, coalesce(visible_count, 0) AS visible_count, coalesce(result_count, 0) AS result_count, coalesce(matched_count, 0) AS matched_count,
        CASE WHEN visible_count > 0 THEN round(coalesce(matched_count, 0) / visible_count::DOUBLE, 6) END AS recall_at_k,
        CASE WHEN visible_count > 0 THEN round(coalesce(1.0::DOUBLE / first_rank, 0), 6) END AS reciprocal_rank,
        CASE WHEN visible_count > 0 THEN round(coalesce(dcg, 0) / idcg, 6) END AS ndcg,
        coalesce(hidden_violation_count, 0) AS hidden_violation_count,
        CASE WHEN coalesce(visible_count, 0) = 0 THEN coalesce(result_count, 0) = 0 END AS no_answer_success
    FROM benchmark LEFT JOIN found ON question_id = item_id LEFT JOIN ideal i ON i.question_id = item_id
)"""


def _metrics(read) -> DataFrame:
    results = vector.vector_topk(_vector_queries(read), _vectors(read), 10).select(F.col("query_id").alias("question_id"), "chunk_id", "rank")
    questions = read("benchmark").select(F.col("item_id").alias("question_id"))
    like = questions.join(read("embeddings"), F.col("label") == F.col("question_id") % 10).join(read("labels"), F.col("doc_id") == F.col("vec_id"))
    targets = like.select("question_id", F.col("doc_id").alias("chunk_id"), F.col("quality").alias("grade"), F.when(F.col("toxic") == 1, "hidden").otherwise("visible").alias("expectation"))
    return evaluate.question_metrics(questions, results, targets, 10)


@query(f"WITH {_EVAL_CTE} SELECT * FROM qm")
def question_metrics(read):
    return _metrics(read)


@query(
    f"""WITH {_EVAL_CTE} SELECT count(*) AS question_count, count(recall_at_k) AS evaluated_count, round(avg(recall_at_k), 6) AS mean_recall_at_k, round(avg(reciprocal_rank), 6) AS mean_reciprocal_rank,
    round(avg(ndcg), 6) AS mean_ndcg, sum(hidden_violation_count)::BIGINT AS hidden_violation_count, count(no_answer_success) AS no_answer_count, round(avg(no_answer_success::INT::DOUBLE), 6) AS no_answer_success_rate FROM qm"""
)
def metric_summary(read):
    return evaluate.metric_summary(_metrics(read))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(read):
    found = evaluate.latest_per_key(read("events"), ["user_id"], F.col("ts").desc_nulls_last(), F.col("event_id").desc())
    return found.select("user_id", "event_id", "event_type", "value")


_WEEK = "SELECT user_id, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events WHERE ts >= TIMESTAMP '{}' AND ts < TIMESTAMP '{}' GROUP BY 1"


def _week(read, first: str, last: str) -> DataFrame:
    own = read("events").where((F.col("ts") >= F.lit(first).cast("timestamp")) & (F.col("ts") < F.lit(last).cast("timestamp")))
    return own.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    f"""
SELECT coalesce(b.user_id, t.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'added' WHEN t.user_id IS NULL THEN 'removed' ELSE 'common' END AS comparison_status,
    t.n - b.n AS n_delta, round(t.mean - b.mean, 6) AS mean_delta
FROM ({_WEEK.format("2024-01-01", "2024-01-02")}) b FULL JOIN ({_WEEK.format("2024-01-08", "2024-01-09")}) t ON b.user_id = t.user_id
"""
)
def snapshot_compare(read):
    return evaluate.compare_snapshots(_week(read, "2024-01-01", "2024-01-02"), _week(read, "2024-01-08", "2024-01-09"), ["user_id"], ["n", "mean"])


@query(
    f"""
SELECT coalesce(b.user_id, t.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'added' WHEN t.user_id IS NULL THEN 'removed' ELSE 'common' END AS comparison_status,
    t.n - b.n AS n_delta, round(t.mean - b.mean, 6) AS mean_delta
FROM ({_WEEK.format("2024-01-01", "2024-01-08")}) b FULL JOIN ({_WEEK.format("2024-01-08", "2024-01-15")}) t ON b.user_id = t.user_id
"""
)
def snapshot_compare_weeks(read):
    return evaluate.compare_snapshots(_week(read, "2024-01-01", "2024-01-08"), _week(read, "2024-01-08", "2024-01-15"), ["user_id"], ["n", "mean"])


@query(
    """
WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL)
SELECT event_type, day, n, mean, row_number() OVER w AS sequence, n - lag(n) OVER w AS n_delta, round(mean - lag(mean) OVER w, 6) AS mean_delta FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)
"""
)
def metric_trend(read):
    daily = read("events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    found = evaluate.metric_trend(daily.withColumn("tie", F.lit(0)), "event_type", "day", "tie", ["n", "mean"])
    return found.drop("tie")


_RUN_STATUS = {"error": "failed", "click": "pending", "view": "canceled", "signup": "succeeded", "purchase": "skipped"}


@query(
    """
WITH r AS (SELECT event_id % 7000 AS batch_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'pending' WHEN 'view' THEN 'canceled' WHEN 'signup' THEN 'succeeded' ELSE 'skipped' END AS status FROM events),
b AS (SELECT batch_id, list_sort(list(DISTINCT status)) AS s, count(*) AS runs FROM r GROUP BY 1)
SELECT batch_id, CASE WHEN s = ['succeeded'] THEN 'succeeded' WHEN list_contains(s, 'failed') THEN 'failed' WHEN list_has_any(s, ['running', 'pending']) THEN 'running' WHEN list_contains(s, 'canceled') THEN 'canceled' ELSE 'failed' END AS batch_status, runs FROM b
"""
)
def batch_status(read):
    state = F.create_map(*[F.lit(x) for pair in _RUN_STATUS.items() for x in pair])
    return evaluate.batch_status(read("events").select((F.col("event_id") % 7000).alias("batch_id"), F.element_at(state, F.col("event_type")).alias("status")), "batch_id")


def _batch_runs(read) -> DataFrame:
    """Orders as experiment runs, named by their batch and question."""
    return read("orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.struct(
            evaluate.batch_prefix(F.concat_ws(" / Q", "o_orderpriority", F.col("o_custkey").cast("string")), F.col("o_custkey")).alias("batch_prefix"),
            F.when(F.col("o_orderstatus") == "F", "heading_512_64").alias("chunk_policy_name"),
            F.array(F.lit("vector"), F.col("o_orderstatus")).alias("profile_names"),
            (F.col("o_custkey") % 3 + 1).alias("question_set_id"),
            F.when(F.col("o_orderkey") % 2 == 0, F.lit(0.25)).alias("score_threshold"),
            F.lit("hybrid").alias("strategy_name"),
            F.lit(10).cast("long").alias("top_k"),
        ).alias("batch"),
    )


@query(
    """
WITH r AS (SELECT '{"batch_prefix":"' || o_orderpriority || '","chunk_policy_name":' || CASE WHEN o_orderstatus = 'F' THEN '"heading_512_64"' ELSE 'null' END || ',"profile_names":["vector","' || o_orderstatus || '"],"question_set_id":' || (o_custkey % 3 + 1)
    || ',"score_threshold":' || CASE WHEN o_orderkey % 2 = 0 THEN '0.25' ELSE 'null' END || ',"strategy_name":"hybrid","top_k":10}' AS j, o_orderpriority AS batch_prefix, o_custkey % 3 + 1 AS question_set_id FROM orders)
SELECT rtrim(translate(base64(j::BLOB), '+/', '-_'), '=') AS batch_key, any_value(batch_prefix) AS batch_prefix, any_value(question_set_id) AS question_set_id, count(*) AS runs FROM r GROUP BY 1
"""
)
def batch_identity(read):
    """Batches by their key, with what the key decodes to."""
    found = _batch_runs(read).groupBy(evaluate.batch_key(F.col("batch")).alias("batch_key")).agg(F.count("*").alias("runs"))
    own = evaluate.batch_fields(F.col("batch_key"))
    return found.select("batch_key", own["batch_prefix"].alias("batch_prefix"), own["question_set_id"].alias("question_set_id"), "runs")


@query(
    """
WITH f AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS labels FROM events GROUP BY 1)
SELECT c_custkey AS result_id, array_to_string(labels, ',') AS labels FROM customer JOIN f ON user_id = c_custkey
WHERE list_contains(labels, 'purchase') AND c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)
"""
)
def promotion_candidates(read):
    feedback = read("events").select(F.col("user_id").alias("result_id"), F.when(F.col("event_type") == "purchase", "relevant").otherwise(F.col("event_type")).alias("relevance_label"), F.lit("").alias("comment"), F.col("ts").alias("created_at"), F.col("event_id").alias("feedback_id"))
    promoted = read("supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("result_id"))
    found = evaluate.promotion_candidates(feedback, read("customer").select(F.col("c_custkey").alias("result_id")), promoted)
    labels = F.array_sort(F.transform("labels", lambda x: F.when(x == "relevant", "purchase").otherwise(x)))
    return found.select("result_id", F.array_join(labels, ",").alias("labels"))


# --- logs ---


def _logs(read) -> DataFrame:
    e = read("events")
    return e.select(F.col("event_id").alias("log_id"), "user_id", "event_type", F.col("ts").alias("created_at"), F.col("value").alias("elapsed_ms"), (F.col("event_type") == "error").alias("failed"), "props")


@query(
    """
WITH r AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00'),
g AS (SELECT user_id, event_type, count(*) AS n FROM r GROUP BY ALL)
SELECT count(*) AS search_count, count(*) FILTER (WHERE event_type = 'error') AS failure_count, count(*) FILTER (WHERE value >= 60) AS slow_count, round(avg(value), 6) AS average_elapsed_ms, max(value) AS max_elapsed_ms,
    (SELECT count(*) FROM g WHERE n > 1) AS duplicate_group_count, (SELECT max(n) FROM g) AS max_group_size FROM r
"""
)
def ops_summary(read):
    return logs.operations_summary(_logs(read), as_of(), 168, ["user_id", "event_type"], 60.0)


@query("SELECT event_id AS log_id, user_id, value AS elapsed_ms FROM events WHERE value >= 50 ORDER BY value DESC, event_id DESC LIMIT 100")
def latency_outliers(read):
    return logs.latency_outliers(_logs(read), 50.0, 100).select("log_id", "user_id", "elapsed_ms")


@query("SELECT DISTINCT o_custkey AS log_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.o_custkey AND event_type = 'purchase')")
def no_result(read):
    """Customers as searches, purchases of users as results: most customers are no user."""
    searches = read("orders").select(F.col("o_custkey").alias("log_id")).distinct()
    return logs.without_results(searches, read("events").where("event_type = 'purchase'").select(F.col("user_id").alias("log_id")))


@query("SELECT event_id AS log_id, unnest(json_keys(props)) AS profile_name, json_extract_string(props, '$.k') AS reason FROM events WHERE event_type = 'error'")
def runtime_failures(read):
    return logs.runtime_failures(_logs(read).where("failed"), F.col("props"))


@query(
    """SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS condition, count(*) AS uses, min(doc_id) AS first_id, max(doc_id) AS latest_id FROM documents GROUP BY 1 HAVING count(*) > 1"""
)
def duplicate_conditions(read):
    own = read("documents").select("doc_id", F.lower(tx.squeezed(F.col("text"))).alias("condition"))
    return logs.duplicate_conditions(own, ["condition"], "doc_id", "doc_id")


@query(
    """
WITH r AS (SELECT l_orderkey AS event_id, count(*) AS n FROM lineitem GROUP BY 1), l AS (SELECT e.*, hour(ts) AS at_hour, coalesce(n, 0) AS n FROM events e LEFT JOIN r USING (event_id))
SELECT user_id, event_type, at_hour, count(*) AS uses, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS latest_id, count(*) FILTER (WHERE n = 0) AS zero_result_count,
    count(*) FILTER (WHERE event_type = 'error') AS runtime_failure_count, round(avg(value), 6) AS average_elapsed_ms, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_created_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_created_at
FROM l GROUP BY ALL HAVING count(*) > 1
"""
)
def duplicate_report(read):
    own = _logs(read).withColumns({"at_hour": F.hour("created_at"), "failures": F.when(F.col("failed"), F.col("props")).otherwise("{}")})
    found = logs.duplicate_report(own, read("lineitem").select(F.col("l_orderkey").alias("log_id")), ["user_id", "event_type", "at_hour"], "failures")
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_created_at", "latest_created_at")})


@query(
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM s GROUP BY user_id, k
"""
)
def user_sessions(read):
    found = job_stream.sessions(read("events").withColumnRenamed("ts", "at"), "user_id", "2 hours")
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("session_start", "session_end")})


@query(
    """
WITH e AS (SELECT user_id, event_id, ts, event_type FROM events)
SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'
"""
)
def views_followed(read):
    """Views with the purchases of the same user up to three hours later; the same function joins two streams."""
    e = read("events").withColumnRenamed("ts", "at")
    return job_stream.followed(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "3 HOURS")


@query(
    """
WITH w AS (SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, user_id, value FROM events)
SELECT event_type, week, count(*) AS events, true AS people_within_bound, true AS quantiles_within_bound FROM w GROUP BY ALL
"""
)
def weekly_sketches(read):
    """Weeks merged from stored days; distinct users and quantiles are held against the exact ones in the same row."""
    e = read("events")
    path = scratch(e.sparkSession, "daily")
    sketches.daily(e, ["event_type"], "ts", "user_id", "value").write.parquet(path)
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")
    shares = {"p50": 0.5, "p95": 0.95}
    found = sketches.read_out(sketches.merged(e.sparkSession.read.parquet(path), ["event_type", week]), shares)
    own = e.select(F.col("event_type").alias("t"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("w"), "user_id", "value")
    both = own.join(found, (F.col("t") == F.col("event_type")) & (F.col("w") == F.col("week")))
    rank = {n: F.count_if(F.col("value") < F.col(n)) / F.count("*") <= s + 0.0333 for n, s in shares.items()} | {f"{n}_": F.count_if(F.col("value") <= F.col(n)) / F.count("*") >= s - 0.0333 for n, s in shares.items()}
    checked = both.groupBy("event_type", "week", "events", "people").agg(F.count_distinct("user_id").alias("exact"), *[c.alias(n) for n, c in rank.items()])
    near = F.abs(F.col("people") - F.col("exact")) <= 0.05 * F.col("exact")
    return checked.select("event_type", "week", "events", near.alias("people_within_bound"), (F.col("p50") & F.col("p50_") & F.col("p95") & F.col("p95_")).alias("quantiles_within_bound"))


@query(
    """
WITH p AS (SELECT DISTINCT c_custkey AS profile FROM customer), f AS (SELECT user_id AS profile, event_type FROM events)
SELECT profile, count(event_type) AS total, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase
FROM p LEFT JOIN f USING (profile) GROUP BY 1
"""
)
def feedback_summary(read):
    labels = read("events").select(F.col("user_id").alias("profile"), F.col("event_type").alias("label"))
    return logs.feedback_summary(read("customer").select(F.col("c_custkey").alias("profile")), labels, ["view", "click", "purchase"])


@query(
    """
WITH fb AS (SELECT l_orderkey * 10 + l_linenumber AS result_id, count(*) AS c, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
rs AS (SELECT DISTINCT l_orderkey AS log_id, l_orderkey * 10 + l_linenumber AS result_id FROM lineitem)
SELECT o_orderkey AS log_id, count(rs.result_id) AS result_count, coalesce(sum(c), 0)::BIGINT AS feedback_count, coalesce(sum(r), 0)::BIGINT AS relevant_count
FROM orders LEFT JOIN rs ON rs.log_id = o_orderkey LEFT JOIN fb USING (result_id) GROUP BY 1
"""
)
def log_list(read):
    li = read("lineitem").withColumn("result_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    feedback = li.select("result_id", F.when(F.col("l_returnflag") == "R", "relevant").otherwise("other").alias("label"))
    results = li.select(F.col("l_orderkey").alias("log_id"), "result_id").distinct()
    return logs.log_list(read("orders").select(F.col("o_orderkey").alias("log_id")), results, feedback)


@query(
    """
SELECT o_orderkey AS log_id, to_json(coalesce(list({'rank': l_linenumber, 'part': l_partkey} ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_linenumber IS NOT NULL), []))::VARCHAR AS results
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
"""
)
def log_detail(read):
    li = read("lineitem").withColumn("result_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    results = li.select(F.col("l_orderkey").alias("log_id"), F.col("l_linenumber").alias("rank"), "result_id", F.col("l_partkey").alias("chunk_id"), F.col("l_quantity").alias("score"))
    feedback = li.select("result_id", F.col("l_suppkey").alias("feedback_id"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("comment"))
    found = logs.log_detail(read("orders").select(F.col("o_orderkey").alias("log_id")), results, feedback)
    parts = F.transform("results", lambda r: F.struct(r["rank"].alias("rank"), r["chunk_id"].alias("part")))  # the columns of the SQL
    return found.select("log_id", F.coalesce(F.to_json(parts), F.lit("[]")).alias("results"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-17 00:00:00'")
def retention_kept(read):
    e = read("events")
    return logs.purged(e, logs.expired(e, "ts", "event_id", as_of(), 14), "event_id").select("event_id")


@query("SELECT count(*) AS expired_count, strftime(min(ts), '%Y-%m-%d') AS oldest FROM events WHERE ts < TIMESTAMP '2024-01-17 00:00:00'")
def retention_preview(read):
    old = logs.expired(read("events"), "ts", "event_id", as_of(), 14)
    return old.agg(F.count("*").alias("expired_count"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("oldest"))


@query("SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(read):
    return read("events").groupBy("event_type", metrics.json_number(F.col("props"), "$.k").alias("k")).agg(F.count("*").alias("n"))


# --- coverage and readiness ---


@query(
    """
WITH docs AS (SELECT doc_id AS document_id FROM documents), pol AS (SELECT DISTINCT lang AS policy FROM documents),
ix AS (SELECT doc_id FROM labels)
SELECT document_id, policy, (d.doc_id IS NOT NULL)::BIGINT AS chunk_count, (ix.doc_id IS NOT NULL AND d.doc_id IS NOT NULL)::BIGINT AS indexed_count,
    greatest((d.doc_id IS NOT NULL)::BIGINT - (ix.doc_id IS NOT NULL AND d.doc_id IS NOT NULL)::BIGINT, 0) AS missing_count,
    CASE WHEN d.doc_id IS NOT NULL AND ix.doc_id IS NOT NULL THEN 100.0 ELSE 0.0 END::DOUBLE AS coverage_percent,
    CASE WHEN d.doc_id IS NULL THEN 'not_chunked' WHEN ix.doc_id IS NOT NULL THEN 'complete' ELSE 'missing' END AS index_status
FROM docs CROSS JOIN pol LEFT JOIN documents d ON d.doc_id = document_id AND d.lang = policy LEFT JOIN ix ON ix.doc_id = document_id
"""
)
def keyword_coverage(read):
    d = read("documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("policy"))
    terms = read("labels").select(F.col("doc_id").alias("chunk_id")).join(d.select("chunk_id", "policy"), "chunk_id")
    statistics = d.groupBy("policy").agg(F.count("*").alias("corpus_chunk_count"))
    return coverage.keyword_coverage(d, d.select("policy").distinct(), d, terms, statistics)


_EMB_CTE = """
ch AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS document_id, l_returnflag, l_linestatus, l_quantity FROM lineitem),
pr AS (SELECT 'small' AS profile UNION ALL SELECT 'large'),
jb AS (SELECT chunk_id, document_id, CASE WHEN l_returnflag = 'A' THEN 'small' ELSE 'large' END AS profile,
    CASE WHEN l_linestatus = 'O' AND l_quantity > 25 THEN 'pending' WHEN l_linestatus = 'O' THEN 'failed' WHEN l_quantity > 48 THEN 'running' WHEN l_quantity < 3 THEN 'skipped' ELSE 'succeeded' END AS status FROM ch),
cc AS (SELECT document_id, count(DISTINCT chunk_id) AS chunk_count FROM ch GROUP BY 1),
js AS (SELECT document_id, profile, count(*) AS job_count, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(DISTINCT chunk_id) FILTER (WHERE status = 'succeeded') AS embedded_count FROM jb GROUP BY 1, 2),
cells AS (SELECT o_orderkey AS document_id, pr.profile AS profile, coalesce(chunk_count, 0) AS chunk_count, coalesce(job_count, 0) AS job_count, coalesce(pending, 0) AS pending, coalesce(running, 0) AS running, coalesce(failed, 0) AS failed,
    coalesce(succeeded, 0) AS succeeded, coalesce(skipped, 0) AS skipped, coalesce(embedded_count, 0) AS embedded_count
    FROM orders CROSS JOIN pr LEFT JOIN cc ON cc.document_id = o_orderkey LEFT JOIN js ON js.document_id = o_orderkey AND js.profile = pr.profile),
sc AS (SELECT *, CASE WHEN chunk_count > 0 THEN round_even((embedded_count * 100)::DOUBLE / chunk_count, 2) ELSE 0 END AS coverage_percent,
    CASE WHEN chunk_count = 0 THEN 'not_chunked' WHEN embedded_count >= chunk_count THEN 'complete' WHEN running > 0 THEN 'running' WHEN failed > 0 AND pending = 0 THEN 'failed' WHEN pending > 0 THEN 'pending'
        WHEN embedded_count > 0 OR succeeded > 0 THEN 'partial' WHEN job_count > 0 AND skipped = job_count THEN 'skipped' ELSE 'missing' END AS embedding_status FROM cells)"""


def _embedding_cells(read) -> DataFrame:
    li = read("lineitem")
    own = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("document_id"), "l_returnflag", "l_linestatus", "l_quantity")
    state = (
        F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 25), "pending").when(F.col("l_linestatus") == "O", "failed")
        .when(F.col("l_quantity") > 48, "running").when(F.col("l_quantity") < 3, "skipped").otherwise("succeeded")
    )
    jobs = own.select("chunk_id", F.when(F.col("l_returnflag") == "A", "small").otherwise("large").alias("profile"), state.alias("status"))
    profiles = li.sparkSession.sql("SELECT explode(array('small', 'large')) AS profile")
    documents = read("orders").select(F.col("o_orderkey").alias("document_id"))
    return coverage.embedding_coverage(documents, profiles, own.select("chunk_id", "document_id").distinct(), jobs, jobs.where("status = 'succeeded'"))


@query(f"WITH {_EMB_CTE} SELECT * FROM sc")
def embedding_coverage(read):
    return _embedding_cells(read)


@query(f"WITH {_EMB_CTE} SELECT profile, count(*) AS cell_count, sum(chunk_count)::BIGINT AS chunk_count, count(*) FILTER (WHERE embedding_status = 'complete') AS complete_count, count(*) FILTER (WHERE embedding_status = 'missing') AS missing_count FROM sc GROUP BY 1")
def coverage_summary(read):
    return coverage.coverage_summary(_embedding_cells(read), "embedding_status", ["profile"])


@query("SELECT doc_id AS chunk_id, source AS profile FROM (SELECT doc_id FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents) EXCEPT SELECT doc_id, source FROM documents")
def unscheduled_jobs(read):
    d = read("documents")
    return coverage.unscheduled(d.select(F.col("doc_id").alias("chunk_id")), d.select(F.col("source").alias("profile")).distinct(), d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("profile")))


@query(
    """
WITH j AS (SELECT l_orderkey AS document_id, max_by(l_linenumber, (l_shipdate, l_linenumber)) AS latest_job_id FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey AS document_id, count(*) AS chunk_count, sum(l_quantity)::BIGINT AS token_count FROM lineitem GROUP BY 1)
SELECT o_orderkey AS document_id, coalesce(chunk_count, 0) AS chunk_count, coalesce(token_count, 0) AS token_count, latest_job_id
FROM orders LEFT JOIN j ON j.document_id = o_orderkey LEFT JOIN c ON c.document_id = o_orderkey
"""
)
def document_inventory(read):
    li = read("lineitem")
    docs = read("orders").select(F.col("o_orderkey").alias("document_id"), (-F.col("o_orderkey")).alias("file_id"))
    chunks = li.select(F.col("l_orderkey").alias("document_id"), F.col("l_quantity").alias("token_count"))
    by_document = F.col("l_linenumber") % 2 == 0
    jobs = li.select(F.when(by_document, F.col("l_orderkey")).alias("document_id"), F.when(~by_document, -F.col("l_orderkey")).alias("file_id"), F.col("l_linenumber").alias("job_id"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("queued_at"))
    return coverage.document_inventory(docs, chunks, jobs).select("document_id", "chunk_count", "token_count", "latest_job_id")


@query(
    """SELECT count(*) AS total_count, count(*) FILTER (WHERE u IS NOT NULL AND n IS NOT NULL) AS ready_count, count(*) FILTER (WHERE u IS NULL) AS missing_owner_count, count(*) FILTER (WHERE n IS NULL) AS missing_unit_count, 0::BIGINT AS missing_scope_count,
    round(count(*) FILTER (WHERE u IS NOT NULL AND n IS NOT NULL) * 100.0::DOUBLE / count(*), 4) AS ready_percent
    FROM (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey END AS u, CASE WHEN c_nationkey > 2 THEN c_nationkey END AS n FROM customer)"""
)
def permission_readiness(read):
    c = read("customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("u"), F.when(F.col("c_nationkey") > 2, F.col("c_nationkey")).alias("n"), F.lit("team").alias("s"))
    return coverage.permission_readiness(c, "u", "n", "s")


@query(
    """
WITH h AS (SELECT user_id AS route_id, max_by(event_type, (ts, event_id)) AS h FROM events WHERE event_id % 2 = 0 GROUP BY 1),
c AS (SELECT user_id AS route_id, max_by(event_type, (ts, event_id)) AS c FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(h.route_id, c.route_id) AS route_id, CASE WHEN h IS NULL THEN 'unchecked' WHEN h = 'error' THEN 'unhealthy' WHEN c IS NULL THEN 'contract_unchecked' WHEN c = 'error' THEN 'contract_failed' ELSE 'ready' END AS readiness
FROM h FULL JOIN c ON h.route_id = c.route_id
"""
)
def route_readiness(read):
    e = read("events").select(F.col("user_id").alias("route_id"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("ts").alias("checked_at"), F.col("event_id").alias("snapshot_id"))
    return coverage.route_readiness(e.where("snapshot_id % 2 = 0"), e.where("snapshot_id % 2 = 1"))


@query(
    """
WITH r AS (SELECT s_nationkey AS profile, count(*) AS route_count, count(*) FILTER (WHERE s_acctbal > 0) AS active, count(*) FILTER (WHERE s_acctbal > 3000) AS ready FROM supplier GROUP BY 1)
SELECT n_nationkey AS profile, coalesce(route_count, 0) AS route_count, coalesce(ready, 0) AS ready_route_count,
    CASE WHEN n_nationkey % 7 = 0 THEN 'model_missing' WHEN n_nationkey % 7 = 1 THEN 'model_incomplete' WHEN ready > 0 THEN 'ready' WHEN active > 0 THEN 'route_not_ready' WHEN route_count > 0 THEN 'route_inactive' ELSE 'missing_route' END AS availability
FROM nation LEFT JOIN r ON profile = n_nationkey
"""
)
def model_availability(read):
    profiles = read("nation").select(F.col("n_nationkey").alias("profile"))
    models = profiles.where("profile % 7 <> 0").select("profile", F.lit(True).alias("is_present"), (F.col("profile") % 7 != 1).alias("is_complete"))
    routes = read("supplier").select(F.col("s_nationkey").alias("profile"), (F.col("s_acctbal") > 0).alias("is_active"), F.when(F.col("s_acctbal") > 3000, "ready").otherwise("failed").alias("readiness"))
    return coverage.model_availability(profiles, models, routes)


# --- operations ---


@query("SELECT count(*) AS total_count, count(DISTINCT h) AS distinct_count, (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)) AS duplicate_group_count, count(*) - count(DISTINCT h) AS duplicate_count FROM (SELECT sha256(text) AS h FROM documents)")
def core_indicators(read):
    return ops.core_indicators(read("documents").select(tx.content_hash(F.col("text")).alias("sha256")), "sha256")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, lang, source LIMIT 8")
def top_groups(read):
    return ops.top_groups(read("documents"), ["lang", "source"])


def _order_jobs(read) -> DataFrame:
    """Orders as jobs: O queued, P running with a lease of 30 days, F done; one in eleven of these failed."""
    o = read("orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderkey") % 11 == 0, "failed").otherwise("succeeded")
    return o.select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("queued_at"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("lease_expires_at"),
        (F.col("o_custkey") % 4).alias("attempts"), F.lit(3).alias("max_attempts"),
    )


_JOBS_CTE = """jobs AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
    o_orderpriority AS priority, o_orderdate AS queued_at, o_orderdate + INTERVAL 30 DAY AS lease_expires_at, o_custkey % 4 AS attempts, 3 AS max_attempts FROM orders)"""
_JOBS_AS_OF = "1996-01-01 00:00:00"


@query(
    f"""WITH {_JOBS_CTE} SELECT priority, count(*) AS total, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'succeeded') AS succeeded,
    count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'canceled') AS canceled, count(*) FILTER (WHERE status = 'running' AND lease_expires_at < TIMESTAMP '{_JOBS_AS_OF}') AS stale_running,
    count(*) FILTER (WHERE status = 'failed' AND attempts < max_attempts) AS retryable_failed, count(*) FILTER (WHERE status = 'failed' AND attempts >= max_attempts) AS exhausted_failed,
    strftime(min(queued_at) FILTER (WHERE status = 'queued'), '%Y-%m-%d') AS oldest_queued FROM jobs GROUP BY ROLLUP (priority)"""
)
def queue_backlog(read):
    found = ops.queue_summary(_order_jobs(read), F.lit(_JOBS_AS_OF).cast("timestamp"), ["priority"], totals=True)
    return found.withColumn("oldest_queued", F.date_format("oldest_queued_at", "yyyy-MM-dd")).drop("oldest_queued_at")


@query(f"WITH {_JOBS_CTE} SELECT job_id, attempts::BIGINT AS attempts FROM jobs WHERE status = 'running' AND lease_expires_at < TIMESTAMP '{_JOBS_AS_OF}'")
def stale_jobs(read):
    return ops.stale_jobs(_order_jobs(read), F.lit(_JOBS_AS_OF).cast("timestamp")).select("job_id", F.col("attempts").cast("long").alias("attempts"))


@query(f"WITH {_JOBS_CTE} SELECT job_id, status FROM jobs WHERE status = 'queued' OR (status = 'running' AND lease_expires_at < TIMESTAMP '{_JOBS_AS_OF}' AND attempts < max_attempts)")
def claimable_jobs(read):
    return ops.claim_order(_order_jobs(read), F.lit(_JOBS_AS_OF).cast("timestamp")).select("job_id", "status")


@query(f"WITH {_JOBS_CTE} SELECT job_id FROM jobs WHERE status = 'failed' AND attempts < max_attempts")
def retryable_jobs(read):
    return coverage.retryable(_order_jobs(read)).select("job_id")


@query(
    """
WITH st AS (SELECT unnest(['AF', 'NF', 'NO', 'RF', 'XX']) AS stage, unnest(range(5)) AS position),
j AS (SELECT l_returnflag || l_linestatus AS stage, CASE WHEN l_discount > 0.08 THEN 'failed' ELSE 'succeeded' END AS status, coalesce(CASE WHEN l_linenumber % 3 > 0 THEN l_shipdate - INTERVAL 1 HOUR * l_linenumber END, l_shipdate - INTERVAL 5 DAY) AS a, l_shipdate AS z FROM lineitem),
r AS (SELECT *, (epoch_us(z) - epoch_us(a)) / 1000.0::DOUBLE AS ms FROM j WHERE z >= TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 8760 HOUR AND z <= TIMESTAMP '1996-01-01 00:00:00'),
c AS (SELECT stage, count(*) FILTER (WHERE status = 'succeeded') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, round(avg(ms) FILTER (WHERE status = 'succeeded'), 3) AS average_ms, round(max(ms) FILTER (WHERE status = 'succeeded'), 3) AS max_ms FROM r GROUP BY 1)
SELECT stage, position, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, round(coalesce(completed, 0) / (8760 * 3600.0::DOUBLE), 6) AS per_second,
    round(completed * 100.0::DOUBLE / (completed + failed), 2) AS success_percent, average_ms, max_ms FROM st LEFT JOIN c USING (stage)
"""
)
def throughput(read):
    li = read("lineitem")
    started = F.col("l_shipdate") - F.make_dt_interval(F.lit(0), F.col("l_linenumber"))
    jobs = li.select(
        F.concat("l_returnflag", "l_linestatus").alias("stage"), F.when(F.col("l_discount") > 0.08, "failed").otherwise("succeeded").alias("status"), F.when(F.col("l_linenumber") % 3 > 0, started).alias("started_at"),
        (F.col("l_shipdate") - F.expr("INTERVAL 5 DAYS")).alias("queued_at"), F.col("l_shipdate").alias("finished_at"),
    )
    stages = li.sparkSession.sql("SELECT posexplode(array('AF', 'NF', 'NO', 'RF', 'XX')) AS (position, stage)").withColumn("position", F.col("position").cast("long"))
    return ops.throughput(jobs, stages, F.lit(_JOBS_AS_OF).cast("timestamp"), 8760)


@query(
    """
WITH a AS (SELECT 'event' AS source_name, event_id AS id, ts AS at_ts, props AS detail FROM events WHERE event_type = 'error'), b AS (SELECT 'order' AS source_name, o_orderkey AS id, o_orderdate AS at_ts, o_orderpriority AS detail FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT 'line' AS source_name, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS at_ts, l_linestatus AS detail FROM lineitem WHERE l_returnflag = 'R')
SELECT source_name, id, strftime(at_ts, '%Y-%m-%d %H:%M:%S') AS at_text, detail FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) ORDER BY at_ts DESC, source_name, id DESC LIMIT 50
"""
)
def recent_failures(read):
    sources = {
        "event": read("events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("props").alias("detail")),
        "order": read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("detail")),
        "line": read("lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("at"), F.col("l_linestatus").alias("detail")),
    }
    found = ops.recent_failures(sources, 50)
    return found.select("source_name", "id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at_text"), "detail")


_RULES = [("pipeline_stale", "critical", 5), ("pipeline_exhausted", "critical", 100_000), ("pipeline_retryable", "warning", 1), ("app_error", "warning", 1)]


def _health(read) -> DataFrame:
    found = ops.queue_summary(_order_jobs(read), F.lit(_JOBS_AS_OF).cast("timestamp"))
    counts = found.select(F.col("stale_running").alias("pipeline_stale"), F.col("exhausted_failed").alias("pipeline_exhausted"), F.col("retryable_failed").alias("pipeline_retryable"))
    return ops.health_signals(counts.crossJoin(read("events").agg(F.count_if(F.col("event_type") == "error").alias("app_error"))), _RULES)


_HEALTH_CTE = f"""{_JOBS_CTE},
c AS (SELECT unnest(['pipeline_stale', 'pipeline_exhausted', 'pipeline_retryable', 'app_error']) AS code, unnest(['critical', 'critical', 'warning', 'warning']) AS severity, unnest([5, 100000, 1, 1])::BIGINT AS threshold,
    unnest([(SELECT count(*) FROM jobs WHERE status = 'running' AND lease_expires_at < TIMESTAMP '{_JOBS_AS_OF}'), (SELECT count(*) FROM jobs WHERE status = 'failed' AND attempts >= max_attempts),
        (SELECT count(*) FROM jobs WHERE status = 'failed' AND attempts < max_attempts), (SELECT count(*) FROM events WHERE event_type = 'error')]) AS signal_count),
sg AS (SELECT * FROM c WHERE signal_count >= threshold)"""


@query(f"WITH {_HEALTH_CTE} SELECT code, severity, signal_count, threshold FROM sg")
def health_signals(read):
    return _health(read)


@query(f"WITH {_HEALTH_CTE} SELECT CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN count(*) > 0 THEN 'warning' ELSE 'healthy' END AS health, count(*) AS signal_count, count(*) FILTER (WHERE severity = 'critical') AS critical_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count FROM sg")
def health_status(read):
    return ops.health_status(_health(read))


@query(
    """SELECT event_type AS provider, count(*) AS snapshot_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, max_by(value, ts) AS latest_value, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events GROUP BY 1"""
)
def snapshot_rollup(read):
    found = ops.snapshot_summary(read("events"), "event_type", "ts", ["value"])
    return found.select(F.col("event_type").alias("provider"), "snapshot_count", F.date_format("latest_at", "yyyy-MM-dd HH:mm:ss").alias("latest"), "latest_value", "mean_value", "max_value")


_PIPELINE_EVENTS = ("created", "claimed", "heartbeat", "stage_started", "progress", "stage_succeeded", "failed", "retried", "canceled")


def _pipeline_events(read) -> DataFrame:
    """Events as those of pipeline jobs: all nine types in turn; jobs of a user and day, every other stage the last one."""
    kinds = F.array(*map(F.lit, _PIPELINE_EVENTS))
    return read("events").select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("job_id"), "event_id", F.get(kinds, (F.crc32(F.col("event_id").cast("string").cast("binary")) % 9).cast("int")).alias("event_type"),
        F.when(F.col("event_id") % 2 == 0, "completed").otherwise("chunking").alias("stage"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").alias("worker"),
    )


@query(
    """
WITH e AS (SELECT user_id * 100 + day(ts) AS job_id, event_id, event_id % 9 AS kind, event_id % 2 = 0 AS last_stage, ts FROM events),
s AS (SELECT *, CASE WHEN kind IN (0, 7) THEN 'queued' WHEN kind = 5 AND last_stage THEN 'succeeded' WHEN kind = 6 THEN 'failed' WHEN kind = 8 THEN 'canceled' ELSE 'running' END AS status FROM e)
SELECT job_id, arg_max(status, (ts, event_id)) AS status, count(*) FILTER (WHERE kind = 1) AS attempts, count(*) AS events FROM s GROUP BY 1
"""
)
def pipeline_job_states(read):
    """Status of jobs from all nine types of event, null for none."""
    kinds = F.array(*map(F.lit, _PIPELINE_EVENTS))
    e = _pipeline_events(read).withColumn("event_type", F.get(kinds, (F.col("event_id") % 9).cast("int")))
    return job_stream.job_state(e).select("job_id", "status", "attempts", "events")


@query()
def job_leases(read):
    """Jobs with attempts, leases and refused events at the end of the month; the stream of the same name is tested to agree."""
    return machine.job_table(_pipeline_events(read), as_of())


@query("SELECT user_id, max(event_id) AS last_event, count(*) AS events, count(*) FILTER (WHERE event_type = 'click') AS attempts FROM events GROUP BY 1")
def job_states(read):
    kinds = F.create_map(*map(F.lit, ("view", "queued", "click", "claimed", "signup", "progress", "purchase", "succeeded", "error", "failed")))
    e = read("events").select(F.col("user_id").alias("job_id"), "event_id", F.element_at(kinds, F.col("event_type")).alias("event_type"), F.col("ts").alias("at"))
    found = job_stream.job_state(e)
    last = e.groupBy("job_id").agg(F.max("event_id").alias("last_event"))
    return found.join(last, "job_id").select(F.col("job_id").alias("user_id"), "last_event", "events", "attempts")


@query(
    """
WITH s AS (SELECT event_type AS provider, CASE WHEN event_id % 4 = 0 THEN 'vllm:num_requests_running' WHEN event_id % 4 = 1 THEN 'vllm:kv_cache_usage_perc' WHEN event_id % 4 = 2 THEN 'vllm:e2e_request_latency_seconds_sum' ELSE 'vllm:e2e_request_latency_seconds_count' END AS name, round(value) AS v FROM events)
SELECT provider, count(*) AS metric_count, sum(v) FILTER (WHERE name LIKE '%running')::BIGINT AS running_requests, max(v) FILTER (WHERE name LIKE '%perc') AS kv_cache_usage_ratio,
    round(sum(v) FILTER (WHERE name LIKE '%_sum') / sum(v) FILTER (WHERE name LIKE '%_count'), 6) AS average_e2e_request_latency_seconds FROM s GROUP BY 1
"""
)
def runtime_metrics(read):
    names = F.array(*map(F.lit, ("vllm:num_requests_running", "vllm:kv_cache_usage_perc", "vllm:e2e_request_latency_seconds_sum", "vllm:e2e_request_latency_seconds_count")))
    lines = read("events").select(F.col("event_type").alias("provider"), F.concat(F.get(names, (F.col("event_id") % 4).cast("int")), F.lit('{engine="0"} '), F.round("value").cast("string")).alias("value"))
    found = ops.runtime_snapshot(metrics.prometheus_samples(lines), ["provider"])
    return found.select("provider", "metric_count", "running_requests", "kv_cache_usage_ratio", "average_e2e_request_latency_seconds")


@query(
    """
WITH l AS (SELECT user_id, arg_max(struct_pack(id := event_id, ts := ts, v := value), (ts, event_id)) AS s FROM events GROUP BY 1),
m AS (SELECT c_custkey AS provider, s.id AS id, greatest(0.0, round((epoch_us(TIMESTAMP '2024-01-30 20:00:00') - epoch_us(s.ts)) / 60e6, 2)) AS age, s.v AS v FROM customer LEFT JOIN l ON user_id = c_custkey),
c AS (SELECT provider, id, list_filter([
    struct_pack(code := 'snapshot_stale', st := CASE WHEN age >= 30 THEN 3 WHEN age >= 10 THEN 2 ELSE 0 END), struct_pack(code := 'missing_vllm_metrics', st := CASE WHEN id % 3 <= 0 THEN 3 ELSE 0 END),
    struct_pack(code := 'kv_cache_pressure', st := CASE WHEN v >= 90 THEN 3 WHEN v >= 80 THEN 2 ELSE 0 END), struct_pack(code := 'waiting_queue_pressure', st := CASE WHEN id % 7 >= 5 THEN 3 WHEN id % 7 >= 1 THEN 2 ELSE 0 END),
    struct_pack(code := 'swapped_request_pressure', st := CASE WHEN id % 4 >= 3 THEN 3 WHEN id % 4 >= 1 THEN 2 ELSE 0 END), struct_pack(code := 'preemption_pressure', st := CASE WHEN id % 12 >= 10 THEN 3 WHEN id % 12 >= 1 THEN 2 ELSE 0 END),
    struct_pack(code := 'ttft_latency', st := CASE WHEN id % 5 = 0 THEN -1 WHEN v / 10 >= 5 THEN 3 WHEN v / 10 >= 2 THEN 2 ELSE 0 END), struct_pack(code := 'e2e_latency', st := CASE WHEN v >= 60 THEN 3 WHEN v >= 30 THEN 2 ELSE 0 END)], lambda x: x.st > 0) AS bad FROM m)
SELECT provider, id AS snapshot_id, CASE WHEN id IS NULL THEN 'unknown' ELSE ['ok', 'unknown', 'warning', 'critical'][coalesce(list_max(list_transform(bad, lambda x: x.st)), 0) + 1] END AS status,
    CASE WHEN id IS NULL THEN 'no_runtime_snapshot' ELSE array_to_string(list_transform(bad, lambda x: x.code), ',') END AS reason_codes FROM c
"""
)
def runtime_readiness(read):
    """Users as providers with their latest event as a snapshot; most customers have none."""
    i, v = F.col("event_id"), F.col("value")
    snapshots = read("events").select(
        F.col("user_id").alias("provider"), i.alias("snapshot_id"), F.col("ts").alias("sampled_at"), (i % 3).alias("vllm_metric_count"), v.alias("kv_cache_usage_percent"), (i % 7).alias("waiting_requests"), (i % 4).alias("swapped_requests"),
        (i % 12).alias("num_preemptions_total"), F.when(i % 5 != 0, v / 10).alias("average_time_to_first_token_seconds"), v.alias("average_e2e_request_latency_seconds"),
    )
    found = ops.runtime_readiness(read("customer").select(F.col("c_custkey").alias("provider")), snapshots, F.lit("2024-01-30 20:00:00").cast("timestamp"))
    return found.select("provider", "snapshot_id", "status", F.array_join("reason_codes", ",").alias("reason_codes"))


@query(
    """
SELECT 'positive_ids' AS rule, (SELECT count(*) FROM labels WHERE doc_id - 20 <= 0 OR doc_id % 10 <= 0) AS n
UNION ALL SELECT 'grade_range', (SELECT count(*) FROM labels WHERE quality + toxic * 3 > 3)
UNION ALL SELECT 'unique_ranks', (SELECT count(*) FROM (SELECT user_id, hour(ts) FROM events GROUP BY ALL HAVING count(*) > 1))
"""
)
def target_violations(read):
    """Labels as targets with some ids and grades that are not allowed, hours of users' events as ranks."""
    targets = read("labels").select((F.col("doc_id") - 20).alias("question_id"), (F.col("doc_id") % 10).alias("chunk_id"), (F.col("quality") + F.col("toxic") * 3).alias("grade"))
    return evaluate.target_violations(targets, read("events").select(F.col("user_id").alias("question_id"), F.hour("ts").alias("rank")))


# --- permissions ---


def _units(read) -> DataFrame:
    """Region r is unit 1000 + r below unit 999; nation n is unit n below its region."""
    n = read("nation").select(F.col("n_nationkey").cast("long").alias("unit_id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"))
    r = read("region").select((F.col("r_regionkey") + 1000).cast("long").alias("unit_id"), F.lit(999).cast("long").alias("parent_id"))
    return n.union(r).union(n.sparkSession.sql("SELECT 999L, CAST(NULL AS BIGINT)"))


_UNITS_CTE = """units AS (SELECT n_nationkey::BIGINT AS unit_id, (n_regionkey + 1000)::BIGINT AS parent_id FROM nation UNION ALL SELECT (r_regionkey + 1000)::BIGINT, 999 FROM region UNION ALL SELECT 999, NULL),
up(unit_id, ancestor_id, depth) AS (SELECT unit_id, unit_id, 0::BIGINT FROM units UNION ALL SELECT up.unit_id, u.parent_id, depth + 1 FROM up JOIN units u ON up.ancestor_id = u.unit_id WHERE u.parent_id IS NOT NULL)"""


@query(f"WITH RECURSIVE {_UNITS_CTE} SELECT * FROM up")
def org_closure(read):
    return permission.org_closure(_units(read))


@query(f"WITH RECURSIVE {_UNITS_CTE} SELECT unit_id, max(depth) AS depth, string_agg(ancestor_id::VARCHAR, '/' ORDER BY depth DESC) AS path FROM up GROUP BY 1")
def org_paths(read):
    return permission.org_paths(_units(read))


def _permission_inputs(read):
    closure = permission.org_closure(_units(read))
    role = F.when(F.col("c_custkey") % 50 == 0, "admin").when(F.col("c_custkey") % 10 == 0, "group_lead").otherwise("member")
    unit = F.when(role == "group_lead", 1000 + F.col("c_nationkey") % 5).otherwise(F.col("c_nationkey")).cast("long")
    memberships = read("customer").select(F.col("c_custkey").alias("user_id"), role.alias("role_name"), unit.alias("unit_id"), F.lit(True).alias("is_primary"), F.col("c_custkey").alias("membership_id"))
    users = read("customer").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("is_active"))
    scope = F.element_at(F.array(*map(F.lit, ("personal", "team", "org_tree", "company"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    owner_unit = F.when(F.col("s_suppkey") % 3 == 0, 1000 + F.col("s_nationkey") % 5).otherwise(F.col("s_nationkey")).cast("long")
    documents = read("supplier").select(F.col("s_suppkey").alias("document_id"), F.col("s_suppkey").alias("owner_user_id"), owner_unit.alias("owner_unit_id"), scope.alias("access_scope"))
    requests = users.select("user_id", F.element_at(F.array(*map(F.lit, permission.SCOPES)), (F.col("user_id") % 4 + 1).cast("int")).alias("requested_scope"))
    return documents, requests, permission.grants(permission.actors(users, memberships, closure), requests, closure, memberships)


_VISIBLE_CTE = f"""{_UNITS_CTE},
mem AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 10 = 0 THEN 'group_lead' ELSE 'member' END AS role_name,
    (CASE WHEN c_custkey % 10 = 0 AND c_custkey % 50 <> 0 THEN 1000 + c_nationkey % 5 ELSE c_nationkey END)::BIGINT AS unit_id, ['personal', 'team', 'managed_org', 'company'][c_custkey % 4 + 1] AS requested_scope FROM customer),
act AS (SELECT mem.*, CASE role_name WHEN 'admin' THEN (SELECT min(ancestor_id) FROM up WHERE up.unit_id = mem.unit_id) WHEN 'group_lead' THEN unit_id END AS managed_root FROM mem),
req AS (SELECT *, CASE WHEN requested_scope = 'managed_org' AND managed_root IS NULL THEN 'team' ELSE requested_scope END AS effective_scope FROM act),
doc AS (SELECT s_suppkey AS document_id, s_suppkey AS owner_user_id, (CASE WHEN s_suppkey % 3 = 0 THEN 1000 + s_nationkey % 5 ELSE s_nationkey END)::BIGINT AS owner_unit_id, ['personal', 'team', 'org_tree', 'company'][s_suppkey % 4 + 1] AS access_scope FROM supplier),
man AS (SELECT user_id, up.unit_id AS managed_unit FROM req JOIN up ON up.ancestor_id = managed_root),
vis AS (
    SELECT req.user_id, requested_scope, effective_scope, document_id FROM req, doc
    WHERE (role_name = 'admin' AND effective_scope = 'company') OR access_scope = 'company' OR (access_scope = 'personal' AND owner_user_id = req.user_id)
        OR (effective_scope IN ('team', 'managed_org', 'company') AND access_scope = 'team' AND owner_unit_id = req.unit_id)
        OR (effective_scope IN ('team', 'managed_org', 'company') AND access_scope = 'org_tree' AND EXISTS (SELECT 1 FROM up WHERE up.unit_id = req.unit_id AND up.ancestor_id = owner_unit_id))
        OR (effective_scope IN ('managed_org', 'company') AND access_scope = 'personal' AND EXISTS (SELECT 1 FROM man JOIN mem m ON m.unit_id = managed_unit WHERE man.user_id = req.user_id AND m.user_id = owner_user_id))
        OR (effective_scope IN ('managed_org', 'company') AND access_scope IN ('team', 'org_tree') AND EXISTS (SELECT 1 FROM man WHERE man.user_id = req.user_id AND managed_unit = owner_unit_id))
)"""


@query(f"WITH RECURSIVE {_VISIBLE_CTE} SELECT * FROM vis")
def visible_documents(read):
    documents, _, granted = _permission_inputs(read)
    return permission.visible_documents(documents, granted)


@query(
    f"""WITH RECURSIVE {_VISIBLE_CTE}, c AS (SELECT access_scope, count(*) AS candidate_count FROM doc GROUP BY 1), s AS (SELECT user_id, access_scope, count(*) AS visible_count FROM vis JOIN doc USING (document_id) GROUP BY ALL)
SELECT user_id, requested_scope, access_scope, candidate_count, coalesce(visible_count, 0) AS visible_count FROM (SELECT DISTINCT user_id, requested_scope FROM vis) CROSS JOIN c LEFT JOIN s USING (user_id, access_scope)"""
)
def scope_explanation(read):
    documents, _, granted = _permission_inputs(read)
    return permission.scope_explanation(granted, documents)


@query(
    f"""WITH RECURSIVE {_VISIBLE_CTE}, res AS (SELECT ps.part AS chunk_id, ps.part % 100 + 1 AS document_id, row_number() OVER (ORDER BY ps.part) AS rank FROM (SELECT p_partkey AS part FROM part) ps),
m AS (SELECT user_id, requested_scope, count(*) AS result_count, count(DISTINCT chunk_id) AS chunk_count, min_by(chunk_id, rank) AS top_chunk_id FROM res JOIN vis USING (document_id) GROUP BY ALL)
SELECT req.user_id, req.requested_scope, coalesce(result_count, 0) AS result_count, coalesce(chunk_count, 0) AS chunk_count, top_chunk_id FROM req LEFT JOIN m USING (user_id, requested_scope)"""
)
def permission_matrix(read):
    documents, requests, granted = _permission_inputs(read)
    chunks = read("part").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_partkey") % 100 + 1).alias("document_id"))
    results = chunks.select("chunk_id", F.col("chunk_id").alias("rank"), F.lit(1).alias("query_id"))
    return permission.permission_matrix(results, requests, granted, chunks.join(documents, "document_id"))


# --- answers ---


@query(
    """SELECT conv_id, turn, CASE WHEN lower(text) SIMILAR TO '.*(보고서|제안서|요약서|작성|생성|draft|proposal|report).*' THEN 'document_generation'
    WHEN regexp_matches(lower(text), '요약|summarize|summary') AND regexp_matches(lower(text), '검색|찾아|찾기|관련 문서|search|retrieve') THEN 'document_search_summary' WHEN regexp_matches(lower(text), '요약|summarize|summary') THEN 'document_summary'
    WHEN regexp_matches(lower(text), '근거|규정|정책|사규|문서 기준|based on|citation|검색|찾아|찾기|관련 문서|search|retrieve') THEN 'grounded_answer' ELSE 'general_answer' END AS intent,
    CASE WHEN regexp_matches(lower(text), '보고서|제안서|요약서|작성|생성|draft|proposal|report') THEN 0.88 WHEN regexp_matches(lower(text), '요약|summarize|summary') AND regexp_matches(lower(text), '검색|찾아|찾기|관련 문서|search|retrieve') THEN 0.84
    WHEN regexp_matches(lower(text), '요약|summarize|summary') THEN 0.80 WHEN regexp_matches(lower(text), '근거|규정|정책|사규|문서 기준|based on|citation|검색|찾아|찾기|관련 문서|search|retrieve') THEN 0.76 ELSE 0.55 END::DOUBLE AS confidence FROM conversations"""
)
def intent_route(read):
    name, sure = answers.intent(F.col("text"))
    return read("conversations").select("conv_id", "turn", name.alias("intent"), sure.alias("confidence"))


def _answers(read) -> DataFrame:
    """Turns as answers: every third cites, guardrails and provider errors by turn."""
    c = read("conversations")
    cited = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("[RCP-001] "), F.col("text"))).when(F.col("conv_id") % 3 == 1, F.concat(F.col("text"), F.lit(" [RCP-002][RCP-009]"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", cited.alias("answer_text"), F.array(F.lit("RCP-001"), F.lit("RCP-002")).alias("expected_keys"), F.when(F.col("turn") == 2, "no_answer").otherwise("ok").alias("guardrail_status"), (F.col("turn") == 3).alias("provider_error"))


@query(
    """
WITH a AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN '[RCP-001] ' || text WHEN 1 THEN text || ' [RCP-002][RCP-009]' ELSE text END AS t FROM conversations),
b AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS recognized, CASE conv_id % 3 WHEN 1 THEN 1 ELSE 0 END AS unrecognized, trim(t) <> '' AS present,
    regexp_matches(lower(t), '답변할 수 없습니다|확인할 수 없습니다|알 수 없습니다|insufficient context|cannot answer|not enough information') AS noans FROM a)
SELECT conv_id, turn, recognized * 50.0::DOUBLE AS coverage_percent, CASE WHEN turn = 3 THEN 'not_evaluated'
    WHEN NOT present OR (turn = 2 AND present AND NOT noans) OR (turn <> 2 AND noans) OR (turn <> 2 AND recognized = 0) THEN 'failed'
    WHEN (turn = 2 AND conv_id % 3 < 2) OR (turn <> 2 AND (recognized = 1 OR unrecognized = 1)) THEN 'warning' ELSE 'passed' END AS quality_status FROM b
"""
)
def answer_quality(read):
    return answers.answer_quality(_answers(read)).select("conv_id", "turn", "coverage_percent", "quality_status")


def _compared(read) -> tuple[DataFrame, DataFrame]:
    """Searches as logs: four profiles each, of which one failed in every tenth search."""
    results = search.compare(_vector_queries(read), _chunks(read), _vectors(read), 10, ["vector_cosine", "bm25_keyword", "hybrid_keyword_vector"]).withColumnRenamed("query_id", "log_id")
    names = F.array(*map(F.lit, ("vector_cosine", "bm25_keyword", "hybrid_keyword_vector")))
    profiles = _vector_queries(read).select(F.col("query_id").alias("log_id"), F.posexplode(names).alias("position", "profile_name"))
    return profiles.withColumn("failed", (F.col("log_id") % 10 == 0) & (F.col("position") == 1)), results


_CONFIDENCE_CTE = f"""{_FUSED_CTE},
top AS (
    SELECT query_id AS log_id, 'vector_cosine' AS profile_name, 0 AS position, count(*) AS n, min_by(chunk_id, rank) AS top_chunk_id, max(score) >= 0.5 AS ok, ['weak_vector_score'] AS why FROM vr WHERE rank <= 10 GROUP BY 1
    UNION ALL SELECT kw.query_id, 'bm25_keyword', 1, count(*), min_by(chunk_id, rank), max(score) >= 0.01, ['weak_bm25_score'] FROM kw JOIN embeddings ON vec_id = kw.query_id WHERE rank <= 10 GROUP BY 1
    UNION ALL SELECT query_id, 'hybrid_keyword_vector', 2, count(*), min_by(chunk_id, rank), max_by(source_count >= 2 OR coalesce(vector_score >= 0.5, false) OR coalesce(keyword_score >= 0.01, false), -rank), ['single_hybrid_source', 'weak_vector_score', 'weak_keyword_score'] FROM rrf WHERE rank <= 10 GROUP BY 1
),
pf AS (SELECT log_id, profile_name, position, log_id % 10 = 0 AND position = 1 AS failed, n, top_chunk_id, ok, why FROM top),
pa AS (SELECT log_id, profile_name, CASE WHEN failed THEN 'failed' WHEN ok THEN 'answerable' ELSE 'low_confidence' END AS confidence_status, CASE WHEN failed THEN 0 ELSE n END AS result_count,
    CASE WHEN NOT failed THEN top_chunk_id END AS top_chunk_id, CASE WHEN failed THEN 'profile_failed' WHEN ok THEN '' ELSE array_to_string(why, ',') END AS reasons FROM pf)"""


@query(f"WITH {_CONFIDENCE_CTE} SELECT * FROM pa")
def profile_confidence(read):
    found = answers.profile_confidence(*_compared(read))
    return found.select("log_id", "profile_name", "confidence_status", "result_count", "top_chunk_id", F.array_join("reason_codes", ",").alias("reasons"))


@query(
    f"""WITH {_CONFIDENCE_CTE} SELECT log_id, CASE WHEN bool_or(confidence_status = 'answerable') THEN 'answerable' WHEN sum(result_count) > 0 THEN 'low_confidence' ELSE 'no_context' END AS confidence_status, count(*) AS profile_count, sum(result_count)::BIGINT AS result_count,
    count(*) FILTER (WHERE confidence_status = 'answerable') AS answerable_profiles, count(*) FILTER (WHERE confidence_status = 'failed') AS failed_profiles FROM pa GROUP BY 1"""
)
def overall_confidence(read):
    found = answers.overall_confidence(answers.profile_confidence(*_compared(read)))
    return found.select("log_id", "confidence_status", "profile_count", "result_count", "answerable_profiles", "failed_profiles")


def _context_rows(read) -> DataFrame:
    _, results = _compared(read)
    w = Window.partitionBy("log_id").orderBy("profile_name", "rank", "chunk_id")
    rows = results.withColumn("result_id", F.row_number().over(w).cast("long")).join(_chunks(read).select("chunk_id", "text", "source", "lang"), "chunk_id", "left")
    return rows.select("log_id", "result_id", "profile_name", "rank", "chunk_id", F.concat(F.lit("Document "), F.col("chunk_id")).alias("title"), F.col("source").alias("source_label"), F.col("lang").alias("heading"), "text", F.lit("answerable").alias("confidence_status"))


@query()
def context_package(read):
    return answers.context_packages(_context_rows(read))


def _citations(read) -> DataFrame:
    rows = answers.context_packages(_context_rows(read))
    yes = F.lit(True)
    c = {"included": F.col("included"), "citation_key": F.col("citation_key"), "context_text": F.col("context_text"), "truncated": F.col("truncated"), "has_document": yes, "has_chunk": yes, "has_anchor": F.lit(False), "has_location": F.col("chunk_id") % 2 == 0, "has_lineage": F.col("chunk_id") % 3 == 0}
    issues = answers.citation_issues(c)
    return rows.select("log_id", "chunk_id", "included", (c["has_location"] | c["has_lineage"]).alias("anchored"), F.size(issues).cast("long").alias("issue_count"), answers.citation_status(issues).alias("citation_status"))


@query()
def citation_readiness(read):
    return answers.citation_readiness(_citations(read))


@query(
    """WITH a AS (SELECT l_orderkey AS log_id, l_linenumber <= 3 AS included, CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'R' THEN 'warning' ELSE 'ready' END AS s, l_linestatus = 'O' AS anchored, l_linenumber % 3 AS issues FROM lineitem),
c AS (SELECT log_id, count(*) AS candidate_count, count(*) FILTER (WHERE included) AS included_count, count(*) FILTER (WHERE s = 'ready') AS ready_count, count(*) FILTER (WHERE s = 'warning') AS warning_count, count(*) FILTER (WHERE s = 'failed') AS failed_count, count(*) FILTER (WHERE included AND anchored) AS n, sum(issues)::BIGINT AS issue_count FROM a GROUP BY 1)
SELECT log_id, CASE WHEN failed_count > 0 OR included_count = 0 THEN 'failed' WHEN warning_count > 0 THEN 'warning' ELSE 'ready' END AS package_status, candidate_count, included_count, ready_count, warning_count, failed_count,
    CASE WHEN included_count > 0 THEN round(n * 100.0::DOUBLE / included_count, 2) ELSE 0 END AS anchor_percent, round(ready_count * 100.0::DOUBLE / candidate_count, 2) AS ready_percent, issue_count FROM c"""
)
def citation_rates(read):
    """Order lines as assessed candidates of their order's package."""
    li = read("lineitem")
    status = F.when(F.col("l_returnflag") == "A", "failed").when(F.col("l_returnflag") == "R", "warning").otherwise("ready")
    assessed = li.select(F.col("l_orderkey").alias("log_id"), (F.col("l_linenumber") <= 3).alias("included"), status.alias("citation_status"), (F.col("l_linestatus") == "O").alias("anchored"), (F.col("l_linenumber") % 3).cast("long").alias("issue_count"))
    return answers.citation_readiness(assessed)


# --- parsing, chunking, sources ---


@query(
    """SELECT conv_id, turn, text, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def neighbours(read):
    return chunking.neighbours(read("conversations"), "conv_id", "turn", "text")


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS token_count, sha256(text) AS content_hash FROM documents"""
)
def token_counts(read):
    return read("documents").select("doc_id", tx.token_count(F.col("text")).alias("token_count"), tx.content_hash(F.col("text")).alias("content_hash"))


@query(
    """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(substr(t, 1, 239)) || '...' END AS search_preview, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(substr(t, 1, 219)) || '...' END AS context_preview FROM f"""
)
def previews(read):
    return read("documents").select("doc_id", tx.search_preview(F.col("text")).alias("search_preview"), tx.context_preview(F.col("text")).alias("context_preview"))


@query(
    """SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1) AS block_seq, trim(line) AS block_text, k AS start_line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents) WHERE trim(line) <> ''"""
)
def line_blocks(read):
    return chunking.parse(read("documents"), "lines", "doc_id").select("document_id", "block_seq", "block_text", "start_line")


@query()
def chunks_by_size(read):
    found = chunking.chunk_documents(read("documents"), [chunking.POLICIES["heading_512_64"]], "lines", "doc_id")
    return found.drop("start_char", "end_char", "page", "slide", "sheet", "cell_range", "block_seqs")


_ONE_CHUNK_SQL = """WITH l AS (SELECT doc_id, trim(line) AS t, k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents) WHERE trim(line) <> '')
SELECT doc_id AS document_id, max(k)::BIGINT AS last_line, count(*) AS blocks, sum(len(regexp_extract_all(t, '[^\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}]+')))::BIGINT AS tokens FROM l GROUP BY 1 HAVING tokens <= 1000 OR blocks = 1"""


def _one_chunk(chunks: DataFrame) -> DataFrame:
    """Documents that are one chunk, with its last line, blocks and tokens."""
    whole = chunks.groupBy("document_id").agg(F.max("end_line").alias("last_line"), F.count("*").alias("chunks"), F.max(F.size("block_seqs")).cast("long").alias("blocks"), F.max("token_count").alias("tokens"))
    return whole.where("chunks = 1").drop("chunks")


@query(_ONE_CHUNK_SQL)
def chunk_anchors(read):
    """Documents that are one chunk, as they fit it or are one block, however long: it reaches from their first to their last line and names all their blocks."""
    return _one_chunk(chunking.chunk_documents(read("documents"), [chunking.POLICIES["heading_1000_200"]], "lines", "doc_id"))


@query(_ONE_CHUNK_SQL)
def chunk_anchors_by_sql(read):
    """``chunk_anchors`` from one SQL statement over the table functions."""
    docs = read("documents")
    spark = docs.sparkSession
    table_functions.register(spark)
    blocks = spark.sql("SELECT d.doc_id AS document_id, b.* FROM {docs} d, LATERAL text_blocks(d.text, 'lines') b", docs=docs)
    return _one_chunk(spark.sql("SELECT * FROM block_chunks(TABLE(SELECT * FROM {blocks}) PARTITION BY document_id ORDER BY (block_seq), 'heading_1000_200')", blocks=blocks))


@query()
def markdown_blocks(read):
    """Documents with their first line as a heading, through the Markdown reader."""
    marked = F.concat(F.lit("# "), F.regexp_replace("text", "\n", "\n\n"))
    return chunking.parse(read("documents").select("doc_id", marked.alias("text")), "markdown", "doc_id")


@query()
def html_blocks(read):
    return files.html_pages(read("pages"))


_HANGUL_SQL = """
WITH w AS (SELECT item_id, unnest(t) AS term, unnest(range(len(t))) AS p FROM (SELECT item_id, regexp_extract_all(replace(lower('업무보고서는 검색 기능, ' || text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS t FROM benchmark)),
r AS (SELECT item_id, p, term, unnest(regexp_extract_all(term, '[가-힣]+')) AS run, unnest(range(len(regexp_extract_all(term, '[가-힣]+')))) AS rn FROM w),
g AS (SELECT item_id, p, term, rn, n, k, run[k:k + n - 1] AS gram FROM (SELECT *, unnest(range(1, len(run) - n + 2)) AS k FROM r, (VALUES (2), (3)) s(n) WHERE len(run) >= n)),
a AS (SELECT item_id, p, -1 AS rn, 0 AS n, 0 AS k, term FROM w UNION ALL SELECT item_id, p, rn, n, k, gram FROM g WHERE gram <> term)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY p, rn, n, k) - 1 AS pos, term FROM a"""


@query(_HANGUL_SQL)
def hangul_ngrams(read):
    mixed = F.concat_ws(" ", F.lit("업무보고서는 검색 기능,"), F.col("text"))
    return read("benchmark").select("item_id", F.posexplode(tx.words_and_hangul_grams(mixed)).alias("pos", "term"))


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def keyed_upsert(read):
    current = read("customer").select("c_custkey", F.col("c_acctbal").alias("acctbal"))
    return tables.upserted(current, read("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("acctbal")), ["c_custkey"])


@query("SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + coalesce(n, 0) AS seq FROM supplier LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = s_nationkey")
def sequence_append(read):
    current = read("customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("seq"))
    return tables.appended_in_sequence(current, read("supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "seq", ["s_suppkey"]).select("s_suppkey", "s_nationkey", "seq")


@query("SELECT item_id AS question_id, text AS question_text, (SELECT count(*) FROM labels WHERE doc_id = item_id) AS target_count FROM benchmark")
def question_exchange(read):
    questions = read("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question_text"))
    targets = read("labels").join(F.broadcast(questions.select(F.col("question_id").alias("doc_id"))), "doc_id").select(F.col("doc_id").alias("question_id"), F.col("doc_id").alias("chunk_id"), F.col("quality").cast("int").alias("grade"), F.lit("visible").alias("expectation"))
    q, t = tables.imported_questions(tables.exported_questions(questions, targets, "items"))
    counted = t.groupBy("question_id").agg(F.count("*").alias("target_count"))
    return q.join(counted, "question_id", "left").select("question_id", "question_text", F.coalesce("target_count", F.lit(0)).alias("target_count"))


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(read):
    found = job_stream.windowed_counts(read("events").withColumnRenamed("ts", "at"), "1 day")
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


# --- histories and audits ---


def _runs(read) -> DataFrame:
    e = read("events")
    number = (F.col("event_id") % 700).cast("string")
    meta = F.concat(F.lit('{"document_id": "'), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("-"), number)).otherwise(number), F.lit('"}'))
    return e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("mode"), F.col("ts").alias("created_at"), F.col("value").alias("elapsed_ms"), F.get_json_object("props", "$.k").cast("double").alias("tokens"), "props", meta.alias("metadata"))


def _status():
    return answers_history.json_status(F.col("props"), "$.status", "$.k")


@query("SELECT event_id AS run_id, event_type AS mode, coalesce(json_extract_string(props, '$.status'), json_extract_string(props, '$.k'), 'unknown') AS run_status FROM events WHERE event_type = 'click'")
def generation_history(read):
    return answers_history.run_history(_runs(read), _status(), mode="click").select("run_id", "mode", "run_status")


@query(
    """WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000) SELECT event_type AS mode, count(*) AS run_count, count(*) FILTER (WHERE value > 5) AS succeeded_count, round(avg(value), 6) AS mean_elapsed_ms, round(avg(json_extract_string(props, '$.k')::DOUBLE), 6) AS mean_tokens FROM r GROUP BY 1"""
)
def provider_metrics(read):
    return answers_history.provider_metrics(_runs(read).withColumn("run_status", F.when(F.col("elapsed_ms") > 5, "succeeded").otherwise("failed")), 2000)


@query("SELECT count(*) AS document_count, count(*) FILTER (WHERE doc_id IN (SELECT event_id % 700 FROM events WHERE event_id % 5 <> 0 AND value > 5)) AS summarized_count FROM documents WHERE length(trim(text)) > 0")
def summary_readiness(read):
    runs = _runs(read).withColumn("run_status", F.when(F.col("elapsed_ms") > 5, "succeeded").otherwise("failed"))
    return answers_history.summary_readiness(read("documents").select(F.col("doc_id").alias("document_id"), "text"), runs)


@query(
    f"""WITH RECURSIVE {_VISIBLE_CTE}, res AS (SELECT c_custkey AS user_id, c_custkey % 7 AS question_id, 1::BIGINT AS rank, c_custkey % 100 + 1 AS chunk_id FROM customer)
SELECT user_id, question_id, rank, chunk_id, chunk_id AS document_id, EXISTS (SELECT 1 FROM vis WHERE vis.user_id = res.user_id AND vis.document_id = chunk_id) AS is_visible FROM res WHERE chunk_id IN (SELECT s_suppkey FROM supplier)"""
)
def permission_audit(read):
    documents, _, granted = _permission_inputs(read)
    results = read("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 7).alias("question_id"), F.lit(1).cast("long").alias("rank"), (F.col("c_custkey") % 100 + 1).alias("chunk_id"))
    return answers_history.permission_audit(results, documents.withColumn("chunk_id", F.col("document_id")), granted)


@query("SELECT user_id, CASE WHEN count(*) <> count(*) FILTER (WHERE event_type = 'view') + count(*) FILTER (WHERE event_type = 'click') THEN 'sum_differs' END AS violation FROM events GROUP BY 1 HAVING violation IS NOT NULL")
def count_violations(read):
    runs = read("events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    return answers_history.count_violations(runs, "total", ["a", "b"]).select("user_id", "violation")


@query("SELECT DISTINCT user_id AS result_id, CASE WHEN user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey > 3) THEN 'missing' WHEN user_id IN (SELECT s_suppkey FROM supplier) THEN 'already_promoted' ELSE 'promoted' END AS outcome FROM events")
def promotions(read):
    chosen = read("events").select(F.col("user_id").alias("result_id"))
    return answers_history.promoted(chosen, read("customer").where("c_nationkey > 3").select(F.col("c_custkey").alias("result_id")), read("supplier").select(F.col("s_suppkey").alias("result_id")))


@query(
    """WITH p AS (SELECT unnest(['a', 'b']) AS profile), e AS (SELECT DISTINCT doc_id, CASE WHEN quality = 1 THEN 'a' ELSE 'b' END AS profile FROM labels)
SELECT lang AS policy, p.profile AS profile, count(*) AS chunk_count, count(e.doc_id) AS embedded_count, count(*) = count(e.doc_id) AS is_ready FROM documents d CROSS JOIN p LEFT JOIN e ON e.doc_id = d.doc_id AND e.profile = p.profile GROUP BY 1, 2"""
)
def search_readiness(read):
    chunks = read("documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("lang").alias("policy"))
    embedded = read("labels").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, "a").otherwise("b").alias("profile"))
    return answers_history.search_readiness(chunks, embedded, chunks.sparkSession.sql("SELECT explode(array('a', 'b')) AS profile"))


@query("SELECT conv_id AS session_id, turn AS seq, text AS content FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_user_turn(read):
    m = read("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    return answers_history.last_turn(m, "user").select("session_id", "seq", "content")


@query("SELECT conv_id AS session_id, count(*) AS n, string_agg(role || ':' || turn, ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1")
def chat_threads(read):
    m = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    links = m.select("message_id", F.lit("source").alias("link_type"), F.col("seq").alias("target_id"))
    found = answers_history.threads(m, links)
    return found.select("session_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["role"], x["seq"].cast("string"))), ",").alias("turns"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM benchmark) AS questions, (SELECT count(*) FROM events WHERE event_type = 'error') AS failures")
def dashboard_counts(read):
    return answers_history.dashboard({"documents": read("documents"), "embeddings": read("embeddings"), "questions": read("benchmark"), "failures": read("events").where("event_type = 'error'")})


_ALL_FAILURES_SQL = """
WITH n AS (SELECT l_orderkey, count(*) AS n, list(l_linenumber ORDER BY l_shipdate DESC, l_linenumber DESC)[1] AS latest FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_orderdate::DATE::VARCHAR AS day, o_custkey AS c, o_orderstatus AS st FROM orders),
g AS (SELECT event_id AS k, ts::DATE::VARCHAR AS day, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'CRITICAL' ELSE 'ERROR' END ELSE 'INFO' END AS level,
    CASE event_id % 4 WHEN 0 THEN 'embedding_provider_route_health_alert' WHEN 1 THEN 'embedding_provider_route_contract_alert' ELSE event_type END AS kind, event_id % 5 = 0 AS seen FROM events)
SELECT 'pipeline' AS source, k::VARCHAR AS reference_id, 'Pipeline job #' || k AS title, CASE st WHEN 'P' THEN 'warning' ELSE 'error' END AS severity, CASE st WHEN 'P' THEN 'canceled' ELSE 'failed' END AS status, day, c AS document_id, least(coalesce(n, 0), 10) AS event_count, latest AS latest_event
FROM o LEFT JOIN n ON l_orderkey = k WHERE st IN ('P', 'F')
UNION ALL SELECT 'embedding', k::VARCHAR, 'Embedding job #' || k, 'error', 'failed', day, c, 0, NULL FROM o WHERE st = 'F'
UNION ALL SELECT 'parsing', p_partkey::VARCHAR, p_name, 'warning', 'failed', '2024-01-05', d, 0, NULL FROM part LEFT JOIN (SELECT doc_id // 2 AS f, min(doc_id) AS d FROM documents GROUP BY 1) ON f = p_partkey WHERE p_size % 4 = 0
UNION ALL SELECT 'app_log', k::VARCHAR, kind, lower(level), CASE WHEN seen THEN 'acknowledged' ELSE level END, day, NULL, 0, NULL FROM g WHERE level <> 'INFO' AND kind NOT LIKE 'embedding_%'
UNION ALL SELECT 'provider_alert', k::VARCHAR, kind, lower(level), CASE WHEN seen THEN 'acknowledged' ELSE 'unacknowledged' END, day, NULL, 0, NULL FROM g WHERE kind LIKE 'embedding_%'
"""


@query(_ALL_FAILURES_SQL)
def all_failures(read):
    """Failures of five sources: orders as jobs, lines as their events, parts as files, events as logs."""
    text, o, i = F.lit(None).cast("string"), read("orders"), F.col("event_id")
    status = F.when(F.col("o_orderstatus") == "P", "canceled").when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded")
    day = F.col("o_orderdate")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), day.alias("finished_at"), day.alias("updated_at"), day.alias("queued_at"), day.alias("last_error_at"), day.alias("created_at"), text.alias("error_message"), F.col("o_custkey").alias("document_id"))
    events = read("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("event_id"), F.col("l_shipdate").alias("created_at"), F.col("l_linestatus").alias("event_type"))
    files_ = read("part").select(F.col("p_partkey").alias("file_id"), F.col("p_name").alias("original_file_name"), F.when(F.col("p_size") % 4 == 0, "failed").otherwise("succeeded").alias("parse_status"), text.alias("parse_error_message"), F.lit("2024-01-05").cast("timestamp").alias("updated_at"))
    documents = read("documents").select(F.floor(F.col("doc_id") / 2).alias("file_id"), F.col("doc_id").alias("document_id"))
    level = F.when(F.col("event_type") == "error", F.when(i % 3 == 0, "CRITICAL").otherwise("ERROR")).otherwise("INFO")
    kind = F.when(i % 4 == 0, ops.ALERTS[0]).when(i % 4 == 1, ops.ALERTS[1]).otherwise(F.col("event_type"))
    logged = read("events").select(i.alias("log_id"), level.alias("level"), kind.alias("event_type"), F.when(i % 5 == 0, F.col("ts")).alias("acknowledged_at"), text.alias("message"), F.col("ts").alias("occurred_at"))
    found = ops.all_failures(jobs, events, jobs.where("status <> 'canceled'"), files_, documents, logged)
    return found.select("source", "reference_id", "title", "severity", "status", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), "document_id", F.size("events").cast("long").alias("event_count"), F.get("events", F.lit(0))["event_id"].alias("latest_event"))


@query(
    """WITH j AS (SELECT l_orderkey AS chunk_id, l_returnflag AS profile, max(l_linenumber) AS job_id FROM lineitem GROUP BY ALL), e AS (SELECT DISTINCT l_orderkey AS chunk_id, l_returnflag AS profile FROM lineitem WHERE l_linestatus = 'F')
SELECT o_orderkey AS chunk_id, j.profile AS profile, job_id, e.chunk_id IS NOT NULL AS is_embedded FROM orders LEFT JOIN j ON j.chunk_id = o_orderkey LEFT JOIN e ON e.chunk_id = j.chunk_id AND e.profile = j.profile"""
)
def coverage_detail(read):
    li = read("lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_returnflag").alias("profile"), F.col("l_linenumber").alias("job_id"), F.col("l_linestatus").alias("status"))
    found = answers_history.coverage_detail(read("orders").select(F.col("o_orderkey").alias("chunk_id")), li, li.where("status = 'F'"))
    return found.select("chunk_id", "profile", "job_id", "is_embedded")


@query("SELECT event_id AS log_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '7' AND ts >= TIMESTAMP '2024-01-10 00:00:00'")
def change_history(read):
    e = read("events").select(F.col("event_id").alias("log_id"), "user_id", F.col("ts").alias("created_at"), F.to_json(F.struct(F.get_json_object("props", "$.k").alias("change"))).alias("detail"))
    return answers_history.change_history(e, "7", F.lit("2024-01-10").cast("timestamp")).select("log_id", "user_id")


@query(
    f"""WITH {_FUSED_CTE},
tg AS (SELECT DISTINCT b.item_id AS query_id, l.doc_id AS chunk_id FROM benchmark b JOIN embeddings e ON e.label = b.item_id % 10 JOIN labels l ON l.doc_id = e.vec_id WHERE quality = 1),
r AS (SELECT query_id, 'vector_cosine' AS profile_name, chunk_id FROM vr WHERE rank <= 10 UNION ALL SELECT kw.query_id, 'bm25_keyword', chunk_id FROM kw JOIN embeddings ON vec_id = kw.query_id WHERE rank <= 10 UNION ALL SELECT query_id, 'hybrid_keyword_vector', chunk_id FROM rrf WHERE rank <= 10),
v AS (SELECT query_id, count(*) AS n FROM tg GROUP BY 1),
m AS (SELECT query_id, profile_name, count(*) AS k FROM r JOIN tg USING (query_id, chunk_id) GROUP BY ALL)
SELECT profile_name, count(*) AS question_count, count(n) AS evaluated_count, round(avg(CASE WHEN n > 0 THEN round(coalesce(k, 0) / n::DOUBLE, 6) END), 6) AS mean_recall_at_k
FROM benchmark CROSS JOIN (SELECT unnest(['vector_cosine', 'bm25_keyword', 'hybrid_keyword_vector', 'never_built']) AS profile_name) LEFT JOIN v ON v.query_id = item_id LEFT JOIN m USING (query_id, profile_name) GROUP BY 1"""
)
def batch_metrics(read):
    _, results = _compared(read)
    questions = read("benchmark").select(F.col("item_id").alias("question_id"))
    like = questions.join(read("embeddings"), F.col("label") == F.col("question_id") % 10).join(read("labels"), F.col("doc_id") == F.col("vec_id"))
    targets = like.select("question_id", F.col("doc_id").alias("chunk_id"), F.col("quality").alias("grade"), F.lit("visible").alias("expectation"))
    profiles = read("benchmark").sparkSession.createDataFrame([(p,) for p in ("vector_cosine", "bm25_keyword", "hybrid_keyword_vector", "never_built")], "profile_name string")
    found = evaluate.question_metrics(questions, results.withColumnRenamed("log_id", "question_id"), targets, 10, by=["profile_name"], groups=profiles)
    return evaluate.metric_summary(found, ["profile_name"]).select("profile_name", "question_count", "evaluated_count", "mean_recall_at_k")


# --- keyed tables ---


def _jobs_table(read) -> DataFrame:
    """Orders as embedding jobs: customers are chunks, priorities profiles."""
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded")
    return read("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("chunk_id"), F.col("o_orderpriority").alias("profile_name"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


_ENTITY_JOBS = "ej AS (SELECT o_orderkey AS job_id, o_custkey AS chunk_id, o_orderpriority AS profile_name, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'succeeded' END AS status, o_orderdate AS created_at FROM orders)"


@query(f"WITH {_ENTITY_JOBS} SELECT job_id, chunk_id, profile_name FROM ej WHERE status = 'failed' ORDER BY created_at DESC, job_id DESC LIMIT 100")
def entity_listing(read):
    return entities.listing("embedding_jobs", _jobs_table(read), 100, status="failed").select("job_id", "chunk_id", "profile_name")


@query(f"WITH {_ENTITY_JOBS} SELECT chunk_id, job_id, status, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, job_id DESC) AS rank FROM ej QUALIFY rank <= 3")
def entity_listing_by_group(read):
    return entities.listing_by("embedding_jobs", _jobs_table(read), "chunk_id", 3).select("chunk_id", "job_id", "status", "rank")


@query("SELECT user_id AS file_id, s_nationkey AS parser_id, s_suppkey IS NOT NULL AS is_found FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN supplier ON s_suppkey = user_id")
def entity_lookup(read):
    rows = read("supplier").select(F.col("s_suppkey").alias("file_id"), F.col("s_nationkey").alias("parser_id"))
    return entities.found("files", rows, read("events").select(F.col("user_id").alias("file_id"))).select("file_id", "parser_id", "is_found")


@query("SELECT c_custkey AS chat_session_id, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'closed' END, c_mktsegment) AS status, coalesce(s_acctbal, c_acctbal) AS updated_at FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def entity_changes(read):
    current = read("customer").select(F.col("c_custkey").alias("chat_session_id"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("updated_at"))
    changes = read("supplier").select(F.col("s_suppkey").alias("chat_session_id"), F.when(F.col("s_suppkey") % 2 == 0, "closed").alias("status"), F.col("s_acctbal").alias("updated_at"))
    return entities.changed("chat_sessions", current, changes)


@query("SELECT o_orderkey AS job_id, o_orderstatus FROM orders UNION ALL SELECT p_partkey + 10000000, 'new' FROM part")
def entity_creation(read):
    current = read("orders").select(F.col("o_orderkey").alias("job_id"), "o_orderstatus")
    return entities.created("embedding_jobs", current, read("part").select((F.col("p_partkey") + 10000000).alias("job_id"), F.lit("new").alias("o_orderstatus")))


_ROUTES = "rt AS (SELECT s_suppkey AS route_id, s_nationkey AS profile_name, (s_suppkey * 7) % 5 AS priority, s_acctbal > 0 AS is_active FROM supplier)"


def _routes(read) -> DataFrame:
    """Suppliers as model routes of their nation's profile."""
    return read("supplier").select(F.col("s_suppkey").alias("route_id"), F.col("s_nationkey").alias("profile_name"), (F.col("s_suppkey") * 7 % 5).alias("priority"), (F.col("s_acctbal") > 0).alias("is_active"))


@query(f"WITH {_ROUTES} SELECT profile_name, route_id, priority FROM rt WHERE is_active QUALIFY row_number() OVER (PARTITION BY profile_name ORDER BY priority, route_id) = 1")
def route_selection(read):
    return entities.selected_routes(_routes(read)).select("profile_name", "route_id", "priority")


@query(f"WITH {_ROUTES} SELECT route_id, CASE WHEN route_id = 3 THEN FALSE ELSE is_active END AS is_active FROM rt")
def route_activation(read):
    return entities.activated("routes", _routes(read), 3, False).select("route_id", "is_active")


def _templates(read) -> DataFrame:
    """Customers as generation templates of their segment's language; every eleventh is the default."""
    return read("customer").select(
        F.col("c_custkey").alias("template_key"), F.col("c_mktsegment").alias("language"), F.col("c_nationkey").alias("template_family"), F.lit(1).alias("template_version"), (F.col("c_custkey") % 11 == 0).alias("is_default"), (F.col("c_acctbal") > 0).alias("is_active")
    )


_TEMPLATES = "tp AS (SELECT c_custkey AS template_key, c_mktsegment AS language, c_custkey % 11 = 0 AS is_default, c_acctbal > 0 AS is_active FROM customer)"


@query(f"WITH {_TEMPLATES} SELECT language, min(template_key) AS template_key FROM tp WHERE is_default AND is_active GROUP BY 1")
def template_defaults(read):
    return entities.default_of("generation_templates", _templates(read)).select("language", "template_key")


@query(
    f"""WITH {_TEMPLATES}, k AS (SELECT min(template_key) AS template_key FROM tp WHERE is_active),
g AS (SELECT language FROM tp JOIN k USING (template_key))
SELECT template_key, CASE WHEN language = (SELECT language FROM g) THEN template_key = (SELECT template_key FROM k) ELSE is_default END AS is_default FROM tp"""
)
def template_made_default(read):
    rows = _templates(read)
    key = rows.where("is_active").agg(F.min("template_key")).first()[0]
    return entities.made_default("generation_templates", rows, key).select("template_key", "is_default")


@query(
    f"""WITH {_TEMPLATES}, n AS (SELECT s_suppkey AS template_key, ['AUTOMOBILE', 'BUILDING'][s_suppkey % 2 + 1] AS language, s_suppkey <= 2 AS is_default, TRUE AS is_active FROM supplier),
a AS (SELECT * FROM n UNION ALL SELECT * FROM tp WHERE template_key NOT IN (SELECT template_key FROM n))
SELECT template_key, CASE WHEN language IN ('AUTOMOBILE', 'BUILDING') THEN template_key <= 2 ELSE is_default END AS is_default FROM a"""
)
def template_upsert(read):
    language = F.when(F.col("s_suppkey") % 2 == 0, "AUTOMOBILE").otherwise("BUILDING")
    new = read("supplier").select(F.col("s_suppkey").alias("template_key"), language.alias("language"), (F.col("s_suppkey") <= 2).alias("is_default"), F.lit(True).alias("is_active"))
    current = _templates(read).select("template_key", "language", "is_default", "is_active")
    return entities.stored("generation_templates", current, new).select("template_key", "is_default")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def keyed_delete(read):
    return tables.deleted(read("customer"), read("supplier").select(F.col("s_suppkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("SELECT DISTINCT o_custkey AS chunk_id FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def unknown_references(read):
    return entities.unknown_references(_jobs_table(read), "chunk_id", read("supplier"), "s_suppkey")


@query("SELECT '14' AS retention_days, '1000' AS purge_batch")
def settings_values(read):
    stored = read("region").select(F.when(F.col("r_regionkey") == 0, "retention_days").otherwise("other").alias("key"), F.lit("14").alias("value"))
    return metrics.setting(stored, entities.SETTINGS["search_log_retention"])


@query("SELECT m.conv_id * 100 + m.turn AS chat_message_id, CASE WHEN p.conv_id IS NULL THEN 'missing_parent' WHEN p.conv_id <> m.conv_id THEN 'other_session' END AS problem FROM conversations m LEFT JOIN conversations p ON p.conv_id * 100 + p.turn = m.conv_id * 100 + m.turn + (m.turn % 3) * 50 - 50 WHERE problem IS NOT NULL")
def parent_problems(read):
    c = read("conversations")
    messages = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("chat_message_id"), F.col("conv_id").alias("chat_session_id"), "turn")
    incoming = messages.withColumn("parent_message_id", F.col("chat_message_id") + (F.col("turn") % 3) * 50 - 50)
    return entities.parent_problems(incoming, messages)


@query(f"WITH {_ENTITY_JOBS} SELECT profile_name, count(*) AS pending_count, max(c_nationkey) AS max_token_count, max(length(c_name)) AS max_char_count, min(job_id) AS min_job_id, max(job_id) AS max_job_id FROM ej JOIN customer ON c_custkey = chunk_id WHERE status = 'pending' GROUP BY 1")
def pending_profiles(read):
    chunks = read("customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_nationkey").alias("token_count"), F.length("c_name").alias("char_count"))
    return entities.pending_profiles(_jobs_table(read), chunks)


@query(
    """SELECT user_id AS document_id, count(*) AS snapshot_count, count(*) FILTER (WHERE s = 'passed') AS passed_count, count(*) FILTER (WHERE s = 'warning') AS warning_count, count(*) FILTER (WHERE s = 'failed') AS failed_count,
    arg_max(event_id, (ts, event_id)) AS latest_snapshot_id, arg_max(s, (ts, event_id)) AS latest_status FROM (SELECT *, CASE event_type WHEN 'view' THEN 'passed' WHEN 'click' THEN 'warning' WHEN 'error' THEN 'failed' ELSE 'other' END AS s FROM events) GROUP BY 1"""
)
def quality_summary(read):
    status = F.when(F.col("event_type") == "view", "passed").when(F.col("event_type") == "click", "warning").when(F.col("event_type") == "error", "failed").otherwise("other")
    return entities.quality_summary(read("events").select(F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("document_id"), status.alias("status"), F.col("ts").alias("created_at")))


@query(
    """SELECT event_id AS feedback_id, n_nationkey AS log_id, n_name AS query_text, c_custkey * 2 AS chunk_id, 'purchase' AS comment, r_name AS actor
    FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey > 0 WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 100"""
)
def feedback_comments(read):
    comment = F.when(F.col("event_type") == "purchase", "purchase").when(F.col("event_type") == "click", "  ")
    feedback = read("events").select(F.col("event_id").alias("feedback_id"), F.col("user_id").alias("result_id"), comment.alias("comment"), F.col("ts").alias("created_at"))
    results = read("customer").select(F.col("c_custkey").alias("result_id"), F.col("c_nationkey").alias("log_id"), (F.col("c_custkey") * 2).alias("chunk_id"))
    asked = read("nation").select(F.col("n_nationkey").alias("log_id"), F.col("n_name").alias("query_text"), F.col("n_regionkey").alias("actor_user_id"))
    users = read("region").where("r_regionkey > 0").select(F.col("r_regionkey").alias("actor_user_id"), F.col("r_name").alias("actor"))
    return logs.feedback_comments(feedback, results, asked, users, 100).select("feedback_id", "log_id", "query_text", "chunk_id", "comment", "actor")


@query(
    """SELECT 'embedding:' || o_orderkey AS failure_id, 'error' AS severity, 'failed' AS status, o_orderdate::DATE::VARCHAR AS day, 0::BIGINT AS event_count FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'pipeline:' || o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'warning' ELSE 'error' END, CASE o_orderstatus WHEN 'P' THEN 'canceled' ELSE 'failed' END, o_orderdate::DATE::VARCHAR, least(coalesce(n, 0), 10) FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'P')
    UNION ALL SELECT 'app_log:' || event_id, 'error', 'unacknowledged', ts::DATE::VARCHAR, 0 FROM events WHERE event_type = 'error'"""
)
def failure_details(read):
    o = read("orders")
    status = F.when(F.col("o_orderstatus") == "P", "canceled").when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("finished_at"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderdate").alias("queued_at"), F.lit(None).cast("string").alias("error_message"))
    events = read("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("event_id"), F.col("l_shipdate").alias("created_at"), F.col("l_linestatus").alias("event_type"))
    errors = read("events").where("event_type = 'error'").select(F.col("event_id").alias("log_id"), F.lit("ERROR").alias("level"), F.lit(None).cast("string").alias("acknowledged_by"), F.lit("error").alias("message"), F.col("ts").alias("occurred_at"))
    found = ops.failure_details(jobs, events, jobs.where("status <> 'canceled'"), errors)
    return found.select("failure_id", "severity", "status", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), F.size("events").cast("long").alias("event_count"))


@query(
    """WITH j AS (SELECT l_orderkey AS chunk_id, l_returnflag AS profile, max(l_linenumber) AS job_id FROM lineitem GROUP BY ALL), e AS (SELECT DISTINCT l_orderkey AS chunk_id, l_returnflag AS profile FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber > 1)
SELECT o_orderkey AS chunk_id, p.profile, job_id, e.chunk_id IS NOT NULL AS is_embedded FROM orders CROSS JOIN (SELECT DISTINCT l_returnflag AS profile FROM lineitem) p LEFT JOIN j ON j.chunk_id = o_orderkey AND j.profile = p.profile LEFT JOIN e ON e.chunk_id = o_orderkey AND e.profile = p.profile"""
)
def coverage_cells(read):
    li = read("lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_returnflag").alias("profile"), F.col("l_linenumber").alias("job_id"), F.col("l_linestatus").alias("status"))
    found = answers_history.coverage_cells(read("orders").select(F.col("o_orderkey").alias("chunk_id")), li.select("profile").distinct(), li, li.where("status = 'F' AND job_id > 1"))
    return found.select("chunk_id", "profile", "job_id", "is_embedded")


@query(f"WITH {_COSINE_CTE} SELECT query_id, 'vector_cosine:' || chunk_id AS candidate_key, rank, score AS source_score, d.text AS text FROM vr JOIN documents d ON doc_id = chunk_id WHERE rank <= 10")
def rerank_candidates(read):
    found = vector.vector_topk(_vector_queries(read), _vectors(read), 10).withColumn("profile_name", F.lit("vector_cosine"))
    return fuse.rerank_candidates(found, _chunks(read)).select("query_id", "candidate_key", "rank", "source_score", "text")


@query("SELECT vec_id AS chunk_id, 64 AS dimension FROM embeddings UNION ALL SELECT o_orderkey + 1000000, 64 FROM orders WHERE o_orderkey % 10 = 0")
def embedding_store(read):
    current = _vectors(read).select("chunk_id", "embedding")
    one = F.array_repeat(F.lit(0.5).cast("float"), 64)
    new = read("orders").where("o_orderkey % 10 = 0").select((F.col("o_orderkey") + 1000000).alias("chunk_id"), one.alias("embedding"))
    again = current.where("chunk_id % 2 = 0").select("chunk_id", F.reverse("embedding").alias("embedding"))
    return vector.stored_embeddings(current, new.union(again), vector.Profile("stand_in", 64)).select("chunk_id", F.size("embedding").alias("dimension"))


@query(
    f"""WITH RECURSIVE {_VISIBLE_CTE}, me AS (SELECT document_id FROM vis WHERE user_id = 3)
SELECT p_partkey AS chunk_id FROM part JOIN supplier ON s_suppkey = p_partkey % 100 + 1 WHERE s_suppkey % 7 <> 0 AND s_nationkey < 20 AND p_size <= 25 AND s_suppkey IN (SELECT document_id FROM me)"""
)
def search_candidates(read):
    """Parts as chunks of suppliers' documents, for the request of one user."""
    documents, _, granted = _permission_inputs(read)
    s = read("supplier").select(F.col("s_suppkey").alias("document_id"), F.when(F.col("s_suppkey") % 7 == 0, "archived").otherwise("active").alias("document_status"), F.when(F.col("s_nationkey") < 20, "near").otherwise("far").alias("document_group"))
    chunks = read("part").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_partkey") % 100 + 1).alias("document_id"), F.when(F.col("p_size") <= 25, "small").otherwise("large").alias("chunk_policy_name"))
    return permission.search_candidates(chunks, documents.join(s, "document_id"), "small", "near", None, granted.where("user_id = 3"))


@query(
    """SELECT lang AS policy, source AS profile, count(*) AS cell_count, sum(chunk_count)::BIGINT AS chunk_count FROM (
    SELECT d.doc_id, p.lang, q.source, count(c.doc_id) AS chunk_count FROM documents d CROSS JOIN (SELECT DISTINCT lang FROM documents) p CROSS JOIN (SELECT DISTINCT source FROM documents) q LEFT JOIN documents c ON c.doc_id = d.doc_id AND c.lang = p.lang GROUP BY ALL) GROUP BY 1, 2"""
)
def multi_policy_coverage(read):
    """Languages as policies, sources as profiles: every document under each of both."""
    d = read("documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("lang").alias("policy"))
    jobs = d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("profile"), F.lit("succeeded").alias("status"))
    cells = coverage.embedding_coverage(d.select(F.col("doc_id").alias("document_id")), d.select(F.col("source").alias("profile")).distinct(), chunks, jobs, jobs, ["policy"])
    return coverage.coverage_summary(cells, "embedding_status", ["policy", "profile"]).select("policy", "profile", "cell_count", "chunk_count")
