import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findery.functions import text as tx
from findery.functions.vectors import stand_in_embedding, stand_in_embeddings
from findery.operators import evaluate, fuse, keyword, vector
from findery.plans import models, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Red-Fox 문서 검색 2.0, BM25 bm25!", ["red", "fox", "문서", "검색", "2", "0", "bm25", "bm25"]),
        ("... --- !!!", []),
        ("Straße under_score ½", ["strasse", "under_score", "½"]),
    ],
)
def test_word_tokens(spark, text, tokens):
    assert one(spark, tx.words(F.lit(text))) == tokens


def test_hangul_grams_follow_their_word(spark):
    got = one(spark, tx.words_and_hangul_grams(F.lit("검색기능 a")))
    assert got == ["검색기능", "검색", "색기", "기능", "검색기", "색기능", "a"]
    assert one(spark, tx.words_and_hangul_grams(F.lit("검색"))) == ["검색"]


def test_unknown_tokenizer_is_named():
    with pytest.raises(ValueError, match="unicode_words"):
        tx.tokenizer("none")


def test_bm25_ranks_by_hand_computed_scores(spark):
    chunks = spark.createDataFrame([(1, "Beta beta reimbursement workflow"), (2, "Alpha beta general policy"), (3, "Gamma security handbook"), (4, None)], "chunk_id long, text string")
    queries = spark.createDataFrame([(7, "beta reimbursement"), (8, "... !")], "query_id long, query_text string")
    got = keyword.bm25_topk(queries, chunks.where("chunk_id < 4"), 2).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id, r["rank"], r.matched_term_count, r.document_length) for r in got] == [(7, 1, 1, 2, 4), (7, 2, 2, 1, 4)]
    average, idf = round(11 / 3, 4), lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, df: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 4 / average))
    assert got[0].score == pytest.approx(part(2, 2) + part(1, 1), abs=1e-6)
    assert got[1].score == pytest.approx(part(1, 2), abs=1e-6)


def test_candidates_restrict_results_not_statistics(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "c")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "a")], "query_id long, query_text string")
    free = {r.chunk_id: r.score for r in keyword.bm25_topk(queries, chunks, 5).collect()}
    held = {r.chunk_id: r.score for r in keyword.bm25_topk(queries, chunks, 5, candidates=chunks.where("chunk_id = 2").select("chunk_id")).collect()}
    assert held == {2: free[2]}


def test_terms_beyond_the_broadcast_bound_give_the_same_ranks(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 17}" for j in range(1, 12)) + " common") for k in range(60)], "chunk_id long, text string").repartition(5)
    queries = spark.createDataFrame([(1, "w3 common w5 w5"), (2, "w16 w1"), (3, "nowhere")], "query_id long, query_text string")
    got = sorted(map(tuple, keyword.bm25_topk(queries, chunks, 7).collect()))
    keyword.refresh_index(chunks, str(tmp_path))
    assert sorted(map(tuple, keyword.stored_topk(queries, str(tmp_path), 7).select("query_id", "chunk_id", "score", "matched_term_count", "document_length", "rank").collect())) == got
    monkeypatch.setattr(keyword, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, keyword.bm25_topk(queries, chunks, 7).collect())) == got


def test_refresh_goes_on_after_a_policy_that_fails(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(1, "a b", "x"), (2, "b", "y")], "chunk_id long, text string, policy string")
    real = keyword.refresh_index
    monkeypatch.setattr(keyword, "refresh_index", lambda own, path, *a, **k: real(own, path, *a, **k) if own.where("policy = 'x'").count() else (_ for _ in ()).throw(OSError("disk")))
    got = {r.policy: (r.status, r.chunk_count, r.term_rows, r.error) for r in keyword.refresh_indexes(chunks, str(tmp_path), ["x", "y"]).collect()}
    assert got == {"x": ("succeeded", 1, 2, None), "y": ("failed", 0, 0, "OSError: disk")}
    with pytest.raises(OSError):
        keyword.refresh_indexes(chunks, str(tmp_path), ["y"], go_on=False)


def test_index_refresh_replaces_its_policies_only(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a b", "x"), (2, "b", "y")], "chunk_id long, text string, p string")
    keyword.refresh_index(chunks, str(tmp_path), F.col("p"))
    keyword.refresh_index(chunks.where("p = 'y'").withColumn("text", F.lit("c")), str(tmp_path), F.col("p"))
    got = {(r.policy, r.term) for r in spark.read.parquet(f"{tmp_path}/postings").collect()}
    assert got == {("x", "a"), ("x", "b"), ("y", "c")}


def test_vector_search_equals_numpy_and_breaks_ties_by_id(spark):
    rows = [(k, stand_in_embedding(f"text {k % 7}", "p", 32).tolist()) for k in range(40)] + [(99, [0.0] * 32), (100, None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(1, stand_in_embedding("text 3", "p", 32).tolist())], "query_id long, embedding array<double>")
    got = [r.chunk_id for r in vector.vector_topk(queries, vectors, 8).orderBy("rank").collect()]
    q = np.array(rows[3][1])
    order = sorted(range(40), key=lambda k: (-round(float(np.dot(rows[k][1], q)), 6), k))
    assert got == order[:8]
    with pytest.raises(ValueError):
        vector.vector_topk(queries, vectors, 0)
    with pytest.raises(ValueError):
        vector.vector_topk(queries, vectors, 5, metric="other")


def test_stand_in_embedding_is_a_unit_vector(spark):
    v = stand_in_embedding("text", "p", 100)
    assert len(v) == 100 and np.linalg.norm(v) == pytest.approx(1)
    assert not np.allclose(v, stand_in_embedding("text", "other", 100))
    df = spark.createDataFrame([("text",), (None,)], "text string")
    got = [r.e for r in df.select(stand_in_embeddings(F.col("text"), "p", 100).alias("e")).collect()]
    assert got[0] == pytest.approx(v.tolist()) and got[1] is None


def ranked(spark, rows):
    return spark.createDataFrame([(1, c, r, 1.0 / r) for c, r in rows], "query_id long, chunk_id long, rank long, score double")


def test_fusion_order(spark):
    got = fuse.reciprocal_rank_fusion(ranked(spark, [(10, 1), (20, 2)]), ranked(spark, [(20, 1), (30, 2)]), 10)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [20, 10, 30]


def test_near_ties_do_not_depend_on_partitions(spark):
    turned = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(3, turned(0.1234561)), (5, turned(0.1234564)), (9, turned(0.1234558)), (2, turned(0.05))]
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    for parts in (1, 2, 50):
        df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(parts)
        assert [r.chunk_id for r in vector.vector_topk(queries, df, 2).orderBy("rank").collect()] == [3, 5]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-3, 3)), min_size=1, max_size=40), st.sampled_from(["cosine", "inner_product", "l2"]), st.integers(1, 9))
def test_top_k_equals_brute_force_for_any_partitions(spark, points, metric, k):
    rows = [(i, [float(a), float(b), 1e-7 * i]) for i, (a, b) in enumerate(points)]
    q = np.array([1.0, 0.5, 0.0])
    x = np.array([v for _, v in rows])
    with np.errstate(all="ignore"):
        score = {"cosine": x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)), "inner_product": x @ q, "l2": -np.linalg.norm(x - q, axis=1)}[metric]
    want = sorted((-round(float(s), 6), i) for i, s in enumerate(score) if np.isfinite(s))[:k]
    queries = spark.createDataFrame([(1, q.tolist())], "query_id long, embedding array<double>")
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(parts)
        assert [r.chunk_id for r in vector.vector_topk(queries, df, k, metric=metric).orderBy("rank").collect()] == [i for _, i in want]


def test_odd_vectors_are_no_candidates(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.5, 0.5]), (9, [2.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (None, [1.0, 0.0]), (3, None), (4, [None, 1.0])], "query_id long, embedding array<double>")
    for block in (vector.BLOCK_BYTES, 8):
        monkeypatch.setattr(vector, "BLOCK_BYTES", block)
        got = sorted((r.query_id, r["rank"], r.chunk_id) for r in vector.vector_topk(queries, vectors, 5).collect())
        assert got == [(1, 1, 1), (1, 2, 8), (2, 1, 4), (2, 2, 9)]


def test_embedding_profiles(spark):
    assert vector.profile(" bge_m3_1024 ").dimension == 1024 and vector.profile("qwen3_4b_2560").storage == "half"
    with pytest.raises(ValueError, match="unknown"):
        vector.profile("none")
    own, current = vector.Profile("p", 2), spark.createDataFrame([(1, [1.0, 2.0])], "chunk_id long, embedding array<double>")
    put = lambda v: vector.stored_embeddings(current, spark.createDataFrame([(1, v)], "chunk_id long, embedding array<double>"), own).collect()
    assert [tuple(r) for r in put([3.0, 4.0])] == [(1, [3.0, 4.0])]
    for wrong in ([1.0], [1.0, float("nan")], None):
        with pytest.raises(Exception, match="takes 2 finite numbers"):
            put(wrong)


def test_compare_isolates_a_profile_that_fails(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(1, "red apple"), (2, "green pear")], "chunk_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, "apple", [1.0, 0.1])], "query_id long, query_text string, embedding array<double>")
    def gone(*a, **k):
        raise OSError("index gone")

    monkeypatch.setattr(search, "bm25_topk", gone)
    results, profiles = search.run_compare(queries, chunks, vectors, 2, ["none", "vector_exact", "bm25_keyword"], str(tmp_path))
    assert [(r.profile_name, r.status, r.result_count) for r in profiles.collect()] == [("none", "failed", 0), ("vector_exact", "succeeded", 2), ("bm25_keyword", "failed", 0)]
    assert {(r.profile_name, r.chunk_id) for r in results.where("rank = 1").collect()} == {("vector_exact", 1)}
    assert search.vector_profile(None, ["bm25_keyword", "b"], ["a", "b"]) == "b" and search.vector_profile("a", ["b"], ["a", "b"]) == "a" and search.vector_profile(None, [], ["a"]) == "a"
    with pytest.raises(ValueError):
        search.vector_profile("c", [], ["a"])


def test_rerankers_keep_their_contract(spark):
    results = spark.createDataFrame([(1, "v", 5, 1, 0.9), (1, "v", 6, 2, 0.8)], "query_id long, profile_name string, chunk_id long, rank long, score double")
    texts = spark.createDataFrame([(5, "a"), (6, "bb")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "q")], "query_id long, query_text string")
    by_length = lambda request: {"candidate_count": 2, "results": [{"candidate_key": c["candidate_key"], "rank": n + 1, "score": float(len(c["text"]))} for n, c in enumerate(sorted(request["candidates"], key=lambda c: -len(c["text"])))]}
    candidates = fuse.rerank_candidates(results, texts)
    got = models.reranked(candidates, queries, by_length, 2, "p", "m").orderBy("rank").collect()
    assert [(r.candidate_key, r.source_rank, r.score) for r in got] == [("v:6", 2, 2.0), ("v:5", 1, 1.0)]
    with pytest.raises(Exception, match="must be unique"):
        fuse.rerank_candidates(results.union(results), texts).collect()
    request = {"reranker_profile_name": "p", "reranker_model_id": "m", "top_k": 1, "candidates": [{"candidate_key": "a"}]}
    good = {"candidate_key": "a", "rank": 1, "score": 0.5}
    assert models.checked_rerank(request, {"results": [good]}) == [good]
    for wrong in ({"top_k": 2}, {"reranker_model_id": "x"}, {"candidate_count": 2}, {"results": [good, good]}, {"results": [good | {"candidate_key": "z"}]}, {"results": [good | {"rank": 2}]}):
        with pytest.raises(models.WrongAnswer):
            models.checked_rerank(request, wrong)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 8), unique=True, min_size=1), st.lists(st.integers(1, 8), unique=True, min_size=1))
def test_fusion_scores_do_not_depend_on_the_side(spark, a, b):
    left, right = ranked(spark, [(c, k + 1) for k, c in enumerate(a)]), ranked(spark, [(c, k + 1) for k, c in enumerate(b)])
    score = lambda x, y: {r.chunk_id: r.score for r in fuse.reciprocal_rank_fusion(x, y, 50).collect()}
    assert score(left, right) == score(right, left)


def test_rerank_prefers_shared_words(spark):
    candidates = ranked(spark, [(1, 1), (2, 2)])
    queries = spark.createDataFrame([(1, "red apple")], "query_id long, query_text string")
    texts = spark.createDataFrame([(1, "green pear"), (2, "an apple, red")], "chunk_id long, text string")
    got = fuse.lexical_rerank(candidates, queries, texts, 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1]
    assert got[0].score == pytest.approx(1.0005)


def test_strategies_are_validated():
    assert fuse.candidate_depth(10) == 40 and fuse.candidate_depth(60) == 100
    with pytest.raises(ValueError):
        fuse.validate_strategy("none")
    with pytest.raises(ValueError):
        fuse.validate_strategy("hybrid_keyword_vector", 5, threshold=0.1)


def metrics(spark, targets, ranks, k):
    q = spark.createDataFrame([(1,)], "question_id long")
    t = spark.createDataFrame([(1, c, g, e) for c, g, e in targets], "question_id long, chunk_id long, grade long, expectation string")
    r = spark.createDataFrame([(1, c, n) for c, n in ranks], "question_id long, chunk_id long, rank long")
    return evaluate.question_metrics(q, r, t, k).first()


def test_metrics_by_hand(spark):
    got = metrics(spark, [(1, 3, "visible"), (2, 2, "visible"), (5, 0, "hidden")], [(9, 1), (2, 2), (5, 3), (1, 4)], 3)
    assert (got.recall_at_k, got.reciprocal_rank, got.hidden_violation_count, got.no_answer_success) == (0.5, 0.5, 1, None)
    assert got.ndcg == pytest.approx((3 / math.log2(3)) / (7 + 3 / math.log2(3)), abs=1e-6)
    got = metrics(spark, [(10, 1, "visible"), (10, 3, "visible")], [(10, 1), (10, 2)], 3)
    assert (got.visible_count, got.recall_at_k, got.ndcg) == (1, 1.0, 1.0)
    got = metrics(spark, [(10, 3, "visible")], [(11, 1)], 5)
    assert (got.recall_at_k, got.reciprocal_rank, got.ndcg) == (0.0, 0.0, 0.0)
    assert metrics(spark, [(None, 3, "visible")], [], 5).no_answer_success is True
    assert metrics(spark, [(None, 3, "visible")], [(42, 1)], 5).no_answer_success is False


def test_snapshot_warnings(spark):
    fields = "struct<batch_key:string,question_set_id:int,strategy_name:string,top_k:int,score_threshold:double,chunk_policy_name:string,profile_names:array<string>,created_at:int>"
    rows = spark.createDataFrame([(("b", 1, "s", 5, None, "p", ["x", "y"], 2), ("b", 2, "s", 5, 0.5, "p", ["y", "x"], 1))], f"base {fields}, target {fields}")
    got = rows.select(evaluate.snapshot_warnings(F.col("base"), F.col("target")).alias("w")).first().w
    assert got == ["question_set_differs", "score_threshold_differs", "target_older_than_base"]
