import random
import re

import pytest
from pyspark.sql import functions as F

from findery.functions.shared import scratch
from findery.operators import blockmax, keyword

WORDS = [f"w{k}" for k in range(60)]


@pytest.fixture(scope="module", autouse=True)
def few_buckets():
    old, blockmax.BUCKETS = blockmax.BUCKETS, 8
    yield
    blockmax.BUCKETS = old


def corpus(r, ids):
    """Texts with words of very different frequency, and lengths from none to a few hundred."""
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    return {i: None if r.random() < 0.03 else " ".join(r.choices(WORDS, weights, k=r.choice([0, 3, 20, 60, 300]))) for i in ids}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(3)


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score, r.matched_term_count, r.document_length) for r in df.collect())


def figures(df):
    return sorted((r.term, r.document_frequency, r.corpus_chunk_count, r.average_document_length) for r in df.collect())


@pytest.fixture(scope="module")
def kept(spark):
    """An index after inserts, changes, deletions and a repeated batch, and the texts that are alive."""
    r, path = random.Random(4), scratch(spark, "index")
    alive = corpus(r, range(900))
    blockmax.apply_batch(spark, path, 0, frame(spark, alive))
    steps = [(corpus(r, range(850, 1100)), [3, 4, 5, 99_999]), (corpus(r, range(0, 40)), list(range(500, 530))), ({}, [7, 8]), (corpus(r, [3, 2000]), [])]
    for batch, (new, gone) in enumerate(steps, 1):
        for text in (["broken first try"] if batch == 2 else []):
            blockmax.apply_batch(spark, path, batch, frame(spark, dict.fromkeys(range(600), text)), frame(spark, {1: ""}))
        blockmax.apply_batch(spark, path, batch, frame(spark, new) if new else None, spark.createDataFrame([(i,) for i in gone], "chunk_id long") if gone else None)
        alive = {i: t for i, t in alive.items() if i not in gone} | new
    return path, alive


def test_statistics_equal_a_rebuild(spark, kept):
    path, alive = kept
    want = keyword.text_statistics(frame(spark, alive))
    assert figures(blockmax.statistics(spark, path)) == figures(want)
    few = spark.createDataFrame([("w3",), ("w59",), ("nowhere",)], "term string")
    assert figures(blockmax.statistics(spark, path, few)) == [x for x in figures(want) if x[0] in ("w3", "w59")]
    assert sorted((r.chunk_id, r.length) for r in blockmax.live_chunks(spark, path).collect()) == sorted((i, len((t or "").split())) for i, t in alive.items())


QUERIES = ["w0 w1 w2", "w40 w41 w0", "w59", "w5 w5 w30 w31 w32 w33 w1 w0", "nowhere", "", None, " ".join(WORDS)]


@pytest.mark.parametrize("k", [1, 10, 400])
def test_search_equals_a_search_of_all_postings(spark, kept, k):
    path, alive = kept
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query_text string")
    docs = frame(spark, alive)
    assert rows(blockmax.search(queries, path, k).rows) == rows(keyword.bm25_topk(queries, docs, k))
    some = docs.where("chunk_id % 3 = 1").select("chunk_id")
    assert rows(blockmax.search(queries, path, k, some).rows) == rows(keyword.bm25_topk(queries, docs, k, candidates=some))


def test_a_compacted_index_gives_the_same(spark, kept):
    path, alive = kept
    into = scratch(spark, "compact")
    blockmax.compact(spark, path, into)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query_text string")
    assert rows(blockmax.search(queries, into, 10).rows) == rows(blockmax.search(queries, path, 10).rows)
    assert figures(blockmax.statistics(spark, into)) == figures(blockmax.statistics(spark, path))
    assert blockmax.table(spark, into, "removed", [4]).count() == 0
    blockmax.apply_batch(spark, into, 5, frame(spark, {1: "w59 w59 again"}))
    assert blockmax.search(queries.where("query_id = 2"), into, 1).rows.first().chunk_id == 1


def test_few_postings_are_read(spark):
    r, path = random.Random(9), scratch(spark, "index")
    common, texts = [f"c{k}" for k in range(20)], {}
    for i in range(4000):
        texts[i] = " ".join(r.choices(common, k=40)) + (f" rare{i % 100}" if i % 3 == 0 else "")
    blockmax.apply_batch(spark, path, 0, frame(spark, texts))
    queries = spark.createDataFrame([(q, f"rare{q} c1 c2 c3") for q in range(20)], "query_id long, query_text string")
    found = blockmax.search(queries, path, 5)
    assert rows(found.rows) == rows(keyword.bm25_topk(queries, frame(spark, texts), 5))
    total, read = found.reading.agg(F.sum("postings"), F.sum("postings_read")).first()
    assert read < 0.6 * total, (read, total)


def test_only_buckets_of_the_terms_are_scanned(spark, kept):
    path, _ = kept
    found = blockmax.statistics(spark, path, spark.createDataFrame([("w3",)], "term string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_later_batches_stay(spark, kept):
    with pytest.raises(ValueError, match="later"):
        blockmax.apply_batch(spark, kept[0], 0, frame(spark, {1: "x"}))


def test_an_empty_index(spark):
    path = scratch(spark, "index")
    queries = spark.createDataFrame([(1, "w1")], "query_id long, query_text string")
    assert blockmax.search(queries, path, 3).rows.count() == 0
    blockmax.apply_batch(spark, path, 0, spark.createDataFrame([(1, None), (None, "w1")], "chunk_id long, text string"))
    assert blockmax.search(queries, path, 3).rows.count() == 0 and blockmax.corpus_totals(spark, path) == (1, 0.0)


def shuffled_rows(spark, run):
    """Rows that all queries together wrote to shuffles while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    wait = spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty
    seq = lambda found: [found.apply(k) for k in range(found.size())]
    wait()
    before = max([e.executionId() for e in seq(store.executionsList())], default=-1)
    run()
    wait()
    total = 0
    for e in seq(store.executionsList()):
        if e.executionId() > before:
            wanted = {m.accumulatorId() for node in seq(store.planGraph(e.executionId()).allNodes()) for m in seq(node.metrics()) if m.name() == "shuffle records written"}
            shown = re.findall(r"(\d+) -> ([\d,]+)$", store.executionMetrics(e.executionId()).mkString("\n"), re.M)
            total += sum(int(n.replace(",", "")) for k, n in shown if int(k) in wanted)
    return total


def test_words_are_counted_where_texts_meet(spark):
    """300,000 words of 60 kinds in 1,000 texts of about 8 ranges: texts and blocks are shuffled, words are not."""
    r, path = random.Random(2), scratch(spark, "index")
    texts = {i: " ".join(r.choices(WORDS, k=300)) for i in range(1000)}
    docs = frame(spark, texts)
    assert shuffled_rows(spark, lambda: blockmax.apply_batch(spark, path, 0, docs)) < 30_000
    assert figures(blockmax.statistics(spark, path)) == figures(keyword.text_statistics(docs))


def test_blocks_of_other_terms_are_not_shuffled(spark):
    """50,000 terms that no query has."""
    path = scratch(spark, "index")
    texts = {i: f"w{i % 7} w{i % 11} " + " ".join(f"other{i}x{k}" for k in range(25)) for i in range(2000)}
    blockmax.apply_batch(spark, path, 0, frame(spark, texts))
    queries = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9")], "query_id long, query_text string")
    got, limit = [], "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")  # as where the terms' postings are too many to be broadcast
    try:
        assert shuffled_rows(spark, lambda: got.extend(rows(blockmax.search(queries, path, 10).rows))) < 20_000
    finally:
        spark.conf.unset(limit)
    assert got == rows(keyword.bm25_topk(queries, frame(spark, texts), 10))


@pytest.mark.parametrize("few", [1, 10**6])
def test_replaced_chunks_and_candidates_on_both_ways(spark, kept, few, monkeypatch):
    """Queries whose weak terms are left aside and those that score all blocks, with small tables broadcast or not."""
    path, alive = kept
    monkeypatch.setattr(blockmax, "BROADCAST_TERMS", few)
    docs, some = frame(spark, alive), frame(spark, alive).where("chunk_id % 2 = 0").select("chunk_id")
    for text in ("w59 w0", " ".join(WORDS)):
        queries = spark.createDataFrame([(1, text)], "query_id long, query_text string")
        for k in (1, 50):
            assert rows(blockmax.search(queries, path, k, some).rows) == rows(keyword.bm25_topk(queries, docs, k, candidates=some))
