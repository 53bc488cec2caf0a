import math
import random

import numpy as np
from pyspark.sql import functions as F

from findery.llm import common, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    got = queries.op12_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in bad) >= 0.9 * len(bad) and sum(r.predicted for r in good) <= 0.02 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def learnt(seed=1):
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdefgilnorstu") for _ in range(r.randint(3, 8))) for _ in range(300)]
    docs = []
    for k in range(300):
        words = [r.choice(plain) for _ in range(r.randint(20, 80))]
        if k % 4 == 0:
            words += [r.choice(["wretched", "scoundrel", "knavery"]) for _ in range(2)]
        docs.append((int(k % 4 == 0), list(dict.fromkeys(words)), np.array([words.count(w) for w in dict.fromkeys(words)])))
    return toxicity.fit(docs, math.log(1 / 3)), plain


def test_misspellings_share_subwords():
    model, plain = learnt()
    text = " ".join(plain[:30])
    score = lambda t: float(model.scores([t.encode()])[0])
    assert score(text) < 0.5
    for bad in ("wretched", "WRETCHED", "wretchedd", "wretchd!", "scoundrell", "sc0undrel", "knaveryy"):
        assert score(f"{text} {bad} {bad}") > 0.5
    near = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert near(model.word_vector("wretched"), model.word_vector("wretchhed")) > 0.7


def test_subwords_are_the_word_and_its_grams():
    words = ["ab", "über", "a", "😀xyz", "long-er", "ab"]
    bucket, owner = toxicity.subwords(words)
    for k, w in enumerate(words):
        marked = f" {w} "
        assert (owner == k).sum() == 1 + sum(max(0, len(marked) - n + 1) for n in toxicity.GRAMS)
        alone = toxicity.subwords([w])[0]
        assert sorted(alone.tolist()) == sorted(bucket[owner == k].tolist())
    assert ((bucket >= 0) & (bucket < toxicity.BUCKETS)).all()
    assert toxicity.subwords([])[0].size == 0


def test_scores_equal_a_plain_rewrite(monkeypatch):
    model, plain = learnt(2)
    texts = [" ".join(plain[:50]), "Wretched soul\tof a knave", "", None, " \n ", "x" * 5000, "one"]

    def by_hand(text):
        words = (text or "").split()
        mean = np.mean([model.word_vector(w) for w in words], 0) * toxicity.SCALE if words else np.zeros(toxicity.DIMENSIONS)
        logits = mean @ model.weights + model.bias
        return float(np.exp(logits[1]) / np.exp(logits).sum())

    as_bytes = [None if t is None else t.encode() for t in texts]
    assert np.allclose(model.scores(as_bytes), [by_hand(t) for t in texts], atol=1e-4)
    monkeypatch.setattr(toxicity, "word_slices", lambda t, size: common.word_slices(t, 40))
    monkeypatch.setattr(toxicity, "_PIECE", 60)
    assert np.allclose(model.scores(as_bytes), [by_hand(t) for t in texts], atol=1e-4)
    assert model.scores([]).size == 0


def test_odd_rows_and_missing_labels(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels)
    got = toxicity.classify(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    bare = {r.score for r in got if r.doc_id in (200, 201, 202)}
    assert len(bare) == 1 and bare.pop() < 0.5
    assert toxicity.classify(empty, model).count() == 0
    odd_labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (99999, 1), (5, 0)], "doc_id long, label int")
    assert toxicity.classify(odd, toxicity.train(odd, odd_labels)).count() == odd.count()
    for none in (labels.where("label > 5"), labels.where("label = 0")):
        assert toxicity.classify(odd, toxicity.train(docs, none)).where("score > 0.51").count() == 0
    assert toxicity.classify(odd, toxicity.train(empty, labels)).count() == odd.count()
