import corpus_pipeline
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from findery.llm import common, language, pii, quality_net, queries, shingles
from findery.llm.common import scratch, written

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    got = queries.op8_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.95 * len(good) and sum(not r.predicted for r in bad) >= 0.7 * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_of_odd_rows_and_without_labels(spark, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality_net.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = quality_net.classify(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_net.classify(empty, model).count() == 0
    none = quality_net.train(odd, labels.where("label > 5"))
    assert quality_net.classify(odd, none).where("predicted = 1").count() == odd.count()


def test_language_on_held_out_documents(spark):
    got = queries.op9_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.98 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark, odd, empty):
    model = language.train(odd, F.lit(True))
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert {(i, language.UNKNOWN) for i in (200, 201, 202, 302)} <= got and {p for _, p in got} <= {"en", "de", language.UNKNOWN}
    nothing = language.train(empty, F.lit(True))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {language.UNKNOWN}
    assert language.identify(empty, model).count() == 0


def test_only_letters_make_a_language(spark):
    docs = spark.createDataFrame([(k, "the house is here " * 5, "en") for k in range(20)] + [(100 + k, "une maison est là " * 5, "fr") for k in range(20)], "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    texts = {"½ ② ³": "und", "Ⅷ": "und", "42_": "und", "": "und", "maison": "fr", "HOUSE": "en", "e\u0301": None, "\u0301": "und", "一": None}
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, want in enumerate(texts.values()):
        assert got[k].lang_pred == want if want else got[k].lang_pred in ("en", "fr")


def test_predictions_equal_a_plain_rewrite(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = language.train(docs, queries._remainder(4) != 2)

    def plain(text):
        words = regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())
        total = np.zeros(len(m.languages))
        for w in words:
            if w in m.tables[0]:
                total += m.logs[m.tables[0][w]]
                continue
            for n in range(language.LONGEST, 0, -1):
                known = [m.logs[m.tables[n][g]] for g in (f"_{w}_"[k : k + n] for k in range(len(w) + 3 - n)) if g in m.tables[n]]
                if known:
                    total += np.mean(known, axis=0)
                    break
        return m.languages[int(total.argmax())] if words else "und"

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, m).collect()}
    assert got == {k: plain(t) for k, t in texts.items()}


def test_one_language_with_most_rows_is_drawn_from_by_its_share(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_PER_LANGUAGE", 40)
    rows = [(k, f"common word{k % 7} again", "en") for k in range(4000)] + [(9000 + k, "rare wort hier", "de") for k in range(30)] + [(5, "common word5 again", "en")] * 50
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), F.lit(True))
    got = np.exp(model.logs[model.tables[0]["common"]])
    assert model.languages == ["de", "en"] and 0.25 < got[1] < 0.4 and "rare" in model.tables[0]


def test_scores_equal_a_plain_rewrite(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = quality_net.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", F.col("quality").alias("label")))

    def plain(text):
        words = (text or "").encode().split()
        x = np.zeros(quality_net.DIMENSIONS + 5)
        if words:
            own = [m.vectors[m.rows.get(w, m.rows.get(b"\x00" + quality_net.shape(w), m.rows[b""]))] for w in words]
            mean, n = np.mean(np.array(own, np.float64), axis=0), len(words)
            x = np.array([*mean, np.linalg.norm(mean), len(set(words)) / n**0.8, sum(a == b for a, b in zip(words, words[1:])) / n, np.log1p(n), sum(map(len, words)) / n / 10])
        logit = np.tanh((x - m.mean) / m.spread @ m.w1 + m.b1) @ m.w2 + m.b2
        return 1 / (1 + np.exp(-(logit / m.temperature + m.prior)))

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_net.classify(docs, m).collect():
        assert abs(r.score - plain(texts[r.doc_id])) < 1e-4


def test_long_texts_are_read_slice_by_slice(monkeypatch):
    text = b" ".join(b"w%d" % (k % 50) for k in range(3000)) + b" " + b"ab1" * 5000
    rows, vectors = {b"w1": 0, b"w2": 1, b"": 2}, np.arange(192, dtype=np.float32).reshape(3, 64)
    whole = quality_net.pool(rows, vectors, text)
    monkeypatch.setattr(quality_net, "word_slices", lambda t: common.word_slices(t, 100))
    assert np.allclose(quality_net.pool(rows, vectors, text), whole, rtol=1e-5)
    assert quality_net.shape(b"ab1" * 5000) == b"a0a0a0a0"


def test_unknown_words_fall_back_to_shorter_grams():
    logs = np.array([[-1.0, -9.0], [-7.0, -6.0], [-2.0, -3.0], [-5.0, -4.0]])
    m = language.LanguageModel(["a", "b"], [{"haus": 0}, {"z": 1}, {"_z": 2}, {}, {"haus": 3}], logs)
    assert m.word_score("haus").tolist() == [-1.0, -9.0]
    assert m.word_score("xhausx").tolist() == [-5.0, -4.0]
    assert m.word_score("zq").tolist() == [-2.0, -3.0]
    assert m.word_score("qzq").tolist() == [-7.0, -6.0]
    assert m.word_score("qq").tolist() == [0.0, 0.0]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = written(stage(spark, docs, SF), scratch(spark, "stage"))
    return [*out, docs]


def test_pipeline_stages(spark, stages):
    first, good, single, clean, redacted, tokens = stages
    assert good.columns == single.columns == clean.columns == redacted.columns == first.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = [labels[i] for i in ids(first) - ids(good) if i in labels]
    assert gone and np.mean(gone) < 0.05
    groups = shingles.near_duplicates(good).collect()
    assert ids(single) == {r.component_id for r in groups}
    hit = {r.doc_id for r in queries.op6_decontaminate(spark, SF).where("contaminated").collect()}
    assert ids(clean) == ids(single) - hit
    assert ids(redacted) == ids(clean) == ids(tokens)
    assert pii.personal_data(redacted).where("size(base) + size(added) > 0").count() == 0
    before = {r.doc_id: r.text for r in clean.collect()}
    spans = {r.doc_id: len(r.base) + len(r.added) for r in pii.personal_data(clean).collect()}
    assert all(spans[r.doc_id] or r.text == before[r.doc_id] for r in redacted.collect())


def test_pipeline_on_odd_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty):
            got = written(stage(spark, docs, SF), scratch(spark, "stage"))
            assert got.count() <= docs.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == docs.columns
