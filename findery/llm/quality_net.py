"""Quality classifier: random-indexing word vectors pooled per document, and a small calibrated network.

Words and word shapes (case, digits and punctuation) get vectors by random indexing: each has a sparse
random index vector, and a word's vector sums the index vectors of its neighbours over a sample.  A
document is the mean of its words' vectors and a few pooled statistics.  A network of two layers learns
labels from that, and its probabilities are calibrated by a temperature on documents it did not fit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.llm.common import scratch, small_batches, word_slices, written

#: Labelled documents of each class that training uses at most, the first by a hash of doc_id.
SAMPLE_PER_CLASS = 3000
#: Words and shapes in at least this share of the sample's documents, and two of them, get a vector of their own.
COMMON = 1 / 1000
DIMENSIONS = 64
NEIGHBOURS = 2
HIDDEN = 24
STEPS = 600
SEED = 7
#: predicted is 1 from this score on.
THRESHOLD = 0.3

_RUNS = re.compile(rb"([A-Z])[A-Z]*|([a-z\x80-\xff])[a-z\x80-\xff]*|([0-9])[0-9]*|(.)\4*", re.S)


def shape(word: bytes) -> bytes:
    """``Rewh.###`` becomes ``Aa.#``: runs of capitals, other letters, digits and each other character, at most 8."""
    runs = (m.groups() for m in islice(_RUNS.finditer(word), 8))
    return b"".join([b"A" if a else b"a" if b else b"0" if c else d for a, b, c, d in runs])


@dataclass
class QualityModel:
    """Vectors of words and shapes and the network's weights; its size is bounded by the constants above."""

    rows: dict[bytes, int]
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    prior: float = 0.0
    known: bool = True

    def pooled(self, text: bytes | None) -> np.ndarray:
        return pool(self.rows, self.vectors, text)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """P(label 1) of each text."""
        if not self.known:
            return np.full(len(texts), 1.0 if self.prior >= 0 else 0.0)
        x = np.array([self.pooled(t) for t in texts]).reshape(len(texts), -1)
        logit = np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature + self.prior, -40, 40)))


def _rows_of(rows: dict[bytes, int], words: list[bytes]) -> list[int]:
    """The vector of each word: its own, else its shape's, else the last, which stands for all others."""
    other = rows[b""]
    return [r if (r := rows.get(w)) is not None else rows.get(b"\x00" + shape(w), other) for w in words]


def pool(rows: dict[bytes, int], vectors: np.ndarray, text: bytes | None) -> np.ndarray:
    """A document: the mean of its words' vectors, its length, and how varied and how long its words are."""
    counts: Counter = Counter()
    own: set[bytes] = set()
    n, repeats, letters, last = 0, 0, 0, None
    for words in word_slices(text):
        counts.update(_rows_of(rows, words))
        own.update(words)
        repeats += sum(map(bytes.__eq__, words, words[1:])) + (words[0] == last)
        letters += sum(map(len, words))
        n, last = n + len(words), words[-1]
    if not n:
        return np.zeros(vectors.shape[1] + 5, np.float32)
    at = sorted(counts)
    mean = (np.array([counts[k] for k in at], np.float32) @ vectors[at]) / n
    extra = (float(np.linalg.norm(mean)), len(own) / n**0.8, repeats / n, math.log1p(n), letters / n / 10)
    return np.concatenate([mean, np.array(extra, np.float32)])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word and shape of a document once."""
    for batch in batches:
        for t in batch.column(0).to_pylist():
            own = set().union(*word_slices(t))
            own |= {b"\x00" + shape(w) for w in own}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary())], names=["term"])


def _index_vectors(n: int) -> np.ndarray:
    """Sparse random vectors: 8 entries of +1 or -1 each."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((n, DIMENSIONS), np.float32)
    at = rng.integers(0, DIMENSIONS, (n, 8))
    out[np.arange(n)[:, None], at] = rng.choice(np.array([-1, 1], np.float32), (n, 8))
    return out


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on a bounded sample of ``labels`` (doc_id, label 0 or 1); lang, source and doc_id are no inputs.

    At most SAMPLE_PER_CLASS documents of each label are read whole, those with the least hashes of doc_id
    and then the least ids; of rows that share a doc_id the least (text, label) counts.  Word counts, neighbour
    sums and pooled vectors are made on the executors; the driver gets the common words and matrices of
    their number.  Null labels, ids and labels without a document count for nothing; without both labels
    the model gives the prior.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    nothing = np.zeros(0, np.float32)
    empty = QualityModel({b"": 0}, np.zeros((1, DIMENSIONS), np.float32), nothing, nothing, nothing, nothing, nothing, 0.0, 1.0, prior, False)
    if not (counts.get(0) and counts.get(1)):
        return empty
    chosen = None
    for label in (0, 1):
        own = usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
        chosen = own if chosen is None else chosen.union(own)
    chosen = written(chosen.dropDuplicates(["doc_id"]), scratch(spark, "chosen"))  # 2 * SAMPLE_PER_CLASS rows at most
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(chosen), "doc_id")
    sample = written(found.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("own")).select("doc_id", "own.*"), scratch(spark, "sample"))

    terms = sample.select("text").mapInArrow(_terms, "term binary").groupBy("term").agg(F.count("*").alias("n"))
    common = terms.where(F.col("n") >= max(2, COMMON * sample.count())).orderBy(F.desc("n"), "term").collect()
    rows = {bytes(r.term): k for k, r in enumerate(common)}
    rows[b""] = len(rows)
    index = _index_vectors(len(rows))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(rows), DIMENSIONS), np.float32)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                before = np.empty(0, np.int64)  # the last words of the slice before, whose neighbours go on here
                for words in word_slices(t):
                    at = np.concatenate([before, np.array(_rows_of(rows, words), np.int64)])
                    near, old = np.zeros((len(at), DIMENSIONS), np.float32), len(before)
                    for step in range(1, NEIGHBOURS + 1):
                        a = max(0, old - step)  # pairs of two old words were counted before
                        near[a : len(at) - step] += index[at[a + step :]]
                        near[a + step :] += index[at[a : len(at) - step]]
                    used, back = np.unique(at, return_inverse=True)
                    for d in range(DIMENSIONS):
                        sums[used, d] += np.bincount(back, near[:, d], len(used)).astype(np.float32)
                    before = at[-NEIGHBOURS:]
        yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tobytes()], pa.binary())})

    vectors = np.zeros((len(rows), DIMENSIONS), np.float32)
    for r in sample.select("text").coalesce(8).mapInArrow(neighbours, "sums binary").toLocalIterator():
        vectors += np.frombuffer(r.sums, np.float32).reshape(vectors.shape)
    vectors += index  # a word's own index vector tells it from others with like neighbours
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pool(rows, vectors, t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], names=["label", "x", "doc_id"])

    got = sample.select("label", "text", "doc_id").mapInArrow(pooled, "label int, x binary, doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id", "x").collect()
    if len({r.label for r in got}) < 2:
        return empty
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], np.float64)
    return _fit(rows, vectors, x, np.array([r.label for r in got], np.float64), prior)


def _fit(rows: dict[bytes, int], vectors: np.ndarray, x: np.ndarray, y: np.ndarray, prior: float) -> QualityModel:
    """Full-batch Adam on four fifths, classes weighted alike; temperature by grid on the rest; then the labels' prior."""
    rng = np.random.default_rng(SEED)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    mean, spread = x[~held].mean(0), x[~held].std(0) + 1e-3
    z, t = (x[~held] - mean) / spread, y[~held]
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9)) / len(t)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        h = np.tanh(z @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
        d = weight * (p - t)
        back = d[:, None] * params[2] * (1 - h**2)
        grads = [z.T @ back + 1e-4 * params[0], back.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
        for k, (g, (m, v)) in enumerate(zip(grads, moments, strict=True)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params[k] = params[k] - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(rows, vectors, mean, spread, params[0], params[1], params[2], float(params[3][0]))
    if held.any():
        logit = np.tanh((x[held] - mean) / spread @ params[0] + params[1]) @ params[2] + params[3]
        grid = np.geomspace(0.5, 20, 60)
        w = np.where(y[held] == 1, 0.5 / y[held].mean(), 0.5 / (1 - y[held].mean()))
        loss = [float((w * np.logaddexp(0, -(2 * y[held] - 1) * logit / g)).mean()) for g in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    model.prior = prior
    return model


def score_column(model: Broadcast, text: Column) -> Column:
    """score of a text beside the other columns of its table; a null text counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        out = [model.value.scores(values[k : k + 256]) for k in range(0, len(values), 256)]
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return score(text.cast("binary"))


def classify(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score double, predicted int) of every row: predicted is 1 from THRESHOLD on.

    Null and empty texts are scored like a document without words.  Texts are read whole, long ones slice
    by slice.  Repeated rows each get their row, equal texts get equal scores, an empty table gives an empty
    one, and other columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(shared, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
