"""Toxicity: embeddings of words' subwords, averaged over a document, under a linear softmax, trained together.

A word is the sum of the embeddings of itself and of its character n-grams, which are hashed into a table, so a
misspelling that was never seen still shares most of its vector with the word it stands for.  A document is the mean
of its words.  Embeddings and softmax are fitted in numpy on a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.llm.common import scratch, small_batches, word_slices, written

#: Labelled documents that training uses at most, by label, the first by a hash of doc_id.
SAMPLE = {0: 3000, 1: 1500}
#: Documents of more characters are not drawn for the sample; they are scored whole like any other.
LONGEST = 200_000
#: Lengths of the n-grams of a word with its marks of start and end.
GRAMS = range(3, 7)
BUCKETS = 1 << 18
DIMENSIONS = 8
#: Buckets with fewer words of sampled documents keep no embedding.
FLOOR = 4
#: Words that the log odds of a bucket are drawn to the average by.
SMOOTHING = 10
#: A mean over words is small where one word in fifty counts; it is multiplied by this before the softmax.
SCALE = 4.0
STEPS = 120
#: Training ends when the mean loss falls below this.
ENOUGH = 0.01
RATES = (3.0, 0.03, 0.03)
SEED = 11
#: predicted is 1 from this score on.
THRESHOLD = 0.5
#: Words of the sample, and bytes of text, that are worked on at once.
_BLOCK, _PIECE = 20_000, 1 << 17

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters(words: list[str]) -> np.ndarray:
    """Code points of the words with one space before, between and after them."""
    return np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _buckets(letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """Buckets of subwords as (bucket, whether it counts, where it starts): for each length of GRAMS those of all places, then whole words.

    A space marks the start or the end of a word, so it stands first or last in a subword and never within.  Values are
    polynomials in _MIX, those of words by differences of running sums.
    """
    gap = letters == 32
    gaps = np.cumsum(gap, dtype=np.int32)
    letters = letters.astype(np.uint64)
    places = np.arange(len(letters), dtype=np.int32)
    value = np.zeros(len(letters), np.uint64)
    for n in range(1, min(GRAMS[-1], len(letters)) + 1):
        value = value[: len(letters) - n + 1] * _MIX + letters[n - 1 :]
        if n in GRAMS:
            yield _bucket(value, n), gaps[n - 2 : len(gaps) - 1] == gaps[: len(value)], places[: len(value)]
    start = np.flatnonzero(gap)
    power, inverse = _powers(len(letters))
    sums = np.cumsum(letters * power[: len(letters)])
    yield _bucket((sums[start[1:]] - sums[start[:-1]]) * inverse[start[:-1]], 0), None, start[:-1]


@lru_cache(maxsize=2)
def _power_table(bits: int) -> tuple[np.ndarray, np.ndarray]:
    back = np.uint64(pow(int(_MIX), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << bits) - 1, x)]), dtype=np.uint64) for x in (_MIX, back))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _MIX and of its inverse modulo 2 to the 64, at least ``n`` of each."""
    return _power_table(n.bit_length())


def _bucket(value: np.ndarray, n: int) -> np.ndarray:
    value = (value ^ (value >> np.uint64(29)) ^ np.uint64(n)) * _MIX
    return (value >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all words, and the word that each belongs to; words hold no space and are not empty.

    Subwords are the word and every n-gram of it with its marks; a word shorter than an n-gram has none of that length.
    """
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    letters = _letters(words)
    owner = np.cumsum(letters == 32, dtype=np.int32) - 1
    found = [(bucket if use is None else bucket[use], owner[at if use is None else at[use]]) for bucket, use, at in _buckets(letters)]
    return np.concatenate([b for b, _ in found]), np.concatenate([o for _, o in found])


def _folded(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower()


@dataclass
class ToxicityModel:
    """Embeddings of the buckets and the softmax over their mean; of a fixed size."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def __post_init__(self) -> None:
        """slope: what each bucket adds to the difference of the two logits, before the mean."""
        self.slope = (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    def word_vector(self, word: str) -> np.ndarray:
        """The sum of its subwords' embeddings, also of a word never seen."""
        return self.embeddings[subwords([word.lower()])[0]].sum(0)

    def _worths(self, pieces: list[list[bytes]]) -> np.ndarray:
        """What the words of each piece add up to; as all is linear, words need not be told apart."""
        texts = [_folded(b" ".join(words)) for words in pieces]
        letters = _letters(texts)
        worth = np.zeros(len(letters), np.float32)
        for bucket, use, at in _buckets(letters):
            if use is None:
                worth[at] += self.slope[bucket]
            else:
                worth[: len(bucket)] += self.slope[bucket] * use
        start = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        return np.add.reduceat(worth, start, dtype=np.float64)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """P(toxic) of each text; one without words has the bias alone.  Texts are worked on in pieces of about _PIECE bytes."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        own, of, size = [], [], 0

        def add() -> None:
            if own:
                np.add.at(total, of, self._worths(own))
                own.clear()
                of.clear()

        for k, text in enumerate(texts):
            for words in word_slices(text, _PIECE):
                own.append(words)
                of.append(k)
                n[k] += len(words)
                size += sum(map(len, words))
                if size >= _PIECE:
                    add()
                    size = 0
        add()
        logit = SCALE * total / np.maximum(n, 1) + float(self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its label, its words once each, space-joined, and how often each occurs."""
    for batch in batches:
        words, counts = [], []
        for text in batch.column(1).to_pylist():
            own: Counter = Counter()
            for part in word_slices(text):
                own.update(part)
            folded: Counter = Counter()
            for w, n in own.items():
                folded[_folded(w)] += n
            words.append(" ".join(folded))
            counts.append(np.fromiter(folded.values(), np.int32, len(folded)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string()), pa.array(counts, pa.binary())], names=["label", "words", "counts"])


def fit(docs: list[tuple[int, list[str], np.ndarray]], prior: float) -> ToxicityModel:
    """Descend along the whole sample's gradient, then shift the bias to ``prior``, the log odds of all labels.

    ``docs`` are (label, words, counts).  As all layers up to the softmax are linear, the gradient of an embedding is
    what its bucket adds to the documents' errors times the difference of the two weight columns.  A bucket learns the
    faster the more unevenly its words are spread over the labels (smoothed log odds, squared) and the rarer it is (the
    root of its share of the text), so that subwords of one or two documents are not learnt by heart.
    """
    rng = np.random.default_rng(SEED)
    e = rng.normal(0, 0.01, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w = rng.normal(0, 1 / math.sqrt(DIMENSIONS), (DIMENSIONS, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    docs = [d for d in docs if d[1]]
    y = np.array([label for label, _, _ in docs], np.float32)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(e * 0, w, np.array([0.0, prior], np.float32))
    place: dict[str, int] = {}
    word = np.fromiter((place.setdefault(x, len(place)) for _, words, _ in docs for x in words), np.int32)
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), [len(words) for _, words, _ in docs])
    share = np.concatenate([c / c.sum() for _, _, c in docs]).astype(np.float32)
    listed = list(place)
    n = len(listed)
    of_label = [np.bincount(word[y[doc] == k], minlength=n) for k in (0, 1)]
    mass = np.bincount(word, share, n)
    counts = np.zeros((3, BUCKETS))
    for k in range(0, n, _BLOCK):
        bucket, owner = subwords(listed[k : k + _BLOCK])
        for row, x in zip(counts, (*of_label, mass), strict=True):
            row += np.bincount(bucket, x[k + owner], BUCKETS)
    seen, average = counts[0] + counts[1], counts[1].sum() / counts[:2].sum()
    live = seen >= FLOOR
    odds = np.log((counts[1] + SMOOTHING * average) / (seen + SMOOTHING) / average)
    pace = np.where(live, odds**2 / np.sqrt(np.maximum(counts[2], 1e-9)), 0)
    pace = (pace / max(pace.sum() / max(live.sum(), 1), 1e-12)).astype(np.float32)
    e[~live] = 0
    blocks = []
    for k in range(0, n, _BLOCK):
        bucket, owner = subwords(listed[k : k + _BLOCK])
        keep = live[bucket]
        blocks.append((k, min(k + _BLOCK, n), bucket[keep].astype(np.int32), owner[keep].astype(np.int32)))

    layers = [e, w, b]
    momentum, square = [np.zeros_like(x) for x in layers], [0.0, 0.0, 0.0]
    for step in range(1, STEPS + 1):
        slope = e @ (w[:, 1] - w[:, 0])
        worth = np.concatenate([np.bincount(owner, slope[bucket], end - k) for k, end, bucket, owner in blocks])
        logit = SCALE * np.bincount(doc, share * worth[word], len(docs)) + b[1] - b[0]
        if np.logaddexp(0, (1 - 2 * y) * logit).mean() < ENOUGH:
            break
        d = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(docs)
        back = SCALE * np.bincount(word, share * d[doc], n)
        by_bucket = np.zeros(BUCKETS)
        for k, end, bucket, owner in blocks:
            by_bucket += np.bincount(bucket, back[k:end][owner], BUCKETS)
        to_w = (by_bucket @ e).astype(np.float32)
        grads = [(by_bucket * pace).astype(np.float32)[:, None] * (w[:, 1] - w[:, 0]), np.stack([-to_w, to_w], 1), np.array([-d.sum(), d.sum()], np.float32)]
        for k, (x, g) in enumerate(zip(layers, grads, strict=True)):
            momentum[k] += np.float32(0.1) * (g - momentum[k])
            square[k] += 0.02 * (float((g * g).sum()) - square[k])
            x -= np.float32(RATES[k] / (math.sqrt(square[k] / (1 - 0.98**step)) + 1e-12) / (1 - 0.9**step)) * momentum[k]
    b += np.array([0.0, prior - math.log(y.sum() / (len(y) - y.sum()))], np.float32)
    return ToxicityModel(e, w, b)


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on a bounded sample of ``labels`` (doc_id, label 0 or 1); lang, source and doc_id are no inputs.

    Of each label at most SAMPLE documents of up to LONGEST characters are read, whole, those with the least hashes of
    doc_id and then the least ids; of rows that share a doc_id the least (text, label) counts.  Executors count their
    words; the driver gets the words of the sample.  Null labels, ids and labels without a document count for
    nothing; without both labels the model gives their share, smoothed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label, most in SAMPLE.items():
        own = usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = own if chosen is None else chosen.union(own)
    chosen = written(chosen.dropDuplicates(["doc_id"]), scratch(spark, "chosen"))  # as many rows as SAMPLE at most
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    found = docs.where(F.length(F.coalesce("text", F.lit(""))) <= LONGEST).select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(chosen), "doc_id")
    sample = written(found.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("own")).select("doc_id", "own.*"), scratch(spark, "sample"))
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id").select("label", "text").mapInArrow(_counted, "label int, words string, counts binary")
    got = [(r.label, r.words.split(" ") if r.words else [], np.frombuffer(r.counts, np.int32)) for r in rows.toLocalIterator()]
    return fit(got, math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))


def score_column(model: Broadcast, text: Column) -> Column:
    """score of a text beside the other columns of its table; a null text counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.scores(texts.to_pylist()), pa.float64())

    return score(text.cast("binary"))


def classify(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score double, predicted int) of every row: predicted is 1 from THRESHOLD on.

    Null and empty texts are scored by the bias alone.  Texts are read whole, long ones slice by slice, a long word
    at once.  Repeated rows each get their row, equal texts get equal scores, an empty table gives an empty one,
    and other columns may have any names.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(shared, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
