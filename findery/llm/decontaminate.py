"""Benchmark passages in documents: a prefix-filtered join of item windows with whole documents.

A window is WINDOW consecutive words of an item.  It is contained in a document exactly if its words
stand there consecutively, so of its word shingles any single one is a sufficient prefix; the rarest
over all documents is taken.  A document is a candidate where a prefix shingle occurs, the position of
the shingle in the window fixes where the window would start, the bounds of the document must hold
it, and all words are then compared.

A benchmark of up to BROADCAST_BYTES is one index that every task holds.  Beyond that nothing of the
benchmark is held anywhere whole: windows, prefixes and the documents' matching shingles are joined by
shuffles, and only a bit filter of fixed size is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.llm.common import alnum_words, scratch, small_batches, unused, written

WINDOW = 10
SHINGLE = 3
#: Benchmark text up to which one index is broadcast, some fifty times as large in memory.
BROADCAST_BYTES = 4 << 20
#: Bits of the filter through which documents' shingles pass before they are shuffled.
FILTER_BITS = 1 << 26
#: Text turned into words at once in a worker.
TEXT_BYTES = 4 << 20


class WindowIndex:
    """Distinct windows of some items: word codes, the items of each window, and prefix shingles."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, shingle: int = SHINGLE) -> None:
        self.code: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            codes = tuple(self.code.setdefault(w, len(self.code) + 1) for w in alnum_words(text))
            size = min(window, len(codes))
            for k in range(len(codes) - size + 1 if codes else 0):
                owners.setdefault(codes[k : k + size], set()).add(item)
        self.windows, self.owners = list(owners), [sorted(x) for x in owners.values()]
        self.size = np.array(list(map(len, self.windows)), np.int64)
        self.words = np.zeros((len(self.windows), window), np.int64)
        for row, w in zip(self.words, self.windows, strict=True):
            row[: len(w)] = w
        self.base, self.shingle = len(self.code) + 1, shingle
        self.lengths = sorted({min(shingle, n) for n in self.size.tolist()})
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def _key(self, codes: np.ndarray, length: int) -> np.ndarray:
        """A number for the ``length`` words from each place on; 0 where a word is not the benchmark's."""
        n = max(0, len(codes) - length + 1)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(length):
            part = codes[k : k + n]
            key, known = key * self.base + part, known & (part > 0)
        return np.where(known, key, 0)

    def shingles(self, length: int) -> np.ndarray:
        """Sorted keys of all shingles of that length in windows that use it."""
        own = [self._key(np.array(w, np.int64), length) for w in self.windows if min(self.shingle, len(w)) == length]
        return np.unique(np.concatenate(own)) if own else np.empty(0, np.int64)

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's prefix: the shingle that occurs least in the documents, the first of equals."""
        for length in self.lengths:
            rows = []
            for k, w in enumerate(self.windows):
                if min(self.shingle, len(w)) == length:
                    keys = self._key(np.array(w, np.int64), length).tolist()
                    at = min(range(len(keys)), key=lambda i: (counts.get((length, keys[i]), 0), i))
                    rows.append((keys[at], k, at))
            table = np.array(sorted(rows), np.int64)
            keys, first, many = np.unique(table[:, 0], return_index=True, return_counts=True)
            self.prefix[length] = keys, first, many, table[:, 1], table[:, 2]

    def coded(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of many documents' words in a row, a 0 after each, and where each document starts."""
        get = self.code.get
        flat = np.array([get(w, 0) for own in words for w in (*own, b"")], np.int64)
        starts = np.concatenate([[0], np.cumsum(np.array(list(map(len, words)), np.int64) + 1)])
        return flat, starts

    def tally(self, words: list[list[bytes]]) -> list[tuple[int, int, int]]:
        """(length, shingle key, how often) of the benchmark's shingles in documents."""
        flat, _ = self.coded(words)
        out = []
        for length in self.lengths:
            keys = self._key(flat, length)
            keys, many = np.unique(keys[np.isin(keys, self.shingles_of[length])], return_counts=True)
            out += [(length, k, n) for k, n in zip(keys.tolist(), many.tolist(), strict=True)]
        return out

    def find(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places hit as a mask with document starts, document and window of each occurrence)."""
        flat, starts = self.coded(words)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for length, (keys, first, many, window, offset) in self.prefix.items():
            own = self._key(flat, length)
            place = np.flatnonzero(own)
            at = np.minimum(np.searchsorted(keys, own[place]), len(keys) - 1)
            hit = keys[at] == own[place]
            place, at = place[hit], at[hit]
            # a candidate for each window that has this prefix
            n = many[at]
            row = np.repeat(first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, w = np.repeat(place, n) - offset[row], window[row]
            fits = (start >= 0) & (start + self.size[w] <= len(flat))
            found.append((start[fits], w[fits]))
        start = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
        w = np.concatenate([x for _, x in found]) if found else np.empty(0, np.int64)
        same = np.ones(len(start), bool)
        for k in range(self.words.shape[1]):  # a 0 between documents equals no word of a window
            inside = k < self.size[w]
            same &= ~inside | (flat[np.minimum(start + k, len(flat) - 1)] == self.words[w, k])
        start, w = start[same], w[same]
        edge = np.zeros(len(flat) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.size[w], -1)
        return np.cumsum(edge[:-1]) > 0, starts, np.searchsorted(starts, start, "right") - 1, w


def _slices(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Runs of texts of up to TEXT_BYTES, or one longer text."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t or b"") > TEXT_BYTES:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t or b"")
    if own:
        yield own


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, text): a null item_id or text is no item; rows with one item_id are one item with several texts."""
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).dropna()


def build_index(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> WindowIndex:
    """The index of a small benchmark; its shingles are counted in one pass over all documents."""
    index = WindowIndex(sorted((r.item, bytes(r.text)) for r in items.collect()), window)
    index.shingles_of = {n: index.shingles(n) for n in index.lengths}
    if index.windows:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts in _slices(batch.column(0).to_pylist()):
                    rows = shared.value.tally([alnum_words(t) for t in texts])
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["length", "shingle", "n"])

        found = docs.select(F.col("text").cast("binary")).mapInArrow(tally, "length long, shingle long, n long")
        counts = found.groupBy("length", "shingle").agg(F.sum("n").alias("n")).collect()
        shared.destroy()
        index.order({(r.length, r.shingle): r.n for r in counts})
    return index


def _matched(index: WindowIndex, texts: list[bytes | None]) -> Iterator[tuple[int, int, list[str]]]:
    """(words, words hit, items) of each text."""
    for own in _slices(texts):
        words = [alnum_words(t) for t in own]
        hit, starts, doc, window = index.find(words)
        items = [set() for _ in own]
        for d, w in np.unique(np.stack([doc, window], 1), axis=0).tolist():
            items[d].update(index.owners[w])
        counts = np.concatenate([[0], np.cumsum(hit)])
        for k, ws in enumerate(words):
            yield len(ws), int(counts[starts[k + 1]] - counts[starts[k]]), sorted(items[k])


def _hash(words: list[bytes], at: int, length: int) -> int:
    """A signed 64-bit hash of ``length`` words, other for each length."""
    h = xxhash.xxh64_intdigest(b" ".join(words[at : at + length]), length)
    return h - (1 << 64) if h >> 63 else h


def _filter_of(shingles: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set at the low bits of each ``sh``; parts of it are made by the executors."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) % FILTER_BITS] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in shingles.select("sh").coalesce(8).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def _passing(shared, words: list[bytes], lengths: list[int]) -> Iterator[tuple[int, int, int]]:
    """(place, length, hash) of the shingles of a text that the filter lets pass."""
    for n in lengths:
        own = np.array([_hash(words, k, n) for k in range(len(words) - n + 1)], np.int64)
        at = own.view(np.uint64) % FILTER_BITS
        hit = shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1
        for k in np.flatnonzero(hit).tolist():
            yield k, n, int(own[k])


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("binary"), F.lit(b"")))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item, win, size, at, length, sh): each window, its words joined by spaces, with each of its shingles and where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                size = min(window, len(words))
                length = min(SHINGLE, size)
                rows = [(item, b" ".join(words[k : k + size]).decode(), size, i, length, _hash(words, k + i, length)) for k in range(len(words) - size + 1 if words else 0) for i in range(size - length + 1)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["item", "win", "size", "at", "length", "sh"])

    return items.mapInArrow(run, "item string, win string, size long, at long, length long, sh long")


def hits_by_shuffle(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, n_hit, items) of each text, by ``_text_key``, in which a window stands; of a benchmark of any size."""
    spark = docs.sparkSession
    placed = written(_windows(items, window), scratch(spark, "windows"))
    lengths = sorted(r.length for r in placed.select("length").distinct().collect())
    texts = docs.select(_text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))

    counting = spark.sparkContext.broadcast(_filter_of(placed))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([h for t in batch.column(0).to_pylist() for _, _, h in _passing(counting, alnum_words(t), lengths)], np.int64)
            hashes, many = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(many, pa.int64())], names=["sh", "n"])

    counts = texts.select("text").mapInArrow(count, "sh long, n long").groupBy("sh").agg(F.sum("n").alias("n"))
    rarest = placed.join(counts, "sh", "left").groupBy("win").agg(F.min_by(F.struct("sh", "at", "size"), F.struct(F.coalesce("n", F.lit(0)), F.col("at"))).alias("p"))
    prefixes = written(rarest.select("win", "p.*"), scratch(spark, "prefixes"))
    seeking = spark.sparkContext.broadcast(_filter_of(prefixes))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, hashes, before, around = [], [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = alnum_words(t)
                for place, _, h in _passing(seeking, words, lengths):
                    first = max(0, place - window)
                    keys.append(k)
                    places.append(place)
                    hashes.append(h)
                    before.append(place - first)
                    around.append(b" ".join(words[first : place + window]).decode())
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((keys, places, hashes, before, around), kinds, strict=True)], names=["key", "place", "sh", "before", "around"])

    candidates = texts.mapInArrow(seek, "key string, place long, sh long, before long, around string").join(prefixes, "sh")
    inside = F.col("before") >= F.col("at")
    stands = F.array_join(F.slice(F.split("around", " "), (F.col("before") - F.col("at") + 1).cast("int"), F.col("size").cast("int")), " ") == F.col("win")
    hits = written(candidates.where(inside).where(stands).select("key", (F.col("place") - F.col("at")).alias("start"), "size", "win").distinct(), scratch(spark, "hits"))
    hit = hits.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("word")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    owners = hits.select("key", "win").distinct().join(placed.select("win", "item").distinct(), "win").select("key", "item").distinct()
    return hit.join(owners.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items")), "key")


def _is_small(items: DataFrame) -> bool:
    return (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words long, n_hit long, items array<string>) for every document.

    A null or empty text has no words, hits or items; without items nothing is hit; a null item_id or text
    is no item.  Texts are read whole; repeated rows each get their row; an empty table gives an empty one;
    other columns may have any names.  With a small benchmark no document is shuffled.
    """
    small_batches(docs.sparkSession)
    items = _items(benchmark)
    if not _is_small(items):

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = [len(alnum_words(t)) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "key", "n_words"])

        rows = docs.select(F.col("doc_id").cast("long"), _text_key(F.col("text")), F.col("text").cast("binary")).mapInArrow(count, "doc_id long, key string, n_words long")
        found = rows.join(hits_by_shuffle(docs, items, window), "key", "left")
        return found.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    shared = docs.sparkSession.sparkContext.broadcast(build_index(docs, items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_matched(shared.value, batch.column(1).to_pylist()))
            n, hit, items = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "n_hit", "items"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, n_words long, n_hit long, items array<string>"
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows, with all their columns, in whose text no window stands.

    Null, empty and very long texts are texts like any other: the first two hold no window and stay, the last are
    read whole.  Repeated rows stay or go together, an empty table or benchmark takes nothing away, and columns
    may have any names.
    """
    small_batches(docs.sparkSession)
    items = _items(benchmark)
    if not _is_small(items):
        key = unused(docs, "key")
        found = hits_by_shuffle(docs, items, window).select(F.col("key").alias(key))
        return docs.join(found, _text_key(F.col("text")) == F.col(key), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(build_index(docs, items, window))

    @F.arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        return pa.array([n > 0 for _, n, _ in _matched(shared.value, texts.to_pylist())], pa.bool_())

    return docs.where(~hit(F.col("text").cast("binary")))
