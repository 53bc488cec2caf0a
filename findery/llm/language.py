"""Language identification: known words first, ever shorter character n-grams for the rest."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.llm.common import scratch, small_batches, written

#: Documents of each language that training reads, drawn by a hash of doc_id; of fewer it reads all.
SAMPLE_PER_LANGUAGE = 1500
#: Words and n-grams below this share of all of their length in a language teach nothing, nor do those seen once.
#: It is a floor of frequency, no count of terms: terms of one length and language number 1 / RARE at the most.
RARE = 1e-5
LONGEST = 4
#: Texts whose words are scored together.
GROUP = 250
#: Longer texts are read word by word instead of as one list of words.
LONG = 1 << 20
UNKNOWN = "und"

_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def word_counts(text: str | None) -> Counter:
    """Runs of letters, and marks after them, in lower case, with how often each occurs."""
    text = (text or "").lower()
    return Counter(_WORDS.findall(text) if len(text) < LONG else (m[0] for m in _WORDS.finditer(text)))


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with a mark at both ends; the whole if it is shorter."""
    marked = f"_{word}_"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


@dataclass
class LanguageModel:
    """Rows of log frequencies, an entry for each language; by table (0: words, n: n-grams) the row of each term."""

    languages: list[str]
    tables: list[dict[str, int]]
    logs: np.ndarray

    def word_score(self, word: str) -> np.ndarray:
        """Log frequencies of a known word, else the mean over its longest n-grams of which any is known."""
        return self.scores([word])[0]

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word; the n-grams of unknown words are looked up word by word and averaged all at once."""
        rows: list[int] = []
        sizes = np.zeros(len(words), np.int64)
        known, tables = self.tables[0].get, [(n, self.tables[n].get) for n in range(LONGEST, 0, -1)]
        for k, word in enumerate(words):
            if (own := known(word)) is not None:
                rows.append(own)
                sizes[k] = 1
                continue
            marked = f"_{word}_"
            for n, get in tables:
                if found := [r for i in range(len(marked) - n + 1) if (r := get(marked[i : i + n])) is not None]:
                    rows += found
                    sizes[k] = len(found)
                    break
        out = np.zeros((len(words), len(self.languages)))
        some = np.flatnonzero(sizes)
        if len(some):
            starts = np.cumsum(sizes[some]) - sizes[some]
            out[some] = np.add.reduceat(self.logs[rows], starts, axis=0) / sizes[some, None]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its share of the likelihood) of each text; ``und`` and 0 without a letter."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        counted = [word_counts(t) for t in texts]
        own = list(set().union(*counted))
        at = dict(zip(own, range(len(own)), strict=True))
        scores, out = self.scores(own), []
        for counts in counted:
            if not counts:
                out.append((UNKNOWN, 0.0))
                continue
            total = np.fromiter(counts.values(), np.float64, len(counts)) @ scores[list(map(at.__getitem__, counts))]
            share = np.exp(total - total.max())
            best = int(np.argmax(total))
            out.append((self.languages[best], float(share[best] / share.sum())))
        return out


def train(docs: DataFrame, learn: Column) -> LanguageModel:
    """Count words and n-grams of about SAMPLE_PER_LANGUAGE whole documents a language, of rows where ``learn`` holds.

    A document is drawn if the hash of its doc_id lies below its language's share, so no task sorts or
    gathers a language, however large; of rows that share a doc_id the least (lang, text) counts once.
    Rows with a null lang, text or doc_id teach nothing.  Counting is distributed; the driver gets a
    number of rows for each language, and the terms above the floor.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lang = F.col("lang").cast("string")
    usable = docs.where(learn & lang.isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text")
    rows = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    shares = F.from_json(F.lit(json.dumps({k: SAMPLE_PER_LANGUAGE / n for k, n in rows.items()})), "map<string,double>")
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(shares, F.col("lang")) * (1 << 30))
    sample = drawn.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("own")).select("own.*")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(language, Counter()).update(word_counts(text))
            rows = Counter()
            for language, words in counts.items():
                for word, n in words.items():
                    rows[language, 0, word] += n
                    for size in range(1, LONGEST + 1):
                        for g in grams(word, size):
                            rows[language, size, g] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int32()), pa.array([k[2] for k in rows], pa.string()), pa.array(list(rows.values()), pa.int64())],
                names=["lang", "size", "term", "n"],
            )

    counted = written(sample.select("lang", "text").mapInArrow(terms, "lang string, size int, term string, n long").groupBy("lang", "size", "term").agg(F.sum("n").alias("n")), scratch(spark, "terms"))
    summed = counted.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    totals = {(r.lang, r["size"]): r.total for r in summed.collect()}
    kept = counted.join(F.broadcast(summed), ["lang", "size"]).where((F.col("n") > 1) & (F.col("n") >= RARE * F.col("total")))
    languages = sorted({k[0] for k in totals})
    at = {x: k for k, x in enumerate(languages)}
    tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    found, terms_known = kept.select("lang", "size", "term", "n").collect(), 0
    for r in found:
        terms_known += tables[r["size"]].setdefault(r.term, terms_known) == terms_known
    counts, all_of = np.zeros((terms_known, len(languages)), np.float32), np.zeros((terms_known, len(languages)), np.float32)
    for r in found:
        counts[tables[r["size"]][r.term], at[r.lang]] = r.n
    for size, table in enumerate(tables):
        all_of[list(table.values())] = [totals.get((x, size), 0) + 1 for x in languages]
    return LanguageModel(languages, tables, np.log((counts + 0.1) / np.maximum(all_of, 1)))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred string, score double) of every row, from its whole text alone, however long.

    A text that is null, empty or has no letter is ``und`` with score 0, and so is every text if nothing
    was learnt.  Of languages that score alike the first by name is given.  Repeated rows each get their
    row, an empty table gives an empty one, and other columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [x for k in range(0, len(texts), GROUP) for x in own.predict(texts[k : k + GROUP])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
