"""Near-duplicates by word shingles: SimHash balls and MinHash bands propose pairs, exact Jaccard similarity of the shingle sets decides.

A similarity of 0.8 leaves SimHash fingerprints 2 to 14 bits apart; meet-in-the-middle balls for 14 bits
would have 700 million values a fingerprint.  So balls join the closest copies, bands most others, and an
exact set join over all texts finds every pair that neither proposes: no link depends on a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findery.llm.common import scratch, small_batches, unused, word_slices, written
from findery.llm.components import components
from findery.llm.simhash import SEED, ball, first_rows, grouped, majority

#: Words of a shingle, and the least similarity (a fraction of whole numbers, so that it is compared exactly) of near-duplicates.
SIZE, SIMILAR = 5, (4, 5)
#: Bits by which fingerprints differ that balls join.
CLOSE = 2
#: A pair shares no band with probability (1 - 0.8 ** ROWS) ** BANDS: 1.5e-5 at a similarity of just 0.8, less above.
BANDS, ROWS = 28, 5
#: Texts on which common shingles are counted, in how many of them a common one is, and how many of these are kept at most.
COUNTED, COMMON, MOST_COMMON = 5_000, 2, 100_000
#: Texts that meet in a shingle are compared in pairs if no more have it; others are first put in order by exact counts.
HEAVY = 256
#: Rounds in which the leaders of buckets are compared with the others.
LEADS = 2
#: So many keys (a few MB) are broadcast to find their texts.
FEW = 200_000
#: Words whose hashes a worker remembers: workers outlive a stage, so what they hold is kept from all later ones.
REMEMBERED = 50_000
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_known: dict[bytes, int] = {}


def _hashed(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, SEED)
    if len(_known) < REMEMBERED:
        _known[word] = h
    return h


def forget() -> None:
    """Give up remembered words and Arrow's free memory: a worker that goes on to other stages needs it."""
    _known.clear()
    pa.default_memory_pool().release_unused()


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z."""
    get = _known.get
    parts = [np.fromiter((h if (h := get(w)) is not None else _hashed(w) for w in words), np.uint64, len(words)) for words in word_slices(text.lower() if text else None)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def key(words: np.ndarray) -> int:
    """Texts that agree in their folded words share it; 0 if there is no word."""
    return xxhash.xxh64_intdigest(words.tobytes(), SEED) if len(words) else 0


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes; a text of fewer words is one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - SIZE + 1)
    out = np.full(n, len(words[:SIZE]), np.uint64)
    for k in range(min(SIZE, len(words))):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def bands(own: np.ndarray) -> np.ndarray:
    """A hash of each band of ROWS minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 1024):
        np.minimum(least, (FACTORS * own[k : k + 1024]).min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def signature(text: Column) -> Column:
    """struct<fp, n, sim, bands> of a text: its key, its number of shingles, their SimHash and the bands of their minima."""

    @F.arrow_udf("struct<fp:bigint,n:bigint,sim:bigint,bands:array<bigint>>")
    def sign(texts: pa.Array) -> pa.Array:
        keys, counts, sims, values = [], [], [], []
        for text in texts:  # one text at a time: a batch of sets would fill the worker
            words = word_hashes(text.as_py())
            own = shingles(words)
            keys.append(key(words))
            counts.append(len(own))
            sims.append(majority(own))
            values.append(bands(own) if len(own) else [])
        fp, sim = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, sims))
        return pa.StructArray.from_arrays([fp, pa.array(counts, pa.int64()), sim, pa.array(values, pa.list_(pa.int64()))], names=["fp", "n", "sim", "bands"])

    return sign(text.cast("binary"))


def _first_of_key(rows: DataFrame) -> DataFrame:
    """The shingles of one row of each key ``k`` in each partition; rows stream by, only keys are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            new = [i for i, k in enumerate(batch.column(0).to_pylist()) if not (k in seen or seen.add(k))]
            sets = [shingles(word_hashes(batch.column(1)[i].as_py())).tobytes() for i in new]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(new, pa.int64())), pa.array(sets, pa.binary())], names=["k", "own"])
        forget()

    return rows.mapInArrow(run, "k long, own binary")


def _sets(keys: DataFrame, held: DataFrame, fp: Column) -> DataFrame:
    """(k, own): the shingles of the texts of some keys ``w``; other texts are not shuffled."""
    rows = held.select(fp.alias("k"), F.col("text").cast("binary").alias("text"))
    same = F.col("k") == F.col("w")
    rows = rows.join(keys.hint("shuffle_hash"), same, "left_semi") if keys.count() > FEW else rows.join(F.broadcast(keys), same, "left_semi")
    return written(_first_of_key(rows).groupBy("k").agg(F.min("own").alias("own")), scratch(held.sparkSession, "sets"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar."""
    both = pairs.join(sets.select(F.col("k").alias("b"), F.col("own").alias("own_b")), "b").join(sets.select(F.col("k").alias("a"), F.col("own").alias("own_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(k)] for k in (2, 3)]
            found = [similar(x, y) for x, y in zip(*sets, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return both.select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long")


def _untested(pairs: DataFrame, tested: DataFrame | None, spark: SparkSession) -> DataFrame:
    """The pairs to verify, written: those of fitting sizes that were not verified before."""
    pairs = _sized(pairs)
    return written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), scratch(spark, "pairs"))


def _sized(pairs: DataFrame) -> DataFrame:
    """Without pairs whose numbers of shingles alone rule similarity out, each once with its smaller key first."""
    near = SIMILAR[1] * F.least("na", "nb") >= SIMILAR[0] * F.greatest("na", "nb")
    return pairs.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set."""
    for batch in batches:
        for k, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = np.frombuffer(own.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), k, np.int64)), pa.array(tokens)], names=["k", "token"])


def prefix(own: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles of a set: similar sets share one of them, as all are ordered alike.

    Those in the sorted array ``common`` come last, by how ``often`` they were counted; the order changes no result.
    """
    wanted = len(own) - -(-len(own) * SIMILAR[0] // SIMILAR[1]) + 1
    at = np.searchsorted(common, own)
    hit = np.append(common, np.uint64(0))[at] == own
    hit &= at < len(common)
    rest = own[~hit]
    if len(rest) < wanted:
        rest = np.concatenate([rest, own[hit][np.lexsort((own[hit], often[at[hit]]))]])
    return rest[:wanted]


def _places(rows: DataFrame, chosen: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(value, k): the chosen shingles of one row of each key ``k`` in each partition; rows stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = set(), [], 0
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (k in seen or seen.add(k)) and len(own := shingles(word_hashes(text.as_py()))):
                    own = chosen(own).view(np.int64)
                    held.append((own, np.full(len(own), k, np.int64)))
                    n += len(own)
                if n > 1 << 16:
                    yield flat(held)
                    held, n = [], 0
        if held:
            yield flat(held)
        forget()

    def flat(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["value", "k"])

    return rows.mapInArrow(run, "value long, k long")


def _common(rows: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of those that several of about COUNTED texts have, sorted; at most MOST_COMMON, the most frequent."""
    few = rows.where(F.pmod(F.xxhash64("k"), F.lit(max(1, texts // COUNTED))) == 0)
    counted = _places(few, lambda own: own).groupBy("value").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("often"))
    found = counted.where(f"low < high AND often >= {COMMON}").orderBy(F.desc("often"), "value").limit(MOST_COMMON).select("value", "often").toArrow()
    common, often = found.column("value").to_numpy().view(np.uint64), found.column("often").to_numpy()
    order = np.argsort(common)
    return common[order], often[order]


def _unjoined(first: DataFrame, held: DataFrame, fp: Column, roots: DataFrame) -> DataFrame:
    """(value, k, n, root): shingles of prefixes in which texts of different roots meet.

    Every text is asked, whatever balls and bands found: similar texts that are not joined yet meet here.
    """
    spark = held.sparkSession
    rows = held.select(fp.alias("k"), F.col("text").cast("binary").alias("text"))
    common = spark.sparkContext.broadcast(_common(rows, first.count()))
    alike = Window.partitionBy("value")
    met = _places(rows, lambda own: prefix(own, *common.value)).select("*", F.min("k").over(alike).alias("low"), F.max("k").over(alike).alias("high"))
    met = written(met.where("low < high").select("value", "k").distinct(), scratch(spark, "met"))  # copies in several tasks count once
    placed = met.join(first.select("fp", "n"), F.col("k") == F.col("fp")).join(roots, F.col("k") == F.col("node"), "left")
    placed = written(placed.select("value", "k", "n", F.coalesce("root", "k").alias("root")), scratch(spark, "placed"))
    return written(_still_open(placed), scratch(spark, "unjoined"))


def _light_pairs(placed: DataFrame, heavy: DataFrame) -> DataFrame:
    """(a, na, b, nb): pairs of different roots that share a shingle of ``placed`` that is not ``heavy`` and can be similar.

    What two sets share lies in both prefixes or, of the one whose prefix ends first, behind it: ceil(0.8 n) - 1 at
    most.  So similar texts share nearly half of their prefixes; a heavy shingle counts as shared.
    """
    counted = placed.join(heavy, "value", "left_semi").groupBy("k").agg(F.count("*").alias("heavy"))
    light = placed.join(heavy, "value", "left_anti").join(counted, "k", "left").select("value", "k", "n", "root", F.coalesce("heavy", F.lit(0)).alias("heavy"))
    other = light.select("value", *[F.col(c).alias(f"o_{c}") for c in ("k", "n", "root", "heavy")])
    met = light.join(other, "value").where("k < o_k AND root <> o_root").where(SIMILAR[1] * F.least("n", "o_n") >= SIMILAR[0] * F.greatest("n", "o_n"))
    pairs = met.groupBy(F.col("k").alias("a"), F.col("o_k").alias("b")).agg(F.count("*").alias("both"), *[F.first(c).alias(c) for c in ("n", "o_n", "heavy", "o_heavy")])
    behind = F.ceil(F.greatest("n", "o_n") * SIMILAR[0] / SIMILAR[1]) - 1
    most = F.col("both") + F.least("heavy", "o_heavy") + behind
    return pairs.where((SIMILAR[0] + SIMILAR[1]) * most >= SIMILAR[0] * (F.col("n") + F.col("o_n"))).select("a", F.col("n").alias("na"), "b", F.col("o_n").alias("nb"))


def _prefix_pairs(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, na, b, nb): all pairs of different roots that can be similar, of ``open_`` (fp, n, root) with their ``sets``.

    Shingles are put in order of how many of these texts have them.  Two sets that are similar have one of their
    first n - ceil(0.8 n) + 1 shingles in common, and at the first such place what is left in both must still
    suffice.  Rare shingles come first, so texts that share one passage hardly ever meet; a shingle of one
    text or one root meets nothing.
    """
    tokens = sets.mapInArrow(_listed, "k long, token long")
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    ordered = tokens.join(often, "token").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("own"))  # a text's own shingles
    n = F.size("own")
    prefix = F.slice("own", F.lit(1), n - F.ceil(n * SIMILAR[0] / SIMILAR[1]).cast("int") + 1)
    placed = ordered.select("k", n.cast("long").alias("n"), F.posexplode(prefix).alias("at", "t")).where("t.often > 1").select("k", "n", "at", "t.token")
    placed = written(placed.join(open_.select("fp", "root"), F.col("k") == F.col("fp")).select("token", "k", "n", "at", "root"), scratch(sets.sparkSession, "prefixes"))
    placed = written(_still_open(placed, "token"), scratch(sets.sparkSession, "split"))
    other = placed.select("token", *[F.col(c).alias(f"o_{c}") for c in ("k", "n", "at", "root")])
    met = placed.join(other, "token").where("k < o_k AND root <> o_root")
    least = F.lit(SIMILAR[0]) * (F.col("n") + F.col("o_n"))  # (SIMILAR[0] + SIMILAR[1]) times what both must share
    left = F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at"))
    met = met.where((SIMILAR[1] * F.least("n", "o_n") >= SIMILAR[0] * F.greatest("n", "o_n")) & ((SIMILAR[0] + SIMILAR[1]) * left >= least))
    return met.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("o_k").alias("b"), F.col("o_n").alias("nb"))


def _still_open(members: DataFrame, value: str = "value") -> DataFrame:
    """The members of buckets in which not all are connected yet."""
    split = members.groupBy(value).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(value)
    return members.join(split, value, "left_semi")


def links(first: DataFrame, held: DataFrame, fp: Column) -> DataFrame:
    """(a, b) verified links that join all texts connected by similar pairs.

    ``first``: (fp, n, sim, bands), a row for each key; ``held``: rows with their text and key ``fp``.  Texts meet
    in the values of their SimHash balls and in their bands.  A round
    compares the leader of each bucket with all others of it and then takes it out, so that a large
    group of near-copies costs no pairs within it: members that are connected already need no comparison.
    The leader is the member whose buckets are the largest in sum, as those of a text are that many others
    were made from, and of equals the one with the greatest key.  After LEADS rounds all texts go through an
    exact set join between different roots, so no pair that could join two groups is left out: texts that share
    a shingle of their prefixes are compared, those of a shingle that more than HEAVY have by prefixes of the
    rarest shingles among them.
    """
    spark = held.sparkSession
    # one shuffle of the values serves both the grouping and the join; nearly all buckets have one member
    values = first.select("fp", F.explode(F.concat(ball(F.col("sim"), CLOSE), "bands")).alias("value")).repartition("value")
    shared = values.groupBy("value").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("size")).where("low < high").select("value", "size")
    members = written(values.join(shared, "value").select("value", "fp", "size"), scratch(spark, "shared"))
    weights = members.groupBy("fp").agg(F.sum("size").alias("weight")).join(first.select("fp", "n"), "fp")
    left = written(members.join(weights, "fp").select("value", "fp", "n", "weight", F.col("fp").alias("root")), scratch(spark, "members"))
    found = tested = None
    for _ in range(LEADS):
        lead = left.groupBy("value").agg(F.max(F.struct("weight", "fp", "n", "root")).alias("lead"))
        met = written(left.join(lead, "value"), scratch(spark, "met"))
        pairs = met.where("lead.root <> root").select(F.col("lead.fp").alias("a"), F.col("lead.n").alias("na"), F.col("fp").alias("b"), F.col("n").alias("nb"))
        pairs = _untested(pairs, tested, spark)
        tested = pairs if tested is None else tested.union(pairs)
        keys = written(pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct(), scratch(spark, "wanted"))
        more = written(_verified(pairs, _sets(keys, held, fp)), scratch(spark, "links"))
        found = more if found is None else found.union(more)
        roots = components(found)
        rest = met.where("lead.fp <> fp").select("value", "fp", "n", "weight").join(roots, F.col("fp") == F.col("node"), "left").select("value", "fp", "n", "weight", F.coalesce("root", "fp").alias("root"))
        left = written(_still_open(rest), scratch(spark, "members"))
        if not left.limit(1).count():
            break
    placed = _unjoined(first, held, fp, roots)
    heavy = written(placed.groupBy("value").agg(F.count("*").alias("size")).where(F.col("size") > HEAVY).select("value"), scratch(spark, "heavy"))
    pairs = _untested(_light_pairs(placed, heavy), tested, spark)
    tested = tested.union(pairs)
    keys = written(pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct(), scratch(spark, "wanted"))
    found = found.union(written(_verified(pairs, _sets(keys, held, fp)), scratch(spark, "links")))
    open_ = written(placed.join(heavy, "value", "left_semi").select(F.col("k").alias("fp"), "n", "root").distinct(), scratch(spark, "open"))
    if not open_.limit(1).count():
        return found
    sets = _sets(open_.select(F.col("fp").alias("w")), held, fp)
    return found.union(written(_verified(_untested(_prefix_pairs(open_, sets), tested, spark), sets), scratch(spark, "links")))


def _near(docs: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """(rows as written with their signature, its column, (doc_id, fp, component_id, root) of every row)."""
    spark = docs.sparkSession
    small_batches(spark)
    name = unused(docs, "signature")
    held = written(docs.withColumn(name, signature(F.col("text"))), scratch(spark, "signed"))
    own = held.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"{name}.fp"), *[F.col(f"{name}.{c}") for c in ("n", "sim", "bands")])
    first = written(own.groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "sim", "bands")]), scratch(spark, "first"))
    linked = links(first.select("fp", "n", "sim", "bands"), held, F.col(f"{name}.fp"))
    return held, name, grouped(own.select("doc_id", "fp"), first.select("fp", "least"), linked)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root) of every row, as in ``simhash``; fp is the key of the row's text.

    Shingles are compared by 64-bit hashes.  Texts without words, null ones too, are copies of each other.
    Texts are read whole, long ones slice by slice.  Repeated rows stay, an empty table gives an empty one,
    and other columns may have any names.
    """
    return _near(docs.select("doc_id", "text"))[2]


def one_of_each(docs: DataFrame) -> DataFrame:
    """All columns of one row of each group of near-duplicates: the one with the smallest doc_id, as in ``simhash``."""
    held, name, near = _near(docs)
    return first_rows(held, near, F.col(f"{name}.fp")).drop(name)
