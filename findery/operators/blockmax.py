"""A stored keyword index that is kept up to date in batches and searched with block-max pruning.

Postings of a term lie in blocks, one for each range of chunks, in order of impact.  A block's head holds the pairs of
frequency and length that no other posting of it beats, so its greatest score is known exactly whatever the mean length
has become.  A search reads heads, scores a few promising ranges to learn what the k-th best score is at least, and then
reads only blocks that can still matter.  Results equal those of a search over all postings.

Batches add rows and rewrite none: new blocks, changes of document frequencies and lengths, and the chunks that they
replace.  Statistics are sums of those changes, so an update reads the terms of the chunks that it touches and no others.

Below a path: ``blocks`` (batch, bucket of the term), ``forward`` (batch, bucket of the chunk), ``frequencies`` (batch,
bucket of the term), ``totals`` and ``removed`` (batch).  A chunk_id stands once in a batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findery.functions.shared import scratch, written
from findery.functions.text import half_even, tokenizer
from findery.operators.keyword import BROADCAST_TERMS, K1, B, query_terms, top_k

#: Chunks in a range, on average; a block has at most one posting of each.
SPAN = 128
BUCKETS = 64
#: Ranges of a query that are scored whole to learn the k-th best score, and how much k may add to them.
FIRST_RANGES = 4
#: Scores are rounded to 6 digits; a bound must be under the k-th best by more than this to prune.
SLACK = 1e-5
_SCHEMAS = {
    "blocks": "range long, term string, n long, front array<struct<tf:long,length:long>>, postings array<struct<chunk_id:long,tf:long,length:long>>",
    "forward": "range long, chunk_id long, length long, terms array<string>",
    "frequencies": "term string, delta long",
    "totals": "chunks long, length long",
    "removed": "range long, chunk_id long",
}
_BUCKETED = ("blocks", "forward", "frequencies")


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _put(df: DataFrame, path: str, table: str, batch: int, last: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Replace a batch's part of a table; rows of a bucket meet in few files, large buckets are split; ``last`` is done there."""
    own = df if table not in _BUCKETED else last(df.withColumn("bucket", _bucket(F.col("chunk_id" if table == "forward" else "term"))).hint("rebalance", "bucket"))
    own.write.mode("overwrite").partitionBy(*(["bucket"] if table in _BUCKETED else [])).parquet(f"{path}/{table}/batch={batch}")


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Batches whose last table was written: the index is what they say together."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(x.getPath().getName()[6:]) for x in fs.listStatus(folder) if fs.exists(done(x.getPath(), "_SUCCESS")))


def table(spark: SparkSession, path: str, name: str, batches: list[int]) -> DataFrame:
    """A table of the index over some batches, with batch and, where it has one, bucket."""
    schema = f"{_SCHEMAS[name]}{', bucket int' if name in _BUCKETED else ''}, batch int"
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*(f"{path}/{name}/batch={b}" for b in batches))


def live_chunks(spark: SparkSession, path: str, batches: list[int] | None = None) -> DataFrame:
    """(range, chunk_id, length, terms, bucket, batch) of chunks that no later batch replaced or removed."""
    batches = _batches(spark, path) if batches is None else batches
    gone = table(spark, path, "removed", batches).select("range", "chunk_id")
    return table(spark, path, "forward", batches).join(gone, ["range", "chunk_id"], "left_anti")


def apply_batch(spark: SparkSession, path: str, batch: int, chunks: DataFrame | None = None, deleted: DataFrame | None = None, text: str = "text", key: str = "chunk_id", tokens: str = "unicode_words") -> None:
    """Insert or replace ``chunks`` (key, text) and remove ``deleted`` (key) as a batch; batches count upwards.

    Null texts are chunks without terms; rows without a key are left out; a key in both is replaced.  The last batch may
    be applied again after a failure and replaces what it wrote: an index without it is as it was before, as the table of
    totals is written last.  Old versions are found by the buckets of their chunk_ids.
    """
    before = [b for b in _batches(spark, path) if b < batch]
    if any(b > batch for b in _batches(spark, path)):
        raise ValueError(f"batch {batch} has later ones")
    empty = spark.createDataFrame([], "chunk_id long, text string")
    new = empty if chunks is None else chunks.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("chunk_id"), F.col(text).alias("text"))
    ranges = F.lit(max(1, -(-new.count() // SPAN)))
    place = F.shiftleft(F.lit(batch).cast("long"), 40) + F.pmod(F.xxhash64("chunk_id", F.lit("range")), ranges)
    placed = new.select("chunk_id", place.alias("range"), "text")
    tokenized = lambda df, *kept: df.select(*kept, "chunk_id", "range", F.coalesce(tokenizer(tokens)(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    impact = lambda p: p["tf"] / (p["tf"] + K1 * (1 - B + B * p["length"] / 256.0))
    ordered = F.sort_array(F.transform("postings", lambda p: F.struct(impact(p).alias("impact"), p["tf"].alias("tf"), p["length"].alias("length"), p["chunk_id"].alias("chunk_id"))), asc=False)
    by_impact = F.when(F.size("postings") == 1, F.col("postings")).otherwise(F.transform(ordered, lambda p: F.struct(p["chunk_id"].alias("chunk_id"), p["tf"].alias("tf"), p["length"].alias("length")))).alias("postings")
    _put(placed, path, "forward", batch, lambda df: tokenized(df, "bucket").select("range", "chunk_id", F.size("tokens").cast("long").alias("length"), F.array_distinct("tokens").alias("terms"), "bucket"))

    own = table(spark, path, "forward", [batch])
    ids = own.select("chunk_id")
    if deleted is not None:
        ids = ids.union(deleted.where(F.col(key).isNotNull()).select(F.col(key).cast("long")))
    ids = written(ids.distinct(), scratch(spark, "ids"))
    held = [r.b for r in ids.select(_bucket(F.col("chunk_id")).alias("b")).distinct().collect()]  # BUCKETS at most
    old = live_chunks(spark, path, before).where(F.col("bucket").isin(held)).join(ids, "chunk_id", "left_semi")
    old = written(old.select("range", "chunk_id", "length", "terms"), scratch(spark, "old"))
    _put(old.select("range", "chunk_id"), path, "removed", batch)

    # texts meet by range, so that words are counted and gathered where they are cut; explode alone would also cut them before, to leave out those without words
    counted = tokenized(placed.repartition("range")).select("range", "chunk_id", F.size("tokens").cast("long").alias("length"), F.explode_outer("tokens").alias("term")).where("term IS NOT NULL")
    counted = counted.groupBy("range", "term", "chunk_id", "length").agg(F.count("*").alias("tf"))
    blocks = counted.groupBy("range", "term").agg(F.collect_list(F.struct("chunk_id", "tf", "length")).alias("postings"))  # a range's chunks at most
    _put(blocks, path, "blocks", batch, lambda df: df.select("range", "term", F.size("postings").cast("long").alias("n"), by_impact, "bucket").select("range", "term", "n", _front(F.col("postings")).alias("front"), "postings", "bucket"))

    change = own.select(F.explode("terms").alias("term"), F.lit(1).alias("by")).union(old.select(F.explode("terms"), F.lit(-1)))
    _put(change.groupBy("term").agg(F.sum("by").alias("delta")).where("delta <> 0"), path, "frequencies", batch)
    size = lambda df, sign: df.agg((F.count("*") * sign).alias("chunks"), (F.coalesce(F.sum("length"), F.lit(0)) * sign).alias("length"))
    _put(size(own, 1).union(size(old, -1)).agg(F.sum("chunks").alias("chunks"), F.sum("length").alias("length")), path, "totals", batch)


def _front(postings: Column) -> Column:
    """The pairs (tf, length) that no posting beats in both: the best of them is the block's greatest score at any mean length."""
    pairs = F.array_sort(F.transform(postings, lambda p: F.struct((-p["tf"]).alias("tf"), p["length"].alias("length"))))
    none = F.array().cast("array<struct<tf:long,length:long>>")
    one = F.array(F.struct(postings[0]["tf"].alias("tf"), postings[0]["length"].alias("length")))
    shorter = lambda acc, p: F.when((F.size(acc) == 0) | (p["length"] < F.try_element_at(acc, F.lit(-1))["length"]), F.concat(acc, F.array(F.struct((-p["tf"]).alias("tf"), p["length"].alias("length"))))).otherwise(acc)
    return F.when(F.size(postings) == 1, one).otherwise(F.aggregate(pairs, none, shorter))


def corpus_totals(spark: SparkSession, path: str) -> tuple[int, float]:
    """Live chunks and their mean length, with 4 digits, ties to even."""
    sums = table(spark, path, "totals", _batches(spark, path)).agg(F.sum("chunks").alias("n"), F.sum("length").alias("sum"))
    r = sums.select("n", half_even(F.try_divide(F.col("sum").cast("double"), F.col("n")), 4).alias("mean")).first()
    return r.n or 0, r.mean or 0.0


def statistics(spark: SparkSession, path: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, document_frequency, corpus_chunk_count, average_document_length) of all terms, or of ``terms`` (term), as sums of changes."""
    n, mean = corpus_totals(spark, path)
    changes = table(spark, path, "frequencies", _batches(spark, path))
    if terms is not None:
        changes = changes.where(F.col("bucket").isin(_term_buckets(terms))).join(terms, "term", "left_semi")
    found = changes.groupBy("term").agg(F.sum("delta").alias("document_frequency")).where("document_frequency > 0")
    return found.withColumns({"corpus_chunk_count": F.lit(n).cast("long"), "average_document_length": F.lit(mean)})


def _term_buckets(terms: DataFrame) -> list[int]:
    """Buckets of terms, BUCKETS at most: partitions that a scan is pruned to."""
    return [r.b for r in terms.select(_bucket(F.col("term")).alias("b")).distinct().collect()]


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write the index at another path as one batch, under the number of its last: live chunks and postings alone, frequencies summed.

    Ranges keep their numbers, which later batches do not use again.
    """
    batches = _batches(spark, path)
    one = max(batches, default=0)
    gone = table(spark, path, "removed", batches).select("range", "chunk_id")
    _put(live_chunks(spark, path).drop("bucket", "batch"), into, "forward", one)
    each = table(spark, path, "blocks", batches).select("range", "term", F.posexplode("postings").alias("at", "p"))
    each = each.join(gone.withColumnRenamed("range", "r"), (F.col("range") == F.col("r")) & (F.col("p.chunk_id") == F.col("chunk_id")), "left_anti")
    blocks = each.groupBy("range", "term").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("postings"))
    _put(blocks.select("range", "term", "n", _front(F.col("postings")).alias("front"), "postings"), into, "blocks", one)
    _put(statistics(spark, path).select("term", F.col("document_frequency").alias("delta")), into, "frequencies", one)
    _put(gone.limit(0), into, "removed", one)
    _put(table(spark, path, "totals", batches).agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")), into, "totals", one)


@dataclass
class Search:
    """rows: the ranked results; reading: (query_id, postings, postings_read) of the queries' terms."""

    rows: DataFrame
    reading: DataFrame


def search(queries: DataFrame, path: str, k: int, candidates: DataFrame | None = None, tokens: str = "unicode_words") -> Search:
    """(query_id, chunk_id, score, matched_term_count, document_length, rank), as ``bm25_topk`` gives over the live chunks.

    Of each query the FIRST_RANGES (and a few more for a large k) with the greatest bounds are scored whole; their k-th
    score is a floor.  A range whose blocks' greatest scores sum to less is left out.  In the others the weakest terms
    that stay below the floor together are left aside; blocks of the rest give chunks, those that cannot reach the
    floor even with all that was left aside are dropped, and only ranges with chunks left read the blocks left aside.
    ``candidates`` (chunk_id) restricts results alone.  A query without terms has no results.
    """
    spark = queries.sparkSession
    batches = _batches(spark, path)
    terms = written(query_terms(queries, tokens=tokens), scratch(spark, "terms"))
    few = terms.count() <= BROADCAST_TERMS
    side = F.broadcast if few else (lambda df: df)
    buckets = _term_buckets(terms)
    n, mean = corpus_totals(spark, path)
    known = statistics(spark, path, side(terms.select("term").distinct()))
    idf = F.log(1 + (F.lit(n) - F.col("document_frequency") + 0.5) / (F.col("document_frequency") + 0.5))
    weights = written(terms.join(known, "term").select("query_id", "term", (idf * (K1 + 1) * F.col("query_frequency")).alias("w")), scratch(spark, "weights"))
    part = lambda p: p["tf"] / (p["tf"] + K1 * (1 - B + B * p["length"] / F.lit(mean or 1.0)))

    greatest = F.array_max(F.transform("front", part))
    asked = side(weights.select("term").distinct())
    gone = table(spark, path, "removed", batches).select("range", "chunk_id")
    gone_in = gone.groupBy("range").agg(F.collect_set("chunk_id").alias("gone"))  # a range's chunks at most
    gone_in = F.broadcast(gone_in) if gone.count() <= BROADCAST_TERMS else gone_in
    blocks = table(spark, path, "blocks", batches).where(F.col("bucket").isin(buckets)).join(asked, "term", "left_semi").join(gone_in, "range", "left")
    left = F.when(F.col("gone").isNull(), F.col("postings")).otherwise(F.filter("postings", lambda p: ~F.array_contains("gone", p["chunk_id"])))
    blocks = written(blocks.select("range", "term", "n", greatest.alias("most"), left.alias("postings")), scratch(spark, "blocks"))  # of the terms asked for alone
    heads = blocks.select("range", "term", "n", "most").join(side(weights), "term").select("query_id", "range", "term", "n", "w", (F.col("w") * F.col("most")).alias("bound"))
    heads = written(heads, scratch(spark, "heads"))

    def exploded(found: DataFrame, *kept: str) -> DataFrame:
        """(query_id, range, chunk_id, length, part, kept...) of every live posting of blocks with query_id and w."""
        found = found.select("query_id", "range", "w", *kept, F.explode("postings").alias("p"))
        found = found.select("query_id", "range", F.col("p.chunk_id").alias("chunk_id"), F.col("p.length").alias("length"), (F.col("w") * part(F.col("p"))).alias("part"), *kept)
        return found if candidates is None else found.join(candidates.select("chunk_id"), "chunk_id", "left_semi")

    def matches(wanted: DataFrame, *kept: str) -> DataFrame:
        """``exploded`` of the blocks of (query_id, range, term, w, kept...)."""
        return exploded(wanted.select("query_id", "range", "term", "w", *kept).join(blocks.select("range", "term", "postings"), ["range", "term"]), *kept)

    by_range = heads.groupBy("query_id", "range").agg(F.sum("bound").alias("whole"))
    best = Window.partitionBy("query_id").orderBy(F.desc("whole"), "range")
    first = by_range.withColumn("at", F.row_number().over(best)).where(F.col("at") <= FIRST_RANGES + -(-k // SPAN)).select("query_id", "range")
    first = written(first, scratch(spark, "first"))
    small = F.broadcast if first.count() <= BROADCAST_TERMS else (lambda df: df)
    seeds = written(heads.join(small(first), ["query_id", "range"], "left_semi"), scratch(spark, "seeds"))
    small = F.broadcast if seeds.count() <= BROADCAST_TERMS else (lambda df: df)
    scored = matches(small(seeds)).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
    kth = Window.partitionBy("query_id").orderBy(F.desc("score"))
    floor = written(scored.withColumn("at", F.row_number().over(kth)).where(F.col("at") == k).select("query_id", (F.col("score") - SLACK).alias("floor")), scratch(spark, "floor"))

    weakest = Window.partitionBy("query_id", "range").orderBy("bound", "term")
    together = Window.partitionBy("query_id", "range")

    def ranked(rows: DataFrame) -> DataFrame:
        """Heads of ranges that can reach the floor: which terms are left aside, and the bounds of those together as ``rest``."""
        alive = rows.join(floor, "query_id", "left").withColumn("whole", F.sum("bound").over(together)).where(F.col("floor").isNull() | (F.col("whole") >= F.col("floor")))
        aside = F.coalesce(F.sum("bound").over(weakest.rowsBetween(Window.unboundedPreceding, 0)) < F.col("floor"), F.lit(False))
        return alive.withColumn("aside", aside).withColumn("rest", F.coalesce(F.sum(F.when(F.col("aside"), F.col("bound"))).over(together), F.lit(0.0))).drop("whole")

    def reaching(rows: DataFrame, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Chunks that can reach the floor by what is not left aside, with their parts so far."""
        found = matches(join(rows.where("NOT aside")), "floor", "rest").groupBy("query_id", "range", "chunk_id", "length").agg(F.sum("part").alias("part"), F.count("*").alias("terms"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
        return found.where(F.col("floor").isNull() | (F.col("part") + F.col("rest") >= F.col("floor"))).drop("floor", "rest")

    # where over a quarter of the chunks of the first ranges stay open, to leave terms aside saves no work: all blocks are scored, range by range
    if reaching(ranked(seeds), small).count() * 4 > scored.count():
        every = exploded(blocks.repartition("range").join(side(weights), "term")).groupBy("range", "query_id", "chunk_id")
        scores = every.agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("matched_term_count"), F.first("length").alias("document_length")).drop("range")
        return Search(top_k(scores, k), heads.groupBy("query_id").agg(F.sum("n").alias("postings"), F.sum("n").alias("postings_read")))
    kept = written(ranked(heads), scratch(spark, "ranked"))
    main = kept.where("NOT aside")
    open_ = written(reaching(kept, lambda df: df), scratch(spark, "open"))
    later = kept.where("aside").join(open_.select("query_id", "range").distinct(), ["query_id", "range"], "left_semi")
    more = matches(later).join(open_.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    both = open_.select("query_id", "chunk_id", "length", "part", "terms").unionByName(more.select("query_id", "chunk_id", "length", "part", F.lit(1).cast("long").alias("terms")))
    scores = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"), F.sum("terms").alias("matched_term_count"), F.first("length").alias("document_length"))

    read = seeds.select("query_id", "range", "term", "n").union(main.select("query_id", "range", "term", "n")).union(later.select("query_id", "range", "term", "n")).distinct()
    of = lambda df, name: df.groupBy("query_id").agg(F.sum("n").alias(name))
    reading = of(heads, "postings").join(of(read, "postings_read"), "query_id")
    return Search(top_k(scores, k), reading)
