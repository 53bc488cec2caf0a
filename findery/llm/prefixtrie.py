"""Prefix trie of conversations by partition refinement.

All conversations start in one class.  Each round splits the classes by the next turn; a class of one conversation,
or of copies of one, is retired and its tail written as a chain.  Rounds therefore end where different conversations
part, however long they are.  Sums over subtrees are folded back from the deepest level to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.llm.common import scratch, small_batches, written

#: A rebuilt conversation borrows fewer turns than this.
BORROWED = 6
_EMPTY = hashlib.sha256(b"").digest()
_TURN = "conv_id long, place long, key binary, chars long, upto long"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order get their place and the characters so far, within their conversation and partition."""
    last, n, total = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, chars = np.array(batch.column(0)), np.array(batch.column(2))
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        if ids[0] != last:
            n, total = 0, 0
        size = np.diff(np.concatenate([first, [len(ids)]]))
        start = np.repeat(first, size)
        sums = np.cumsum(chars)
        before = np.concatenate([[0], sums])[start]
        own = start == 0
        place = np.arange(len(ids)) - start + 1 + n * own
        upto = sums - before + total * own
        last, n, total = ids[-1], int(place[-1]), int(upto[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), batch.column(1), batch.column(2), pa.array(upto)], names=["conv_id", "place", "key", "chars", "upto"])


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, key, chars, upto) of all turns: place in order of turn, chars the code points of the text, upto their sum so far.

    Null turns come first, turns alike go by role and text; null roles and texts are empty, rows without a conv_id
    are left out.  key is a digest of role and text.  Rows are dealt by ranges of (conv_id, turn), so that a
    conversation of any length is spread over tasks; texts travel only where turns are alike.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.length(text).cast("long").alias("chars"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("key"),
    )
    alike = own.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("of"), F.col("turn").alias("at"), F.lit(True).alias("tied"))
    own = own.join(alike, (F.col("conv_id") == F.col("of")) & F.col("turn").eqNullSafe(F.col("at")), "left")
    tie = F.when(F.col("tied"), F.struct("role", "text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "tie"]
    dealt = own.select("conv_id", "turn", tie.alias("tie"), "key", "chars").repartitionByRange(*order).sortWithinPartitions(*order)
    parts = dealt.select("conv_id", "key", "chars").mapInArrow(_numbered, _TURN).withColumn("part", F.spark_partition_id())
    parts = written(parts, scratch(spark, "turns"))
    held = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("chars").alias("sum"))
    cut = held.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("parts")).where("parts > 1")
    so_far = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.join(cut, F.col("conv_id") == F.col("of")).select(F.col("conv_id").alias("of"), F.col("part").alias("in"), F.sum("n").over(so_far).alias("n"), F.sum("sum").over(so_far).alias("sum"))
    both = parts.join(F.broadcast(before), (F.col("conv_id") == F.col("of")) & (F.col("part") == F.col("in")), "left")  # two rows a partition at most
    moved = {c: F.col(c) + F.coalesce(F.col(by), F.lit(0)) for c, by in (("place", "n"), ("upto", "sum"))}
    return both.withColumns(moved).select("conv_id", "place", "key", "chars", "upto")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start like the first of their hundred: their turns, and (conv_id, len, total) of each, turnless ones too.

    Conversation c gets the first h turns of c - c % 100 (all if it has fewer, none if there is none; % has the sign
    of c), then its own turns after its first h; h is the CRC-32 of the decimal c, modulo BORROWED.
    """
    own = written(turns, scratch(turns.sparkSession, "ordered"))
    few = range(1, BORROWED)
    convs = own.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.sum("chars").alias("sum"),
        F.array(F.lit(0).cast("long"), *(F.max(F.when(F.col("place") == k, F.col("upto"))) for k in few)).alias("cuts"),
        F.array(*(F.max(F.when(F.col("place") == k, F.struct("key", "chars", "upto"))) for k in few)).alias("firsts"),
    )
    convs = written(convs, scratch(turns.sparkSession, "convs"))
    first = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("cuts").alias("base_cuts"), F.col("firsts").alias("base_firsts"))
    c = F.col("conv_id")
    info = convs.select("conv_id", "n", "sum", "cuts", (F.crc32(c.cast("string").cast("binary")) % BORROWED).cast("int").alias("h"), (c - c % 100).alias("base")).join(first, "base", "left")
    borrowed = F.least(F.col("h"), F.coalesce(F.col("base_n"), F.lit(0))).cast("int")
    skipped = F.least(F.col("h"), F.col("n")).cast("int")
    info = info.withColumns({"b": borrowed, "lost": F.get("cuts", skipped), "won": F.coalesce(F.get("base_cuts", borrowed), F.lit(0))})
    theirs = info.where("b > 0").select("conv_id", F.posexplode(F.slice("base_firsts", F.lit(1), F.col("b"))).alias("at", "t")).select("conv_id", (F.col("at") + 1).cast("long").alias("place"), "t.key", "t.chars", "t.upto")
    rest = own.join(info.select(c.alias("of"), "h", "b", "lost", "won"), c == F.col("of")).where("place > h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("b")).alias("place"), "key", "chars", (F.col("upto") - F.col("lost") + F.col("won")).alias("upto"))
    length = F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return theirs.unionByName(rest), info.select("conv_id", length.alias("len"), (F.col("won") + F.col("sum") - F.col("lost")).alias("total"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring ids of a group as one text, for each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        of, ids = np.array(batch.column(0)), batch.column(1).to_pylist()
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(first, [*first[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(of[first]), pa.array([ids[k] for k in first], pa.int64()), pa.array(texts)], names=["rep", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's texts in order, joined by commas; the state alone stays in memory."""
    now, state, done = None, hashlib.sha256(), []
    row = lambda: pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([d for _, d in done], pa.binary())], names=["rep", "ends"])
    for batch in batches:
        for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if of == now:
                state.update(b",")
            else:
                if now is not None:
                    done.append((now, state.digest()))
                now, state = of, hashlib.sha256()
            state.update(text.encode())
        yield row()
        done.clear()
    if now is not None:
        done.append((now, state.digest()))
        yield row()


def _groups(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Copies as one row: (rep: the smallest conv_id, w: how many, len, total, ends: digest of their ids).

    Whole conversations are compared by 192 bits that are exclusive ors over (place, key), so that they are made in
    parts where the turns lie.  Ids are put in order and packed by ranges, then hashed text by text.
    """
    spark = convs.sparkSession
    bits = [f"x{k}" for k in range(3)]
    marks = turns.groupBy(F.col("conv_id").alias("of")).agg(*(F.bit_xor(F.xxhash64(F.lit(k), "place", "key")).alias(x) for k, x in enumerate(bits)))
    told = convs.join(marks, F.col("conv_id") == F.col("of"), "left").select("conv_id", "len", "total", *(F.coalesce(x, F.lit(0)).alias(x) for x in bits))
    told = written(told, scratch(spark, "told"))
    same = ["len", "total", *bits]
    groups = written(told.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count("*").alias("w")), scratch(spark, "groups"))
    many = told.join(groups.where("w > 1"), same).select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    packed = many.mapInArrow(_packed, "rep long, first long, ids string")
    ends = packed.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(_digests, "rep long, ends binary")
    one = groups.where("w = 1").withColumn("ends", F.unhex(F.sha2(F.col("rep").cast("string").cast("binary"), 256)))
    return one.unionByName(groups.where("w > 1").join(ends, "rep").select(one.columns)).select("rep", "w", "len", "total", "ends")


def _suffix() -> Column:
    """The chars of a conversation from this turn on."""
    return F.col("total") - F.col("upto") + F.col("chars")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie: each distinct sequence of first turns of ``turns`` (conv_id, place, key, chars, upto).

    ``convs`` (conv_id, len, total) has every conversation once, also turnless ones, which end at the root.  Per node:
    conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (of its
    subtree, itself included), saved (over its subtree, each node's n_convs - 1 times the chars of its last turn), ends
    (binary SHA-256 of the ids of members that end here, ascending, comma-joined).  No conversations, no nodes.

    Each round reads the turns of one place of the conversations still active and writes two tables; a class is
    known by its smallest member.  There are as many rounds as different conversations have turns in common, plus
    one.  The driver gets one number a round.
    """
    spark = convs.sparkSession
    groups = written(_groups(turns, convs), scratch(spark, "reps"))
    kept = turns.join(groups.select("rep", "len", "total"), F.col("conv_id") == F.col("rep")).select("rep", F.col("place").alias("depth"), "key", "chars", "upto", "len", "total")
    kept = written(kept.repartitionByRange("depth", "rep").sortWithinPartitions("depth", "rep"), scratch(spark, "places"))
    nodes, folded = scratch(spark, "nodes"), scratch(spark, "folded")

    def level(classes: DataFrame, k: int) -> DataFrame:
        alone = {c: F.min(c).alias(c) for c in ("len", "total", "upto")}
        stats = [F.min("rep").alias("conv_id"), F.sum("w").alias("n_convs"), F.count("*").alias("reps"), F.first("chars").alias("chars"), *alone.values()]
        ended = F.coalesce(F.max(F.when(F.col("len") == k, F.col("ends"))), F.lit(_EMPTY)).alias("ends")
        kept_ends = F.max("ends").alias("tail_ends")  # of one conversation: its own
        return written(classes.agg(*stats, ended, kept_ends), f"{nodes}/{k}")

    active = groups.withColumns({"parent": F.lit(None).cast("long"), "chars": F.lit(0).cast("long"), "upto": F.lit(0).cast("long")})
    levels = [level(active.groupBy("parent"), 0)]
    root = levels[0].where("reps > 1").select("conv_id").collect()  # one row at most
    active = active.where(F.lit(bool(root))).withColumn("class", F.lit(root[0].conv_id if root else None).cast("long"))
    while True:
        k = len(levels)
        turn = kept.where(F.col("depth") == k).select("rep", "key", "chars", "upto")
        here = active.select("rep", "w", "len", "total", "ends", F.col("class").alias("parent")).join(turn, "rep")
        here = written(here, scratch(spark, "split"))
        found = level(here.groupBy("parent", "key"), k)
        if not found.limit(1).count():
            break
        levels.append(found)
        split = found.where("reps > 1").select("parent", "key", F.col("conv_id").alias("class"))
        active = here.join(split, ["parent", "key"])

    below = None
    for k in reversed(range(len(levels))):
        own = levels[k].withColumn("depth", F.lit(k).cast("long"))
        alone = F.col("reps") == 1
        if below is None:
            kids = {"kids": F.lit(None).cast("long"), "under": F.lit(None).cast("long"), "worth": F.lit(None).cast("long")}
            own = own.withColumns(kids)
        else:
            sums = below.groupBy(F.col("parent_conv_id").alias("of")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("under"), F.sum("saved").alias("worth"))
            own = own.join(sums, F.col("conv_id") == F.col("of"), "left")
        below = own.select(
            "conv_id",
            "depth",
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            F.when(alone, (F.col("len") > k).cast("long")).otherwise(F.coalesce("kids", F.lit(0))).alias("n_children"),
            F.when(alone, 1).otherwise(F.coalesce("under", F.lit(1))).cast("long").alias("n_leaves"),
            F.when(alone, (F.col("n_convs") - 1) * _suffix()).otherwise((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("worth", F.lit(0))).alias("saved"),
            "ends",
        )
        below = written(below, f"{folded}/{k}")

    heads = [x.where("reps = 1 AND len > " + str(k)).select(F.col("conv_id").alias("rep"), F.lit(k).cast("long").alias("from"), "n_convs", F.col("tail_ends").alias("ends")) for k, x in enumerate(levels)]
    tails = kept.join(reduce(DataFrame.unionByName, heads), "rep").where("depth > from")
    last = F.col("depth") == F.col("len")
    chain = tails.select(
        F.col("rep").alias("conv_id"),
        "depth",
        F.col("rep").alias("parent_conv_id"),
        "n_convs",
        (~last).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * _suffix()).alias("saved"),
        F.when(last, F.col("ends")).otherwise(F.lit(_EMPTY)).alias("ends"),
    )
    return spark.read.schema(below.schema).parquet(*(f"{folded}/{k}" for k in range(len(levels)))).unionByName(chain)
