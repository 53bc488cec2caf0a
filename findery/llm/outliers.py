"""Quality rules: counts of whole texts, fixed rules, and robust multivariate outliers by group.

DataFrame functions only.  Groups are pairs of language and source; the location and scatter of each
are minimum-covariance-determinant estimates: from several starts that follow from the rows alone,
concentration steps refit mean and covariance to the three quarters of rows that are nearest by
Mahalanobis distance, as long as the determinant falls; of the starts the least determinant counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.llm.common import scratch, written

WINDOW = 5
WORD = r"[^\x20\x09-\x0D]++"
SYMBOLS = "#*$%&|<>"
#: Words that every rate is smoothed by, so that a few words make no outlier.
PRIOR_WORDS = 40
#: The share of rows that estimates rest on, and the factor that makes them right for normal rows of 5 dimensions.
CORE, CONSISTENCY = 0.75, 1.41
#: A start is followed until its determinant falls by less than this share.
FALL = 1e-4
#: Rank error of quantiles is one part in so many; groups of fewer rows have exact ones.
ACCURACY = 10_000
#: Groups of fewer rows are pooled by language, and if still too small, all together: forty rows for each dimension.
SMALLEST = 200
#: Squared Mahalanobis distance beyond which a row is rejected: about 1 in 7,000 of normal rows of 5 dimensions (chi-square 0.99986).
CUTOFF = 25.0
#: Tables by group of up to so many rows (a few MB) are broadcast; larger ones are joined by a shuffle.
BROADCAST_GROUPS = 20_000
#: The transformed statistics, and the least standard deviation assumed of each (statistics that hardly vary).
FLOORS = {"x_length": 0.3, "x_chars": 0.03, "x_symbols": 0.04, "x_lines": 0.07, "x_repeats": 0.03}
X = list(FLOORS)


def _repeated_words(windows: Column) -> tuple[Column, Column]:
    """The hashes with their places, sorted, for a column ``placed``; and the words in windows that occur again.

    Only texts with a repeated window are sorted: equal hashes then are neighbours, and the runs of
    five words from their places on are united in one sweep.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(x: Column, k: Column) -> Column:
        return F.coalesce(F.get(placed_ref, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(placed_ref, k + 1)["h"] == x["h"], F.lit(False))

    placed_ref = F.col("placed")
    starts = F.array_sort(F.transform(F.filter(placed_ref, again), lambda x: x["i"]))
    return placed, F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(acc["end"], p.cast("long"))).alias("n"), (p.cast("long") + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row.

    Windows are compared by 64-bit hashes within one text.  A null text counts as empty.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    cut = text.withColumns(
        {
            "words": F.regexp_extract_all("text", F.lit(f"({WORD})"), 1),
            "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
        }
    ).drop("text")
    hashed = cut.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    places = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    windows = hashed.withColumn("windows", F.transform(places, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))).drop("hashes")
    placed, repeated = _repeated_words(F.col("windows"))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    found = windows.withColumn("placed", F.when(some, placed)).drop("windows")
    return found.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0).cast("long"))).drop("placed")


def base_failed() -> Column:
    """The fixed rules: fewer than 10 words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _transformed(stats: DataFrame) -> DataFrame:
    n = F.col("n_words") + PRIOR_WORDS
    return stats.withColumns(
        {
            "x_length": F.log1p("n_words"),
            "x_chars": F.log((F.col("word_chars") + 5 * PRIOR_WORDS) / n),
            "x_symbols": F.col("n_symbols") / n,
            "x_lines": F.col("n_dup_lines") / (F.col("n_lines") + 2),
            "x_repeats": F.col("n_repeat_words") / n,
        }
    )


def _side(by_group: DataFrame, groups: int) -> DataFrame:
    """A table with a row for each group, broadcast if there are few, so that a group's rows stay where they are."""
    return F.broadcast(by_group) if groups <= BROADCAST_GROUPS else by_group


def _grouped(rows: DataFrame) -> DataFrame:
    """With the key of each row's group: its language and source, or what that is pooled into.

    Keys name their level and write nulls out, so null languages and sources are groups of their own and
    no group shares a key with a pool.
    """
    named = lambda level, *columns: F.concat(F.lit(level), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    counts = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = counts.where(F.col("n") < SMALLEST).groupBy(F.col("lang").alias("small_lang")).agg(F.sum("n").alias("n_lang"))
    keys = counts.join(small, F.col("lang").eqNullSafe(F.col("small_lang")), "left").select(
        F.col("lang").alias("k_lang"), F.col("source").alias("k_source"),
        F.when(F.col("n") >= SMALLEST, named("group", "lang", "source")).when(F.col("n_lang") >= SMALLEST, named("pool", "lang")).otherwise("rest").alias("key"),
    )
    keys = written(keys, scratch(rows.sparkSession, "keys"))
    same = F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source"))
    return rows.join(_side(keys, keys.count()), same, "left").drop("k_lang", "k_source")


def _cholesky(moments: DataFrame) -> DataFrame:
    """Lower triangles l_i_j of the groups' covariances c_i_j, column by column as plain arithmetic."""
    d = len(X)
    for j in range(d):
        inner = sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        moments = moments.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - inner, F.lit(FLOORS[X[j]] ** 2))))
        lower = {}
        for i in range(j + 1, d):
            inner = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            lower[f"l_{i}_{j}"] = (F.col(f"c_{i}_{j}") - inner) / F.col(f"l_{j}_{j}")
        if lower:
            moments = moments.withColumns(lower)
    logs = sum((2 * F.log(f"l_{j}_{j}") for j in range(d)), F.lit(0.0))
    return moments.select("g", "s", *[f"m_{i}" for i in range(d)], *[f"l_{i}_{j}" for i in range(d) for j in range(i + 1)], logs.alias("log_det"))


def _distance(rows: DataFrame, fit: DataFrame, groups: int) -> DataFrame:
    """With d2, the squared Mahalanobis distance of each row from the fits of its group, by forward substitution."""
    out = rows.join(_side(fit, groups), F.col("key") == F.col("g"), "left")
    for i, x in enumerate(X):
        inner = sum((F.col(f"l_{i}_{k}") * F.col(f"z_{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"z_{i}", (F.col(x) - F.col(f"m_{i}") - inner) / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(X))), F.lit(0.0)))


def _moments(near: DataFrame, value=lambda i: F.col(X[i]), factor: float = 1.0) -> DataFrame:
    """Mean m_i and covariance c_i_j, times ``factor``, of the rows of each (g, s), about the fit's m_i so that little cancels."""
    d = len(X)
    off = lambda i: value(i) - F.col(f"m_{i}")
    sums = near.groupBy("g", "s").agg(
        *[F.avg(off(i)).alias(f"s_{i}") for i in range(d)],
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(d)],
        *[F.avg(off(i) * off(j)).alias(f"p_{i}_{j}") for i in range(d) for j in range(i + 1)],
    )
    return sums.select(
        "g", "s",
        *[(F.col(f"m_{i}") + F.col(f"s_{i}")).alias(f"m_{i}") for i in range(d)],
        *[(factor * (F.col(f"p_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}"))).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)],
    )


def _starts(rows: DataFrame) -> tuple[DataFrame, int]:
    """Three fits s of each group g, and how many groups there are.

    0: medians and quartile ranges; 1: mean and covariance of all rows; 2: medians and the covariance of
    signs, in which a row counts by its direction from the medians only.
    """
    spark, d = rows.sparkSession, len(X)
    quartiles = rows.groupBy(F.col("key").alias("g")).agg(*[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), ACCURACY).alias(f"q_{i}") for i, x in enumerate(X)])
    scale = [F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(FLOORS[X[i]])) for i in range(d)]
    first = quartiles.select(
        "g", F.lit(0).alias("s"),
        *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(d)],
        *[(scale[i] if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(d) for j in range(i + 1)],
        F.lit(float("inf")).alias("log_det"),
    )
    first = written(first, scratch(spark, "fit"))
    groups = first.count()
    near = _distance(rows, first, groups)
    length = F.sqrt(F.greatest(F.col("d2"), F.lit(1e-12)))
    signs = _cholesky(_moments(near.withColumn("s", F.lit(2)), lambda i: F.col(f"m_{i}") + (F.col(X[i]) - F.col(f"m_{i}")) / length))
    medians = first.select(F.col("g").alias("h"), *[F.col(f"m_{i}").alias(f"n_{i}") for i in range(d)])
    signs = signs.join(_side(medians, groups), F.col("g") == F.col("h")).select("g", "s", *[F.col(f"n_{i}").alias(f"m_{i}") for i in range(d)], *[f"l_{i}_{j}" for i in range(d) for j in range(i + 1)], F.lit(float("inf")).alias("log_det"))
    whole = _cholesky(_moments(near.withColumn("s", F.lit(1)))).withColumn("log_det", F.lit(float("inf")))
    return written(first.unionByName(whole).unionByName(signs), scratch(spark, "fit")), groups


def estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """Robust location m_i and scatter l_i_j of each group g, a row for each group; and how many groups there are.

    Concentration steps run on all starts of all groups at once; a start whose determinant has stopped
    falling keeps its fit and drops out.  Determinants fall and are bounded below by FLOORS, so this ends.
    All aggregates are combined before they are shuffled, and every fit is a table in the shared folder,
    small enough to be broadcast by its measured size or else joined by a shuffle that Spark can split.
    """
    spark = rows.sparkSession
    fit, groups = _starts(rows)
    done = None
    while True:
        near = _distance(rows, fit, groups).where("g IS NOT NULL")
        edge = near.groupBy(F.col("g").alias("e"), F.col("s").alias("t")).agg(F.percentile_approx("d2", CORE, ACCURACY).alias("edge"))
        core = near.join(_side(edge, groups), (F.col("g") == F.col("e")) & (F.col("s") == F.col("t"))).where("d2 <= edge")
        new = _cholesky(_moments(core, factor=CONSISTENCY))
        old = fit.select(F.col("g").alias("e"), F.col("s").alias("t"), F.col("log_det").alias("before"))
        new = written(new.join(_side(old, groups), (F.col("g") == F.col("e")) & (F.col("s") == F.col("t"))).drop("e", "t"), scratch(spark, "fit"))
        falls = F.col("log_det") < F.col("before") + math.log1p(-FALL)
        ended = new.where(~falls).drop("before")
        done = ended if done is None else done.unionByName(ended)
        fit = new.where(falls).drop("before")
        if not fit.limit(1).count():
            best = done.groupBy("g").agg(F.min_by(F.struct(*[c for c in done.columns if c != "g"]), F.struct("log_det", "s")).alias("best")).select("g", "best.*")
            return written(best, scratch(spark, "fit")), groups


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept) of every row.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows.  kept: neither
    that nor a robust outlier of its language and source; rows that base rules reject form no estimate.
    Null and empty texts have no words and fail.  Null languages and sources are groups of their own, and
    groups under SMALLEST rows are pooled.  Texts are read whole.  Repeated rows each get their row, rows with
    equal statistics are judged alike; an empty table gives an empty one; other columns may have any names.
    """
    spark = docs.sparkSession
    rows = written(_transformed(statistics(docs)).withColumn("base_failed", base_failed()), scratch(spark, "statistics"))
    sound = written(_grouped(rows.where(~F.col("base_failed"))), scratch(spark, "sound"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = _distance(sound, *estimates(sound)).select(*columns, "d2", (F.coalesce("d2", F.lit(0.0)) <= CUTOFF).alias("kept"))
    return judged.union(rows.where("base_failed").select(*columns, F.lit(None).cast("double"), F.lit(False)))
