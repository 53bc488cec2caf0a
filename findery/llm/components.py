"""Connected components of a graph whose nodes are longs, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.common import scratch, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b) the smallest node that it is connected with.

    Each round takes the least label of the neighbours, then the label of that label, so long chains
    shorten fast; it ends when no label changes.  Rounds read tables in the shared folder: the plan
    stays short, a lost executor costs a reread, and both sides of each join are dealt out afresh, so
    that Spark can split a node or label with very many rows.  The driver gets one number a round.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), scratch(spark, "edges"))
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), scratch(spark, "labels")
    )
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        moved = written(
            labels.join(near, F.col("a") == F.col("node"))
            .select("node", F.least("root", "near").alias("next"), "root"),
            scratch(spark, "labels"),
        )
        jump = moved.select(F.col("node").alias("via"), F.col("next").alias("beyond"))
        new = written(
            moved.join(jump, F.col("next") == F.col("via")).select(
                "node", F.col("beyond").alias("root"), (F.col("beyond") < moved["root"]).alias("changed")
            ),
            scratch(spark, "labels"),
        )
        if not new.where("changed").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")
