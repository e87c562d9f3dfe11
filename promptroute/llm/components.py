"""Connected components of a graph given as links, by smallest labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reached) for all nodes of ``links`` (a, b).

    Each round every node takes the smallest label of its neighbours and then its label's label, so a
    path of n links takes about log n rounds.  Labels are combined before they are shuffled.
    """
    both = materialise(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links"
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = materialise(labels.select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "root"), "b").select(
            F.col("a").alias("node"), "root", F.lit(None).cast(links.schema["a"].dataType).alias("old")
        )
        own = labels.select("node", "root", F.col("root").alias("old"))
        taken = told.union(own).groupBy("node").agg(F.min("root").alias("new"), F.max("old").alias("old"))
        jump = taken.select(F.col("node").alias("new"), F.col("new").alias("root"))
        labels = materialise(taken.join(jump, "new").select("node", "root", (F.col("root") != F.col("old")).alias("changed")), "labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
