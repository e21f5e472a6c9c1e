"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of the links ``a, b`` (long): the least node it is connected with.

    Each round a node takes the least label among its neighbours and then that label's own label, so
    the rounds grow with the logarithm of the longest path. Minima are formed before the shuffle, and
    each round is written, which cuts the lineage.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        of_label = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        closer = closer.join(of_label, "next", "left")
        closer = materialize(closer.select("node", F.col("label").alias("old"), F.least("next", "beyond").alias("label")), "labels")
        labels = closer.select("node", "label")
        if closer.where("old <> label").isEmpty():
            return labels
