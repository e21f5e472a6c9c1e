"""Score-weighted votes of retrieved neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions.labels import NORMAL_LABEL


def vote(hits: DataFrame, by: Sequence[str] = ("qid",)) -> DataFrame:
    """Votes per label: ``<by>, label, votes, first_rank``. Ranked hits are already grouped by query."""
    return hits.groupBy(*by, "label").agg(
        F.round(F.sum("score"), 6).alias("votes"), F.min("rank").alias("first_rank")
    )


def vote_share(votes: DataFrame, by: Sequence[str] = ("qid",)) -> DataFrame:
    """Percentage of the votes each label got; null when a query's scores sum to zero."""
    total = F.sum("votes").over(Window.partitionBy(*by))
    return votes.withColumn("share", F.try_divide(F.col("votes"), total) * 100)


def winner(votes: DataFrame, by: Sequence[str] = ("qid",)) -> DataFrame:
    """``<by>, predicted``: the label with most votes; equal votes go to the one met first."""
    return votes.groupBy(*by).agg(F.max_by("label", F.struct(F.col("votes"), -F.col("first_rank"))).alias("predicted"))


def dominance(votes: DataFrame, by: Sequence[str] = ("qid",)) -> DataFrame:
    """Two alerts per query: normal does not outweigh the other labels; some neighbour is not normal."""
    normal = F.sum(F.when(F.col("label") == NORMAL_LABEL, F.col("votes")).otherwise(0.0))
    scored = votes.groupBy(*by).agg(
        F.round(normal, 6).alias("normal_votes"),
        F.round(F.sum("votes"), 6).alias("all_votes"),
        F.bool_or(F.col("label") != NORMAL_LABEL).alias("any_attack"),
    )
    others = F.round(F.col("all_votes") - F.col("normal_votes"), 6)
    return scored.withColumn("normal_not_dominant", F.col("normal_votes") <= others)


def predict(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Every query with its predicted label and a status; without neighbours there is no prediction."""
    predicted = queries.join(winner(vote(hits)), "qid", "left")
    return predicted.withColumn(
        "status", F.when(F.col("predicted").isNull(), "no_match").otherwise(F.lit("success"))
    )


def sweep(hits: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Hits of one search repeated for every k that includes them, with a ``k`` column."""
    each = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return each.where(F.col("rank") <= F.col("k"))
