"""Confusion matrices, per-class reports and comparisons of several models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.functions.labels import SUMMARY_KEYS


MOST_LABELS = 500


def confusion(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``label, predicted, n`` of the rows that have a prediction; all later metrics start from it."""
    return (
        scored.where("label IS NOT NULL AND predicted IS NOT NULL")
        .groupBy(*by, "label", "predicted")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_matrix(counts: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """Dense form, one row and one column per label seen on either side, sorted.

    A model's free-text labels may be any number: beyond ``most`` the dense form is refused, and ``counts`` is the form to use.
    """
    labels = label_union(counts)
    padded = counts.unionByName(labels.select("label", F.col("label").alias("predicted"), F.lit(0).cast("bigint").alias("n")))
    names = sorted(row[0] for row in labels.limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} labels; keep the long form")
    return padded.groupBy("label").pivot("predicted", names).agg(F.sum("n")).na.fill(0).orderBy("label")


def label_union(counts: DataFrame) -> DataFrame:
    return counts.select("label").union(counts.select("predicted")).distinct()


def class_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``label, precision, recall, f1, support, tp``; a division by zero counts as 0."""
    tp = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("label"), tp.alias("tp"), F.lit(0).cast("bigint").alias("predicted"), F.col("n").alias("support")),
            F.struct(
                F.col("predicted").alias("label"),
                F.lit(0).cast("bigint").alias("tp"),
                F.col("n").alias("predicted"),
                F.lit(0).cast("bigint").alias("support"),
            ),
        )
    ).alias("side")
    totals = (
        counts.select(*by, sides)
        .groupBy(*by, F.col("side.label").alias("label"))
        .agg(*[F.sum(f"side.{c}").alias(c) for c in ("tp", "predicted", "support")])
    )

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    rated = totals.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn(
        "recall", ratio(F.col("tp"), F.col("support"))
    )
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.select(*by, "label", "precision", "recall", f1.alias("f1"), "support", "tp")


def overall_report(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro average and support-weighted average of a class report."""
    total = F.sum("support")
    return report.groupBy(*by).agg(
        F.try_divide(F.sum("tp"), total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        total.alias("support"),
    )


def compare_models(
    reports: DataFrame,
    models: Sequence[str],
    metric: str = "f1",
    excluded: Sequence[str] = tuple(SUMMARY_KEYS),
) -> DataFrame:
    """One metric per label, a column per model, 0 where a model never met the label.

    ``RARE_LABELS`` names classes that a comparison may leave out.
    """
    kept = reports.where(~F.col("label").isin(*excluded))
    wide = kept.groupBy("label").pivot("model", list(models)).agg(F.first(metric))
    return wide.na.fill(0.0).orderBy("label")


def model_metrics(report: DataFrame, excluded: Sequence[str] = tuple(SUMMARY_KEYS)) -> DataFrame:
    """All three metrics per label for one model."""
    kept = report.where(~F.col("label").isin(*excluded))
    return kept.select("label", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in ("precision", "recall", "f1")]).orderBy("label")


def overall_comparison(overall: DataFrame) -> DataFrame:
    """Accuracy and the weighted averages, one row per model."""
    return overall.select(
        "model", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1")]
    )


def run_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attempted, successful and failed rows, and the mean time per call where it was taken."""
    ok = F.col("status") == "success"
    seconds = [F.avg("seconds").alias("avg_seconds")] if "seconds" in results.columns else []
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), *seconds
    )


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
