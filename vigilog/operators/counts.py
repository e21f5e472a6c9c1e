"""Counts, distinct values and coverage checks over a labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.functions.labels import is_normal


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; missing values are not counted."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: all rows, normal rows, the others."""
    normal = F.coalesce(is_normal(label_col), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(normal).alias("normal"), F.count_if(~normal).alias("other")
    )


def coverage_missing(
    full: DataFrame, sample: DataFrame, label_col: str = "label", source_col: str = "source"
) -> DataFrame:
    """``source, missing``: sources lost by a sample (``any``), or that lost all normal rows (``normal``)."""

    def lost(kind: str, before: DataFrame, after: DataFrame) -> DataFrame:
        gone = before.select(source_col).distinct().join(after.select(source_col).distinct(), source_col, "left_anti")
        return gone.select(F.col(source_col).alias("source"), F.lit(kind).alias("missing"))

    normal = is_normal(label_col)
    return lost("any", full, sample).unionByName(lost("normal", full.where(normal), sample.where(normal)))
