"""Exact ranks by parallel sorting by regular sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from vigilog.llm.common import materialize

#: Rows of a segment on average, beyond which there are more segments than shuffle partitions.
SEGMENT_ROWS = 2_000_000
#: Samples whose order is found on the driver; more of them are ranked like the rows themselves.
SAMPLES_FETCHED = 1_000_000
_PLACE = (1 << 33) - 1  # monotonically_increasing_id: the partition above, the place in it below


def _splitters(runs: DataFrame, n: int, segments: int) -> np.ndarray:
    """``segments - 1`` rows ``score, tie, at`` that cut the sorted runs into about equal parts.

    Each run gives every ``n / segments ** 2``-th of its rows; of all these in order, every ``segments``-th is a splitter.
    """
    step = max(1, n // segments**2)
    samples = runs.where(F.col("at").bitwiseAND(_PLACE) % step == 0).select("score", "tie", "at")
    m = samples.count()
    if m <= SAMPLES_FETCHED:
        found = samples.toArrow()
        keys = np.stack([found[c].to_numpy() for c in ("score", "tie", "at")], axis=1)
        keys = keys[np.lexsort((keys[:, 2], keys[:, 1], -keys[:, 0]))]
        return keys[np.arange(1, segments) * len(keys) // segments]
    every = m // segments
    few = max(2, math.isqrt(SAMPLES_FETCHED // 2))  # so that the samples of the samples can be fetched
    runs = samples.coalesce(few).withColumnRenamed("at", "__at")  # every run gives a sample, so there must be few runs too
    some = ranked(runs, "score", "tie", segments=few).where(F.col("rank") % every == 0)
    rows = some.orderBy("rank").limit(segments - 1).collect()  # one row a segment
    return np.array([(r["score"], r["tie"], r["__at"]) for r in rows], np.int64)


def _segments(runs: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Each row with the number of splitters up to it."""
    schema = StructType([*runs.schema.fields, StructField("segment", IntegerType())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("score", "tie", "at")], axis=1)
            both = np.concatenate((splitters.reshape(-1, 3), keys))
            order = np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))
            segment = np.empty(len(both), np.int64)
            segment[order] = np.cumsum(order < len(splitters))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment[len(splitters) :], pa.int32())], schema.names)

    return runs.mapInArrow(dealt, schema)


def ranked(rows: DataFrame, score: str, tie: str, most: int | None = None, segments: int | None = None) -> DataFrame:
    """The rows with their exact ``rank`` (from 1) by ``score`` descending, then ``tie`` ascending; both are long.

    Partitions are sorted where they are and written as runs; regular samples of the runs give splitters; a count
    of each segment says where its ranks begin; the segments are exchanged and sorted each on its own. Only segments that reach
    into the ``most`` highest ranks are exchanged; rows beyond ``most`` have a null rank. Rows equal in both columns are told
    apart by their place in a run, so a key that many rows share is split too. Null scores come last, null ties last of their
    score. There are ``segments`` of them, else as many as shuffle partitions or more. An empty table gives no rows.
    """
    spark = rows.sparkSession
    worst, last = F.lit(-(2**63) + 1).cast("long"), F.lit(2**63 - 1).cast("long")
    keyed = rows.select(F.struct("*").alias("row"), F.coalesce(F.col(score), worst).alias("score"), F.coalesce(F.col(tie), last).alias("tie"))
    order = [F.col("score").desc(), F.col("tie")]
    runs = materialize(keyed.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "runs")
    n = runs.count()
    if not n:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    most = n if most is None else min(most, n)
    segments = segments or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SEGMENT_ROWS))
    dealt = materialize(_segments(runs, _splitters(runs, n, segments)), "segments")
    sizes = {r["segment"]: r["n"] for r in dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a segment
    before, starts = 0, []
    while before < most:
        starts.append(before)
        before += sizes.get(len(starts) - 1, 0)
    beyond = dealt.where(F.col("segment") >= len(starts)).select("row.*", F.lit(None).cast("long").alias("rank"))
    if not starts:
        return beyond
    offsets = F.broadcast(spark.createDataFrame(list(enumerate(starts)), "segment int, start long"))  # a row a segment
    inside = dealt.where(F.col("segment") < len(starts)).repartitionById(len(starts), "segment").sortWithinPartitions(*order, "at")
    inside = inside.withColumn("place", F.monotonically_increasing_id().bitwiseAND(_PLACE)).join(offsets, "segment")
    rank = F.col("start") + F.col("place") + 1
    return inside.select("row.*", F.when(rank <= most, rank).alias("rank")).unionByName(beyond)
