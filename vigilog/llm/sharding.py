"""A seeded global shuffle into shards, in two passes over memory-sized buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vigilog.llm.common import beside, materialize

ROW_BYTES = 16
BUCKET_BYTES = 48 << 20


def row_size(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES


def external_shuffle(
    docs: DataFrame, seed: int, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All rows in a seeded random order: the input's columns, then ``bucket`` and ``position``.

    Pass one scatters rows into ``total bytes / bucket_bytes`` buckets by a seeded hash of key and text.
    Rows that repeat one key and text beyond a quarter of a bucket are scattered by their place in
    the input as well, so that no bucket outgrows memory; the input should then be a stored table,
    whose places are the same when a task runs again. Pass two puts each bucket into a canonical
    order, shuffles it (Fisher-Yates, seeded by seed and bucket) and writes it to the shared scratch
    folder; what is returned reads those files.

    Null keys and texts are values like others. Equal rows get places of their own. An empty table
    gives no rows. Input columns called ``bucket`` or ``position`` are replaced.
    """
    docs = beside(docs, "bucket", "position")
    total = docs.agg(F.sum(row_size(text)).alias("n")).first().n or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    row = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    # at most four for each bucket
    repeated = docs.groupBy(row.alias("__row")).agg(F.sum(row_size(text)).alias("__n")).where(F.col("__n") > bucket_bytes // 4)
    repeated = materialize(repeated.select("__row"), "repeated")
    hot = docs.withColumn("__row", row).join(F.broadcast(repeated.withColumn("__hot", F.lit(True))), "__row", "left")
    salt = F.when(F.col("__hot"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "__row", salt), F.lit(buckets)).cast("bigint")
    scattered = hot.select(*docs.columns, bucket.alias("bucket"))
    columns = [key, text]

    def shuffled(groups: tuple, rows: pa.Table) -> pa.Table:
        order = rows.select(columns).append_column("__place", pa.array(np.arange(rows.num_rows)))
        order = order.sort_by([(columns[0], "ascending"), (columns[1], "ascending")]).column("__place").to_numpy()
        order = np.array(order)
        np.random.default_rng([seed, groups[0].as_py()]).shuffle(order)
        return rows.take(order).append_column("position", pa.array(np.arange(len(order), dtype=np.int64)))

    schema = StructType([*scattered.schema.fields, StructField("position", LongType())])
    return materialize(scattered.groupBy("bucket").applyInArrow(shuffled, schema), "buckets")


def shard_rows(
    docs: DataFrame,
    shards: int,
    seed: int = 20,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """The shuffled order cut into ``shards`` runs whose row counts differ by one at most.

    Gives the input's columns, ``bucket`` and ``position`` (the file order within a bucket), ``shard``
    (from 0) and ``slot`` (from 0, without gaps). With fewer rows than shards some shards are empty.
    """
    rows = external_shuffle(beside(docs, "shard", "slot"), seed, key, text, bucket_bytes)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    sizes = sizes.select(
        "bucket",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy()).alias("__all"),
    )
    placed = rows.join(F.broadcast(materialize(sizes, "offsets")), "bucket")
    place = F.col("__before") + F.col("position")
    placed = placed.withColumn("__place", place).withColumn("shard", F.expr(f"(__place * {shards}) div __all").cast("int"))
    start = F.expr(f"(shard * __all + {shards - 1}) div {shards}")
    return placed.withColumn("slot", F.col("__place") - start).select(*rows.columns, "shard", "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder a shard; the files hold their rows in the order of ``slot``.

    A bucket lies in one shard or few, so nothing is shuffled again.
    """
    placed.write.partitionBy("shard").parquet(path)
