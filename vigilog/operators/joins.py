"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LOOKUP_ROWS = 100_000
MAX_LOOKUP_BYTES = 64 << 20
HOT_KEY_ROWS = 200_000
HOT_KEYS_SENT = 100_000


@dataclass(frozen=True)
class Lookup:
    """A summary table keyed uniquely.

    ``fits`` says its size was checked and it may be broadcast; its fetched rows are then at hand.
    """

    table: DataFrame
    fits: bool
    rows: pa.Table | None = None

    def with_table(self, table: DataFrame) -> Lookup:
        """A table derived from this one that has no more rows: the same check holds."""
        return Lookup(table, self.fits)


def as_lookup(table: DataFrame, max_rows: int | None = None) -> Lookup:
    """Measure a summary table: at most ``max_rows`` rows (MAX_LOOKUP_ROWS) are fetched to decide."""
    max_rows = MAX_LOOKUP_ROWS if max_rows is None else max_rows
    found = table.limit(max_rows + 1).toArrow()
    if found.num_rows <= max_rows and found.nbytes <= MAX_LOOKUP_BYTES:
        return Lookup(table.sparkSession.createDataFrame(found, schema=table.schema), True, found)
    return Lookup(table, False)


def lookup_join(
    rows: DataFrame, lookup: Lookup, keys: Sequence[str], salt_on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Attach a summary table: broadcast when it was measured small, salted shuffle join otherwise."""
    if lookup.fits:
        return rows.join(F.broadcast(lookup.table), list(keys), how)
    return salted_join(rows, lookup.table, keys, salt_on, how)


def salted_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    salt_on: Sequence[str],
    how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """Inner or left join of ``rows`` with a table unique on ``keys``, splitting the hot keys.

    A key with more than ``hot_rows`` rows (HOT_KEY_ROWS) is spread over several salts chosen by a hash of
    ``salt_on`` and only its table row is repeated. The list of hot keys is broadcast if it was measured
    small, else Spark chooses how to join it.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"salted_join cannot do a {how} join")
    keys = list(keys)
    hot_rows = HOT_KEY_ROWS if hot_rows is None else hot_rows
    found = as_lookup(
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > hot_rows)
        .select(*keys, F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int").alias("__salts")),
        HOT_KEYS_SENT,
    )
    hot = F.broadcast(found.table) if found.fits else found.table
    salts = F.coalesce("__salts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*salt_on), salts).cast("int"))
    right = table.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.drop("__salts").join(right.drop("__salts"), [*keys, "__salt"], how).drop("__salt")
