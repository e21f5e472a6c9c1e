"""What the operators share: tables, bounded values in expressions, memory-sized parts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import vigilog
from vigilog.session import materialize, ship_code

ship_code(vigilog)

SPACES = " \t\n\x0b\x0c\r"
MIX = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

__all__ = ["MASK", "MIX", "SPACES", "beside", "crc_of_id", "held_out", "let", "materialize", "parts", "table", "text_or_empty", "whole"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it.

    An expression that a lambda refers to is otherwise computed again for each element.
    """
    return F.transform(F.array(value), body)[0]


def beside(df: DataFrame, *made: str) -> DataFrame:
    """The frame without columns that carry the names an operator gives to its own."""
    return df.drop(*made)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary"))


def held_out(modulus: int, remainder: int, name: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder; a row without id is not held out."""
    return F.coalesce(crc_of_id(name) % modulus == remainder, F.lit(False))


def parts(df: DataFrame, text: str, part_bytes: int) -> int:
    """How many parts of about ``part_bytes`` UTF-8 bytes the texts make, with 64 bytes for each row."""
    found = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 64).alias("n")).first()
    return max(1, -(-int(found.n or 0) // part_bytes))


def whole(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema)
