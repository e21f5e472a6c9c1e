"""Nearest neighbours from one bit a dimension, with an error bound that says when to stop.

A document o of the cell around pivot c is a * c + r * u, u a unit vector at right angles to c. All vectors are turned by
one random rotation; of u only the signs are kept, scaled to unit length (x), and three numbers that hold a, r and
f = <x, u>. For a query q, <x, q - <c, q> c> / f estimates <u, q> without bias, and as the rotation is random its error is that
of a coordinate on a sphere: its standard deviation is at most |q - <c, q> c| * sqrt((1 - f*f) / (d - 1)) / f (Gao and
Long, RaBitQ, 2024). ``deviations`` of them, times r, are a document's slack: the nearer to their pivot both are, the less.

A search compares codes in two passes:

1. the ``first * k`` best estimates of a query in each unit are scored by full vectors; the k-th score of all bounds its k-th score;
2. a document whose estimate and slack stay below that bound is ruled out, and every other one is scored.

Documents are scored in the task that compares their codes, so full vectors travel beside the codes and a unit returns k rows
a query, however many it scored. How many that are follows from the bound alone. Where more than SHARE of the documents that a
query meets in a unit (or more than MOST of them) are left, codes do not pay: that query is searched with full vectors
instead, exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.vectors import to_matrix
from vigilog.operators.knn import NO_DOCUMENT, Comparison, Found, Pivots, exact_values, first_per_row, margin_of, rank_hits, search
from vigilog.session import materialize

MOST = 1024
SHARE = 0.5
# A bound travels as a whole number of millionths above -BELOW; scores have six digits.
BELOW = 3_000_000
ROUNDING = 10
# Before the signs: cell, weight of the pivot's product, weight of the signs' product, weight of the slack.
NUMBERS = 4


@dataclass(frozen=True)
class Frame:
    """A random rotation, and the pivots turned by it."""

    turn: np.ndarray
    centres: np.ndarray


def frame(pivots: Pivots, seed: int = 42) -> Frame:
    """The same for the same pivots and seed; as large as the pivots and the square of a vector's length."""
    size = pivots.vectors.shape[1] if pivots.count else 0
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0] if size else np.empty((0, 0))
    return Frame(turn, pivots.vectors @ turn)


def document_codes(vectors: np.ndarray, cells: np.ndarray, known: Frame) -> np.ndarray:
    """One row of bytes a document: four numbers in single precision, then the signs, eight a byte."""
    turned, centres = vectors @ known.turn, known.centres[cells]
    along = (turned * centres).sum(axis=1)
    rest = turned - along[:, None] * centres
    radius = np.sqrt((rest * rest).sum(axis=1))
    signs = np.where(rest > 0, 1, -1) / np.sqrt(rest.shape[1])
    apart = radius > 1e-6  # others are their pivot
    fit = np.divide((signs * rest).sum(axis=1), radius, where=apart, out=np.ones_like(radius))
    weight = np.where(apart, radius / fit, 0)
    numbers = [cells, along - weight * (signs * centres).sum(axis=1), weight, weight * np.sqrt(np.maximum(1 - fit * fit, 0))]
    return np.hstack([np.column_stack(numbers).astype("<f4").view(np.uint8), np.packbits(rest > 0, axis=1)])


def _binaries(rows: np.ndarray, valid: list[bool]) -> pa.Array:
    codes = iter(rows)
    return pa.array([next(codes).tobytes() if ok else None for ok in valid], pa.binary())


def rotated_code(vector: str | Column, cell: str | Column, known: Frame) -> Column:
    """Code of an indexed unit vector in its cell; null for null."""

    @F.arrow_udf("binary")
    def coded(vectors: pa.Array, cells: pa.Array) -> pa.Array:
        valid = vectors.is_valid()
        if not valid.true_count:
            return pa.nulls(len(vectors), pa.binary())
        rows = document_codes(to_matrix(vectors.drop_null()), cells.filter(valid).to_numpy(), known)
        return _binaries(rows, valid.to_pylist())

    return coded(vector, cell)


def _query_code(vector: str | Column, known: Frame) -> Column:
    """The turned vector in single precision."""

    @F.arrow_udf("binary")
    def coded(vectors: pa.Array) -> pa.Array:
        if len(vectors) == vectors.null_count:
            return pa.nulls(len(vectors), pa.binary())
        return _binaries((to_matrix(vectors.drop_null()) @ known.turn).astype("<f4"), vectors.is_valid().to_pylist())

    return coded(vector)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def read_queries(column: pa.ChunkedArray) -> np.ndarray:
    """The bound, then the turned vector."""
    raw = _bytes(column)
    bound = (raw[:, :4].copy().view(">u4").astype(np.float64) - BELOW) / 1e6
    return np.hstack([bound.astype(np.float32), raw[:, 4:].copy().view("<f4")])


def read_documents(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers, then the signs; those that fill up the last byte meet no coordinate of a query."""
    raw, numbers = _bytes(column), 4 * NUMBERS
    signs = np.unpackbits(raw[:, numbers:], axis=1).astype(np.float32) * 2 - 1
    return np.hstack([raw[:, :numbers].copy().view("<f4"), signs])


def _approximations(codes: np.ndarray, size: int, known: Frame) -> np.ndarray:
    """The turned vectors that the codes stand for: a query's product with one is its estimate."""
    centres = known.centres[codes[:, 0].astype(np.int64)].astype(np.float32)
    return centres * codes[:, 1:2] + codes[:, NUMBERS : NUMBERS + size] * (codes[:, 2:3] / np.sqrt(np.float32(size)))


def _off_pivots(asked: np.ndarray, known: Frame) -> np.ndarray:
    """What a query's slack is in each cell, as a multiple of a document's."""
    to_pivot = asked @ known.centres.T.astype(np.float32)
    return np.sqrt(np.maximum(1 - to_pivot**2, 0)) / np.sqrt(np.float32(max(asked.shape[1] - 1, 1)))


def estimates(left: np.ndarray, right: np.ndarray, known: Frame) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of queries and documents, and the standard deviations they stay within."""
    asked = left[:, 1:]
    middle = asked @ _approximations(right, asked.shape[1], known).T
    return middle, _off_pivots(asked, known)[:, right[:, 0].astype(np.int64)] * right[:, 3]


def _whole_queries(column: pa.StructArray) -> np.ndarray:
    """The bound, the turned vector, then the vector."""
    return np.hstack([read_queries(column.field("code")), to_matrix(column.field("embedding"), np.float32)])


def _whole_documents(column: pa.StructArray, known: Frame) -> np.ndarray:
    """The cell, the weight of the slack, the approximation, then the vector."""
    codes, vectors = read_documents(column.field("code")), to_matrix(column.field("embedding"), np.float32)
    return np.hstack([codes[:, [0, 3]], _approximations(codes, vectors.shape[1], known), vectors])


def _sides(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The turned queries, their estimates, and a vector's length; the last so many columns of both sides are the vectors."""
    size = (left.shape[1] - 1) // 2
    asked = left[:, 1 : 1 + size]
    return asked, asked @ right[:, 2 : 2 + size].T, size


def _best_of(left: np.ndarray, right: np.ndarray, rows: np.ndarray, columns: np.ndarray, k: int) -> Found:
    """The k best of each row's pairs by full vectors: in single precision with a margin, the few that are left in double."""
    products = (left @ right.T)[rows, columns]
    order = np.lexsort((-products, rows))
    rows, columns, products = rows[order], columns[order], products[order]
    kth = products[np.minimum(np.searchsorted(rows, rows) + k, np.searchsorted(rows, rows, "right")) - 1]
    near = products >= kth - margin_of(left.shape[1])
    rows, columns = rows[near], columns[near]
    return first_per_row((rows, columns, exact_values(left, right, rows, columns)), k)


def _best_estimates(left: np.ndarray, right: np.ndarray, k: int, first: int) -> Found:
    """The k best of each query, by full vectors, among the ``first * k`` documents with the highest estimates."""
    _, middle, size = _sides(left, right)
    width, keep = len(right), min(first * k, len(right))
    rows, columns = np.nonzero(middle >= np.partition(middle, width - keep, axis=1)[:, [width - keep]])
    return _best_of(left[:, -size:], right[:, -size:], rows, columns, k)


def _not_ruled_out(left: np.ndarray, right: np.ndarray, k: int, known: Frame, deviations: float) -> Found:
    """The k best of each query, by full vectors, among the documents that may reach its bound.

    NO_DOCUMENT alone where these are too many for codes to pay.
    """
    asked, middle, size = _sides(left, right)
    cells, slack, bound = right[:, 0].astype(np.int64), deviations * right[:, 1], left[:, 0]
    off_pivot = _off_pivots(asked, known)
    # first by the widest slack of all, then by its own
    rows, columns = np.nonzero(middle >= (bound - off_pivot.max(axis=1) * slack.max() - 1e-6)[:, None])
    near = middle[rows, columns] + off_pivot[rows, cells[columns]] * slack[columns] >= bound[rows]
    rows, columns = rows[near], columns[near]
    many = np.bincount(rows, minlength=len(left)) > max(k, min(MOST, int(SHARE * len(right))))
    few, wide = ~many[rows], np.flatnonzero(many)
    rows, columns = rows[few], columns[few]
    found = _best_of(left[:, -size:], right[:, -size:], rows, columns, k)
    marks = (wide, np.full(len(wide), NO_DOCUMENT), np.zeros(len(wide), np.int64))
    return tuple(np.concatenate(both) for both in zip(found, marks))


def _millionths(values: np.ndarray, _width: int) -> np.ndarray:
    return values / 1e6


def _bounded(queries: DataFrame, bound: Column) -> DataFrame:
    """Put the bound, a cosine in millionths, before the query's code."""
    return queries.withColumn("code", F.concat(F.unhex(F.lpad(F.hex((bound + BELOW).cast("bigint")), 8, "0")), F.col("code")))


def rotated_candidates(
    queries: DataFrame,
    index: DataFrame,
    pivots: Pivots,
    k: int,
    known: Frame,
    probe: int | None = None,
    first: int = 10,
    deviations: float = 2.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``qid, doc_id, <carry>, score`` of each unit's k best documents that the bound does not rule out.

    A null ``doc_id`` where a unit has too many that are not ruled out.
    """
    read = partial(_whole_documents, known=known)
    best = partial(_best_estimates, first=first)
    left = partial(_not_ruled_out, known=known, deviations=deviations)
    asked = queries.where(F.col("embedding").isNotNull()).withColumn("code", _query_code("embedding", known))
    coded, both = index.withColumn("__both", F.struct("code", "embedding")), F.struct("code", "embedding")
    by_estimate = Comparison("__both", _whole_queries, read, best, _millionths)
    early = search(_bounded(asked, F.lit(0)).withColumn("__both", both), coded, pivots, k, probe, (), by_estimate)
    reached = early.groupBy("qid").agg(F.min("score").alias("__kth"), F.count(F.lit(1)).alias("__n"))
    # where fewer than k were found, nothing can be ruled out
    bound = F.when(F.col("__n") >= k, F.round((2 * F.col("__kth") - 1) * 1_000_000) - ROUNDING).otherwise(F.lit(-2_000_000))
    told = materialize(_bounded(asked.join(reached, "qid", "left"), bound).select(*asked.columns), "bounded")
    by_bound = Comparison("__both", _whole_queries, read, left, _millionths, ranked=False)
    return search(told.withColumn("__both", both), coded, pivots, k, probe, carry, by_bound)


def search_rotated(
    queries: DataFrame,
    index: DataFrame,
    pivots: Pivots,
    k: int,
    known: Frame,
    probe: int | None = None,
    first: int = 10,
    deviations: float = 2.0,
    carry: Sequence[str] = ("label",),
) -> DataFrame:
    """The k nearest documents of every query, as ``search`` returns them: ``qid, doc_id, <carry>, score, rank``.

    ``index`` has a ``code`` by ``rotated_code`` in the same frame. Scores are those of full vectors. A neighbour is missed only where
    its estimate is more than ``deviations`` too low: about one in 44 of those at the very bound with 2, fewer above it.
    With ``probe=None`` cells that cannot hold a hit are left out, with ``probe=n`` all but the n nearest. Rows without a
    vector match nothing; copies and ties go by the lower id; an empty index has no hits.
    """
    if not pivots.count:
        return search(queries, index, pivots, k, probe, carry)
    found = materialize(rotated_candidates(queries, index, pivots, k, known, probe, first, deviations, carry), "not-ruled-out")
    wide = found.where("doc_id IS NULL").select("qid").distinct()
    narrow = found.where("doc_id IS NOT NULL").join(wide, "qid", "left_anti")
    by_codes = rank_hits(narrow, k, F.col("score").desc())
    by_vectors = search(queries.join(wide, "qid", "left_semi"), index, pivots, k, probe, carry)
    return by_codes.unionByName(by_vectors)
