"""Text to unit vectors, and the compact codes derived from them.

A vector column is ``array<float>`` of unit length, or null where no direction exists (no tokens, a
zero vector): such rows can be neither found nor matched.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: length of the vectors in the index.
VECTOR_SIZE = 384
#: Rows and tokens of an Arrow batch that are worked on at a time: what a task holds beside the batch does not follow its size.
ROWS_AT_ONCE = 1_024
TOKENS_AT_ONCE = 1 << 18


def to_matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Rows of a list column without nulls as a matrix; all rows must be equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0), dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width, rest = divmod(len(flat), len(column))
    if rest or not (np.diff(column.offsets.to_numpy()) == width).all():
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), width).astype(dtype, copy=False)


def sliced(made: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """A function of columns that is given a few rows of a batch at a time."""

    @functools.wraps(made)
    def run(*columns: pa.Array) -> pa.Array:
        starts = range(0, max(len(columns[0]), 1), ROWS_AT_ONCE)
        return pa.concat_arrays([made(*[c.slice(start, ROWS_AT_ONCE) for c in columns]) for start in starts])

    return run


def to_lists(matrix: np.ndarray, valid: np.ndarray) -> pa.Array:
    """List column of the matrix rows; rows that are not valid become null."""
    width = matrix.shape[1] if matrix.ndim == 2 else 0
    lengths = np.where(valid, width, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = (matrix if valid.all() else matrix[valid]).astype(np.float32, copy=False).ravel()
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float32()), mask=pa.array(~valid))


def _units(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    usable = np.isfinite(norms) & (norms > 0)
    return np.divide(matrix, norms[:, None], where=usable[:, None], out=np.zeros_like(matrix)), usable


def unit(vector: str | Column) -> Column:
    """Scale to unit length."""

    @F.arrow_udf("array<float>")
    @sliced
    def scaled(values: pa.Array) -> pa.Array:
        valid = values.is_valid().to_numpy(zero_copy_only=False)
        matrix = to_matrix(values.drop_null())
        units, usable = _units(matrix) if len(matrix) else (matrix, np.empty(0, bool))
        out = np.zeros((len(values), matrix.shape[1]))
        out[valid] = units
        valid[valid] = usable
        return to_lists(out, valid)

    return scaled(vector)


def tokens(text: str | Column) -> Column:
    """Lower-case ASCII letter and digit runs of the whole text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_bucket(token: str, dim: int) -> int:
    """The first 32 bits of the token's md5, modulo the vector length."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim


def embed_hash(text: str | Column, dim: int = VECTOR_SIZE) -> Column:
    """Hashed bag of words: token counts per bucket, scaled to unit length. Needs no model.

    Each distinct token of a run of texts is hashed once; a run has about TOKENS_AT_ONCE tokens, or one text.
    """

    def run_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
        coded = words.flatten().dictionary_encode()
        buckets = np.array([token_bucket(token, dim) for token in coded.dictionary.to_pylist()], np.int64)
        cells, counts = np.unique(rows * dim + buckets[coded.indices.to_numpy()], return_counts=True)
        norms = np.sqrt(np.bincount(cells // dim, counts.astype(np.float64) ** 2, minlength=len(words)))
        flat = np.zeros(len(words) * dim, np.float32)
        flat[cells] = counts / norms[cells // dim]
        return flat, norms > 0

    @F.arrow_udf("array<float>")
    def counted(words: pa.Array) -> pa.Array:
        ends, start = words.offsets.to_numpy()[1:] - words.offsets[0].as_py(), 0
        vectors, valid = np.zeros((len(words), dim), np.float32), np.zeros(len(words), bool)
        while start < len(words):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, "right")))
            flat, valid[start:stop] = run_of(words.slice(start, stop - start))
            vectors[start:stop] = flat.reshape(-1, dim)
            start = stop
        return to_lists(vectors, valid)

    return counted(F.coalesce(tokens(text), F.array().cast("array<string>")))


def embed_with(load_model: Callable[[], Callable[[list[str]], Iterable]], text: str | Column) -> Column:
    """Unit vectors from a user's model.

    ``load_model`` runs once per task and returns a function from a list of texts to their vectors;
    a call gets one Arrow batch (``spark.sql.execution.arrow.maxRecordsPerBatch``).
    """

    @F.arrow_udf("array<float>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load_model()
        for texts in batches:
            valid = texts.is_valid().to_numpy(zero_copy_only=False)
            present = texts.drop_null().to_pylist()
            if not present:
                yield pa.nulls(len(texts), pa.list_(pa.float32()))
                continue
            units, usable = _units(np.asarray(list(encode(present)), dtype=np.float64))
            out = np.zeros((len(texts), units.shape[1]))
            out[valid] = units
            valid[valid] = usable
            yield to_lists(out, valid)

    return encoded(text)


def sign_code(vector: str | Column) -> Column:
    """One bit per dimension (is it positive?), packed: 32 times smaller than the vector."""

    @F.arrow_udf("binary")
    @sliced
    def packed(values: pa.Array) -> pa.Array:
        valid = values.is_valid().to_numpy(zero_copy_only=False)
        codes = iter(np.packbits(to_matrix(values.drop_null()) > 0, axis=1)) if valid.any() else iter(())
        return pa.array([next(codes).tobytes() if ok else None for ok in valid], pa.binary())

    return packed(vector)


def cosine_score(left: str | Column, right: str | Column) -> Column:
    """(1 + cosine) / 2 of two unit vectors, rounded to 6 digits."""

    @F.arrow_udf("double")
    @sliced
    def scored(a: pa.Array, b: pa.Array) -> pa.Array:
        if len(a) == 0:
            return pa.array([], pa.float64())
        return pa.array(np.rint((1 + (to_matrix(a) * to_matrix(b)).sum(axis=1)) / 2 * 1e6) / 1e6)

    return scored(left, right)
