"""Near duplicates by circulant MinHash, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from vigilog.llm.common import materialize
from vigilog.llm.setjoin import BROADCAST_ROWS, classes_of, linked, named, signatures, verified
from vigilog.llm.strings import FACTOR, mixed
from vigilog.session import tidy

SHINGLE = 5
PERCENT = 75
BANDS = 32
ROWS = 4
#: Parity bits for each shingle of a set, at least.
PARITIES = 4

__all__ = ["BROADCAST_ROWS", "near_duplicates"]


def coordinates(sets: list[np.ndarray], number: int) -> np.ndarray:
    """The circulant signature of each (non-empty) set, as one row of ``number`` 32-bit minima.

    The first permutation deals shingles to 2 ** 32 places. The second one is a bijection of these
    places; coordinate k is its least value over the set's places, shifted in a circle by k.
    """
    places = (mixed(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    found = np.empty((number, len(sets)), np.uint32)
    for k in range(number):
        x = places - np.uint32(k + 1)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum.reduceat(x, starts, out=found[k])
    return np.ascontiguousarray(found.T)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band of ROWS coordinates."""
    cells = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    found = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        found = mixed(found * np.uint64(FACTOR) + cells[:, :, r] + np.uint64(1))
    return found


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1).view(np.int64)))


def _banded(sets: list[np.ndarray]) -> list[pa.Array]:
    full = np.array([len(s) > 0 for s in sets], bool)
    buckets = np.zeros((len(sets), BANDS), np.uint64)
    if full.any():
        buckets[full] = bands_of(coordinates([s for s in sets if len(s)], BANDS * ROWS))
    return [_lists(buckets)]


@tidy("near-duplicates")
def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row.

    Rows with one shingle set form a class, and only classes are compared. Candidates share a band. First each member
    of a bucket is compared with the bucket's first class, never with all others. Then, in buckets whose members still lie
    in different components, members of different components are compared, the nearest first, at last all, in units of
    classes however large the bucket. Bounds that cannot hide a link (sizes, parities of the sets) rule most pairs out; the others are
    confirmed on full sets. So each pair of classes that shares a band is connected, compared, or proven apart.

    A null, empty or blank text has no shingles and is linked with nothing: its component is its own
    key. Equal rows share a component. A null key is never the least of a component with other keys,
    and such a row is not kept. An empty table gives no rows. Texts of any length are taken whole. No other columns are read
    or returned, so their names do not matter. Intermediates go when the result is written.
    """
    docs = docs.select(key, text)
    signed = materialize(signatures(docs, key, text, SHINGLE, PARITIES, {"bands": ArrayType(LongType())}, _banded), "signatures")
    classes = classes_of(signed, key, ["bands"])
    lists = classes.select(F.explode("bands").alias("bucket"), "cid")
    confirm = lambda pairs: verified(pairs, classes, docs, key, text, SHINGLE, PERCENT)
    return named(signed, classes, linked(lists, classes, confirm, PERCENT, [], None), key)
