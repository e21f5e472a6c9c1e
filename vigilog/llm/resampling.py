"""Importance resampling towards a target corpus: hashed n-gram weights, perturbed scores, exact ranks."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vigilog.llm.common import beside, materialize
from vigilog.llm.ranking import ranked
from vigilog.llm.strings import gathered

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
MADE = ("n_words", "n_features", "weight", "score", "rank")

#: Bytes of words: digits, letters (A-Z lower-cased) and all bytes of other characters; the rest are blanks.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STEPS = 64


def _shifts() -> np.ndarray:
    """What 0 to _STEPS zero bytes make of a checksum, for each value of each of its four bytes. Checksums are linear."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    found = np.empty((_STEPS + 1, 4, 256), np.uint32)
    found[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(_STEPS):
        found[k + 1] = (found[k] >> 8) ^ table[found[k] & 255]
    return found


def _joined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Checksums of two strings each, the second of ``lengths`` bytes, from the checksums of both."""
    done, left = lengths.copy(), left.copy()
    some = np.arange(len(left))
    while len(some):
        step, x = np.minimum(done[some], _STEPS), left[some]
        left[some] = shifts[step, 0, x & 255] ^ shifts[step, 1, x >> 8 & 255] ^ shifts[step, 2, x >> 16 & 255] ^ shifts[step, 3, x >> 24]
        done[some] -= step
        some = some[done[some] > 0]
    return left ^ right


def features_of(texts: list[bytes], shifts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of each text, and for portions of texts the buckets of all their features with the texts' numbers."""
    blank = np.uint32(zlib.crc32(b" "))
    for begin, end in gathered(map(len, texts)):
        words = [t.translate(_WORDS).split() for t in texts[begin:end]]
        sizes = np.array([len(w) for w in words], np.int64)
        total = int(sizes.sum())
        sums = np.fromiter((zlib.crc32(x) for w in words for x in w), np.uint32, total)
        lengths = np.fromiter((len(x) for w in words for x in w), np.int64, total)
        text = np.repeat(np.arange(begin, end), sizes)
        buckets, owners, found = [sums % BUCKETS], [text], sums
        for n in range(2, LONGEST + 1):
            spaced = _joined(found[:-1], np.full(max(0, len(found) - 1), blank), np.ones(max(0, len(found) - 1), np.int64), shifts)
            found = _joined(spaced, sums[n - 1 :], lengths[n - 1 :], shifts)
            whole = text[: len(found)] == text[n - 1 :]
            buckets.append(found[whole] % BUCKETS)
            owners.append(text[: len(found)][whole])
        yield sizes, np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts in each bucket. Each task sums its own; the driver gets BUCKETS rows."""
    shifts = _shifts()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, buckets, _ in features_of(_texts(batch, 0), shifts):
                total += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    found = docs.select(text).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the floored thousandfold logarithm of how much likelier the target holds it, each count raised by one."""
    s, t = int(source.sum()), int(target.sum())
    ratio = [(int(b) + 1) * (s + BUCKETS) / ((int(a) + 1) * (t + BUCKETS)) for a, b in zip(source, target)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """Every row with ``n_words``, ``n_features`` and ``weight``, the sum of its features' gains. Map-only."""
    shifts, at = _shifts(), docs.columns.index(text)
    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in MADE[:3])])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, at)
            words, counts, weights = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for sizes, buckets, owners in features_of(texts, shifts):
                words.append(sizes)
                counts += np.bincount(owners, minlength=len(texts))
                np.add.at(weights, owners, gain[buckets])
            made = [np.concatenate([np.zeros(0, np.int64), *words]), counts, weights]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], schema.names)

    return docs.mapInArrow(scored, schema)


def noise(key: Column) -> Column:
    """A standard Gumbel number in thousandths, from a seeded hash of the key."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Every row with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``: a draw without replacement towards the target.

    Features are runs of 1 to LONGEST words, hashed to BUCKETS buckets; the gains of the buckets are an array that scores
    all texts. The weight plus a Gumbel number is the score; of the rows with LEAST_WORDS words or more, the ``percent`` highest
    scores are drawn and ranked, exactly, ties to the smaller key. Counts cover all rows of both tables and texts of any length.

    A null, empty or wordless text has no features and weight 0 and is not drawn. A null key is hashed like an empty one and
    comes last among equal scores; rows that repeat are rows each, and equal ones take ranks of their own. An empty table
    gives no rows, an empty target a count of 0 for all buckets. Columns named like the operator's own are replaced; the text is
    not returned, all other columns are.
    """
    docs = beside(docs, *(c for c in MADE if c not in (key, text)))
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    scored = weighted(docs, gain, text).drop(text).withColumn("score", F.col("weight") + noise(F.col(key)))
    scored = materialize(scored, "scored")
    long = F.col("n_words") >= LEAST_WORDS
    drawn = percent * scored.where(long).count() // 100
    short = scored.where(~long).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(long), "score", key, drawn).unionByName(short)
