"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from vigilog.llm.common import materialize
from vigilog.llm.strings import gathered

FIT_DOCS = 4_000
#: Lines of a sample that the driver takes; the gradients of more are summed in tasks.
LOCAL_LINES = 256_000
STEPS = 250
RATE = 0.08
DECAY = 1e-3
CUT = 0.3
#: Of one line; a line is described by its own, its predecessor's and its successor's.
WIDTH = 16
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_features(lines: list[str]) -> np.ndarray:
    """One row for each line of one document."""
    found, seen = np.zeros((len(lines), WIDTH), np.float32), set()
    for k, line in enumerate(lines):
        words = _WORD.findall(line)
        n, size = len(words), len(line)
        if not n:
            found[k, 0] = 1
            continue
        symbols = len(_SYMBOLS.findall(line))
        upper = sum(map(str.isupper, words))
        again = sum(map(str.__eq__, words, words[1:]))
        distinct = len(set(words)) / n
        exclaimed = line.count("!")
        found[k] = (
            0,
            min(np.log1p(size) / 8, 2),
            min(symbols / n, 2),
            symbols * 10 > n,
            line.count("|") * 4 > n,
            upper / n,
            upper * 2 > n,
            again / n,
            again * 5 > n,
            distinct,
            distinct < 0.6,
            min(exclaimed / n, 2),
            min(size / n / 10, 3),
            min(sum(map(str.isdigit, line)) / size * 5, 2),
            line.rstrip()[-1:] in ".?!\"'",
            line in seen,
        )
        seen.add(line)
    return found


def with_neighbours(rows: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Own, previous and next features and a constant; zeros beyond a document's ends (``firsts`` has one more entry)."""
    n = len(rows)
    found = np.zeros((n, 3 * WIDTH + 1), np.float32)
    found[:, :WIDTH], found[:, -1] = rows, 1
    if n:
        found[1:, WIDTH : 2 * WIDTH] = rows[:-1]
        found[:-1, 2 * WIDTH : 3 * WIDTH] = rows[1:]
        full = firsts[:-1] < firsts[1:]
        found[firsts[:-1][full], WIDTH : 2 * WIDTH] = 0
        found[firsts[1:][full] - 1, 2 * WIDTH : 3 * WIDTH] = 0
    return found


@dataclass(frozen=True)
class Field:
    """Weights of a line's features for the label good (bad has none), of label pairs, and the calibration."""

    weights: np.ndarray
    pairs: np.ndarray
    slope: float = 1.0
    offset: float = 0.0


def marginals(field: Field, rows: np.ndarray, firsts: np.ndarray, pairwise: bool = False):
    """The probability of good of every line, by forward-backward over all documents side by side.

    With ``pairwise`` also the expected count of each label pair. Time runs over line numbers; documents
    are in order of length, so those that still have a line come first.
    """
    sizes = np.diff(firsts)
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = firsts[:-1][order], sizes[order]
    steps = int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(steps), "left")  # documents with more than t lines
    local = np.ones((len(rows), 2))
    margin = np.clip(rows @ field.weights, -30, 30)
    local[:, 1] = np.exp(margin / 2)
    local[:, 0] = np.exp(-margin / 2)
    pairs = np.exp(field.pairs - field.pairs.max())
    forward, backward = np.ones((len(rows), 2)), np.ones((len(rows), 2))
    for t in range(steps):
        at = starts[: live[t]] + t
        alpha = local[at] if not t else (forward[at - 1] @ pairs) * local[at]
        forward[at] = alpha / alpha.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        beta = (backward[at + 1] * local[at + 1]) @ pairs.T
        backward[at] = beta / beta.sum(axis=1, keepdims=True)
    both = forward * backward
    good = both[:, 1] / both.sum(axis=1)
    if not pairwise:
        return good
    first = np.ones(len(rows), bool)
    first[firsts[:-1][sizes > 0]] = False
    at = np.flatnonzero(first)
    joint = forward[at - 1][:, :, None] * pairs[None] * (local[at] * backward[at])[:, None, :]
    return good, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0), at


def document_means(good: np.ndarray, weights: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The mean probability of good over each document's lines (one at least), weighted by their lengths."""
    return np.add.reduceat(good * weights, firsts[:-1]) / np.add.reduceat(weights, firsts[:-1])


def calibrated(field: Field, means: np.ndarray) -> np.ndarray:
    means = np.clip(means, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(field.slope * np.log(means / (1 - means)) + field.offset)))


def slopes(field: Field, rows: np.ndarray, firsts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The likelihood's gradient by the weights and the label pairs, and the count of lines, as one row of sums."""
    gold = np.repeat(labels, np.diff(firsts)).astype(float)
    good, joint, at = marginals(field, rows, firsts, pairwise=True)
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[at - 1].astype(int), gold[at].astype(int)), 1)
    return np.concatenate([rows.T @ (gold - good), (seen - joint).ravel(), [len(rows)]])


def climb(summed: Callable[[Field], np.ndarray], width: int = 3 * WIDTH + 1) -> Field:
    """Weights by full-batch gradient steps (Adam) on the likelihood of each document's lines all having its label."""
    weights, pairs = np.zeros(width), np.zeros((2, 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, pairs)]
    for step in range(1, STEPS + 1):
        found = summed(Field(weights, pairs))
        found, n = found[:-1], found[-1]
        both = [found[:width] / n - DECAY * weights, found[width:].reshape(2, 2) / n - DECAY * pairs]
        for value, slope, (mean, square) in zip((weights, pairs), both, moments):
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope**2 - square)
            value += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(weights, pairs)


def calibrate(field: Field, means: np.ndarray, labels: np.ndarray) -> Field:
    means = np.clip(means, 1e-6, 1 - 1e-6)
    x = np.log(means / (1 - means))
    slope, offset = 1.0, 0.0
    for _ in range(30):  # Newton steps of a logistic fit, slightly damped
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        w = p * (1 - p) + 1e-6
        gradient = np.array([(x * (labels - p)).sum() - 0.01 * (slope - 1), (labels - p).sum()])
        hessian = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        change = np.linalg.solve(hessian, gradient)
        slope, offset = slope + np.clip(change[0], -1, 1), offset + np.clip(change[1], -1, 1)
    return Field(field.weights, field.pairs, float(slope), float(offset))


def train(rows: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> Field:
    field = climb(lambda now: slopes(now, rows, firsts, labels), rows.shape[1])
    return calibrate(field, document_means(marginals(field, rows, firsts), lengths, firsts), labels)


def _unpacked(found) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with neighbours, each document's first line, line lengths and labels of a table of described documents."""
    lengths = [np.array(x) for x in found.column("lengths").to_pylist()]
    firsts = np.cumsum([0, *map(len, lengths)])
    rows = np.concatenate([np.frombuffer(r, np.float32).reshape(-1, WIDTH) for r in found.column("rows").to_pylist()])
    return with_neighbours(rows, firsts), firsts, np.concatenate(lengths), found.column("label").to_numpy(zero_copy_only=False).astype(float)


def train_apart(lines: DataFrame) -> Field:
    """What ``train`` gives, with the sums over the documents made in tasks."""

    def summed(made: Callable) -> np.ndarray:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = pc.binary_length(batch.column("rows")).to_pylist()
                for low, high in gathered(sizes):
                    found = made(*_unpacked(batch.slice(low, high - low)))
                    yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float64()))], ["sums"])

        schema = StructType([StructField("sums", ArrayType(DoubleType()))])
        return np.array(lines.mapInArrow(of, schema).toArrow().column("sums").to_pylist())

    def gradient(field: Field) -> np.ndarray:
        return summed(lambda rows, firsts, lengths, labels: slopes(field, rows, firsts, labels)[None]).sum(axis=0)

    def means(rows: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return np.stack([document_means(marginals(field, rows, firsts), lengths, firsts), labels], axis=1)

    field = climb(gradient)
    return calibrate(field, *summed(means).T)


def _described(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw line features of all texts, each line's length plus one, and each text's first line."""
    each = [(t or "").split("\n") for t in texts]
    firsts = np.cumsum([0, *map(len, each)])
    lengths = np.array([len(line) + 1.0 for lines in each for line in lines])
    return np.concatenate([line_features(x) for x in each]), lengths, firsts


def fit_quality(
    docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
    fit_docs: int = FIT_DOCS, seed: int = 9,
) -> Field | None:
    """The field fitted to a seeded sample of about ``fit_docs`` labelled documents, none if a class is missing.

    A sampled document teaches with all its lines. The driver gathers the sample's feature rows, no
    texts, up to LOCAL_LINES lines; of more it sees sums only.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & may_learn).select(key, F.col(label).cast("int").alias("label"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000
    sample = materialize(known.where(draw < min(1.0, fit_docs / max(n, 1))).dropDuplicates([key]), "sample")
    texts = docs.join(F.broadcast(sample), key).select(F.col("label"), F.col(text).alias("text"))
    schema = StructType([StructField("label", IntegerType()), StructField("lengths", ArrayType(DoubleType())), StructField("rows", BinaryType())])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, rows = [], []
            for value in batch.column(1):
                raw, size, _ = _described([value.as_py()])
                lengths.append(size.tolist())
                rows.append(raw.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.list_(pa.float64())), pa.array(rows, pa.binary())], schema.names)

    lines = materialize(texts.mapInArrow(described, schema), "lines")
    held = lines.agg(F.sum(F.size("lengths").cast("bigint")).alias("lines"), F.countDistinct("label").alias("labels")).first()
    if held["labels"] < 2:
        return None
    if held["lines"] > LOCAL_LINES:
        return train_apart(lines)
    return train(*_unpacked(lines.orderBy("label", F.xxhash64("rows")).toArrow()))


def score_quality(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """The input's columns with ``score``, the probability of good quality, from the whole text alone.

    A null text is an empty one, and an empty text is one empty line. Without a field (no labels of
    both classes) every score is 0.5. Rows are independent of each other. An input column ``score`` is
    replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "score"]
    schema = StructType([*docs.select(*kept).schema.fields, StructField("score", DoubleType())])
    at = kept.index(text)
    fitted = None if field is None else (field.weights, field.pairs, field.slope, field.offset)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = None if fitted is None else Field(*fitted)
        for batch in batches:
            texts, scores = batch.column(at).to_pylist(), np.full(batch.num_rows, 0.5)
            for low, high in gathered([len(t or "") for t in texts]) if field else ():
                raw, lengths, firsts = _described(texts[low:high])
                good = marginals(field, with_neighbours(raw, firsts), firsts)
                scores[low:high] = calibrated(field, document_means(good, lengths, firsts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*kept, "score"])

    return docs.select(*kept).mapInArrow(scored, schema)
