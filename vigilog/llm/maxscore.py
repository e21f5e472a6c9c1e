"""Exact top-k inner products by MaxScore over blocks of postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from vigilog.llm.common import materialize

SHARD_ROWS = 8_192
QUERY_ROWS = 1_024
FIRST_ROWS = 512
PROBED_AT_ONCE = 8
EXACT = float(1 << 53)
#: Whole numbers that weights are sent as, if they fit; else as doubles.
FORMS = ("int8", "int16", "int32")

PACKED = StructType(
    [
        StructField("part", IntegerType()),
        StructField("terms", IntegerType()),
        StructField("form", StringType()),
        StructField("ids", BinaryType()),
        StructField("postings", BinaryType()),
    ]
)


def _narrowest(grid: np.ndarray) -> str:
    least, most = grid.min(initial=0), grid.max(initial=0)
    return next((f for f in FORMS if np.iinfo(f).min <= least and most <= np.iinfo(f).max), "float64")


def _packed(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """One row for each part of about ``rows`` vectors: the ids, and for each term all its weights (0: no posting)."""
    parts = max(1, -(-vectors.count() // rows))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in found]).astype(np.int64)
            weights = [np.array(v, float) for b in found for v in b.column(1).to_pylist()]
        else:
            ids, weights = np.zeros(0, np.int64), []
        terms = max(map(len, weights), default=0)
        grid = np.zeros((terms, len(ids)))
        for k, w in enumerate(weights):
            grid[: len(w), k] = w
        form = _narrowest(grid)
        row = [[TaskContext.get().partitionId()], [terms], [form], [ids.tobytes()], [grid.astype(form).tobytes()]]
        types = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], PACKED.names)

    return materialize(vectors.repartition(parts).mapInArrow(pack, PACKED), "postings"), parts


def _unpacked(terms: int, form: str, ids: bytes, postings: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, np.int64)
    return keys, np.frombuffer(postings, form).reshape(terms, len(keys)).astype(float)


class Best:
    """The k best of what was seen: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    @property
    def threshold(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_part(query: np.ndarray, own: int, ids: np.ndarray, grid: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Best:
    """The k best documents of one part for one query, without those that carry the query's id.

    ``low`` and ``high`` bound each term's weights, so each term's share of a score lies between two
    known values. The terms of the smallest spans are non-essential as long as a document that is at
    its worst in all others cannot reach the k-th best score. Essential postings are traversed; the
    others are probed, widest span first, for documents that can still compete.
    """
    least, most = np.minimum(query * low, query * high), np.maximum(query * low, query * high)
    span = most - least
    order = np.argsort(span, kind="stable")
    reach = least.sum() + np.cumsum(span[order])
    best, at = Best(k), 0
    while at < len(ids):
        upto = min(len(ids), at + (FIRST_ROWS if not at else SHARD_ROWS))
        theta = best.threshold
        passive = int(np.searchsorted(reach, theta)) if theta > -np.inf else 0
        essential, others = order[passive:], order[:passive][::-1]
        live = np.flatnonzero(ids[at:upto] != own) + at
        scores = (query[essential] @ grid[essential, at:upto])[live - at]
        open_reach = most[others].sum()
        for begin in range(0, len(others), PROBED_AT_ONCE):
            keep = scores + open_reach >= theta
            live, scores = live[keep], scores[keep]
            if not len(live):
                break
            probed = others[begin : begin + PROBED_AT_ONCE]
            scores = scores + query[probed] @ grid[np.ix_(probed, live)]
            open_reach -= most[probed].sum()
        if len(live):
            best.add(scores, ids[live])
        at = upto
    return best


def _exactly(query: np.ndarray, own: int, ids: np.ndarray, grid: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The same for weights whose products leave the exact range of doubles, in whole numbers."""
    whole = [int(x) for x in query]
    found = [(sum(a * int(b) for a, b in zip(whole, grid[:, j])), int(i)) for j, i in enumerate(ids) if i != own]
    bound = (1 << 63) - 1
    return [(i, max(-bound, min(bound, s))) for s, i in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]


def search(vectors: DataFrame, is_query: Column, k: int, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its k best other rows by integer inner product.

    Components become floor(scale * x); each is a term with that weight. Vectors are dealt evenly to
    parts of SHARD_ROWS, queries to parts of QUERY_ROWS, and each pair of parts is searched on its
    own; each gives k rows a query, and the best of those are the result. Query parts times vector
    parts is what an exact search of a stated query set compares.

    A vector that is null or empty, has no key, or holds a null or a non-finite component takes no part.
    Of unequal lengths, the shorter has no posting for the terms it lacks. Rows that repeat a key are
    candidates each, but not for a query of their key. Equal scores go to the smaller key. Scores
    beyond the range of a long are given as its end.
    """
    numbers = F.col(vector)
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & (F.size(numbers) > 0) & fine)
    rows = rows.select(F.col(key).cast("bigint").alias("id"), F.transform(numbers, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("weights"), is_query.alias("asks"))
    rows = materialize(rows, "weights")
    shards, n_shards = _packed(rows.select("id", "weights"), SHARD_ROWS)
    asked, _ = _packed(rows.where("asks").select("id", "weights"), QUERY_ROWS)
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in PACKED.names])
    sent = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    # a size estimate leaves out how often a query part is sent, so neither side may be broadcast by it
    units = sent.hint("merge").join(shards, "part")
    side = [c for c in PACKED.names if c != "part"]
    schema = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", LongType())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = [column[at].as_py() for column in batch.columns]
                asks, questions = _unpacked(*row[: len(side)])
                ids, grid = _unpacked(*row[len(side) :])
                terms = min(len(questions), len(grid))  # a term that one side lacks adds nothing
                if not terms or not len(ids):
                    continue
                questions, grid = questions[:terms], grid[:terms]
                low, high = grid.min(axis=1), grid.max(axis=1)
                largest = np.maximum(-low, high)
                out: list[tuple[int, int, int]] = []
                for j, own in enumerate(asks):
                    query = questions[:, j].copy()
                    if np.abs(query) @ largest < EXACT:
                        best = search_part(query, own, ids, grid, low, high, k)
                        out += [(own, i, int(s)) for i, s in zip(best.ids, best.scores)]
                    else:
                        out += [(own, i, s) for i, s in _exactly(query, own, ids, grid, k)]
                columns = list(zip(*out)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema.names)

    found = units.select(*[f"q_{c}" for c in side], *side).mapInArrow(searched, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
