"""Approximate nearest neighbours by a walk over a proximity graph.

The nodes of the graph are the different vectors of the index; copies of a vector are members of one node. Nodes are dealt into
segments of about SEGMENT_ROWS by a hash, and edges stay within a segment, so that a task that holds a segment links it or walks
it whole: no vector moves for an edge. A node knows the ``edges`` nearest of its segment, up to ``edges`` others that know
it, and the FAR next ones on a random ring through the segment, which connects what would be islands.

A search walks every segment with every query; what it sends are the queries once for each segment, and a segment once for
each CHUNK_ROWS queries. A walk holds ``beam`` nodes, at first the nearest of ENTRIES seeded nodes. In a round the ``wide``
nearest that are still open are closed and what their edges lead to is scored; it ends when no node is open. A node is scored once at most, so it always ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions.vectors import to_matrix
from vigilog.operators.joins import salted_join
from vigilog.operators.knn import at_least, exact_values, first_per_row, rank_hits
from vigilog.session import materialize

EDGES = 24
FAR = 4
SEGMENT_ROWS = 8_192
CHUNK_ROWS = 32_768
#: Scores that a task holds at a time, and pairs of queries and nodes of which it knows whether they were scored.
SCORES_AT_ONCE = 4_000_000
SEEN_AT_ONCE = 4_000_000
ENTRIES = 64

LINKED = "segment int, node bigint, embedding array<float>, edges array<bigint>"


@dataclass(frozen=True)
class Graph:
    """``nodes``: ``segment, node, embedding, edges``; ``members``: a row for each document, with its ``node``."""

    nodes: DataFrame
    members: DataFrame
    segments: int
    seed: int


def _nearest(vectors: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its ``count`` nearest other rows: row, other, score."""
    keep = min(count, len(vectors) - 1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    step = max(1, SCORES_AT_ONCE // len(vectors))
    for start in range(0, len(vectors) if keep else 0, step):
        scores = vectors[start : start + step] @ vectors.T
        own = np.arange(len(scores))
        scores[own, start + own] = -np.inf
        rows, columns = np.nonzero(scores >= at_least(scores, keep))
        values = scores[rows, columns]
        rows, columns, values = first_per_row((rows, columns, values), keep)
        found.append((rows + start, columns, values))
    return tuple(np.concatenate(part) for part in zip(*found))


def _link(edges: int, seed: int):
    def link(key: tuple, table: pa.Table) -> pa.Table:
        """The nodes of one segment with their edges."""
        table = table.combine_chunks().sort_by("node")
        ids, count = table["node"].to_numpy(), table.num_rows
        rows, others, scores = _nearest(to_matrix(table["embedding"], np.float32), edges)
        one_way = ~np.isin(others * count + rows, rows * count + others)
        turned, back, _ = first_per_row((others[one_way], rows[one_way], scores[one_way]), edges)
        ring = np.random.default_rng([seed, key[0].as_py()]).permutation(count)
        steps = range(1, min(FAR, count - 1) + 1)
        near = [rows * count + others, turned * count + back, *[ring * count + np.roll(ring, -step) for step in steps]]
        pairs = np.unique(np.concatenate(near))
        ends = np.searchsorted(pairs, np.arange(count + 1) * count).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[pairs % count]))
        return pa.table([table["segment"], table["node"], table["embedding"], listed], names=["segment", "node", "embedding", "edges"])

    return link


def build_graph(docs: DataFrame, edges: int = EDGES, seed: int = 42, carry: Sequence[str] = ("label",)) -> Graph:
    """The graph of documents ``doc_id`` (bigint), ``embedding`` (unit vectors) and the carried columns.

    Documents without a vector are no part of it. Copies of a vector are one node, however many. An index without a
    document gives a graph without nodes, in which nothing is found.
    """
    docs = docs.where(F.col("embedding").isNotNull())
    copy = F.struct(F.xxhash64("embedding").alias("h0"), F.xxhash64(F.lit(1), "embedding").alias("h1"))
    nodes = docs.groupBy(copy.alias("copy")).agg(F.min("doc_id").alias("node"), F.min_by("embedding", "doc_id").alias("embedding"))
    nodes = materialize(nodes, "nodes")
    members = salted_join(docs.select("doc_id", *carry, copy.alias("copy")), nodes.select("copy", "node"), ["copy"], ["doc_id"])
    members = materialize(members.select("node", "doc_id", *carry), "members")

    segments = max(1, -(-nodes.count() // SEGMENT_ROWS))
    segment = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(segments)).cast("int")
    placed = nodes.select(segment.alias("segment"), "node", "embedding")
    linked = placed.groupBy("segment").applyInArrow(_link(edges, seed), LINKED)
    return Graph(materialize(linked, "graph"), members, segments, seed)


def _neighbourhoods(edges: pa.ListArray, ids: np.ndarray) -> np.ndarray:
    """Where each node's edges lead, as places in ``ids``; -1 stands behind the last one."""
    sizes = np.diff(edges.offsets.to_numpy())
    around = np.full((len(ids), max(1, sizes.max())), -1, np.int32)
    around[np.arange(around.shape[1]) < sizes[:, None]] = np.searchsorted(ids, edges.flatten().to_numpy())
    return around


def _scores(asked: np.ndarray, vectors: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Scores of each query with its places, which end where the next one's begin."""
    scores = np.empty(len(places), np.float32)
    for query, (start, end) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
        if start < end:
            np.dot(vectors.take(places[start:end], axis=0), asked[query], out=scores[start:end])
    return scores


def _walk(asked: np.ndarray, vectors: np.ndarray, around: np.ndarray, entries: np.ndarray, beam: int, wide: int) -> np.ndarray:
    """The nodes that each query holds at the end, -1 where there are fewer than ``beam``."""
    count, queries = len(vectors), len(asked)
    held, best = np.full((queries, beam), -1, np.int32), np.full((queries, beam), -np.inf, np.float32)
    is_open = np.zeros((queries, beam), bool)
    seen = np.zeros(queries * count, np.int32)
    rows, places = np.repeat(np.arange(queries), len(entries)), np.tile(entries, queries)
    while len(rows):
        pairs = rows * count + places
        new = np.flatnonzero(seen[pairs] == 0)
        number = np.arange(1, len(new) + 1, dtype=np.int32)
        seen[pairs[new]] = number
        once = new[seen[pairs[new]] == number]  # of what is listed twice the last
        rows, places = rows[once], places[once]
        values = _scores(asked, vectors, np.bincount(rows, minlength=queries).cumsum(), places)
        near = np.flatnonzero(values > best.min(axis=1)[rows])  # the others would not stay
        rows, places, values = rows[near], places[near], values[near]
        met = np.bincount(rows, minlength=queries)
        at = beam + np.arange(len(rows)) - np.repeat(met.cumsum() - met, met)
        more = ((0, 0), (0, int(met.max(initial=0))))
        pool, score = np.pad(held, more, constant_values=-1), np.pad(best, more, constant_values=-np.inf)
        opened = np.pad(is_open, more)
        pool[rows, at], score[rows, at], opened[rows, at] = places, values, True
        kept = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
        held, best, is_open = (np.take_along_axis(x, kept, axis=1) for x in (pool, score, opened))
        few = min(wide, beam)
        chosen = np.argpartition(np.where(is_open, -best, np.inf), few - 1, axis=1)[:, :few]
        rows, at = np.nonzero(np.take_along_axis(is_open, chosen, axis=1))
        at = chosen[rows, at]
        is_open[rows, at] = False
        led = around[held[rows, at]]
        rows, places = np.repeat(rows, (led >= 0).sum(axis=1)), led[led >= 0].astype(np.int64)
    return held


def _walks(k: int, beam: int, wide: int, seed: int):
    def walks(_key: tuple, queries: pa.Table, nodes: pa.Table) -> pa.Table:
        """The k nearest nodes that each query of a chunk finds in one segment."""
        nothing = np.zeros(0, np.int64)
        found, ids = [(nothing, nothing, nothing)], nothing
        if queries.num_rows and nodes.num_rows:
            nodes = nodes.combine_chunks().sort_by("node")
            ids, vectors = nodes["node"].to_numpy(), to_matrix(nodes["embedding"], np.float32)
            around = _neighbourhoods(nodes["edges"].combine_chunks(), ids)
            entries = np.random.default_rng(seed).permutation(len(ids))[:ENTRIES]
            asked = to_matrix(queries["embedding"], np.float32)
            step = max(1, SEEN_AT_ONCE // len(ids))
            for start in range(0, len(asked), step):
                part = asked[start : start + step]
                held = _walk(part, vectors, around, entries, beam, wide)
                rows, at = np.nonzero(held >= 0)
                places = held[rows, at].astype(np.int64)
                rows, places, values = first_per_row((rows, places, exact_values(part, vectors, rows, places)), k)
                found.append((rows + start, places, values))
        rows, places, values = (np.concatenate(part) for part in zip(*found))
        return pa.table([queries["qid"].take(pa.array(rows)), pa.array(ids[places]), pa.array(values / 1e6)], names=["qid", "node", "score"])

    return walks


def search_graph(
    queries: DataFrame, graph: Graph, k: int, beam: int = 64, wide: int = 16, carry: Sequence[str] = ("label",)
) -> DataFrame:
    """About the k nearest documents of every query, as ``search`` returns them: ``qid, doc_id, <carry>, score, rank``.

    Scores are those of full vectors; copies and ties go by the lower id. A wider beam finds more. ``qid`` is unique; rows without a
    vector match nothing; a graph without nodes has no hits.
    """
    beam = max(beam, k)
    asked = queries.where(F.col("embedding").isNotNull()).select("qid", "embedding")
    chunks = max(1, -(-asked.count() // CHUNK_ROWS))
    chunk = F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int")
    left = asked.withColumn("chunk", chunk).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(graph.segments - 1))))
    right = graph.nodes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    unit = ["segment", "chunk"]
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, node bigint, score double"
    best = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(_walks(k, beam, wide, graph.seed), schema)
    # a node has a document at least, and its number is that of the first one
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "node")
    best = materialize(best, "walked").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
    place = F.row_number().over(Window.partitionBy("node").orderBy("doc_id"))
    members = graph.members.withColumn("place", place).where(F.col("place") <= k)
    listed = members.groupBy("node").agg(F.collect_list(F.struct("doc_id", *carry)).alias("docs"))
    hits = salted_join(best, listed, ["node"], ["qid"]).select("qid", "score", F.explode("docs").alias("doc"))
    return rank_hits(hits.select("qid", "doc.*", "score"), k, F.col("score").desc())
