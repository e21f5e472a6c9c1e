"""Search over a proximity graph: recall, bounded edges, islands, copies, empty sides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.operators import proximity

K = 3


def units(rng, n, size):
    vectors = rng.normal(size=(n, size))
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def rows_of(spark, vectors, name):
    rows = [(i, None if v is None else [float(x) for x in v], f"l{i % 3}") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>, label string")


def nearest(queries, docs, k=K):
    """For each query the k best (score, id), ties to the lower id."""
    scores = np.rint((1 + queries.astype(np.float32).astype(float) @ docs.astype(np.float32).astype(float).T) / 2 * 1e6) / 1e6
    return [sorted(zip(-row, range(len(docs))))[:k] for row in scores]


def found(hits):
    out = {}
    for r in hits.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((-r.score, r.doc_id))
    return out


def recall(hits, expected):
    return sum(len(set(hits.get(q, [])) & set(best)) for q, best in enumerate(expected)) / sum(map(len, expected))


@pytest.mark.parametrize("islands", [0, 30])
def test_nine_in_ten_are_found(spark, islands):
    rng = np.random.default_rng(3)
    docs, queries = units(rng, 900, 32), units(rng, 40, 32)
    if islands:  # each larger than a node's edges
        centres = units(rng, islands, 32)
        docs = np.repeat(centres, 900 // islands, axis=0) + 0.02 * rng.normal(size=docs.shape)
        queries = np.resize(centres, (40, 32)) + 0.02 * rng.normal(size=queries.shape)
        docs, queries = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (docs, queries))
    graph = proximity.build_graph(rows_of(spark, docs, "doc_id"), edges=12)
    most = graph.nodes.agg(F.max(F.size("edges")), F.count(F.lit(1))).first()
    assert most[0] <= 2 * 12 + proximity.FAR and most[1] == 900
    hits = proximity.search_graph(rows_of(spark, queries, "qid"), graph, K)
    assert hits.columns == ["qid", "doc_id", "label", "score", "rank"]
    hits = found(hits)
    assert all(len(hits[q]) == K for q in range(40))
    assert recall(hits, nearest(queries, docs)) >= 0.9


def test_small_graphs_are_searched_whole_and_copies_go_by_id(spark, tiny_limits):
    rng = np.random.default_rng(4)
    different = units(rng, 25, 8)
    docs = np.concatenate([different, np.repeat(different[:1], 40, axis=0), different[::-1]])
    queries = np.concatenate([different[:5], units(rng, 5, 8)])
    graph = proximity.build_graph(rows_of(spark, [*docs, None], "doc_id"), edges=30)
    assert graph.nodes.count() == 25
    asked = rows_of(spark, [*queries, None], "qid")
    expected = nearest(queries, docs, 5)
    got = found(proximity.search_graph(asked, graph, 5))
    assert {q: got[q] for q in range(10)} == dict(enumerate(expected)) and 10 not in got


@pytest.mark.parametrize("n", [0, 1, 2])
def test_hardly_any_documents(spark, n):
    docs = np.eye(4)[:n]
    graph = proximity.build_graph(rows_of(spark, docs, "doc_id"))
    got = found(proximity.search_graph(rows_of(spark, np.eye(4)[:1], "qid"), graph, K))
    assert [i for _, i in got.get(0, [])] == list(range(n))
    none = proximity.search_graph(rows_of(spark, np.zeros((0, 4)), "qid"), graph, K)
    assert none.count() == 0


def test_edges_stay_in_their_segment_and_all_are_walked(spark, monkeypatch):
    for limit, rows in (("SEGMENT_ROWS", 100), ("CHUNK_ROWS", 15), ("SEEN_AT_ONCE", 700), ("SCORES_AT_ONCE", 900)):
        monkeypatch.setattr(proximity, limit, rows, raising=False)
    rng = np.random.default_rng(5)
    docs, queries = units(rng, 700, 16), units(rng, 40, 16)
    graph = proximity.build_graph(rows_of(spark, docs, "doc_id"), edges=8)
    nodes = {r.node: r for r in graph.nodes.select("segment", "node", "edges").collect()}
    assert len({r.segment for r in nodes.values()}) == 7 and len(nodes) == 700
    assert all(nodes[e].segment == r.segment and e != r.node for r in nodes.values() for e in r.edges)
    ids = np.array([i for i in nodes if nodes[i].segment == 3])
    scores = docs[ids] @ docs[ids].T - 3 * np.eye(len(ids))
    assert all(set(ids[row.argsort()[-8:]]) <= set(nodes[i].edges) for i, row in zip(ids, scores))
    hits = found(proximity.search_graph(rows_of(spark, queries, "qid"), graph, K))
    assert all(len(hits[q]) == K for q in range(40))
    assert recall(hits, nearest(queries, docs)) >= 0.99


def test_a_bound_from_groups_never_hides_the_best():
    from vigilog.operators.knn import at_least

    rng = np.random.default_rng(6)
    for width in (1, 5, 255, 300, 512, 700, 2_000):
        for k in (1, 3, min(width, 200)):
            scores = rng.normal(size=(20, width)).round(1).astype(np.float32)
            kth = np.sort(scores, axis=1)[:, [max(0, width - k)]]
            assert (at_least(scores, min(k, width)) <= kth).all()
