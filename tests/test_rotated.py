"""Search by rotated sign bits: the estimate, its bound, and whole results."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_retrieval import brute, clustered, collected, vector_table
from vigilog.operators import knn, rotated

RNG = np.random.default_rng(11)


def units(n, size):
    vectors = RNG.normal(size=(n, size))
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def indexed(docs, count=8):
    index, pivots = knn.build_index(docs, count)
    known = rotated.frame(pivots)
    return index.withColumn("code", rotated.rotated_code("embedding", "cell", known)), pivots, known


def find(queries, index, pivots, known, k, **options):
    return rotated.search_rotated(queries, index, pivots, k, known, **options)


def sides(spark, docs=600, size=40):
    return vector_table(spark, units(40, size), "qid"), vector_table(spark, units(docs, size), "doc_id")


def recall(found, exact):
    return sum(len(set(found.get(q, [])) & set(best)) for q, best in exact.items()) / sum(map(len, exact.values()))


def test_a_code_is_four_numbers_and_a_bit_a_dimension(spark):
    index, *_ = indexed(sides(spark, 9, 40)[1])
    assert {len(r.code) for r in index.collect()} == {16 + 5}


@pytest.mark.parametrize("size", [7, 64, 384])
@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_estimates_stay_within_their_slack(size, spread):
    centres = units(4, size)
    cells = RNG.integers(0, 4, 500)
    docs = centres[cells] + spread * units(500, size)
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)
    docs[0] = centres[cells[0]]  # a pivot itself
    queries = np.concatenate([units(100, size), docs[:100]])
    known = rotated.frame(knn.Pivots(centres, np.arange(4)))
    assert np.allclose(known.turn @ known.turn.T, np.eye(size))
    rows = rotated.document_codes(docs, cells, known)
    right = rotated.read_documents(pa.chunked_array([pa.array([r.tobytes() for r in rows], pa.binary())]))
    left = np.hstack([np.zeros((200, 1)), queries @ known.turn]).astype(np.float32)
    found, deviation = rotated.estimates(left, right, known)
    error = found - queries @ docs.T
    assert (np.abs(error) <= 2 * deviation + 1e-5).mean() > 0.93
    assert np.abs(error[:, 0]).max() < 1e-5
    if size > 7:
        assert abs(error.mean()) < 0.01


@pytest.mark.parametrize("probe", [None, 8])
def test_recall_on_vectors_without_structure(spark, probe):
    queries, docs = sides(spark)
    assert recall(collected(find(queries, *indexed(docs), 3, probe=probe)), brute(queries, docs, 3)) >= 0.95


def test_the_bound_rules_out_most_documents(spark):
    """Near their pivots documents differ by little, and the slack is as little."""
    docs = vector_table(spark, clustered(900, 128, 10), "doc_id")
    queries = docs.where("doc_id < 60").select(F.col("doc_id").alias("qid"), "embedding", "label")
    index, pivots, known = indexed(docs)
    found = rotated.rotated_candidates(queries, index, pivots, 3, known)
    assert found.where("doc_id IS NULL").count() <= 6
    assert found.where("doc_id IS NOT NULL").count() < 60 * 900 / 10
    assert recall(collected(find(queries, index, pivots, known, 3)), brute(queries, docs, 3)) >= 0.95


def test_a_unit_returns_k_rows_a_query_however_many_it_scores(spark):
    queries, docs = sides(spark)  # one unit; the bound leaves about a tenth of the documents
    found = rotated.rotated_candidates(queries, *indexed(docs)[:2], 3, indexed(docs)[2]).where("doc_id IS NOT NULL")
    assert found.groupBy("qid").count().agg(F.max("count")).first()[0] == 3


def test_a_slack_that_rules_nothing_out_gives_the_exact_result(spark):
    queries, docs = sides(spark, 300)
    assert collected(find(queries, *indexed(docs), 3, deviations=100)) == brute(queries, docs, 3)


@pytest.mark.parametrize("share, most", [(1.0, 10**9), (0.0, 1024), (0.6, 1024)])
def test_few_and_many_candidates_in_small_units(spark, tiny_limits, monkeypatch, share, most):
    """All by codes, all by vectors, and some of each: with a wide slack nothing is lost."""
    monkeypatch.setattr(rotated, "SHARE", share)
    monkeypatch.setattr(rotated, "MOST", most)
    queries, docs = sides(spark, 120)
    assert collected(find(queries, *indexed(docs), 3, deviations=8)) == brute(queries, docs, 3)


def test_copies_ties_and_rows_without_direction(spark):
    vectors = np.concatenate([np.repeat(units(1, 16), 150, axis=0), units(50, 16), np.zeros((2, 16))])
    queries, docs = vector_table(spark, vectors[[0, 160, 201]], "qid"), vector_table(spark, vectors, "doc_id")
    found = collected(find(queries, *indexed(docs, 6), 5, deviations=100))
    assert found == brute(queries, docs, 5) and set(found) == {0, 1} and [d for d, _ in found[0]] == [0, 1, 2, 3, 4]


def test_scopes_few_documents_and_empty_sides(spark):
    queries, docs = (df.withColumn("scope", F.col("label")) for df in sides(spark, 90))
    index, *rest = indexed(docs, 6)
    found = find(queries, index, *rest, 2, deviations=100)
    assert found.join(queries.select("qid", F.col("scope").alias("own")), "qid").where("label <> own").count() == 0
    assert found.count() == 80
    assert find(queries.drop("scope"), index.drop("scope").where("doc_id < 3"), *rest, 5).count() == 120
    assert find(queries.where("false"), index, *rest, 3).count() == 0
    assert find(queries, index.where("false"), *rest, 3).count() == 0
    assert find(queries, *indexed(docs.where("false"), 6), 3).count() == 0
