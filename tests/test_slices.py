"""A search that would send many times the rows of both sides does so slice by slice."""

import numpy as np
import pytest

from vigilog.operators import knn
from vigilog.session import materialize


def table(spark, rng, n, name, scopes):
    vectors = rng.normal(size=(n, 6))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v], "l", f"s{i % scopes}") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, f"{name} long, embedding array<float>, label string, scope string")
    return df if scopes > 1 else df.drop("scope")


@pytest.mark.parametrize("scopes", [1, 2])
def test_slices_give_the_hits_of_one_search(spark, monkeypatch, scopes):
    rng = np.random.default_rng(8)
    queries = materialize(table(spark, rng, 60, "qid", scopes), "queries")
    docs = table(spark, rng, 200, "doc_id", scopes)
    pivots = knn.choose_pivots(docs, 4)
    index = materialize(knn.assign_cells(docs, pivots), "index")
    whole = sorted(map(str, knn.search(queries, index, pivots, 3).collect()))
    assert len(whole) == 180
    for limit, rows in (("BLOCK_ROWS", 10), ("CHUNK_ROWS", 5), ("LEAST_ROUTED", 1), ("ROUTED_AT_ONCE", 2)):
        monkeypatch.setattr(knn, limit, rows, raising=False)
    sent, routed = [], knn._rows_routed
    monkeypatch.setattr(knn, "_rows_routed", lambda areas: sent.append(routed(areas)) or sent[-1])
    assert sorted(map(str, knn.search(queries, index, pivots, 3).collect())) == whole
    assert sent[0] > 4 * 260 and len(sent) > 2 and max(sent[1:]) < sent[0] / 2
