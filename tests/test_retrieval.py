import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilog.functions.labels import RARE_LABELS, SUMMARY_KEYS
from vigilog.functions.vectors import embed_hash, embed_with, sign_code, token_bucket, unit
from vigilog.operators import knn
from vigilog.operators import vote as V
from vigilog.operators.metrics import class_report, compare_models, confusion, confusion_matrix, overall_comparison, overall_report
from vigilog.operators.retrieve import resolve_sources, retrieve, retrieve_context, retrieve_stored
from vigilog.operators.sinks import share_entries
from vigilog.plans.evaluation import embed_queries, evaluate_knn
from vigilog.operators.joins import as_lookup
from vigilog.sources.vector_index import (
    append_documents, create_index, load_documents_of, load_index, load_pivots, load_terms, rebuild_index
)
from vigilog.streaming.classify import ARRIVAL_SCHEMA, classify_batch, classify_stream

RNG = np.random.default_rng(7)


def clustered(n, dim=12, centres=6):
    base = RNG.normal(size=(centres, dim))
    return (base[RNG.integers(0, centres, n)] + 0.15 * RNG.normal(size=(n, dim))).astype(np.float32)


def vector_table(spark, matrix, id_name, labels=("a", "b", "c")):
    rows = [(i, [float(x) for x in v], labels[i % len(labels)]) for i, v in enumerate(matrix)]
    df = spark.createDataFrame(rows, f"{id_name} long, raw array<float>, label string")
    return df.withColumn("embedding", unit("raw")).drop("raw")


def brute(queries, docs, k):
    q, x = ({r[0]: np.array(r.embedding, np.float64) for r in df.collect() if r.embedding} for df in (queries, docs))
    ids = sorted(x)
    matrix = np.array([x[i] for i in ids])
    out = {}
    for qid, v in q.items():
        scores = np.round((1 + matrix @ v) / 2, 6)
        best = np.lexsort((np.arange(len(ids)), -scores))[:k]
        out[qid] = [(ids[j], scores[j]) for j in best]
    return out


def collected(hits):
    out = {}
    for r in hits.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.doc_id, r.score))
    return out


@pytest.fixture
def sides(spark):
    return vector_table(spark, clustered(60), "qid"), vector_table(spark, clustered(300), "doc_id")


@pytest.mark.parametrize("k", [1, 3, 10])
def test_exact_search_equals_brute_force(spark, sides, k):
    queries, docs = sides
    index, pivots = knn.build_index(docs, 12)
    assert collected(knn.search(queries, index, pivots, k)) == brute(queries, docs, k)


def test_exact_search_in_small_units(spark, sides, tiny_limits):
    queries, docs = sides
    index, pivots = knn.build_index(docs, 12)
    assert collected(knn.search(queries, index, pivots, 3)) == brute(queries, docs, 3)


def test_a_task_makes_matrices_of_few_queries(monkeypatch):
    monkeypatch.setattr(knn, "SCORES_AT_ONCE", 60)
    seen = []

    def floats(column):
        seen.append(len(column))
        return knn._floats(column)

    rng = np.random.default_rng(5)
    both = {name: pa.array(rng.standard_normal((30, 4)).tolist(), pa.list_(pa.float32())) for name in ("queries", "docs")}
    places = {"unit": ["a"] * 15 + ["b"] * 15, "cells": pa.nulls(30, pa.list_(pa.int32()))}
    queries = pa.table({"qid": range(30), "unit": places["unit"], "cells": places["cells"], "vector": both["queries"]})
    docs = pa.table({"doc_id": [*range(29, -1, -1)], "cell": pa.array([0] * 30, pa.int32()), "unit": places["unit"], "vector": both["docs"]})
    by = knn.Comparison("embedding", floats, knn._floats, knn._best_vectors, knn.VECTORS.score)
    found = knn._compare(2, by)((), queries, docs)
    assert found.num_rows == 60 and max(seen) == 4
    left, right = (np.array(both[name].to_pylist()) for name in ("queries", "docs"))
    for at in range(30):
        unit = range(15) if at < 15 else range(15, 30)
        best = sorted(unit, key=lambda j: -(left[at] @ right[j]))[:2]
        assert {29 - j for j in best} == {d for q, d in zip(found["qid"].to_pylist(), found["doc_id"].to_pylist()) if q == at}


def test_more_neighbours_than_documents(spark, sides):
    queries, docs = sides
    few = docs.where("doc_id < 2")
    index, pivots = knn.build_index(few, 5)
    assert collected(knn.search(queries, index, pivots, 3)) == brute(queries, few, 3)


def test_empty_sides(spark, sides):
    queries, docs = sides
    index, pivots = knn.build_index(docs, 5)
    assert knn.search(queries.where("false"), index, pivots, 3).count() == 0
    assert knn.search(queries, index.where("false"), pivots, 3).count() == 0


def test_copies_share_a_cell_and_are_cut(spark):
    copies = np.repeat(clustered(1), 200, axis=0)
    docs = vector_table(spark, np.concatenate([copies, clustered(100)]), "doc_id")
    queries = vector_table(spark, np.concatenate([copies[:3], clustered(10)]), "qid")
    index, pivots = knn.build_index(docs, 8)
    assert index.where(F.col("copy_rank").isNull()).count() == 200 - knn.COPIES_RANKED
    assert collected(knn.search(queries, index, pivots, 5)) == brute(queries, docs, 5)
    assert collected(knn.search(queries, index, pivots, 70)) == brute(queries, docs, 70)


def test_bounds_leave_out_cells(spark):
    """With clear clusters a query visits few of the cells, and still nothing is missed."""
    centres = np.eye(12, dtype=np.float32)
    spots = np.repeat(centres, 30, axis=0) + 0.02 * RNG.normal(size=(360, 12)).astype(np.float32)
    pivots = spots[::30] / np.linalg.norm(spots[::30], axis=1, keepdims=True)
    units = spots / np.linalg.norm(spots, axis=1, keepdims=True)
    cells = (units @ pivots.T).argmax(axis=1)
    gaps = np.sqrt(np.maximum(2 - 2 * (units * pivots[cells]).sum(axis=1), 0))
    number = np.unique(cells)
    sizes = np.array([(cells == c).sum() for c in number])
    closest = np.array([gaps[cells == c].min() for c in number])
    furthest = np.array([gaps[cells == c].max() for c in number])
    between = knn._distances(pivots, pivots)
    visited = knn._cells_in_reach(units[:20].astype(float), pivots.astype(float), between, number, sizes, closest, furthest, 3)
    assert visited.sum(axis=1).max() <= 2


def test_probing_all_cells_is_exact(spark, sides):
    queries, docs = sides
    index, pivots = knn.build_index(docs, 10)
    exact = brute(queries, docs, 3)
    assert collected(knn.search(queries, index, pivots, 3, probe=10)) == exact

    def recall(found):
        return sum(len(set(found.get(q, [])) & set(best)) for q, best in exact.items())

    recalls = [recall(collected(knn.search(queries, index, pivots, 3, probe=p))) for p in (1, 3, 10)]
    assert recalls == sorted(recalls) and recalls[-1] == 3 * len(exact)


def test_quantized_search_rescores(spark, sides):
    queries, docs = (df.withColumn("code", sign_code("embedding")) for df in sides)
    index, pivots = knn.build_index(docs, 10)
    assert collected(knn.search_quantized(queries, index, pivots, 3, probe=10, oversample=100)) == brute(queries, docs, 3)


def test_rows_without_direction(spark):
    texts = spark.createDataFrame([(1, "GET /index"), (2, "..."), (3, None), (4, "")], "id long, t string")
    vectors = {r.id: r.v for r in texts.select("id", embed_hash("t").alias("v")).collect()}
    assert vectors[2] is None and vectors[3] is None and vectors[4] is None
    expected = np.zeros(384)
    expected[[token_bucket(t, 384) for t in ("get", "index")]] = np.float32(1 / np.sqrt(2))
    assert np.allclose(vectors[1], expected)
    nothing = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [3.0, 4.0])], "id long, v array<float>")
    assert [r[0] and [round(x, 3) for x in r[0]] for r in nothing.select(unit("v")).collect()] == [None, None, [0.6, 0.8]]


def test_vectors_of_different_lengths_fail(spark):
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<float>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        mixed.select(unit("v")).collect()


def test_own_embedder(spark):
    def load():
        return lambda texts: [[len(t), 1.0] for t in texts]

    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r[0] and [round(x, 4) for x in r[0]] for r in df.select(embed_with(load, "t")).collect()] == [[0.9487, 0.3162], None]


def source_index(spark):
    rows = [
        (1, "GET /a", "Inet-dns", "dirb"),
        (2, "GET /b", "mail", "normal_log"),
        (3, "query x", "a_b", None),
        (4, "GET /a", "vpn", "wpscan"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, log string, source string, label string")
    return knn.build_index(docs.withColumn("embedding", embed_hash("log")), 4)


def test_source_resolution(spark):
    index, _ = source_index(spark)
    asked = ["dns", "inet-dns", "a_b", "x_mail", "Mail", "none", None, "a-b_c", "q-vpn"]
    sources = spark.createDataFrame([(s,) for s in asked], "source string")
    found = {r.source: r.scope for r in resolve_sources(sources, index).collect()}
    assert found == {"dns": "=dns", "inet-dns": "=dns", "a_b": "=a_b", "x_mail": "=mail", "Mail": "*", "none": "*", None: "*", "a-b_c": "*", "q-vpn": "=vpn"}


def test_filtered_and_relaxed_search(spark):
    index, pivots = source_index(spark)
    rows = [(1, "GET /a", "inet-dns"), (2, "GET /a", "mail"), (3, "GET /a", None), (4, "query", "a_b"), (5, "...", "mail")]
    queries = spark.createDataFrame(rows, "qid long, log_message string, source string").withColumn("embedding", embed_hash("log_message"))
    relaxed = {(r.qid, r.doc_id, r.label) for r in retrieve(queries, index, pivots, 1).collect()}
    assert relaxed == {(1, 1, "dirb"), (2, 2, "normal_log"), (3, 1, "dirb"), (4, 3, "No Label")}
    strict = {r.qid for r in retrieve(queries, index, pivots, 1, relax=False).collect()}
    assert strict == {2, 3, 4}
    context = retrieve_context(retrieve(queries, index, pivots, 2), index)
    third = context.where("qid = 3").first().context
    assert [(h.log, h.label) for h in third] == [("GET /a", "dirb"), ("GET /a", "wpscan")] and third[0].score == 1.0


def hits_of(spark, rows):
    return spark.createDataFrame(rows, "qid long, label string, score double, rank int")


def test_vote(spark):
    hits = hits_of(spark, [(1, "A", 0.9, 1), (1, "B", 0.8, 2), (1, "B", 0.7, 3), (2, "B", 0.5, 1), (2, "A", 0.5, 2), (3, "Z", 0.0, 1)])
    assert {r.qid: r.predicted for r in V.winner(V.vote(hits)).collect()} == {1: "B", 2: "B", 3: "Z"}
    assert {r.qid: r.predicted for r in V.winner(V.vote(hits.where("rank <= 2"))).collect()}[1] == "A"
    shares = {(r.qid, r.label): r.share for r in V.vote_share(V.vote(hits)).collect()}
    assert round(shares[1, "A"], 2) == 37.5 and round(shares[1, "B"], 2) == 62.5 and shares[3, "Z"] is None
    queries = spark.createDataFrame([(1, "one"), (9, "nine")], "qid long, log_message string")
    predicted = {r.qid: (r.predicted, r.status) for r in V.predict(queries, hits).collect()}
    assert predicted == {1: ("B", "success"), 9: (None, "no_match")}
    swept = {(r.k, r.qid): r.predicted for r in V.winner(V.vote(V.sweep(hits, [1, 3]), ["k", "qid"]), ["k", "qid"]).collect()}
    assert swept[1, 1] == "A" and swept[3, 1] == "B"
    entry = share_entries(queries, V.vote_share(V.vote(hits))).first().entry
    assert entry.split("\n") == ["#" * 80, "Log query: one", "#" * 80, "Label: A, Score: 37.50%", "-" * 80, "Label: B, Score: 62.50%", "-" * 80]


def test_dominance(spark):
    hits = hits_of(spark, [(1, "normal_log", 0.5, 1), (1, "dirb", 0.5, 2), (2, "normal_log", 0.9, 1), (3, "dirb", 0.2, 1)])
    found = {r.qid: (r.normal_not_dominant, r.any_attack) for r in V.dominance(V.vote(hits)).collect()}
    assert found == {1: (True, True), 2: (False, False), 3: (True, True)}


def test_report(spark):
    scored = spark.createDataFrame(
        [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "x"), ("c", None)], "label string, predicted string"
    )
    counts = confusion(scored)
    report = {r.label: (r.precision, r.recall, r.f1, r.support) for r in class_report(counts).collect()}
    assert report["x"] == (0.0, 0.0, 0.0, 0) and report["c"] == (0.0, 0.0, 0.0, 1)
    assert report["a"] == pytest.approx((1.0, 0.5, 2 / 3, 2)) and report["b"] == pytest.approx((2 / 3, 1.0, 0.8, 2))
    overall = overall_report(class_report(counts)).first()
    assert overall.accuracy == pytest.approx(overall.weighted_recall) == pytest.approx(3 / 5)
    assert overall.macro_precision == pytest.approx((1 + 2 / 3) / 4)
    dense = confusion_matrix(counts)
    assert dense.columns == ["label", "a", "b", "c", "x"] and [tuple(r) for r in dense.collect()][3] == ("x", 0, 0, 0, 0)


def test_model_comparison(spark):
    rows = [("m1", "a", 0.5), ("m2", "b", 0.7), ("m1", "accuracy", 1.0), ("m1", "dirb", 1.0)]
    reports = spark.createDataFrame(rows, "model string, label string, f1 double")
    assert [tuple(r) for r in compare_models(reports, ["m1", "m2"]).collect()] == [("a", 0.5, 0.0), ("b", 0.0, 0.7), ("dirb", 1.0, 0.0)]
    wide = compare_models(reports, ["m1", "m2"], excluded=SUMMARY_KEYS + RARE_LABELS)
    assert [tuple(r) for r in wide.collect()] == [("a", 0.5, 0.0), ("b", 0.0, 0.7)]
    overall = spark.createDataFrame([("m1", 0.5, None, 0.1, 0.2)], "model string, accuracy double, weighted_precision double, weighted_recall double, weighted_f1 double")
    assert tuple(overall_comparison(overall).first()) == ("m1", 0.5, 0.0, 0.1, 0.2)


def test_evaluation_against_a_stored_index(spark, tmp_path):
    train = [(i, f"GET /page{i % 5}", "web", "normal_log") for i in range(20)] + [(100 + i, f"nmap scan {i % 3}", "web", "service_scan") for i in range(9)]
    docs = spark.createDataFrame(train, "doc_id long, log string, source string, label string")
    append_documents(docs, f"{tmp_path}/ix", "train", pivots=6)
    held = spark.createDataFrame([(1, "GET /page3", "web", "normal_log"), (2, "nmap scan 1", "web-x", "service_scan"), (3, "!!", "web", "dirb")], "id long, log_message string, source string, label string")
    done = evaluate_knn(embed_queries(held, "id"), load_index(spark, f"{tmp_path}/ix"), load_pivots(spark, f"{tmp_path}/ix"), k=3)
    assert done.overall.first().accuracy == 1.0
    assert tuple(done.summary.first()) == (3, 2, 1)


DOCUMENT = "doc_id long, log string, source string, label string"


def test_empty_index_and_empty_first_batch(spark, tmp_path):
    path = f"{tmp_path}/ix"
    rows = spark.createDataFrame([(1, "GET /page3", "web")], ARRIVAL_SCHEMA)
    create_index(spark, path)
    assert [(r.predicted, r.status) for r in classify_batch(rows, path).collect()] == [(None, "no_match")]
    append_documents(spark.createDataFrame([], DOCUMENT), path, "nothing")
    append_documents(spark.createDataFrame([(7, "??", "web", "x")], DOCUMENT), path, "no-token")
    assert load_index(spark, path).count() == 0 and load_pivots(spark, path).count == 0
    append_documents(spark.createDataFrame([(8, "GET /page3", "web", "normal_log")], DOCUMENT), path, "one")
    assert [(r.predicted, r.status) for r in classify_batch(rows, path).collect()] == [("normal_log", "success")]
    more = [(100 + i, f"word{i} of {i % 9}", "web", "dirb") for i in range(60)]
    append_documents(spark.createDataFrame(more, DOCUMENT), path, "many", pivots=8)
    assert load_pivots(spark, path).count == 1  # the first batch had one document
    rebuild_index(spark, path, f"{tmp_path}/new", pivots=8)
    assert load_pivots(spark, f"{tmp_path}/new").count == 8 and load_index(spark, f"{tmp_path}/new").count() == 61


def test_a_source_that_looks_like_no_filter(spark, tmp_path):
    docs = [(i, f"GET /page{i}", "web", "normal_log") for i in range(5)]
    append_documents(spark.createDataFrame(docs, DOCUMENT), f"{tmp_path}/ix", "train", pivots=2)
    held = spark.createDataFrame([(1, "GET /page3", "*", "a"), (2, "GET /page3", "=web", "a"), (3, "GET /page3", None, "a")], "id long, log_message string, source string, label string")
    hits = retrieve(embed_queries(held, "id"), load_index(spark, f"{tmp_path}/ix"), load_pivots(spark, f"{tmp_path}/ix"), 3, relax=False)
    assert {r.qid for r in hits.collect()} == {3}


def test_approximate_search_reads_the_visited_cells(spark, tmp_path):
    docs = [(i, f"alpha{i % 11} beta{i % 7} gamma{i}", "web", "normal_log") for i in range(200)]
    append_documents(spark.createDataFrame(docs, DOCUMENT), f"{tmp_path}/ix", "train", pivots=8)
    index, pivots = load_index(spark, f"{tmp_path}/ix"), load_pivots(spark, f"{tmp_path}/ix")
    held = spark.createDataFrame([(1, "alpha3 beta2 gamma25", "web", "a")], "id long, log_message string, source string, label string")
    hits = knn.search(embed_queries(held, "id"), index, pivots, 3, probe=2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "embedding" in line and "cell#" in line]
    assert any("PartitionFilters: [cell" in line or "isnotnull(cell" in line or "cell#" in line.split("PartitionFilters: [")[1].split("]")[0] for line in filters)
    assert [r.doc_id for r in hits.where("rank = 1").collect()] == [25]


def test_stream_replay_leaves_one_copy(spark, tmp_path):
    train = [(i, f"GET /page{i % 5}", "web", "normal_log") for i in range(10)] + [(100 + i, f"nmap scan {i % 3}", "web", "service_scan") for i in range(9)]
    append_documents(spark.createDataFrame(train, "doc_id long, log string, source string, label string"), f"{tmp_path}/ix", "train", pivots=4)
    arriving = spark.createDataFrame([(500, "nmap scan 2", "web"), (501, "GET /page1", "web"), (502, "??", "web")], ARRIVAL_SCHEMA)
    arriving.write.parquet(f"{tmp_path}/in")

    def run(checkpoint):
        stream = spark.readStream.schema(ARRIVAL_SCHEMA).parquet(f"{tmp_path}/in")
        classify_stream(stream, f"{tmp_path}/ix", f"{tmp_path}/alerts", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
        return {(r.doc_id, r.label) for r in load_index(spark, f"{tmp_path}/ix").where("batch LIKE 'stream%'").collect()}

    expected = {(500, "service_scan"), (501, "normal_log")}
    assert run("first") == expected
    assert run("again") == expected  # a lost checkpoint replays batch 0 over its own folder
    assert load_index(spark, f"{tmp_path}/ix").count() == 21
    alerts = spark.read.parquet(f"{tmp_path}/alerts")
    assert [(r.qid, r.predicted) for r in alerts.collect()] == [(500, "service_scan")]


def stored_sources(spark, path, sources=12, each=40):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(sources):
        centre = rng.normal(size=8)
        for k in range(each):
            source = None if s == 11 and k % 2 else f"Host-{s}.net_{s}"
            rows.append((s * each + k, f"m{s}", source, f"l{s}", [float(x) for x in centre + 0.1 * rng.normal(size=8)]))
    schema = "doc_id long, log string, source string, label string, embedding array<float>"
    docs = spark.createDataFrame(rows, schema)
    append_documents(docs.where("doc_id % 2 = 0"), path, "even", pivots=12)
    append_documents(docs.where("doc_id % 2 = 1"), path, "odd", pivots=12)
    return rows


def test_a_filtered_search_reads_the_cells_of_its_terms_only(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = stored_sources(spark, path)
    listed = load_terms(spark, path)
    terms = spark.createDataFrame([("net_3",)], "term string")
    docs = load_documents_of(spark, path, listed, as_lookup(terms))
    wanted = {(r["batch"], r["cell"]) for r in listed.where("term = 'net_3'").collect()}
    text = docs._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", text) and re.search(r"PushedFilters: \[[^\]]*source", text)
    files = [r[0] for r in docs.select(F.input_file_name()).distinct().collect()]
    read = {(re.search("batch=([a-z]+)", f)[1], int(re.search("cell=([0-9]+)", f)[1])) for f in files}
    assert read == wanted and len(wanted) < load_index(spark, path).select("batch", "cell").distinct().count() / 3
    assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == [r[0] for r in rows if r[2] == "Host-3.net_3"]


@pytest.mark.parametrize("limits", [(100, 1000), (0, 0)])
@pytest.mark.parametrize("relax", [True, False])
def test_stored_and_plain_retrieval_agree(spark, tmp_path, monkeypatch, relax, limits):
    from vigilog.sources import vector_index

    monkeypatch.setattr(vector_index, "NAMED_BATCHES", limits[0])
    monkeypatch.setattr(vector_index, "NAMED_SOURCES", limits[1])
    path = str(tmp_path / "index")
    rows = stored_sources(spark, path)
    asked = [(1, "net_3"), (2, "x-net_4"), (3, "nowhere"), (4, "host")] + ([(5, None)] if limits[0] else [])
    queries = spark.createDataFrame([(q, s, rows[q * 37][4]) for q, s in asked], "qid long, source string, embedding array<float>")
    plain_hits = retrieve(queries, load_index(spark, path), load_pivots(spark, path), 5, relax=relax)
    hits = retrieve_stored(queries, path, 5, relax=relax)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, plain_hits.collect())) != []
    even = retrieve(queries, load_index(spark, path).where("batch <> 'odd'"), load_pivots(spark, path), 5, relax=relax)
    assert sorted(map(tuple, retrieve_stored(queries, path, 5, relax=relax, without="odd").collect())) == sorted(map(tuple, even.collect()))


def test_an_index_without_a_list_gets_one(spark, tmp_path):
    import shutil

    path = str(tmp_path / "index")
    rows = stored_sources(spark, path, sources=3)
    before = sorted(map(tuple, load_terms(spark, path).select("term", "source", "batch", "cell", "documents").collect()))
    shutil.rmtree(f"{path}/terms")
    assert sorted(map(tuple, load_terms(spark, path).select("term", "source", "batch", "cell", "documents").collect())) == before
    more = spark.createDataFrame([(999, "m", "late", "l", rows[0][4])], "doc_id long, log string, source string, label string, embedding array<float>")
    append_documents(more, path, "third")
    assert load_terms(spark, path).where("batch <> 'third'").count() == len(before) and load_terms(spark, path).count() == len(before) + 1
