"""Every registered query against its SQL, and the entry module itself."""

import pytest

import __spark_entry__ as entry
from vigilog.operators import knn
from workload import queries
from workload.check import compare, connect
from workload.oracles import ORACLES
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name, column", [("knn_no_match", "status"), ("normal_dominance", "normal_not_dominant"), ("log_tree", "label"),
                                          ("path_source", "kept"), ("sidecar_long", "label")])
def test_both_outcomes_occur(spark, name, column):
    assert entry.queries()[name](spark, FOLDER).select(column).distinct().count() > 1


@pytest.mark.parametrize("name", ["knn_eval", "model_eval", "context_eval", "binary_report"])
def test_reports_have_hits_beside_the_normal_class(spark, name):
    rows = entry.queries()[name](spark, FOLDER).collect()
    assert any(r.recall > 0 for r in rows if r.label != "normal_log") and any(r.precision < 1 or r.recall < 1 for r in rows)


@pytest.mark.parametrize("name", ["alerts", "stream_alerts", "malformed_alerts", "coverage_missing"])
def test_no_query_is_empty(spark, name):
    assert not entry.queries()[name](spark, FOLDER).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["knn_exact", "knn_source_relax", "knn_quantized", "knn_rotated_bits", "knn_graph", "stratified_split", "coverage_missing", "prompt_context"])
def test_plan_has_no_pair_join(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(
    "name",
    ["knn_exact", "knn_ivf", "knn_quantized", "knn_rotated_bits", "knn_graph", "knn_source_relax", "knn_source_filter", "prompt_context", "stratified_split",
     "random_split", "downsample_preserve", "diverse_sample", "scan_lines"],
)
def test_query_agrees_when_everything_is_hot(spark, duck, tiny_limits, name):
    assert compare(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name]) is None


def test_recall_counts_no_query_with_too_few_hits(spark, monkeypatch):
    def one_hit(q, index, pivots, k, probe=None):
        return knn.search(q, index, pivots, 1 if probe else k, probe)

    monkeypatch.setattr(queries, "search", one_hit)
    assert not queries.knn_recall(spark, FOLDER).first().enough
