"""What searches and evaluations with neighbours leave on disk: no prompts, a share of the texts at a time, no shuffles, no sides twice."""

import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from vigilog.functions.prompts import context_prompt
from vigilog.functions.vectors import embed_hash
from vigilog.operators import retrieve
from vigilog.operators.knn import build_index
from vigilog.operators.scoring import score_with
from vigilog.plans.evaluation import evaluate_with_context
from vigilog.session import materialize, scratch_root
from workload import queries, tables

FOLDER = "/root/testdata/sf0.001"


def sides(spark):
    """Every query is near one long text."""
    docs = [(0, "scan " * 4_000, "web", "dirb"), *[(i, f"page{i} get", "web", "normal_log") for i in range(1, 6)]]
    docs = spark.createDataFrame(docs, "doc_id long, log string, source string, label string").withColumn("embedding", embed_hash("log"))
    asked = [(i, f"scan page{i % 5}" if i % 7 else "!!", "web", "dirb") for i in range(40)]
    asked = spark.createDataFrame(asked, "qid long, log_message string, source string, label string")
    return asked.withColumn("embedding", embed_hash("log_message")), *build_index(docs, 2)


def scratch(spark):
    return set(glob.glob(scratch_root(spark).removeprefix("file://") + "/*"))


def test_shares_of_the_queries_have_the_contexts_of_all(spark, monkeypatch):
    asked, index, pivots = sides(spark)
    hits = materialize(retrieve.retrieve(asked, index, pivots, 2), "hits")
    expected = asked.join(retrieve.retrieve_context(hits, index), "qid", "left").select("qid", "context")
    monkeypatch.setattr(retrieve, "LEAST_BYTES", 1)
    monkeypatch.setattr(retrieve, "TEXTS_AT_ONCE", 8)
    fetched = []

    def use(rows):
        fetched.append(rows.select(F.sum(F.aggregate("context", F.lit(0), lambda n, h: n + F.length(h["log"])))).first()[0] or 0)
        return rows.select("qid", "context")

    found = retrieve.with_context(asked, hits, index, use, "contexts")
    texts = index.agg(F.sum(F.length("log"))).first()[0]
    assert sum(fetched) > 20 * texts and len(fetched) in (4, 5) and max(fetched) < 16 * texts
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and found.count() == 40


def test_answers_are_kept_without_prompts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(retrieve, "LEAST_BYTES", 400_000, raising=False)
    calls = f"{tmp_path}/calls"

    def open_model():
        def call(_system, user):
            with open(calls, "a") as f:
                f.write("x")
            content = json.dumps({"label": "dirb" if '"label":"dirb"' in user else "normal_log", "explanation": "e"})
            return 200, json.dumps({"choices": [{"message": {"content": content}}]})

        return call

    before = scratch(spark)
    done = evaluate_with_context(*sides(spark), open_model, k=2, concurrency=2)
    assert done.summary.first().successful == 40 and os.path.getsize(calls) == 40
    written = scratch(spark) - before
    assert written and not [p for p in written if "user_prompt" in spark.read.parquet(p).columns]
    predicted = {r.qid: r.predicted for r in done.scored.collect()}
    assert predicted == {i: "dirb" if i % 7 else "normal_log" for i in range(40)}


def test_a_result_can_do_without_columns(spark):
    rows = spark.createDataFrame([(1, "a", "s", "x")], "qid long, log_message string, source string, label string")
    rows = context_prompt(rows.withColumn("context", F.array().cast("array<string>")))
    scored = score_with(rows, lambda: lambda _s, user: (200, str(len(user))), "qid", without=["system_prompt", "user_prompt"])
    assert scored.columns == ["qid", "log_message", "source", "label", "context", "raw_response", "http_status", "error", "seconds"]
    assert scored.first().raw_response == str(len(rows.first().user_prompt))


def test_shuffles_go_when_their_result_is_written(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffled():
        return sum(len(glob.glob(f"{folder}/*/shuffle_*")) for folder in folders)

    before = shuffled()
    done = materialize(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "counted")
    for _ in range(50):  # they are removed in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and done.count() == 10


def test_sides_are_kept_once(spark):
    before = scratch(spark)
    asked, index, _ = tables.document_sides(spark, FOLDER)
    assert asked.count() + index.count() == tables.documents(spark, FOLDER).where("text rlike '[A-Za-z0-9]'").count() + asked.where("embedding IS NULL").count()
    kept = [p for p in scratch(spark) - before if {"embedding", "split"} <= set(spark.read.parquet(p).columns)]
    assert kept == []


def test_both_forms_of_the_prompt_keep_no_context(spark):
    before = scratch(spark)
    made = queries.prompt_binary_context(spark, FOLDER)
    assert {r.form for r in made.select("form").distinct().collect()} == {"binary", "labelled"}
    assert made.columns == ["qid", "system_md5", "user_md5", "form"]
    assert not [p for p in scratch(spark) - before if "context" in spark.read.parquet(p).columns]


@pytest.mark.parametrize("empty", ["queries", "index"])
def test_no_queries_or_no_documents(spark, empty):
    asked, index, pivots = sides(spark)
    hits = materialize(retrieve.retrieve(asked, index, pivots, 2), "hits")
    if empty == "queries":
        asked, hits = asked.limit(0), hits.limit(0)
    else:
        index, hits = index.limit(0), hits.limit(0)
    found = retrieve.with_context(asked, hits, index, lambda rows: rows.select("qid", "context"), "contexts")
    assert found.where("context IS NULL").count() == found.count() == (0 if empty == "queries" else 40)
