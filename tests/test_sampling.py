import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilog.operators import sampling
from vigilog.operators.counts import class_counts, coverage_missing, value_counts
from vigilog.operators.joins import salted_join


def table(spark, normal=30, attack=9, sources=4):
    rows = [(i, "normal_log", f"s{i % sources}") for i in range(normal)]
    rows += [(normal + i, "dirb" if i % 3 else "wpscan", f"s{i % 2}") for i in range(attack)]
    return spark.createDataFrame(rows, "id long, label string, source string")


def in_order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


def ids(df):
    return {r.id for r in df.select("id").collect()}


def test_random_split_is_an_exact_partition(spark):
    split = sampling.random_split(table(spark), "id", 0.2)
    held = ids(split.where("split = 'eval'"))
    assert held == set(in_order(range(39))[: math.ceil(0.2 * 39)])
    assert split.count() == 39


@pytest.mark.parametrize("sizes, expected", [((504, 3027, 449), (101, 605, 90)), ((1, 1, 1), (0, 0, 1)), ((10, 10), (2, 2)), ((5,), (1,))])
def test_class_quotas(spark, sizes, expected):
    rows = [(f"c{c}",) for c, n in enumerate(sizes) for _ in range(n)]
    quotas = sampling.eval_quotas(spark.createDataFrame(rows, "label string"), "label", 0.2)
    found = {r.label: r.quota for r in quotas.collect()}
    assert sum(found.values()) == math.ceil(0.2 * sum(sizes))
    if sizes != (1, 1, 1):
        assert tuple(found[f"c{c}"] for c in range(len(sizes))) == expected


def test_stratified_split(spark):
    split = sampling.stratified_split(table(spark, 100, 21), "id")
    sizes = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert sizes[("normal_log", "eval")] in (20, 21) and sum(n for (_, s), n in sizes.items() if s == "eval") == 25
    assert split.count() == 121


def test_missing_labels_form_a_class(spark):
    rows = [(i, None if i < 10 else "a") for i in range(20)]
    split = sampling.stratified_split(spark.createDataFrame(rows, "id long, label string"), "id")
    assert split.where("label IS NULL AND split = 'eval'").count() == 2


def test_uniform_downsampling(spark):
    kept = sampling.downsample_uniform(table(spark), "id", 0.8)
    assert ids(kept) == set(range(30, 39)) | set(in_order(range(30))[24:])


@pytest.mark.parametrize("fraction", [0.5, 0.95, 1.0, 0.0])
def test_preserving_downsampling(spark, fraction):
    kept = sampling.downsample_preserving(table(spark), "id", fraction)
    normal = kept.where("label = 'normal_log'")
    assert normal.count() == max(int(30 * (1 - fraction)), 4)
    assert normal.select("source").distinct().count() == 4
    assert kept.count() - normal.count() == 9
    assert coverage_missing(table(spark), kept).count() == 0


def test_downsampling_without_normal_rows(spark):
    only = table(spark).where("label <> 'normal_log'")
    assert sampling.downsample_preserving(only, "id").count() == sampling.downsample_uniform(only, "id").count() == 9


@pytest.mark.parametrize("size", [1, 3, 8, 20, 39, 100])
def test_diverse_sample(spark, size):
    full = table(spark)
    sample = sampling.diverse_sample(full, "id", size)
    groups = full.select("label", "source").distinct().count()
    assert sample.count() == min(size, 39)
    assert sample.select("label", "source").distinct().count() == min(size, groups)


def test_diverse_sample_covers_every_group(spark):
    full = table(spark)
    sample = sampling.diverse_sample(full, "id", 10)
    assert full.select("label", "source").distinct().exceptAll(sample.select("label", "source").distinct()).count() == 0


def test_shuffle_keeps_all_rows(spark):
    shuffled = [r.id for r in sampling.shuffle_rows(table(spark), "id", 73).collect()]
    assert shuffled == in_order(range(39), 73)


def test_counts(spark):
    counted = [(r.source, r.n) for r in value_counts(table(spark), "source").collect()]
    assert counted == sorted(counted, key=lambda x: (-x[1], x[0])) and sum(n for _, n in counted) == 39
    assert tuple(class_counts(table(spark)).first()) == (39, 30, 9)


def test_coverage_reports_both_kinds(spark):
    full = table(spark)
    sample = full.where("NOT (source = 's3') AND NOT (source = 's1' AND label = 'normal_log')")
    assert {tuple(r) for r in coverage_missing(full, sample).collect()} == {("s3", "any"), ("s3", "normal"), ("s1", "normal")}


def test_limits_do_not_change_samples(spark, tiny_limits):
    kept = sampling.downsample_preserving(table(spark), "id", 0.5)
    assert kept.where("label = 'normal_log'").count() == 15 and kept.count() == 24
    assert sampling.stratified_split(table(spark), "id").where("split = 'eval'").count() == 8


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=40), hot=st.integers(1, 6))
def test_salted_join_is_a_join(spark, keys, hot):
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k string")
    named = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "k string, v long")
    for how in ("inner", "left"):
        found = {tuple(r) for r in salted_join(rows, named, ["k"], ["id"], how, hot).select("id", "k", "v").collect()}
        expected = {tuple(r) for r in rows.join(named, "k", how).select("id", "k", "v").collect()}
        assert found == expected


def test_salted_join_spreads_a_hot_key(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    named = rows.select("k").distinct().withColumn("v", F.lit(1))
    joined = salted_join(rows, named.hint("merge"), ["k"], ["id"], hot_rows=100)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in plan and joined.count() == 1000
