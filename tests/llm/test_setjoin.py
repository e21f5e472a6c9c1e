"""Joins on shingle sets against all pairs, their bounds, and how their work grows with a group of near copies."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from helpers import edge_rows, edges, lower, nothing, words

from vigilog.llm import neardup, prefix_join, setjoin, strings
from vigilog.llm.neardup import near_duplicates
from vigilog.llm.prefix_join import _meets, jaccard_join, least_common, prefix_of

VOCABULARY = [f"v{k}" for k in range(4000)]


def plain(rows, size, percent):
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[find(k)] = min(least.get(find(k), key), key)
    return sorted(((key, len(s), least.get(find(k)) if s else key) for k, ((key, _), s) in enumerate(zip(rows, sets))), key=str)


def found(df):
    return sorted(((r[0], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def variants(rng, base, copies, share):
    """Copies of a text with a share of its words replaced, each elsewhere."""
    made = []
    for _ in range(copies):
        w = list(base)
        for k in rng.sample(range(len(w)), round(len(w) * share * rng.random() * 2)):
            w[k] = rng.choice(VOCABULARY)
        made.append(" ".join(w))
    return made


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for share in (0.005, 0.01, 0.02, 0.03, 0.05, 0.1):
        texts += variants(rng, rng.choices(VOCABULARY, k=rng.choice([9, 40, 150])), 25, share)
    passage = rng.choices(VOCABULARY, k=60)
    texts += [" ".join(rng.choices(VOCABULARY, k=40) + passage) for _ in range(20)]
    texts += texts[:10] + ["One two", "one TWO", "one", None, "", " \n"]
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("unit", [256, 4])
def test_join_agrees_with_all_pairs(spark, monkeypatch, seed, unit):
    monkeypatch.setattr(setjoin, "UNIT", unit)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard_join(docs)) == plain(rows, 3, 90)


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_agree_with_all_pairs(spark, seed):
    rows = corpus(seed)
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows, 5, 75)


@pytest.mark.parametrize("join, size, percent", [(jaccard_join, 3, 90), (near_duplicates, 5, 75)])
def test_edge_rows(spark, join, size, percent):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert found(join(edges(spark).withColumnRenamed("lang", "cid").withColumnRenamed("source", "kept"))) == plain(rows, size, percent)
    assert join(nothing(spark)).count() == 0
    none = spark.createDataFrame([(None, "a b c d e f")] * 3, "doc_id long, text string")
    assert found(join(none)) == [(None, 7 - size, None)] * 3


@pytest.mark.parametrize("percent", [75, 90])
def test_bounds_hide_no_link(percent):
    rng = np.random.default_rng(percent)
    links = 0
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        new = np.unique(rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 4) + 1))).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) > rng.random() * 0.2], new)))
        if not len(b):
            continue
        common = len(np.intersect1d(a, b))
        link = 100 * common >= percent * (len(a) + len(b) - common)
        allowed = setjoin.may_link((np.array([len(a)]), np.array([len(b)])), ([setjoin.parities(a, 2)], [setjoin.parities(b, 4)]), percent)[0][0]
        assert allowed or not link
        links += link
        if percent == 90:
            counts = rng.integers(1, 50, prefix_join.SLOTS)
            prefixes = [prefix_of(s, counts) for s in (a, b)]
            assert all(1 <= m <= min(prefix_join.MOST_MATCHES, least_common(len(s))) and len(p) == len(s) - least_common(len(s)) + m
                       for s, (p, m) in zip((a, b), prefixes))
            table = pa.table({
                "tokens": pa.array([p.view(np.int64) for p, _ in prefixes], pa.list_(pa.int64())),
                "matches": [m for _, m in prefixes], "n": [len(a), len(b)],
            })
            assert not link or _meets(table, np.array([0]), np.array([1]))[0]
    assert links > 50


def test_costly_prefixes_are_longer():
    rng = np.random.default_rng(1)
    tokens = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    rare, frequent = np.ones(prefix_join.SLOTS, np.int64), np.full(prefix_join.SLOTS, 3)
    frequent[(tokens % np.uint64(prefix_join.SLOTS)).astype(np.int64)] = 2000
    assert prefix_of(tokens, rare)[1] == 1 and prefix_of(tokens, frequent)[1] == prefix_join.MOST_MATCHES


@pytest.mark.parametrize("percent, each", [(75, 4), (90, 2)])
def test_coarse_parities_hide_no_link_and_tell_unrelated_sets_apart(percent, each):
    rng = np.random.default_rng(percent)
    for n in (1, 20, 400, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        others = [np.unique(np.concatenate((a[k:], rng.integers(0, 2**63, k).astype(np.uint64)))) for k in {0, n // 50, n // 20, n // 10, n // 8, n}]
        bits = [setjoin.coarser(setjoin.parities(x, each)) for x in (a, *others)]
        assert all(len(x) <= max(8, each * n // 16) for x in bits)
        for b, held in zip(others, bits[1:]):
            common = len(np.intersect1d(a, b))
            link = 100 * common >= percent * (len(a) + len(b) - common)
            allowed = setjoin.may_link((np.array([len(a)]), np.array([len(b)])), ([bits[0]], [held]), percent)[0][0]
            assert allowed or not link
            assert not allowed or common or n < 400
    assert setjoin.coarser(None) is None


def test_unrelated_classes_that_share_lists_are_not_fetched(spark, monkeypatch):
    # each two texts share a passage, so that they share tokens of their prefixes and have sizes that allow a link
    rng, n, rows = random.Random(6), 16, []
    shared = {(i, j): " ".join(rng.choices(VOCABULARY, k=60)) for i in range(n) for j in range(i)}
    for k in range(n):
        mine = [text for pair, text in shared.items() if k in pair]
        rng.shuffle(mine)
        rows.append((k, " ".join(mine)))
    seen, plain_materialize = {}, setjoin.materialize

    def counting(df, name, *rest):
        made = plain_materialize(df, name, *rest)
        seen[name] = seen.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(setjoin, "materialize", counting)
    assert found(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows, 3, 90)
    assert seen["lists"] >= n and seen["fetched"] == 0, seen


def verified_pairs(monkeypatch):
    counts = []
    plain_verified = setjoin.verified

    def counting(pairs, *rest):
        counts.append(pairs.select("a", "b").distinct().count())
        return plain_verified(pairs, *rest)

    for module in (neardup, prefix_join):
        monkeypatch.setattr(module, "verified", counting)
    return counts


@pytest.mark.parametrize("join, share", [(near_duplicates, 0.045), (jaccard_join, 0.02)])
def test_verified_pairs_are_a_few_for_each_text(spark, monkeypatch, join, share):
    rng, counts = random.Random(4), verified_pairs(monkeypatch)
    texts = variants(rng, rng.choices(VOCABULARY, k=120), 5000, share)
    assert join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 5000
    assert sum(counts) <= 4 * 5000, counts


@pytest.mark.parametrize("join", [near_duplicates, jaccard_join])
def test_many_near_copies_under_one_key(spark, monkeypatch, join):
    rng = random.Random(5)
    texts = variants(rng, rng.choices(VOCABULARY, k=100), 2000, 0.004)
    docs = spark.createDataFrame([(7, t) for t in texts] + [(None, t) for t in texts[:500]], "doc_id long, text string")
    seen, plain_texts = [], setjoin.texts_of

    def counting(*args):
        made = plain_texts(*args)
        seen.append(made.count())
        return made

    monkeypatch.setattr(setjoin, "texts_of", counting)
    assert {r["component_id"] for r in join(docs).collect()} == {7}
    assert max(seen) <= 2600


def test_intermediates_go(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    done = jaccard_join(spark.createDataFrame(corpus(0), "doc_id long, text string"))
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and done.count() == len(corpus(0))


def test_only_the_result_of_the_pipeline_is_left(spark):
    import os

    import corpus_pipeline

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    done = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("packing") and done.count() > 0


def test_texts_are_taken_a_little_at_a_time():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(VOCABULARY, k=700)) if k % 9 else None for k in range(1_500)] + ["long " * 200_000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = [part.column(1).to_pylist() for part in setjoin.in_parts(batch, 1)]
    assert [t for part in parts for t in part] == texts
    assert all(len(part) == 1 or sum(len(t or "") for t in part) <= setjoin.TEXT_AT_ONCE for part in parts)
    strings._powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    tracemalloc.start()
    for part in setjoin.in_parts(batch.slice(0, 1_500), 1):
        setjoin.shingle_sets(part.column(1).to_pylist(), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
