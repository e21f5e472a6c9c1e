"""Periodic runs against a scan of all periods; resampling and ranks against plain sums and sorting."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import DOCS, edges, nothing, words

from vigilog.llm import queries, ranking, resampling
from vigilog.llm.periodic_runs import collapsed, greatest, periodic_runs, runs_of
from vigilog.llm.recompression import Grammar
from vigilog.llm.resampling import features_of, resample

FOLDER = "/root/testdata/sf0.001"


def plain_runs(w):
    least = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                least.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    return " ".join(x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs))


def made(rng, bits):
    w = []
    for _ in range(rng.randint(0, bits)):
        base = [b"w%d" % rng.randint(0, rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 30))]
        w += base * rng.choice([1, 1, 2, 3, 4, 9, 40])
        w = w[: len(w) - rng.randint(0, min(3, len(w)))]
    return w


@pytest.mark.parametrize("seed", range(20))
def test_runs_of_made_texts(seed):
    rng = random.Random(seed)
    texts = [made(rng, 8) for _ in range(12)]
    for w, runs in zip(texts, runs_of(texts)):
        found = [tuple(map(int, r)) for r in runs]
        assert found == plain_runs(w)
        assert collapsed(w, runs).decode() == plain_collapsed([x.decode() for x in w], found)


@pytest.mark.parametrize("seed", range(5))
def test_extensions_of_the_grammar(seed):
    rng = np.random.default_rng(seed)
    codes = np.concatenate([[9], np.tile(rng.integers(0, 3, 17), 20), np.zeros(90, np.int64), rng.integers(0, 2, 200), [8]])
    grammar = Grammar(codes, enough=4)
    a, b = rng.integers(1, len(codes) - 1, (2, 500))
    a, b = a[a != b], b[a != b]
    ahead, behind = grammar.after(a, b), grammar.before(a, b)
    for k, (x, y) in enumerate(zip(a, b)):
        n = next(n for n in range(len(codes)) if codes[x + n] != codes[y + n])
        m = next(m for m in range(len(codes)) if codes[x - 1 - m] != codes[y - 1 - m])
        assert (ahead[k], behind[k]) == (n, m)


def test_runs_do_not_cross_texts():
    assert [len(r) for r in runs_of([[b"a"] * 20, [b"a"] * 20, [b"a"] * 24, []])] == [0, 0, 1, 0]


def test_run_query_agrees_with_plain_python(spark):
    got = {r["doc_id"]: r for r in queries.op11_recompression_runs(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        w, h = words(d["text"]), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, r = plain_runs(w), got[d["doc_id"]]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
    assert sum(r["n_runs"] > 0 for r in got.values()) > 5


def test_runs_of_edge_rows(spark):
    docs = edges(spark).withColumnRenamed("lang", "runs")  # a name of the operator's own
    rows = periodic_runs(docs).collect()
    assert len(rows) == edges(spark).count() and all(r["collapsed"] is not None for r in rows)
    assert {r["n_words"] for r in rows if not (r["text"] or "").strip()} == {0}
    assert periodic_runs(nothing(spark)).count() == 0
    repeated = spark.createDataFrame([(1, "a b " * 30 + "c"), (1, "a b " * 30 + "c"), (None, "É x y")], "doc_id long, text string")
    rows = sorted(periodic_runs(repeated).withColumn("top", greatest("runs")).collect(), key=lambda r: r["n_words"])
    assert rows[0]["runs"] == [] and rows[0]["top"] is None and rows[0]["n_words"] == 2
    assert rows[1]["collapsed"] == "a b c" and tuple(rows[1]["top"]) == (0, 60, 2) and rows[1] == rows[2]


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain_features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_checksums_of_features():
    texts = ["", "One", "one TWO", "é字\U0001f600 `x` a.b\x85c 9", "w" * 1000 + " " + "q" * 65 + " z", "a b c " * 40]
    got = {k: [] for k in range(len(texts))}
    for _, buckets, owners in features_of([t.encode() for t in texts], resampling._shifts()):
        for bucket, owner in zip(buckets, owners):
            got[owner].append(int(bucket))
    for k, text in enumerate(texts):
        assert sorted(got[k]) == sorted(zlib.crc32(f.encode()) % 10_000 for f in plain_features(text)[1])


def plain_resample(docs, target):
    counts = [[0] * 10_000, [0] * 10_000]
    for held, texts in zip(counts, ([t for _, t in docs], target)):
        for text in texts:
            for f in plain_features(text)[1]:
                held[zlib.crc32(f.encode()) % 10_000] += 1
    (s, t), (ss, tt) = counts, map(sum, counts)
    gain = [math.floor(1000 * math.log((y + 1) * (ss + 10_000) / ((x + 1) * (tt + 10_000)))) for x, y in zip(s, t)]
    rows = []
    for key, text in docs:
        w, found = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found)
        rows.append((key, len(w), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = long[: 5 * len(long) // 100]
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in long[len(drawn) :]] + [(*r, None) for r in rows if r[1] < 20], key=str)


def test_resampling_query_agrees_with_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = [tuple(r) for r in queries.op12_regular_sampling(spark, FOLDER).collect()]
    assert sorted(got, key=str) == sorted([(r[0], *r[2:]) for r in plain_resample(docs, target)], key=str)


def test_resampling_of_edge_rows(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(15, 60)))) for k in range(200)]
    rows += [(7, rows[7][1])] * 30 + [(None, rows[9][1]), (None, None), (300, ""), (301, "..."), (302, "x " * 50_000)]
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id long, text string, rank string, extra long")
    target = spark.createDataFrame([(None,), ("aaa bbb",)], "text string")
    got = resample(docs, target)
    assert got.columns == ["doc_id", "extra", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted([tuple(r) for r in got.drop("extra").collect()], key=str) == plain_resample(rows, [None, "aaa bbb"])
    assert resample(nothing(spark), target).count() == 0
    none = resample(docs, spark.createDataFrame([], "text string")).drop("extra").collect()
    assert sorted(map(tuple, none), key=str) == plain_resample(rows, [])


@pytest.mark.parametrize("fetched", [1_000_000, 20])
@pytest.mark.parametrize("most", [None, 0, 1, 700, 5000])
def test_ranks(spark, monkeypatch, most, fetched):
    monkeypatch.setattr(ranking, "SAMPLES_FETCHED", fetched)
    rng = random.Random(1)
    rows = [(rng.choice([5, 5, 5, rng.randint(-50, 50), None]), rng.choice([1, rng.randint(0, 9), None]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "score long, tie long, extra int").repartition(5)
    got = ranking.ranked(df, "score", "tie", most).collect()
    assert len(got) == 3000
    some = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in some] == list(range(1, min(3000, 3000 if most is None else most) + 1))
    order = sorted(((-(2**63) if s is None else s, 2**63 if t is None else t) for s, t, _ in rows), key=lambda x: (-x[0], x[1]))
    assert [(-(2**63) if r["score"] is None else r["score"], 2**63 if r["tie"] is None else r["tie"]) for r in some] == order[: len(some)]


def test_ranks_of_nothing(spark):
    assert ranking.ranked(spark.createDataFrame([], "score long, tie long"), "score", "tie", 5).count() == 0
    assert DOCS["doc_id"].dataType.simpleString() == "bigint"
