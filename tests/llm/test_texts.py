"""Language, near duplicates and quality: held-out accuracy, and comparison with brute force."""

import random
import zlib

import numpy as np
import pytest
from helpers import DOCS, PROSE, documents, edges, linked, nothing, shingles
from pyspark.sql import functions as F

from vigilog.llm import crf, langid, neardup, setjoin
from vigilog.llm.common import held_out
from vigilog.llm.graph import components
from vigilog.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def area_under_curve(scores, labels):
    rank = np.argsort(np.argsort(scores)) + 1
    positive = labels.sum()
    return (rank[labels == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(labels) - positive))


# --- language ------------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in documents(spark, LARGER).collect()}
    rows = QUERIES["op4_word_backoff"](spark, LARGER).collect()
    assert {r.doc_id for r in rows} == set(langs)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in unseen) >= 0.98 * len(unseen)


def test_unseen_words_fall_back_to_their_letters(spark):
    docs = spark.createDataFrame(
        [(1, "nation station nation station", "aa", "s", 0), (2, "gruppe suppe gruppe suppe", "bb", "s", 0), (3, "never used", None, "s", 0)], DOCS
    )
    model = langid.fit_languages(docs, F.lit(True))
    assert model.languages == ["aa", "bb"]
    asked = spark.createDataFrame([(1, "citation", "", "", 0), (2, "puppe!", "", "", 0), (3, "12 .", "", "", 0)], DOCS)
    got = {r.doc_id: r for r in langid.predict_languages(asked.drop("lang"), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["aa", "bb", "und"] and got[3].score == 0


def test_language_edges(spark):
    docs = edges(spark).withColumn("score", F.lit("mine")).withColumn("Lang_Pred", F.lit(1))
    model = langid.fit_languages(docs, F.lit(True))
    rows = langid.predict_languages(docs, model).collect()
    assert len(rows) == docs.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    empty = langid.fit_languages(nothing(spark), F.lit(True))
    assert {r.lang_pred for r in langid.predict_languages(docs, empty).collect()} == {"und"}
    assert langid.predict_languages(nothing(spark), model).count() == 0


# --- near duplicates -----------------------------------------------------------------------------


def copies(seed: int, n: int, changed: int) -> dict[int, str]:
    """Texts with groups of exact and near copies, some of them chained, and one passage in many of them."""
    draw = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(4_000)]
    passage = " ".join(draw.choices(vocabulary, k=60))
    texts: dict[int, str] = {}
    for k in range(n):
        kind = draw.random()
        if texts and kind < 0.5:
            words = texts[draw.choice(list(texts))].split(" ")
            for _ in range(draw.randint(0, changed)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            texts[k] = " ".join(words)
        else:
            words = draw.choices(vocabulary, k=draw.randint(3, 150))
            texts[k] = " ".join(words) + (" " + passage if kind > 0.8 else "")
    return texts


@pytest.mark.parametrize("seed, changed, unit", [(1, 4, 256), (2, 9, 3)])
def test_components_against_all_pairs(spark, monkeypatch, seed, changed, unit):
    monkeypatch.setattr(setjoin, "UNIT", unit)
    texts = copies(seed, 400, changed)
    docs = spark.createDataFrame([(k, t.upper() if k % 3 == 0 else t, "en", "s", 0) for k, t in texts.items()], DOCS)
    want = linked(texts)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(texts[k])) and r.kept == (want[k] == k) for k, r in got.items())
    assert sum(not r.kept for r in got.values()) > 60


def test_one_large_group(spark):
    draw = random.Random(7)
    base = [f"b{k}" for k in range(80)]
    texts = {}
    for k in range(600):
        words = list(base)
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(80)] = f"x{draw.random()}"
        texts[k] = " ".join(words)
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], DOCS)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == linked(texts)


def test_near_duplicate_edges(spark):
    docs = edges(spark).withColumn("kept", F.lit("mine"))
    rows = neardup.near_duplicates(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count()
    assert [by[k].n_shingles for k in (0, 1, 2, 5, 6)] == [0, 0, 0, 1, 1]
    assert all(by[k].component_id == k and by[k].kept for k in (0, 1, 2, 5, 6))
    same = [r for r in rows if r.n_shingles == len(shingles(PROSE))]
    assert {r.component_id for r in same} == {3} and sum(r.kept for r in same) == 3  # the row 3, three times
    assert by[9].component_id == 3  # one word more
    assert neardup.near_duplicates(nothing(spark)).count() == 0


def test_long_paths_are_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}


# --- quality -------------------------------------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = QUERIES["op9_line_field"](spark, LARGER).collect()
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    unseen = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    scores, marks = np.array([s for s, _ in unseen]), np.array([q for _, q in unseen])
    assert area_under_curve(scores, marks) > 0.97


def test_marginals_against_all_label_sequences():
    rng = np.random.default_rng(0)
    firsts = np.array([0, 3, 3, 4, 9])
    rows = rng.normal(size=(9, 4))
    field = crf.Field(rng.normal(size=4), rng.normal(size=(2, 2)))
    good, joint, at = crf.marginals(field, rows, firsts, pairwise=True)
    expected = np.zeros((2, 2))
    for a, b in zip(firsts, firsts[1:]):
        n = b - a
        if not n:
            continue
        total, each, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            score = sum(rows[a + k] @ field.weights * y[k] for k in range(n)) + sum(field.pairs[y[k], y[k + 1]] for k in range(n - 1))
            p = np.exp(score)
            total += p
            each += p * np.array(y)
            for k in range(n - 1):
                pairs[y[k], y[k + 1]] += p
        assert np.allclose(good[a:b], each / total)
        expected += pairs / total
    assert np.allclose(joint, expected) and list(at) == [1, 2, 5, 6, 7, 8]


def test_neighbours_stop_at_documents():
    rows = np.arange(1, 5, dtype=np.float32)[:, None] * np.ones(crf.WIDTH, np.float32)
    found = crf.with_neighbours(rows, np.array([0, 2, 2, 4]))
    assert found[:, crf.WIDTH].tolist() == [0, 1, 0, 3] and found[:, 2 * crf.WIDTH].tolist() == [2, 0, 4, 0]


def test_quality_edges(spark):
    docs = edges(spark).withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(3, 1), (5, 0), (7, 1), (8, 0), (8, 0), (None, 1), (4, None)], "doc_id long, quality int")
    field = crf.fit_quality(docs, labels, ~held_out(1000, 999))
    rows = crf.score_quality(docs, field).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({round(r.score, 9) for r in rows if not r.text}) == 1
    assert crf.fit_quality(docs, labels.where("quality = 1"), F.lit(True)) is None
    assert {r.score for r in crf.score_quality(docs, None).collect()} == {0.5}
    assert crf.score_quality(nothing(spark), field).count() == 0


def late_lines(spark):
    """Documents that differ after their first 64 lines only, and their labels."""
    good, bad = "the birds sing in the old trees.", "### $$$ ||| !!! ###"
    texts = [[good] * 64 + [good if k % 2 else bad] * 200 for k in range(40)]
    docs = spark.createDataFrame([(k, "\n".join(t), "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    return docs, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")


def test_lines_after_the_64th_teach(spark):
    docs, labels = late_lines(spark)
    scores = {r.doc_id: r.score for r in crf.score_quality(docs, crf.fit_quality(docs, labels, F.lit(True))).collect()}
    assert all(scores[k] > 0.9 if k % 2 else scores[k] < 0.1 for k in scores)


def test_field_of_sums_made_in_tasks(spark, monkeypatch):
    docs, labels = late_lines(spark)
    monkeypatch.setattr(crf, "STEPS", 3)
    here = crf.fit_quality(docs, labels, F.lit(True))
    monkeypatch.setattr(crf, "LOCAL_LINES", 0)
    apart = crf.fit_quality(docs, labels, F.lit(True))
    assert np.allclose(here.weights, apart.weights) and np.allclose(here.pairs, apart.pairs)
    assert np.isclose(here.slope, apart.slope) and np.isclose(here.offset, apart.offset)
