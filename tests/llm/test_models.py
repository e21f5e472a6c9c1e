"""N-gram model, exact search, SentencePiece and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import DOCS, documents, edges, linked, lower, nothing, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

import corpus_pipeline
from vigilog.llm import elias_fano, lm_scoring, maxscore, sentencepiece_lattice
from vigilog.llm.common import held_out, materialize
from vigilog.llm.ngram_trie import KEY_BITS, Level, frequencies, pack_counts, quantised, unpack_counts
from vigilog.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# --- n-gram model --------------------------------------------------------------------------------


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 2**46 - 1), max_size=300), st.lists(st.integers(0, 2**46 - 1), max_size=20), st.sampled_from([46, 64]))
def test_sorted_numbers_are_found(values, others, bits):
    values = np.unique(np.array(values, np.uint64))
    found = elias_fano.EliasFano(elias_fano.encode(values, bits))
    assert found.all().tolist() == values.tolist()
    asked = np.array([*values.tolist(), *others], np.uint64)
    want = {v: k for k, v in enumerate(values.tolist())}
    assert found.find(asked).tolist() == [want.get(v, -1) for v in asked.tolist()]


@settings(deadline=None, max_examples=40)
@given(st.dictionaries(st.integers(0, 2**KEY_BITS - 1), st.integers(1, 10**7), max_size=200))
def test_levels_answer_with_quantised_frequencies(counts):
    keys = np.array(sorted(counts), np.uint64)
    level = Level(keys, np.array([counts[int(k)] for k in keys], np.int64))
    asked = np.unique(np.concatenate((keys, keys ^ np.uint64(1), keys ^ np.uint64(1 << 30))))
    got = frequencies(level.find(asked))
    for key, frequency in zip(asked.tolist(), got):
        true = counts.get(key, 0)
        assert frequency == true if true <= 64 else abs(frequency / true - 1) < 0.05


@given(st.lists(st.integers(0, 2**40), max_size=50))
def test_counts_survive_packing(counts):
    assert unpack_counts(pack_counts(np.array(counts, np.int64))).tolist() == counts


def plain_scores(texts: dict, learns: dict) -> dict:
    """The same model over dictionaries, with quantised frequencies."""
    tokens = {k: [*words(lower(t)), None] for k, t in texts.items()}
    grams = Counter()
    for k, t in tokens.items():
        if learns[k]:
            for n in (1, 2, 3):
                grams.update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    total = sum(c for g, c in grams.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in grams)
    heaps = math.log(types) / math.log(total) if types > 1 and total > 1 else 1.0

    def frequency(gram):
        return float(frequencies(quantised(np.array([grams[gram]])))[0]) if len(gram) > 1 else float(grams[gram])

    found = {}
    for k, t in tokens.items():
        base = score = 0.0
        for i, w in enumerate(t):
            chance = (grams[w,] + 1) / (total + types + 1)
            base += math.log10(chance)
            for n in (2, 3):
                if i >= n - 1 and grams[tuple(t[i - n + 1 : i])]:
                    context, own = frequency(tuple(t[i - n + 1 : i])), frequency(tuple(t[i - n + 1 : i + 1]))
                    strength = lm_scoring.PRIOR * context**heaps
                    chance = (own + strength * chance) / (max(context, own) + strength)
            score += math.log10(chance)
        found[k] = (len(t), sum(grams[w,] > 0 for w in t), total, base, score)
    return found


@pytest.mark.parametrize("chunk_bytes", [1 << 14, 1 << 24])
def test_scores_against_dictionaries(spark, chunk_bytes):
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    learns = {k: zlib.crc32(str(k).encode()) % 7 != 2 for k in texts}
    want = plain_scores(texts, learns)
    for r in lm_scoring.score_texts(docs, ~held_out(7, 2), chunk_bytes=chunk_bytes).collect():
        n, known, total, base, score = want[r.doc_id]
        assert (r.learned, r.n_tokens, r.n_known, r.train_tokens) == (learns[r.doc_id], n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)


def test_held_out_texts_score_better_than_by_words_alone(spark):
    rows = QUERIES["op1_elias_fano_trie"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and all(r.score <= 0 for r in rows)


def test_language_model_edges(spark):
    docs = edges(spark).withColumn("score", F.lit("mine"))
    rows = lm_scoring.score_texts(docs, F.col("doc_id") < 5).collect()
    assert len(rows) == docs.count()
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert sum(not r.learned for r in rows if r.doc_id is None) == 2
    untaught = lm_scoring.score_texts(docs, F.lit(False)).collect()
    assert all(r.base_score == r.score == 0 and r.train_tokens == 0 for r in untaught)
    assert lm_scoring.score_texts(nothing(spark), F.lit(True)).count() == 0


# --- exact search --------------------------------------------------------------------------------


@pytest.mark.parametrize("shard, queries, first, scale", [(7, 3, 2, 1), (8_192, 1_024, 512, 256), (50, 1, 4, 1)])
def test_search_with_ties_gaps_and_uneven_lengths(spark, monkeypatch, shard, queries, first, scale):
    for name, value in (("SHARD_ROWS", shard), ("QUERY_ROWS", queries), ("FIRST_ROWS", first), ("PROBED_AT_ONCE", 2)):
        monkeypatch.setattr(maxscore, name, value)
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(-2, 3, rng.integers(1, 9)).astype(float).tolist()) for k in range(120)]
    rows += [(200 + k, [1.0, -1.0, 2.0]) for k in range(20)]
    rows += [(300, None), (301, []), (302, [1.0, None]), (303, [float("nan")]), (304, [float("inf")]), (None, [1.0]), (60, [2.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("mine"))
    got = maxscore.search(vectors, F.col("vec_id") % 20 == 0, k=5, scale=scale).collect()
    fine = [(k, [math.floor(scale * x) for x in v]) for k, v in rows if k is not None and k not in range(300, 305)]
    want = set()
    for q, a in fine:
        if q % 20 == 0:
            every = sorted((-sum(x * y for x, y in zip(a, b)), k) for k, b in fine if k != q)
            want.update((q, k, -s) for s, k in every[:5]) if q != 60 else None
    assert want <= {(r.query_id, r.vec_id, r.score) for r in got}
    assert {r.query_id for r in got} == {q for q, _ in fine if q % 20 == 0}
    assert max(r["rank"] for r in got) == 5


def test_search_beyond_exact_doubles_and_nothing(spark):
    rows = [(0, [1e9, 3.0]), (1, [2e9 + 1, 1.0]), (2, [2e9 + 1, 2.0]), (3, [-1e18, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = maxscore.search(vectors, F.col("vec_id") == 0, k=9, scale=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2 * 10**18 + 10**9 + 6), (1, 2 * 10**18 + 10**9 + 3), (3, -(2**63 - 1))]
    assert maxscore.search(vectors.where("false"), F.col("vec_id") == 0, k=5).count() == 0
    assert maxscore.search(vectors.where("vec_id = 0"), F.col("vec_id") == 0, k=5).count() == 0


def test_query_parts_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 16)
    vectors = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2) - 0.5).alias("embedding"))
    found = maxscore.search(vectors, F.col("vec_id") % 2 == 0, k=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and found.count() == 300


@pytest.mark.parametrize(("most", "form"), [(127, "int8"), (-128, "int8"), (128, "int16"), (-32769, "int32"), (2.0**31, "float64")])
def test_weights_travel_in_the_narrowest_form(most, form):
    assert maxscore._narrowest(np.array([[0.0, most]])) == form and maxscore._narrowest(np.zeros((0, 0))) == "int8"


# --- SentencePiece -------------------------------------------------------------------------------


def more_texts(spark):
    rows = ["  two  blanks ", "\n\nlines\n \nend\n", "\ttabs and ▁ marks", "x" * 300 + " " + "ab" * 90, " " * 70 + "y", "<s> <unk> 字字 \U0001f600"]
    return edges(spark).unionByName(spark.createDataFrame([(100 + k, t, "", "", 0) for k, t in enumerate(rows)], DOCS))


def test_ids_are_those_of_the_library(spark):
    docs = more_texts(spark).unionByName(documents(spark)).withColumn("ids", F.lit("mine")).withColumn("row", F.monotonically_increasing_id())
    docs = materialize(docs, "texts")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = sentencepiece_lattice.Pieces.load(PIECES)
    encoded = materialize(sentencepiece_lattice.encode(docs, model, "row", chunk_bytes=1 << 17), "encoded")
    got = {r.row: r for r in encoded.collect()}
    back = {r.row: r.text for r in sentencepiece_lattice.decode(encoded, model, "row").collect()}
    for r in docs.collect():
        if r.text is None:
            assert got[r.row].ids is None and got[r.row].round_trip and back[r.row] is None
            continue
        assert got[r.row].ids == library.encode(r.text)
        if "▁" not in r.text:
            assert got[r.row].round_trip and back[r.row] == r.text
    assert sentencepiece_lattice.encode(nothing(spark), model).count() == 0


def test_requests_are_exchanged_once_and_texts_move_once(spark):
    encoded = sentencepiece_lattice.encode(documents(spark), sentencepiece_lattice.Pieces.load(PIECES), chunk_bytes=1 << 17)
    encoded.collect()
    plan = encoded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    with_texts = [line for line in plan.split("\n") if "Exchange hashpartitioning(chunk" in line]
    assert len(with_texts) == 2 and "requests" not in plan  # texts and answers, by chunk


def test_substrings_stop_at_the_longest_piece_that_can_begin_there(spark, monkeypatch):
    pieces = ["ab", "abcdef", "abcx", "b", "bc", "cde", "▁a"]
    words = ["abcdefgh", "abcxabcd", "▁abab", "xyz", "bc"]
    rows = spark.createDataFrame([(0, k, w) for k, w in enumerate(words)], "shard int, number int, word string")
    table = spark.createDataFrame([(p, -float(k)) for k, p in enumerate(pieces)], "piece string, score double")
    for shortest in (1, 2):
        got = sentencepiece_lattice.lattice(rows, table, 6, shortest)
        every = {(k, a, b) for k, w in enumerate(words) for a in range(len(w)) for b in range(a + shortest, len(w) + 1)}
        assert {(r.number, r.start, r.end) for r in got.collect()} == {
            (k, a, b) for k, a, b in every if words[k][a:b] in pieces or shortest == 1 and b - a == 1
        }
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "max(" in plan  # the longest piece with the same first characters


def test_the_model_is_read_once(spark, monkeypatch):
    loads, model = spark.sparkContext.accumulator(0), sentencepiece_lattice.Pieces.load(PIECES)
    plain_load = sentencepiece_lattice.Pieces.load

    def loading(path):
        loads.add(1)
        return plain_load(path)

    monkeypatch.setattr(sentencepiece_lattice.Pieces, "load", loading)
    docs = materialize(more_texts(spark), "texts")
    assert sentencepiece_lattice.encode(docs, model, chunk_bytes=1 << 17).count() == docs.count() and loads.value == 0


def test_best_paths_are_those_of_a_unigram_model(spark, tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as data:
        proto.ParseFromString(data.read())
    proto.trainer_spec.model_type = sentencepiece_lattice.UNIGRAM
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    model = sentencepiece_lattice.Pieces.load(str(path))

    def best(word):
        at = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            into = [(at[k][0] + model.scores[word[k:end]], -k) for k in range(max(0, end - 16), end) if word[k:end] in model.ids]
            at.append(max(into))
        found, end = [], len(word)
        while end:
            found, end = [model.ids[word[-at[end][1] : end]], *found], -at[end][1]
        return found

    texts = {r.doc_id: re.sub(r"\s+", " ", r.text[:400]).strip() for r in documents(spark).limit(60).collect()}
    texts = {k: t for k, t in texts.items() if all(c in model.ids for c in t if c != " ")}
    docs = materialize(spark.createDataFrame([(k, t, "", "", 0) for k, t in texts.items()], DOCS), "texts")
    got = {r.doc_id: r.ids for r in sentencepiece_lattice.encode(docs, model).collect()}
    assert texts and all(got[k] == [i for w in t.split(" ") for i in best("▁" + w)] for k, t in texts.items())


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = documents(spark).unionByName(edges(spark).withColumn("doc_id", F.col("doc_id") + 10_000))
    docs = materialize(docs.withColumn("kept", F.lit("mine")).withColumn("__hot", F.lit(1)), "start")
    columns, rows = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, FOLDER), "stage")
        assert after.columns == columns and 0 < after.count() <= docs.count(), name
        before = docs.collect()
        kept = after.collect()
        if name == "near duplicates":
            texts = {k: r.text for k, r in enumerate(before)}
            assert len(kept) == len(set(linked(texts).values()))
        if name != "personal data":
            assert Counter(kept) - Counter(before) == Counter()
        else:
            assert len(kept) == len(before) and any("[EMAIL]" in r.text for r in kept)
            assert all(r.n_chars == len(r.text) for r in kept)
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert len(rows) > docs.count()


def test_pipeline_of_nothing(spark):
    docs = nothing(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), "stage")
    assert docs.count() == 0


def test_pipeline_query(spark):
    rows = QUERIES and corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and all(r.length <= 1024 for r in rows)
