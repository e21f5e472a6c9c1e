"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm import (
    crf, host_rules, langid, lm_scoring, maxscore, neardup, packing, periodic_runs, pii, prefix_join, resampling,
    sentencepiece_lattice, sharding,
)
from vigilog.llm.common import crc_of_id, held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 40
WORDS = r"[^\x20\x09-\x0D]+"


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def public_bpe() -> Callable[[], packing.Encode]:
    import public_tokenizers

    path = public_tokenizers.path
    return packing.byte_bpe(path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query
def op1_elias_fano_trie(spark: SparkSession, folder: str) -> DataFrame:
    scored = lm_scoring.score_texts(table(spark, folder, "documents"), ~held_out(7, 2))
    return scored.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op2_candidate_trees(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    spans = pii.find_spans(docs, pii.fit_selector(docs))
    return spans.select(
        "doc_id",
        *[f"n_{k}" for k in pii.KINDS],
        F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@query
def op3_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    return maxscore.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op3_maxscore"] = """
WITH numbered AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
    FROM numbered q JOIN numbered d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


@query
def op4_word_backoff(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.fit_languages(docs, ~held_out(3, 1))
    found = langid.predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


@query
def op5_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def _alike_sql(size: int, percent: int) -> str:
    """Components of documents whose sets of shingles of ``size`` words have a Jaccard of ``percent`` or more."""
    return f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN shingles USING (doc_id) GROUP BY d.doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""


ORACLES["op5_circulant_minhash"] = _alike_sql(5, 75)


@query
def op6_sentencepiece_lattice(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = sentencepiece_lattice.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = sentencepiece_lattice.encode(table(spark, folder, "documents"), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.crc32(listed.cast("binary")).alias("ids_crc32"), "round_trip"
    )


@query
def op7_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.shard_rows(docs, SHARDS).select(
        "doc_id",
        sharding.row_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    judged = host_rules.host_rules(docs, carry=["doc_id"])
    return judged.select("doc_id", *host_rules.COUNTS, "base_failed", "kept")


_RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "n_symbols * 2 > n_words",
    "dup_lines": "n_dup_lines * 5 > n_words",
    "long_words": "word_chars > 25 * n_words",
}
_HOSTS = " UNION ALL ".join(
    f"SELECT source, '{name}' AS rule, count(*) AS n, count(*) FILTER ({rule}) AS f FROM counted WHERE source IS NOT NULL GROUP BY source"
    for name, rule in _RULES.items()
)
ORACLES["op8_host_rules"] = f"""
WITH worded AS (
    SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) > 4)),
repeated AS (
    SELECT doc_id, count(DISTINCT i + d) AS n
    FROM (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1), (SELECT unnest([0, 1, 2, 3, 4]) AS d)
    GROUP BY doc_id),
lined AS (SELECT doc_id, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{WORDS}')] AS l FROM worded),
counted AS (
    SELECT doc_id, source, len(w) AS n_words, coalesce(list_sum([len(x) FOR x IN w]), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words
    FROM worded JOIN lined USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
hosts AS ({_HOSTS}),
spread AS (
    SELECT rule, m, sum(n * (f / n - m) ** 2) / sum(n) AS v
    FROM hosts JOIN (SELECT rule, sum(f) / sum(n) AS m FROM hosts GROUP BY rule) USING (rule) GROUP BY rule, m),
prior AS (
    SELECT rule, m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1e6 END, 10.0), 1e6) AS strength FROM spread),
rejected AS (
    SELECT source FROM hosts JOIN prior USING (rule) GROUP BY source HAVING max((f + m * strength) / (n + strength)) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(source NOT IN (SELECT source FROM rejected), true) AS kept
FROM counted
"""


@query
def op9_line_field(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    field = crf.fit_quality(docs, table(spark, folder, "labels"), ~held_out(5, 0))
    scored = crf.score_quality(docs, field)
    predicted = (F.col("score") >= crf.CUT).cast("int")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", predicted.alias("predicted"))


@query
def op10_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents").select("doc_id", "text"), public_bpe())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def _made_periodic(docs: DataFrame) -> DataFrame:
    """Texts whose id's checksum is a multiple of ten go on periodically from a word and with a period that it names."""
    words = docs.select("doc_id", "text", host_rules.words_of(F.coalesce("text", F.lit(""))).alias("w"), crc_of_id().alias("h"))
    g, n = F.floor(F.col("h") / 10).cast("long"), F.size("w").cast("long")
    placed = words.withColumn("g", g).withColumn("n", n).withColumn("a", F.col("g") % F.greatest("n", F.lit(1)))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    rest = F.col("n") - F.col("a")
    period = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    again = F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int")))
    made = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(again, F.lit(1), rest.cast("int")))
    planted = (F.col("h") % 10 == 0) & (F.col("n") > 0)
    return placed.select("doc_id", F.when(planted, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


@query
def op11_recompression_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _made_periodic(table(spark, folder, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs).withColumn("top", periodic_runs.greatest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_regular_sampling(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("text")
    return resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


# the checksum of a feature's bytes, from a table of the polynomial's 256 remainders
_REMAINDERS = "[list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END) FOR k IN range(256)]"
ORACLES["op12_regular_sampling"] = f"""
WITH sums AS MATERIALIZED (SELECT {_REMAINDERS} AS remainder),
worded AS (
    SELECT is_doc, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT true AS is_doc, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark)),
listed AS (
    SELECT is_doc, id, array_to_string(w[i:i + n - 1], ' ') AS f
    FROM (SELECT is_doc, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3]) AS n))),
counted AS (SELECT is_doc, id, f, count(*) AS c FROM listed GROUP BY ALL),
hashed AS MATERIALIZED (
    SELECT f, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(0, len(hex(encode(f))), 2), lambda i: ('0x' || substr(hex(encode(f)), i + 1, 2))::BIGINT)),
        lambda crc, b: xor(crc >> 8, remainder[xor(crc, b) % 256 + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM counted), sums),
held AS (
    SELECT bucket, coalesce(sum(c) FILTER (is_doc), 0) AS s, coalesce(sum(c) FILTER (NOT is_doc), 0) AS t
    FROM counted JOIN hashed USING (f) GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
        / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM held),
weights AS (SELECT id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE is_doc GROUP BY id),
scored AS (
    SELECT id AS doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM worded LEFT JOIN weights USING (id) WHERE is_doc),
ranks AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 5 * count(*) OVER () // 100 AS k FROM scored WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= k THEN r END AS rank FROM scored LEFT JOIN ranks USING (doc_id)
"""


@query
def op13_adaptive_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_join.jaccard_join(table(spark, folder, "documents"))


ORACLES["op13_adaptive_prefixes"] = _alike_sql(3, 90)
