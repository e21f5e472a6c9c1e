"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.functions import labels as L
from vigilog.functions import prompts
from vigilog.functions.event_time import event_time
from vigilog.functions.responses import read_label_responses
from vigilog.functions.text import has_letter, is_log_path, relaxation_chain, source_of_path, source_tokens
from vigilog.functions.vectors import embed_hash, tokens
from vigilog.operators import counts, metrics, sampling, sinks
from vigilog.operators import vote as V
from vigilog.operators.knn import probe_for, search, search_quantized
from vigilog.operators.proximity import build_graph, search_graph
from vigilog.operators.retrieve import retrieve, retrieve_context, retrieve_stored, with_context
from vigilog.operators.rotated import frame, rotated_code, search_rotated
from vigilog.plans import evaluation
from vigilog.plans.ingestion import ingest
from vigilog.session import materialize, scratch_path
from vigilog.sources import logtree, tables, vector_index
from vigilog.streaming.classify import ARRIVAL_SCHEMA, classify_batch, classify_stream
from workload.models import alert_model, context_model, text_model
from workload.tables import (
    EVAL_FRACTION,
    PIVOTS,
    SEED,
    document_lines,
    documents,
    document_sides,
    embedding_sides,
    labelled_documents,
    table,
    with_codes,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K = 3
NPROBE = 4
RECALL = 0.9
OVERSAMPLE = 10
DIVERSE_SIZE = 100
DOCS_PER_FILE = 5_000
HEAD_LINES = 5
LOG_SPLITS = 400


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def hits_out(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "doc_id", "label", "score", F.col("rank").cast("bigint").alias("hit_rank"))


# --- sources -------------------------------------------------------------------------------------


@query
def scan_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Write the documents as a log tree, then scan, number and clean its lines."""
    root = f"{scratch_path(spark, 'tree')}/gather"
    lines = document_lines(spark, folder).withColumn("logs", F.floor(F.col("doc_id") / DOCS_PER_FILE))
    (
        lines.repartition("source", "logs")
        .sortWithinPartitions("source", "logs", "doc_id", "line_no")
        .select("value", "source", "logs")
        .write.partitionBy("source", "logs")
        .text(root)
    )
    numbered = logtree.number_lines(logtree.scan_lines(spark, root, "*.txt", logs_only=True))
    return logtree.clean_lines(numbered).select(
        F.regexp_replace(source_of_path("rel_path"), "^source=", "").alias("source"),
        F.regexp_extract("rel_path", "logs=([0-9]+)", 1).cast("bigint").alias("file_no"),
        "line_no",
        F.col("value").alias("log_message"),
    )


@query
def head_lines(spark: SparkSession, folder: str) -> DataFrame:
    """First physical lines of every document; blank ones count."""
    return logtree.clean_lines(document_lines(spark, folder), HEAD_LINES).select("doc_id", "line_no", "value")


@query
def letter_filter(spark: SparkSession, folder: str) -> DataFrame:
    return document_lines(spark, folder).where(has_letter("value")).select("doc_id", "line_no", "value")


@query
def sidecar_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label the lines from sidecar entries derived from them: lists, empty lists, repeats and bad lines."""
    lines = document_lines(spark, folder).withColumn("rel_path", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    digit = F.substring(F.md5(F.concat_ws("|", "doc_id", "line_no")), 1, 1)
    number = F.col("line_no").cast("string")
    entry = (
        F.when(digit <= "3", F.concat(F.lit('{"line": '), number, F.lit(', "labels": ["service_scan"], "rules": {"a": ["b"]}}')))
        .when(digit == "4", F.concat(F.lit('{"line": '), number, F.lit(', "labels": ["dnsteal", "attacker"]}')))
        .when(digit == "5", F.concat(F.lit('{"line": '), number, F.lit(', "labels": []}')))
        .when(digit == "6", F.lit("not json"))
        .when(digit == "7", F.concat(F.lit('{"line": '), number, F.lit("}")))
        .when(digit == "8", F.lit('{"labels": ["dirb"]}'))
    )
    again = F.when(digit == "0", F.concat(F.lit('{"line": '), number, F.lit(', "labels": ["dup"]}')))
    side = lines.select("rel_path", "line_no", F.posexplode(F.array(entry, again))).where(F.col("col").isNotNull())
    side = side.select("rel_path", (F.col("line_no") * 2 + F.col("pos")).alias("line_no"), F.col("col").alias("value"))
    labelled = logtree.attach_labels(lines, logtree.parse_sidecar(side))
    return labelled.select("doc_id", "line_no", "label")


@query
def sidecar_long(spark: SparkSession, folder: str) -> DataFrame:
    """All lines as one file, and two entries for each of them; where both name labels the later one wins."""
    number = (F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("line_no")
    lines = document_lines(spark, folder).select("doc_id", number, F.lit("one.log").alias("rel_path"))
    named = F.col("line_no").cast("string")
    first = F.concat(F.lit('{"line": '), named, F.lit(', "labels": ["dnsteal"]}'))
    later = F.when(F.col("line_no") % 2 == 1, F.concat(F.lit('{"line": '), named, F.lit(', "labels": ["dirb"]}'))).otherwise("[]")
    side = lines.select("rel_path", "line_no", F.posexplode(F.array(first, later)))
    side = side.select("rel_path", (F.col("line_no") * 2 + F.col("pos")).alias("line_no"), F.col("col").alias("value"))
    return logtree.attach_labels(lines, logtree.parse_sidecar(side)).select("doc_id", "line_no", "label")


def put_files(spark: SparkSession, lines: DataFrame, names: dict[str, str], root: str) -> None:
    """Each source's lines, in order, as one file of the given name below the root."""
    parts = scratch_path(spark, "parts")
    ordered = lines.repartition("source").sortWithinPartitions("source", "doc_id", "line_no")
    ordered.select("value", "source").write.partitionBy("source").text(parts)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(parts).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for source, name in names.items():  # one file each
        for found in files.globStatus(path(f"{parts}/source={source}/part-*")) or []:
            files.mkdirs(path(f"{root}/{name}").getParent())
            files.rename(found.getPath(), path(f"{root}/{name}"))


def split_bytes(spark: SparkSession, root: str) -> int:
    """Splits so small that files lie in several of them, and so large that a tree of any size makes about LOG_SPLITS."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max(32 << 10, files.getContentSummary(path).getLength() // LOG_SPLITS)


@query
def log_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a tree of log files, rotated ones, an attacker's, and a file that is no log, with sidecars."""
    base = scratch_path(spark, "log-tree")
    lines = document_lines(spark, folder).select("doc_id", "line_no", "source", F.regexp_replace("value", "\r", " ").alias("value"))
    sources = sorted(r.source for r in lines.select("source").distinct().collect())  # names of the test tables' sources
    kinds = ["{0}/logs/app.log", "{0}/logs/app.log.1", "{0}/logs/deep/b.log", "attacker_0/logs/{0}.log", "{0}/logs/notes.txt"]
    names = {s: kinds[int(s.removeprefix("src")) % len(kinds)].format(s) for s in sources}
    put_files(spark, lines, names, f"{base}/gather")
    entry = F.concat(F.lit('{"line": '), F.col("line_no").cast("string"), F.lit(', "labels": ["dnsteal"]}'))
    order = Window.partitionBy("source").orderBy("doc_id", "line_no")
    placed = lines.withColumn("line_no", F.row_number().over(order)).where("line_no % 7 = 0")
    put_files(spark, placed.select("doc_id", "line_no", "source", entry.alias("value")), names, f"{base}/labels")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes(spark, f"{base}/gather")))
    try:
        logs = materialize(logtree.labelled_logs(spark, f"{base}/gather", f"{base}/labels"), "labelled")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return logs.select("source", "line_no", F.md5("log_message").alias("message_md5"), "label")


@query
def path_source(spark: SparkSession, folder: str) -> DataFrame:
    url = F.regexp_replace("url", "^https?://", "")
    path = F.concat(F.lit("C:\\data\\gather\\"), F.regexp_replace(url, "/", "\\\\"))
    path = (
        F.when(F.col("page_id") % 5 == 0, F.concat(path, F.lit("\\attacker_1\\logs\\a.log")))
        .when((F.col("page_id") % 5 == 1) | F.contains("url", F.lit("/en/")), F.concat(path, F.lit("\\logs\\a.log")))
        .otherwise(path)
    )
    pages = table(spark, folder, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", source_of_path("path").alias("source"), is_log_path("path").alias("kept"))


@query
def event_times(spark: SparkSession, folder: str) -> DataFrame:
    """Event times written in each notation, and read back."""
    stamp = F.col("ts").cast("timestamp")
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.date_format(stamp, "MMM d HH:mm:ss"), F.lit(" host app: x")))
        .when(F.col("event_type") == "click", F.concat(F.lit("- ["), F.date_format(stamp, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0100] GET")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"timestamp"": '), F.unix_seconds(stamp).cast("string"), F.lit(".25}")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Feb 30 00:00:00 "), F.date_format(stamp, "HH:mm")))
        .otherwise("no time here")
    )
    events = table(spark, folder, "events").select("event_id", line.alias("line"))
    return events.select("event_id", F.unix_micros(event_time("line")).alias("epoch_micros"))


@query
def csv_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Lines written as a dataset file and read back; an empty label comes back missing."""
    lines = logtree.clean_lines(document_lines(spark, folder))
    label = F.when(F.length("value") > 40, "normal_log").otherwise("")
    path = scratch_path(spark, "dataset")
    tables.write_dataset(lines.select(F.col("value").alias("log_message"), "source", label.alias("label")), path)
    return tables.read_dataset(spark, path)


# --- dataset preparation -------------------------------------------------------------------------


@query
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = labelled_documents(spark, folder)

    def of(column: str) -> DataFrame:
        return counts.value_counts(docs, column).select(F.lit(column).alias("field"), F.col(column).alias("value"), "n")

    return of("label").unionByName(of("source"))


@query
def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.class_counts(labelled_documents(spark, folder))


@query
def distinct_sources(spark: SparkSession, folder: str) -> DataFrame:
    return counts.distinct_values(labelled_documents(spark, folder), "source")


@query
def seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    docs = labelled_documents(spark, folder)
    return sampling.shuffle_rows(docs, "doc_id", 73).select("doc_id", sampling.order_key(73, "doc_id").alias("order_key"))


@query
def preview(spark: SparkSession, folder: str) -> DataFrame:
    return labelled_documents(spark, folder).select("doc_id", "source", "label").orderBy("doc_id").limit(5)


@query
def random_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = labelled_documents(spark, folder)
    return sampling.random_split(docs, "doc_id", EVAL_FRACTION, SEED).select("doc_id", "split")


@query
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = labelled_documents(spark, folder)
    return sampling.stratified_split(docs, "doc_id", "label", EVAL_FRACTION, SEED).select("doc_id", "label", "split")


@query
def downsample_uniform(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.downsample_uniform(labelled_documents(spark, folder), "doc_id").select("doc_id", "source", "label")


@query
def downsample_preserve(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.downsample_preserving(labelled_documents(spark, folder), "doc_id").select("doc_id", "source", "label")


@query
def diverse_sample(spark: SparkSession, folder: str) -> DataFrame:
    sample = sampling.diverse_sample(labelled_documents(spark, folder), "doc_id", DIVERSE_SIZE)
    return sample.select("doc_id", "source", "label")


@query
def coverage_missing(spark: SparkSession, folder: str) -> DataFrame:
    """What a strong uniform downsampling of lines with digits loses, per source text."""
    docs = labelled_documents(spark, folder).withColumn("source", F.concat_ws("-", "source", "lang"))
    return counts.coverage_missing(docs, sampling.downsample_uniform(docs, "doc_id", 0.95))


@query
def split_files(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides of a split written, and read back side by side."""
    path = scratch_path(spark, "split")
    tables.write_split(sampling.stratified_split(labelled_documents(spark, folder), "doc_id", "label", EVAL_FRACTION, SEED), path)
    sides = [tables.read_split(spark, path, side) for side in ("train", "eval")]
    return sides[0].unionByName(sides[1]).select("doc_id", "label", "split")


@query
def downsample_files(spark: SparkSession, folder: str) -> DataFrame:
    """A down-sampled table as a dataset file, line breaks escaped, read back."""
    path = scratch_path(spark, "sample")
    sample = sampling.downsample_preserving(labelled_documents(spark, folder), "doc_id")
    tables.write_dataset(sample, path, line_breaks="escape")
    return tables.read_dataset(spark, path).select(F.md5("log_message").alias("message_md5"), "source", "label")


# --- vectors and retrieval -----------------------------------------------------------------------


@query
def hash_embed(spark: SparkSession, folder: str) -> DataFrame:
    """Non-zero entries of the document vectors."""
    vectors = documents(spark, folder).select("doc_id", embed_hash("text").alias("v"))
    entries = vectors.select("doc_id", F.posexplode("v"))
    return entries.where("col <> 0").select(
        "doc_id", F.col("pos").cast("bigint").alias("bucket"), F.round(F.col("col").cast("double"), 6).alias("weight")
    )


@query
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return docs.select(
        "doc_id",
        F.size(tokens("text")).cast("bigint").alias("n_tokens"),
        F.coalesce(F.size(F.filter(embed_hash("text"), lambda weight: weight > 0)), F.lit(0)).cast("bigint").alias("n_buckets"),
    )


@query
def source_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of indexed sources and the chain a query source is relaxed through."""
    name = F.concat(F.upper("lang"), F.lit("-"), F.col("source"), F.lit("_x.log"))
    docs = table(spark, folder, "documents").select("doc_id", name.alias("name"))
    return docs.select(
        "doc_id",
        F.array_join(source_tokens("name"), " ").alias("tokens"),
        F.array_join(relaxation_chain("name"), " > ", "*").alias("chain"),
    )


@query
def knn_exact(spark: SparkSession, folder: str) -> DataFrame:
    queries, index, pivots = embedding_sides(spark, folder)
    return hits_out(search(queries, index, pivots, K))


@query
def knn_ivf(spark: SparkSession, folder: str) -> DataFrame:
    queries, index, pivots = embedding_sides(spark, folder)
    return hits_out(search(queries, index, pivots, K, NPROBE))


@query
def knn_quantized(spark: SparkSession, folder: str) -> DataFrame:
    queries, index, pivots = embedding_sides(spark, folder)
    return hits_out(search_quantized(with_codes(queries), with_codes(index), pivots, K, NPROBE, OVERSAMPLE))


def share_found(exact: DataFrame, found: DataFrame) -> float:
    """The share of the exact hits that another search found too."""
    both = exact.join(found.withColumn("found", F.lit(True)), ["qid", "doc_id", "score"], "left")
    return both.agg(F.avg(F.coalesce("found", F.lit(False)).cast("double"))).first()[0] or 0.0


@query
def knn_rotated_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of each query by rotated sign bits with an error bound, and whether they hold nine in ten of all true neighbours."""
    queries, index, pivots = embedding_sides(spark, folder)
    exact = materialize(search(queries, index, pivots, K).select("qid", "doc_id", "score"), "exact")
    known = frame(pivots, SEED)
    coded = materialize(index.withColumn("code", rotated_code("embedding", "cell", known)), "codes")
    found = materialize(search_rotated(queries, coded, pivots, K, known).select("qid", "doc_id", "score"), "rotated")
    return found.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.lit(share_found(exact, found) >= RECALL).alias("enough"))


@query
def knn_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of each query by a walk over a proximity graph, and whether they hold nine in ten of all true neighbours."""
    queries, index, pivots = embedding_sides(spark, folder)
    exact = materialize(search(queries, index, pivots, K).select("qid", "doc_id", "score"), "exact")
    found = materialize(search_graph(queries, build_graph(index, seed=SEED), K).select("qid", "doc_id", "score"), "walked")
    return found.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.lit(share_found(exact, found) >= RECALL).alias("enough"))


@query
def knn_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of the exact search that the approximate one finds too, its probe chosen for nine in ten."""
    queries, index, pivots = document_sides(spark, folder)
    exact = materialize(search(queries, index, pivots, K).select("qid", "doc_id", "score"), "exact")
    probe = probe_for(queries, index, pivots, K, RECALL)
    found = search(queries, index, pivots, K, probe).groupBy("qid").agg(F.min("score").alias("near"), F.count(F.lit(1)).alias("n_found"))
    # documents alike score alike: a query's hits count if the approximate search offers as many at least as near
    worst = exact.groupBy("qid").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).join(found, "qid", "left")
    full = F.coalesce((F.col("n_found") >= F.col("n")) & (F.col("near") >= F.col("score")), F.lit(False))
    enough = F.avg(full.cast("double")) >= RECALL
    return worst.agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("hits"), enough.alias("enough"))


@query
def knn_no_match(spark: SparkSession, folder: str) -> DataFrame:
    """Queries of a source that the index lacks, and queries of an index that is still empty."""
    asked = F.when(F.col("lang") == "de", "*").otherwise(F.col("source"))
    queries, index, pivots = document_sides(spark, folder, asked)
    predicted = V.predict(queries, retrieve(queries, index, pivots, K, relax=False))
    path = scratch_path(spark, "empty-index")
    vector_index.create_index(spark, path)
    early = classify_batch(queries.select(F.col("qid").alias("log_id"), "log_message", "source"), path, K)
    return predicted.select("qid", "predicted", "status", F.lit("filled").alias("index")).unionByName(
        early.select("qid", "predicted", "status", F.lit("empty").alias("index"))
    )


@query
def ingest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A training table into a new index, and its rows per source."""
    return ingest(labelled_documents(spark, folder), "doc_id", scratch_path(spark, "ingested"), pivots=PIVOTS)


@query
def knn_source_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the query's own source token only; an unknown source finds nothing."""
    asked = F.when(F.col("lang") == "de", F.upper("source")).otherwise(F.col("source"))
    queries, index, pivots = document_sides(spark, folder, asked, F.concat(F.lit("Inet-"), F.col("source")))
    return hits_out(retrieve(queries, index, pivots, K, relax=False))


def stored(spark: SparkSession, index: DataFrame) -> str:
    """An index in two batches, one of them of normal lines."""
    path = scratch_path(spark, "index")
    docs = index.select("doc_id", F.lit(None).cast("string").alias("log"), "source", "label", "embedding")
    normal = F.coalesce(L.is_normal("label"), F.lit(False))
    vector_index.append_documents(docs.where(normal), path, "normal", pivots=PIVOTS)
    vector_index.append_documents(docs.where(~normal), path, "attacks", pivots=PIVOTS)
    return path


@query
def knn_stored_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stored index, of which the inverted list of source tokens names the parts to read."""
    asked = F.when(F.col("lang") == "de", F.upper("source")).otherwise(F.col("source"))
    queries, index, _ = document_sides(spark, folder, asked, F.concat(F.lit("Inet-"), F.col("source")))
    return hits_out(retrieve_stored(queries, stored(spark, index), K, relax=False))


@query
def index_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The inverted list of a stored index: documents of each source token in each batch."""
    index = document_sides(spark, folder, index_source=F.concat(F.lit("Inet-"), F.col("source")))[1]
    terms = vector_index.load_terms(spark, stored(spark, index))
    return terms.groupBy("term", "source", "batch").agg(F.sum("documents").alias("documents"))


def relaxed_sides(spark: SparkSession, folder: str):
    asked = (
        F.when(F.col("lang") == "en", F.concat(F.lit("web-"), F.col("source")))
        .when(F.col("lang") == "fr", F.concat(F.lit("a_"), F.col("source")))
        .when(F.col("lang") == "de", F.upper("source"))
    )
    indexed = F.when(F.col("lang") == "fr", F.concat(F.lit("Inet-"), F.col("source"))).otherwise(F.col("source"))
    return document_sides(spark, folder, asked, indexed)


@query
def knn_source_relax(spark: SparkSession, folder: str) -> DataFrame:
    """The source filter relaxed until documents exist, down to no filter; some documents have no label."""
    queries, index, pivots = relaxed_sides(spark, folder)
    index = index.withColumn("label", F.when(~F.col("source").endswith("src3"), F.col("label")))
    return hits_out(retrieve(queries, index, pivots, K))


@query
def knn_two_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Three neighbours searched, two returned."""
    return hits_out(retrieve(*document_sides(spark, folder), K, size=2))


@query
def index_append(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in an index: created once, appended in batches, one batch repeated."""
    path = scratch_path(spark, "index")
    docs = vector_index.document(labelled_documents(spark, folder), "doc_id")
    attacks = docs.where(~L.is_normal("label"))
    vector_index.create_index(spark, path)
    vector_index.append_documents(docs.where(L.is_normal("label")), path, "normal", pivots=PIVOTS)
    for _ in range(2):
        vector_index.append_documents(attacks, path, "attacks", pivots=PIVOTS)
    vector_index.create_index(spark, path)
    index = vector_index.load_index(spark, path)
    return index.select("doc_id", "source", "label", "batch", F.size("embedding").cast("bigint").alias("dim"), F.length("log").cast("bigint").alias("n_chars"))


# --- votes and reports ---------------------------------------------------------------------------


def embedding_hits(spark: SparkSession, folder: str, k: int = K) -> tuple[DataFrame, DataFrame]:
    queries, index, pivots = embedding_sides(spark, folder)
    return queries, search(queries, index, pivots, k)


@query
def knn_vote(spark: SparkSession, folder: str) -> DataFrame:
    queries, hits = embedding_hits(spark, folder)
    return V.predict(queries, hits).select("qid", "label", "predicted", "status")


@query
def vote_share(spark: SparkSession, folder: str) -> DataFrame:
    _, hits = embedding_hits(spark, folder)
    shares = V.vote_share(V.vote(hits))
    return shares.select("qid", "label", "votes", F.round("share", 6).alias("share"))


@query
def normal_dominance(spark: SparkSession, folder: str) -> DataFrame:
    hits = retrieve(*document_sides(spark, folder), K)
    return V.dominance(V.vote(hits))


@query
def k_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy for several k from one search."""
    queries, hits = embedding_hits(spark, folder, 7)
    each = V.winner(V.vote(V.sweep(hits, [3, 5, 7]), ["k", "qid"]), ["k", "qid"])
    scored = each.join(queries.select("qid", "label"), "qid")
    overall = metrics.overall_report(metrics.class_report(metrics.confusion(scored, ["k"]), ["k"]), ["k"])
    return overall.select(F.col("k").cast("bigint").alias("k"), F.round("accuracy", 6).alias("accuracy"), F.round("weighted_f1", 6).alias("weighted_f1"), "support")


def embedding_confusion(spark: SparkSession, folder: str) -> DataFrame:
    queries, hits = embedding_hits(spark, folder)
    return metrics.confusion(V.predict(queries, hits))


def rounded(df: DataFrame, *columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


@query
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_confusion(spark, folder)


@query
def confusion_dense(spark: SparkSession, folder: str) -> DataFrame:
    wide = metrics.confusion_matrix(materialize(embedding_confusion(spark, folder), "confusion"))
    return wide.select("label", *[F.col(c).alias(f"as_{c}") for c in wide.columns[1:]])


@query
def class_report(spark: SparkSession, folder: str) -> DataFrame:
    report = metrics.class_report(embedding_confusion(spark, folder))
    return report.select("label", *rounded(report, "precision", "recall", "f1"), "support")


OVERALL = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]


@query
def overall_report(spark: SparkSession, folder: str) -> DataFrame:
    overall = metrics.overall_report(metrics.class_report(embedding_confusion(spark, folder)))
    return overall.select(*rounded(overall, *OVERALL), "support")


@query
def report_file(spark: SparkSession, folder: str) -> DataFrame:
    """The report written as one JSON object and read back as a table."""
    report = metrics.class_report(materialize(embedding_confusion(spark, folder), "confusion"))
    path = scratch_path(spark, "report")
    sinks.write_report(report, metrics.overall_report(report), path)
    rows = tables.read_reports(spark, {"knn": f"{path}/json"})
    return rows.select("model", "key", *rounded(rows, "precision", "recall", "f1"), "support")


@query
def binary_report(spark: SparkSession, folder: str) -> DataFrame:
    """Normal against attack, both sides collapsed."""
    done = evaluation.evaluate_knn(*document_sides(spark, folder), k=K)
    collapsed = done.scored.withColumn("label", L.to_binary("label")).withColumn("predicted", L.to_binary("predicted"))
    report = metrics.class_report(metrics.confusion(collapsed))
    return report.select("label", *rounded(report, "precision", "recall", "f1"), "support")


@query
def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Text entries of the rows predicted as attacks."""
    done = evaluation.evaluate_knn(*document_sides(spark, folder), k=K)
    entries = sinks.alert_entries(done.scored.withColumn("explanation", F.concat(F.lit("voted by "), F.lit(str(K)))))
    return entries.select("qid", F.md5("entry").alias("entry_md5"))


@query
def vote_share_text(spark: SparkSession, folder: str) -> DataFrame:
    queries, index, pivots = document_sides(spark, folder)
    shares = V.vote_share(V.vote(retrieve(queries, index, pivots, K)))
    entries = sinks.share_entries(queries.select("qid", "log_message"), shares)
    return entries.select("qid", F.md5("entry").alias("entry_md5"))


# --- scoring models ------------------------------------------------------------------------------


def prompt_out(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.md5("system_prompt").alias("system_md5"), F.md5("user_prompt").alias("user_md5"))


@query
def prompt_direct(spark: SparkSession, folder: str) -> DataFrame:
    return prompt_out(prompts.direct_prompt(labelled_documents(spark, folder)), "doc_id")


@query
def prompt_binary(spark: SparkSession, folder: str) -> DataFrame:
    return prompt_out(prompts.binary_prompt(labelled_documents(spark, folder)), "doc_id")


@query
def prompt_closed(spark: SparkSession, folder: str) -> DataFrame:
    return prompt_out(prompts.direct_prompt(labelled_documents(spark, folder), closed=True), "doc_id")


@query
def prompt_binary_context(spark: SparkSession, folder: str) -> DataFrame:
    """Both forms that put the neighbours into the system text."""
    queries, index, pivots = document_sides(spark, folder)
    made = {"binary": lambda rows: prompts.binary_prompt(rows, with_context=True), "labelled": prompts.labelled_context_prompt}

    def both(rows: DataFrame) -> DataFrame:
        for form, prompt in made.items():
            texts = [F.md5("system_prompt").alias("system_md5"), F.md5("user_prompt").alias("user_md5")]
            rows = prompt(rows).withColumn(form, F.struct(*texts, F.lit(form).alias("form"))).drop("system_prompt", "user_prompt")
        return rows.select("qid", F.explode(F.array(*made)).alias("made")).select("qid", "made.*")

    return with_context(queries.drop("embedding"), retrieve(queries, index, pivots, K), index, both, "prompts")


@query
def prompt_context(spark: SparkSession, folder: str) -> DataFrame:
    queries, index, pivots = document_sides(spark, folder)
    context = retrieve_context(retrieve(queries, index, pivots, K), index)
    return prompt_out(prompts.context_prompt(queries.join(context, "qid", "left")), "qid")


def alert_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON alerts; those of small value lack the closing brace."""
    line = F.concat(
        F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "type": "'), F.col("event_type"),
        F.lit('", "props": '), F.col("props"), F.when(F.col("value") < 1, "").otherwise("}"),
    )
    return table(spark, folder, "events").select("event_id", line.alias("value"))


@query
def prompt_alert(spark: SparkSession, folder: str) -> DataFrame:
    good, _ = tables.split_alerts(alert_lines(spark, folder))
    return prompt_out(prompts.alert_prompt(good, "Judge the alert."), "event_id")


@query
def malformed_alerts(spark: SparkSession, folder: str) -> DataFrame:
    _, bad = tables.split_alerts(alert_lines(spark, folder))
    return bad.select("event_id", "value")


@query
def response_status(spark: SparkSession, folder: str) -> DataFrame:
    """Every kind of reply, built from the events, and the status it gets."""
    digit = F.substring(F.md5(F.col("event_id").cast("string")), 1, 1)
    label = F.col("event_type")
    good = F.to_json(F.struct(label.alias("label"), F.lit("why").alias("explanation")))
    content = (
        F.when(digit == "8", "nope")
        .when(digit == "9", '{"label": 5, "explanation": "x"}')
        .when(digit == "a", '{"label": "a"}')
        .when(digit == "c", F.concat(F.lit("  "), good, F.lit("  ")))
        .when(digit == "d", "[1]")
        .when(digit == "e", '{"label": "a", "explanation": null}')
        .when(digit == "f", '"text"')
        .otherwise(good)
    )
    envelope = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    body = (
        F.when(digit == "1", "oops")
        .when(digit == "3", "oops")
        .when(digit == "4", '{"choices": []}')
        .when(digit == "5", '{"id": 1}')
        .when(digit == "6", '{"choices": [{"message": {"content": null}}]}')
        .when(digit == "7", '{"choices": [{"message": {"content": 5}}]}')
        .when((digit != "0") & (digit != "2"), envelope)
    )
    replies = table(spark, folder, "events").select(
        "event_id",
        body.alias("raw_response"),
        F.when(digit == "1", 500).when(digit != "0", 200).cast("bigint").alias("http_status"),
        F.when(digit == "0", "TimeoutError").alias("error"),
        F.col("value").alias("seconds"),
    )
    return read_label_responses(replies).select("event_id", "status", "predicted", "explanation", "seconds")


@query
def strict_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels outside the domain, accepted or refused."""
    events = table(spark, folder, "events")
    label = F.when(F.col("event_type") == "error", "dirb").otherwise(F.col("event_type"))
    content = F.to_json(F.struct(label.alias("label"), F.lit("why").alias("explanation")))
    envelope = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    replies = events.select(
        "event_id", envelope.alias("raw_response"), F.lit(200).cast("bigint").alias("http_status"), F.lit(None).cast("string").alias("error")
    )
    strict = read_label_responses(replies, strict_labels=True)
    return strict.select("event_id", "status", "predicted")


@query
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = metrics.run_summary(response_status(spark, folder))
    return summary.select("attempted", "successful", "failed", F.round("avg_seconds", 6).alias("avg_seconds"))


@query
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.status_counts(response_status(spark, folder))


def model_run(spark: SparkSession, folder: str) -> evaluation.Evaluation:
    rows = sampling.random_split(labelled_documents(spark, folder), "doc_id", EVAL_FRACTION, SEED).where("split = 'eval'")
    rows = rows.select(F.col("doc_id").alias("qid"), "log_message", "source", "label")
    return evaluation.evaluate_model(rows, text_model, concurrency=1)


def context_run(spark: SparkSession, folder: str) -> evaluation.Evaluation:
    return evaluation.evaluate_with_context(*document_sides(spark, folder), context_model, k=K, concurrency=1)


def knn_run(spark: SparkSession, folder: str) -> evaluation.Evaluation:
    return evaluation.evaluate_knn(*document_sides(spark, folder), k=K)


@query
def knn_eval(spark: SparkSession, folder: str) -> DataFrame:
    report = knn_run(spark, folder).report
    return report.select("label", *rounded(report, "precision", "recall", "f1"), "support")


@query
def model_eval(spark: SparkSession, folder: str) -> DataFrame:
    report = model_run(spark, folder).report
    return report.select("label", *rounded(report, "precision", "recall", "f1"), "support")


@query
def context_eval(spark: SparkSession, folder: str) -> DataFrame:
    report = context_run(spark, folder).report
    return report.select("label", *rounded(report, "precision", "recall", "f1"), "support")


def three_models(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion counts of the three ways to classify, with a ``model`` column."""
    queries, index, pivots = document_sides(spark, folder)
    hits = materialize(retrieve(queries, index, pivots, K), "hits")  # one search for both that use neighbours
    runs = {
        "knn": evaluation.evaluate_knn(queries, index, pivots, k=K, hits=hits),
        "model": model_run(spark, folder),
        "model_context": evaluation.evaluate_with_context(queries, index, pivots, context_model, k=K, concurrency=1, hits=hits),
    }
    all_counts = None
    for name, run in runs.items():
        one = run.confusion.withColumn("model", F.lit(name))
        all_counts = one if all_counts is None else all_counts.unionByName(one)
    return all_counts


@query
def compare_models(spark: SparkSession, folder: str) -> DataFrame:
    report = metrics.class_report(three_models(spark, folder), ["model"])
    wide = metrics.compare_models(report, ["knn", "model", "model_context"], "f1")
    return wide.select("label", *rounded(wide, "knn", "model", "model_context"))


@query
def overall_compare(spark: SparkSession, folder: str) -> DataFrame:
    overall = metrics.overall_report(metrics.class_report(three_models(spark, folder), ["model"]), ["model"])
    rows = metrics.overall_comparison(overall)
    return rows.select("model", *rounded(rows, *rows.columns[1:]))


@query
def model_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.model_metrics(knn_run(spark, folder).report, excluded=["low"])
    return rows.select("label", *rounded(rows, "precision", "recall", "f1"))


def alert_results(spark: SparkSession, folder: str) -> DataFrame:
    good, _ = tables.split_alerts(alert_lines(spark, folder))
    return evaluation.reevaluate_alerts(good, alert_model, "Judge the alert.", "event_id", spark.sparkContext.defaultParallelism, concurrency=1)


@query
def alert_reeval(spark: SparkSession, folder: str) -> DataFrame:
    return alert_results(spark, folder).select("event_id", "status", "predicted", "explanation", "confidence")


@query
def alert_result_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON lines written for the alerts, read back field by field."""
    results = alert_results(spark, folder).withColumn("seconds", F.lit(0.5))
    path = scratch_path(spark, "results")
    sinks.write_entries(sinks.result_lines(results), path)
    line = F.try_parse_json("value")

    def text(field: str):
        return F.try_variant_get(line, f"$.{field}", "string").alias(field.split(".")[-1])

    return spark.read.text(path).select(
        F.try_variant_get(line, "$.original_alert.event_id", "bigint").alias("event_id"),
        text("status"),
        text("error"),
        F.try_variant_get(line, "$.status_code", "bigint").alias("status_code"),
        text("raw_response"),
        text("response_text"),
        text("llm_response.final_attack_label"),
        F.try_variant_get(line, "$.inference_time_sec", "double").alias("inference_time_sec"),
    )


# --- streaming -----------------------------------------------------------------------------------


def streamed(spark: SparkSession, folder: str) -> str:
    """The folder of a stream: held-out documents arrive in two waves; each is classified, then joins the index as predicted."""
    rows = sampling.random_split(labelled_documents(spark, folder), "doc_id", EVAL_FRACTION, SEED)
    base = scratch_path(spark, "stream")
    train = vector_index.document(rows.where("split = 'train'"), "doc_id")
    vector_index.append_documents(train, f"{base}/index", "train", pivots=PIVOTS)
    arriving = rows.where("split = 'eval'").select(F.col("doc_id").alias("log_id"), "log_message", "source", "lang")
    for wave in (F.col("lang") == "en", F.col("lang") != "en"):
        arriving.where(wave).drop("lang").write.mode("append").parquet(f"{base}/arrivals")
        stream = spark.readStream.schema(ARRIVAL_SCHEMA).parquet(f"{base}/arrivals")
        classify_stream(stream, f"{base}/index", f"{base}/alerts", f"{base}/checkpoint", K).trigger(
            availableNow=True
        ).start().awaitTermination()
    return base


@query
def stream_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """The index after the stream."""
    return vector_index.load_index(spark, f"{streamed(spark, folder)}/index").select("doc_id", "label", "batch")


@query
def stream_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts that the stream has written."""
    return spark.read.parquet(f"{streamed(spark, folder)}/alerts").select("qid", "predicted", "batch")
