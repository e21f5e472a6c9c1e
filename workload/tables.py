"""The given tables in the roles of the log data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.vectors import embed_hash, sign_code, unit
from vigilog.operators.knn import Pivots, build_index
from vigilog.operators.sampling import random_split
from vigilog.session import Scratch, materialize, spread

SEED = 42
PIVOTS = 16
EVAL_FRACTION = 0.2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, log_message, source, lang, label``; two languages stand for attacks, whose words neighbours share."""
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("lang") == "fr", "dirb").when(F.col("lang") == "es", "dns_scan").otherwise("normal_log")
    return (
        documents(spark, folder)
        .join(labels, "doc_id", "left")
        .select("doc_id", F.col("text").alias("log_message"), "source", "lang", label.alias("label"))
    )


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, source, line_no, value``: the lines of each text, numbered from 1."""
    return (
        table(spark, folder, "documents")
        .select("doc_id", "source", F.posexplode(F.split("text", "\n")))
        .select("doc_id", "source", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.col("col").alias("value"))
    )


def embedding_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, Pivots]:
    """``embeddings`` split 80/20: queries, index and its pivots."""
    rows = random_split(table(spark, folder, "embeddings"), "vec_id", EVAL_FRACTION, SEED)
    rows = rows.select("vec_id", unit("embedding").alias("embedding"), F.col("label").cast("string").alias("label"), "split")
    rows = materialize(rows, "units")
    queries = rows.where("split = 'eval'").select(F.col("vec_id").alias("qid"), "embedding", "label")
    docs = rows.where("split = 'train'").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return queries, *build_index(docs, PIVOTS, SEED)


def with_codes(df: DataFrame) -> DataFrame:
    return df.withColumn("code", sign_code("embedding"))


def document_sides(
    spark: SparkSession,
    folder: str,
    query_source: Column | None = None,
    index_source: Column | None = None,
) -> tuple[DataFrame, DataFrame, Pivots]:
    """Labelled documents split 80/20 and embedded: queries, index and its pivots."""
    rows = random_split(labelled_documents(spark, folder), "doc_id", EVAL_FRACTION, SEED)
    held_out = F.col("split") == "eval"
    source = F.when(held_out, F.col("source") if query_source is None else query_source).otherwise(
        F.col("source") if index_source is None else index_source
    )
    rows = rows.select("doc_id", "log_message", source.alias("source"), "label", "split", embed_hash("log_message").alias("embedding"))
    embedded = Scratch(spark)
    with embedded:
        rows = materialize(rows, "embedded")
    docs = rows.where("split = 'train'").select("doc_id", F.col("log_message").alias("log"), "source", "label", "embedding")
    index, pivots = build_index(docs, PIVOTS, SEED)
    queries = rows.where("split = 'eval'").select(F.col("doc_id").alias("qid"), "log_message", "source", "label", "embedding")
    queries = materialize(queries, "queries")
    embedded.close()  # both sides are written
    return queries, index, pivots
