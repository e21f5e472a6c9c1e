"""Documents in, packed token sequences out: five stages, each written before the next one reads it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm import host_rules, langid, neardup, packing, pii
from vigilog.llm.common import beside, held_out, materialize, table
from vigilog.llm.queries import public_bpe
from vigilog.session import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Each stage's rows are texts and tokens of a model's own making, which SQL cannot state.
ORACLE_SQL = None


#: What the last stage's result still reads.
_left: list[Scratch] = []


def stage(function: Stage) -> Stage:
    """A stage's intermediates last until the next stage is called on other files: its result must have been written by then."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for scope in [s for s in _left if s.spark is spark and not s.is_read_by(docs)]:
            scope.close()
            _left.remove(scope)
        with Scratch(spark) as scope:
            _left.append(scope)
            return function(spark, docs, sf_dir)

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host is rejected, go.

    A null text has no words and goes; a null source has no host and is judged by its text only. Rows that repeat are judged
    each; an empty table gives no rows; a text of any length is judged whole.
    """
    judged = host_rules.host_rules(docs.select(F.struct("*").alias("__doc"), "text", "source"), carry=["__doc"])
    return judged.where("kept").select("__doc.*")


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go. Rows that repeat are judged each; an empty table gives no rows."""
    model = langid.fit_languages(docs, ~held_out(3, 1))
    found = langid.predict_languages(docs.select(F.struct("*").alias("__doc"), "text"), model)
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select("__doc.*")


@stage
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id stays, one row even where ids repeat or are null."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("at"))
    numbered = materialize(beside(docs, "__row").withColumn("__row", row), "numbered")
    gone = neardup.near_duplicates(numbered, "__row", "text").where(~F.col("kept")).select("__row")
    gone = materialize(gone, "copies")
    few = gone.count() <= neardup.BROADCAST_ROWS
    return numbered.join(F.broadcast(gone) if few else gone, "__row", "left_anti").select(*docs.columns)


@stage
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to marks; ``n_chars`` follows.

    A null text stays null, an empty one empty; all rows stay, repeated ones too; an empty table gives no rows.
    """
    spans = pii.find_spans(docs.select(F.struct("*").alias("__doc"), "text"), pii.fit_selector(docs))
    clean = F.when(F.col("text").isNotNull(), pii.redact(F.col("text"), F.col("spans")))
    done = spans.select(F.col("__doc").withField("text", clean).alias("__doc")).select("__doc.*")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row for each piece, with its ids.

    A null or empty text is one piece, its end token; rows that repeat are packed each; an empty table gives no rows.
    """
    return packing.pack(docs, public_bpe())


STAGES = [
    ("host rules", quality),
    ("language", language),
    ("near duplicates", deduplicate),
    ("personal data", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The result reads what the last stage has written."""
    docs, behind = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, apply in STAGES:
        written = Scratch(spark)
        done = apply(spark, docs, sf_dir)
        with written:
            docs = materialize(done, name.replace(" ", "-"))
        behind.close()
        behind = written
    for scope in [s for s in _left if s.spark is spark]:
        scope.close()
        _left.remove(scope)
    return docs
