"""From a log tree or a dataset to a split table and a filled index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from vigilog.functions.text import has_letter
from vigilog.functions.vectors import embed_hash
from vigilog.operators.counts import value_counts
from vigilog.operators.sampling import stratified_split
from vigilog.session import materialize
from vigilog.sources.logtree import labelled_logs, with_log_ids
from vigilog.sources.tables import require_columns, write_split
from vigilog.sources.vector_index import append_documents, document


def build_dataset(spark: SparkSession, gather: str, out: str, eval_fraction: float = 0.2, seed: int = 42) -> None:
    """Label a log tree, keep messages with a letter, split by class and write both sides."""
    logs = labelled_logs(spark, gather).where(has_letter("log_message"))
    rows = materialize(with_log_ids(logs), "logs")  # read three times by the split
    write_split(stratified_split(rows, "log_id", eval_fraction=eval_fraction, seed=seed), out)


def ingest(
    train: DataFrame,
    id_col: str,
    index_path: str,
    batch: str = "train",
    embedder: Callable[[str], Column] = embed_hash,
    pivots: int = 256,
) -> DataFrame:
    """Fill the index from a training table; returns its rows per source."""
    rows = document(require_columns(train), id_col)
    append_documents(rows, index_path, batch, embedder, pivots)
    return value_counts(rows, "source")
