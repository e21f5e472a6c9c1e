"""Classifying logs as they arrive, and feeding the predictions back into the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vigilog.functions.labels import is_alert
from vigilog.functions.vectors import embed_hash
from vigilog.operators.retrieve import retrieve_stored
from vigilog.operators.vote import predict
from vigilog.session import materialize
from vigilog.sources.vector_index import append_documents, document

ARRIVAL_SCHEMA = "log_id bigint, log_message string, source string"


def classify_batch(
    rows: DataFrame,
    index_path: str,
    k: int = 3,
    probe: int | None = None,
    embedder: Callable[[str], Column] = embed_hash,
    before: str | None = None,
) -> DataFrame:
    """Predict a batch from the index as it stands; ``before`` leaves out the batch of that name.

    The rows keep their vectors, so that they can be indexed without embedding them again.
    """
    queries = materialize(
        rows.select(F.col("log_id").alias("qid"), "log_message", "source").withColumn("embedding", embedder("log_message")),
        "arrivals",
    )
    hits = retrieve_stored(queries, index_path, k, probe=probe, without=before)
    return predict(queries, hits)


def classify_stream(
    arrivals: DataFrame,
    index_path: str,
    alert_path: str,
    checkpoint: str,
    k: int = 3,
    probe: int | None = None,
    feedback: bool = True,
    embedder: Callable[[str], Column] = embed_hash,
) -> DataStreamWriter:
    """A stream that writes alerts and, with feedback, appends each batch under its predicted labels.

    A micro-batch sees the index without itself. Its alerts and its documents are folders named after
    it, which a replay replaces, so a restarted query leaves the same index. Rows of one batch do not
    see each other.
    """

    def handle(batch: DataFrame, number: int) -> None:
        name = f"stream-{number}"
        scored = materialize(classify_batch(batch, index_path, k, probe, embedder, name), "scored")
        alerts = scored.where(F.col("predicted").isNotNull() & is_alert("predicted"))
        alerts.drop("embedding").write.mode("overwrite").parquet(f"{alert_path}/batch={name}")
        if feedback:
            known = scored.where(F.col("predicted").isNotNull()).drop("label").withColumnRenamed("predicted", "label")
            append_documents(document(known, "qid"), index_path, name)

    return arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
