"""End-to-end evaluations: predictions, run summary and report for each way of classifying."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.labels import to_binary
from vigilog.functions.prompts import alert_prompt, binary_prompt, context_prompt, direct_prompt
from vigilog.functions.responses import read_alert_responses, read_label_responses
from vigilog.functions.vectors import embed_hash
from vigilog.operators.knn import Pivots
from vigilog.operators.metrics import class_report, confusion, overall_report, run_summary
from vigilog.operators.retrieve import retrieve, with_context
from vigilog.operators.scoring import Call, score_with
from vigilog.operators.vote import predict
from vigilog.session import materialize


PROMPTS = ["system_prompt", "user_prompt"]


@dataclass(frozen=True)
class Evaluation:
    """Scored rows (written once) and the tables derived from them."""

    scored: DataFrame

    @property
    def summary(self) -> DataFrame:
        return run_summary(self.scored)

    @property
    def confusion(self) -> DataFrame:
        """Failed rows have no prediction and stay out; the summary counts them."""
        return confusion(self.scored)

    @property
    def report(self) -> DataFrame:
        return class_report(self.confusion)

    @property
    def overall(self) -> DataFrame:
        return overall_report(self.report)


def embed_queries(rows: DataFrame, id_col: str, embedder: Callable[[str], Column] = embed_hash) -> DataFrame:
    """Held-out rows as queries, embedded once and written: the search reads their vectors several times."""
    queries = rows.select(F.col(id_col).alias("qid"), "log_message", "source", "label")
    return materialize(queries.withColumn("embedding", embedder("log_message")), "queries")


def evaluate_knn(
    queries: DataFrame,
    index: DataFrame,
    pivots: Pivots,
    k: int = 3,
    size: int | None = None,
    probe: int | None = None,
    hits: DataFrame | None = None,
) -> Evaluation:
    """Source-filtered neighbours vote; ``hits`` may come from an earlier search."""
    hits = retrieve(queries, index, pivots, k, size, probe) if hits is None else hits
    return Evaluation(materialize(predict(queries.drop("embedding"), hits), "scored"))


def evaluate_model(
    rows: DataFrame,
    open_model: Callable[[], Call],
    id_col: str = "qid",
    strict_labels: bool = False,
    binary: bool = False,
    partitions: int | None = None,
    concurrency: int = 50,
) -> Evaluation:
    """A model reads each row on its own."""
    prompted = binary_prompt(rows) if binary else direct_prompt(rows, closed=strict_labels)
    answered = materialize(score_with(prompted, open_model, id_col, partitions, concurrency, PROMPTS), "answers")
    return _read(answered, strict_labels, binary)


def evaluate_with_context(
    queries: DataFrame,
    index: DataFrame,
    pivots: Pivots,
    open_model: Callable[[], Call],
    k: int = 3,
    size: int | None = None,
    probe: int | None = None,
    strict_labels: bool = False,
    binary: bool = False,
    partitions: int | None = None,
    concurrency: int = 400,
    hits: DataFrame | None = None,
) -> Evaluation:
    """A model reads each row together with its labelled neighbours; ``hits`` may come from an earlier search."""
    hits = retrieve(queries, index, pivots, k, size, probe) if hits is None else hits

    def answers(rows: DataFrame) -> DataFrame:
        prompted = (binary_prompt(rows, with_context=True) if binary else context_prompt(rows)).drop("context")
        return score_with(prompted, open_model, "qid", partitions, concurrency, PROMPTS)

    return _read(with_context(queries.drop("embedding"), hits, index, answers, "answers"), strict_labels, binary)


def _read(answered: DataFrame, strict_labels: bool, binary: bool) -> Evaluation:
    scored = read_label_responses(answered, strict_labels)
    if binary:  # both sides collapse, so that they can be compared
        scored = scored.withColumn("predicted", to_binary("predicted")).withColumn("label", to_binary("label"))
    return Evaluation(scored)


def reevaluate_alerts(
    alerts: DataFrame,
    open_model: Callable[[], Call],
    system_prompt: str,
    id_col: str,
    partitions: int | None = None,
    concurrency: int = 200,
) -> DataFrame:
    """A model reads each alert (``alert``, JSON text); every alert comes back with a status."""
    prompted = alert_prompt(alerts, system_prompt)
    answered = materialize(score_with(prompted, open_model, id_col, partitions, concurrency), "answers")
    return read_alert_responses(answered).drop("system_prompt", "user_prompt")
