"""Text, JSON-lines and report outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.labels import is_alert

# Rules between the entries of the text outputs, their layout, and the error texts.
HEAVY_RULE = "#" * 80
LIGHT_RULE = "-" * 80


def alert_entries(scored: DataFrame) -> DataFrame:
    """One text entry per row whose predicted label raises an alert."""
    entry = F.format_string(
        "Log query: %s\nLabel: %s\nExplanation: %s\n" + HEAVY_RULE, F.col("log_message"), F.col("predicted"), F.col("explanation")
    )
    return scored.where(F.col("predicted").isNotNull() & is_alert("predicted")).withColumn("entry", entry)


def share_entries(queries: DataFrame, shares: DataFrame) -> DataFrame:
    """One text entry per query: its text and the vote share of each label, in the order first met."""
    line = F.format_string("Label: %s, Score: %.2f%%\n" + LIGHT_RULE, F.col("label"), F.col("share"))
    lines = (
        shares.where(F.col("share").isNotNull())
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct("first_rank", line.alias("line")))).alias("__lines"))  # labels of one query
        .select("qid", F.array_join(F.transform("__lines", lambda x: x["line"]), "\n").alias("__body"))
    )
    head = F.concat(F.lit(HEAVY_RULE + "\nLog query: "), F.col("log_message"), F.lit("\n" + HEAVY_RULE + "\n"))
    return queries.join(lines, "qid").withColumn("entry", F.concat(head, F.col("__body"))).drop("__body")


def write_entries(entries: DataFrame, path: str) -> None:
    entries.select("entry").write.mode("overwrite").text(path)


def result_lines(results: DataFrame) -> DataFrame:
    """One JSON line per scored alert, success or failure; fields a status does not have are left out."""
    status = F.col("status")
    kept = F.struct(
        F.try_parse_json("alert").alias("original_alert"),
        F.try_parse_json("llm_response").alias("llm_response"),
        _error_text(status).alias("error"),
        F.when(status.isin("format_error", "api_error"), F.col("http_status")).alias("status_code"),
        F.when(status.isin("json_error", "validation_error"), F.col("content")).alias("raw_response"),
        F.when(status == "api_error", F.col("raw_response")).alias("response_text"),
        status.alias("status"),
        F.col("seconds").alias("inference_time_sec"),
    )
    return results.withColumn("entry", F.to_json(kept))


def _error_text(status: Column) -> Column:
    return (
        F.when(status == "format_error", "Unexpected LLM response format")
        .when(status == "json_error", F.concat(F.lit("JSONDecodeError: "), "detail"))
        .when(status == "validation_error", F.concat(F.lit("ValidationError: "), "detail"))
        .when(status == "api_error", "LLM API request failed")
        .when(status == "unknown_error", "Unknown processing error")
        .when(status == "processing_error", F.coalesce("error", "detail"))
    )


def report_json(report: DataFrame, overall: DataFrame) -> DataFrame:
    """The report as one JSON object (column ``value``): labels in order, then the three summaries."""

    def entry(key: Column, prefix: str, support: str) -> Column:
        metrics = F.struct(
            F.col(prefix + "precision").alias("precision"),
            F.col(prefix + "recall").alias("recall"),
            F.col(prefix + "f1").alias("f1-score"),
            F.col(support).alias("support"),
        )
        whole = F.to_json(F.create_map(key, metrics))
        return F.substr(whole, F.lit(2), F.length(whole) - 2)

    labels = report.agg(  # the label domain
        F.sort_array(F.collect_list(F.struct(F.col("label"), entry(F.col("label"), "", "support").alias("text")))).alias("labels")
    )
    parts = F.concat(
        F.transform("labels", lambda x: x["text"]),
        F.array(
            F.concat(F.lit('"accuracy":'), F.col("accuracy").cast("string")),
            entry(F.lit("macro avg"), "macro_", "total"),
            entry(F.lit("weighted avg"), "weighted_", "total"),
        ),
    )
    rows = labels.withColumn("__one", F.lit(1)).join(
        overall.withColumnRenamed("support", "total").withColumn("__one", F.lit(1)), "__one"
    )
    return rows.select(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("value"))


def write_report(report: DataFrame, overall: DataFrame, path: str) -> None:
    """Long table for further work, and the single JSON object beside it."""
    report.write.mode("overwrite").parquet(f"{path}/table")
    report_json(report, overall).write.mode("overwrite").text(f"{path}/json")
