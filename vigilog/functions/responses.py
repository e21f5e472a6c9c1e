"""Reading model responses: envelope, content, types, domain and a status per row.

Input columns: ``raw_response`` (body of the reply), ``http_status`` and ``error`` (set when the
call itself failed). JSON types are checked on the parsed value, because a schema-driven read would
turn the number 5 into the label "5".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.json import strict_json
from vigilog.functions.labels import ALERT_LABELS, LOG_LABELS, in_domain

CONTENT_PATH = "$.choices[0].message.content"


def _typed(value: Column, *types: str) -> Column:
    found = F.schema_of_variant(value)
    return F.coalesce(F.reduce(F.array(*[F.lit(t) for t in types]), F.lit(False), lambda acc, t: acc | F.startswith(found, t)), F.lit(False))


def _field(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant")


def _text(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "string")


def _with_content(df: DataFrame) -> DataFrame:
    envelope = strict_json("raw_response")
    with_envelope = df.withColumn("__envelope", envelope).withColumn(
        "__content", F.try_variant_get("__envelope", CONTENT_PATH, "variant")
    )
    text = F.trim(F.try_variant_get("__content", "$", "string"))
    return with_envelope.withColumn("__text", F.when(_typed(F.col("__content"), "STRING"), text)).withColumn(
        "__doc", strict_json("__text")
    )


def _status(valid: Column) -> Column:
    """First failing check decides."""
    return (
        F.when(F.col("error").isNotNull(), "processing_error")
        .when(F.col("http_status") >= 400, "api_error")
        .when(F.col("raw_response").isNull() | F.col("http_status").isNull(), "unknown_error")
        .when(F.col("__envelope").isNull(), "processing_error")
        .when(F.col("__content").isNull(), "format_error")
        .when(F.col("__text").isNull(), "processing_error")
        .when(F.col("__doc").isNull(), "json_error")
        .when(~valid, "validation_error")
        .otherwise("success")
    )


def read_label_responses(df: DataFrame, strict_labels: bool = False, domain: Sequence[str] = tuple(LOG_LABELS)) -> DataFrame:
    """Add ``status, predicted, explanation``; labels outside the domain fail only when strict."""
    doc = F.col("__doc")
    valid = _typed(doc, "OBJECT") & _typed(_field(doc, "label"), "STRING") & _typed(_field(doc, "explanation"), "STRING")
    if strict_labels:
        valid = valid & F.coalesce(in_domain(_text(doc, "label"), domain), F.lit(False))
    checked = _with_content(df).withColumn("status", _status(valid))
    ok = F.col("status") == "success"
    return (
        checked.withColumn("predicted", F.when(ok, _text(doc, "label")))
        .withColumn("explanation", F.when(ok, _text(doc, "explanation")))
        .drop("__envelope", "__content", "__text", "__doc")
    )


def read_alert_responses(df: DataFrame, domain: Sequence[str] = tuple(ALERT_LABELS)) -> DataFrame:
    """Add ``status, predicted, explanation, confidence, content, llm_response, detail`` (what a failed check found)."""
    doc = F.col("__doc")
    given = _field(doc, "confidence")
    number = F.when(
        _typed(given, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "STRING", "BOOLEAN"),
        F.coalesce(F.try_variant_get(given, "$", "double"), _text(doc, "confidence").try_cast("double")),
    )
    known = F.coalesce(in_domain(_text(doc, "final_attack_label"), domain), F.lit(False))
    checks = {
        "the content is no object": _typed(doc, "OBJECT"),
        "final_attack_label is none of the known labels": _typed(_field(doc, "final_attack_label"), "STRING") & known,
        "explanation is no text": _typed(_field(doc, "explanation"), "STRING"),
        "confidence is no number from 0 to 1": F.coalesce(number.between(0.0, 1.0), F.lit(False)),
    }
    failed = F.coalesce(*[F.when(~passed, F.lit(what)) for what, passed in checks.items()])
    detail = (
        F.when(F.col("status") == "validation_error", failed)
        .when(F.col("status") == "json_error", "the content is not one JSON value")
        .when((F.col("status") == "processing_error") & F.col("error").isNull(), "the reply is no JSON with a text as content")
    )
    checked = _with_content(df).withColumn("status", _status(failed.isNull())).withColumn("detail", detail)
    ok = F.col("status") == "success"
    return (
        checked.withColumn("predicted", F.when(ok, _text(doc, "final_attack_label")))
        .withColumn("explanation", F.when(ok, _text(doc, "explanation")))
        .withColumn("confidence", F.when(ok, number))
        .withColumn("content", F.col("__text"))
        .withColumn("llm_response", F.when(ok, F.to_json("__doc")))
        .drop("__envelope", "__content", "__text", "__doc")
    )
