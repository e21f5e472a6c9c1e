import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from vigilog.functions import prompts
from vigilog.functions.json import strict_json
from vigilog.functions.responses import read_alert_responses, read_label_responses
from vigilog.operators import scoring
from vigilog.operators.metrics import run_summary, status_counts
from vigilog.operators.sinks import result_lines
from vigilog.plans.evaluation import evaluate_model, reevaluate_alerts

SCHEMA = "id long, raw_response string, http_status long, error string"


def envelope(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def replies(spark, rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA)


def by_id(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("id").select(*columns).collect()]


def test_strict_json(spark):
    texts = ['{"a": 1}', "5", '"x"', "null", "[1, 2]", "", " ", "nope", '{"a": 1} x', "1, 2", '1, "b": 2', "1] [2", '1} {"x": 2', "{", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strict_json("t").isNotNull()).collect()] == [True] * 5 + [False] * 10


LABEL_CASES = [
    ((envelope('{"label": "dirb", "explanation": "x"}'), 200, None), "success"),
    ((envelope('  {"label": "other", "explanation": "x", "more": 1} '), 200, None), "success"),
    ((envelope("nope"), 200, None), "json_error"),
    ((envelope('{"label": "a", "explanation": "b"} x'), 200, None), "json_error"),
    ((envelope('{"label":5,"explanation":"x"}'), 200, None), "validation_error"),
    ((envelope('{"label":"a"}'), 200, None), "validation_error"),
    ((envelope('{"label":null,"explanation":"x"}'), 200, None), "validation_error"),
    ((envelope("[]"), 200, None), "validation_error"),
    (("{}", 200, None), "format_error"),
    (('{"choices": []}', 200, None), "format_error"),
    (("[]", 200, None), "format_error"),
    ((envelope(None), 200, None), "processing_error"),
    ((envelope(7), 200, None), "processing_error"),
    (("<html>", 200, None), "processing_error"),
    (("busy", 500, None), "api_error"),
    (("moved", 302, None), "processing_error"),
    ((None, None, "TimeoutError"), "processing_error"),
    ((None, None, None), "unknown_error"),
]


def test_label_status(spark):
    read = read_label_responses(replies(spark, [row for row, _ in LABEL_CASES]))
    assert by_id(read, "status") == [status for _, status in LABEL_CASES]
    assert by_id(read, "predicted")[:3] == ["dirb", "other", None]
    summary = run_summary(read).first()
    assert (summary.attempted, summary.successful, summary.failed) == (18, 2, 16)
    assert {r.status: r.n for r in status_counts(read).collect()}["format_error"] == 3


def test_strict_labels(spark):
    read = read_label_responses(replies(spark, [row for row, _ in LABEL_CASES[:2]]), strict_labels=True)
    assert by_id(read, "status") == ["success", "validation_error"]


@pytest.mark.parametrize(
    "confidence, status",
    [("0.5", "success"), ("1", "success"), ("0", "success"), ('"0.25"', "success"), ("true", "success"), ("1.5", "validation_error"),
     ("-0.1", "validation_error"), ('"high"', "validation_error"), ("null", "validation_error"), ("[1]", "validation_error")],
)
def test_alert_confidence(spark, confidence, status):
    content = f'{{"final_attack_label": "Botnet Attack", "explanation": "x", "confidence": {confidence}}}'
    assert by_id(read_alert_responses(replies(spark, [(envelope(content), 200, None)])), "status") == [status]


def test_alert_label_domain(spark):
    content = '{"final_attack_label": "Bot", "explanation": "x", "confidence": 0.5}'
    assert by_id(read_alert_responses(replies(spark, [(envelope(content), 200, None)])), "status") == ["validation_error"]


def test_alert_run_and_result_lines(spark):
    def open_model():
        def call(system, user):
            if '"n": 1' in user:
                raise ValueError("lost")
            if '"n": 2' in user:
                return 503, "busy"
            label = "Benign" if system == "judge" and "{\n  \"n\": 0" in user else "Heartbleed"
            content = json.dumps({"final_attack_label": label, "explanation": "e", "confidence": 1})
            return 200, json.dumps({"choices": [{"message": {"content": content}}]})

        return call

    alerts = spark.createDataFrame([(n, f'{{"n": {n}, "z": [1.5]}}') for n in range(4)], "id long, alert string")
    results = reevaluate_alerts(alerts, open_model, "judge", "id", partitions=2, concurrency=3)
    assert by_id(results, "status", "predicted", "confidence") == [
        ("success", "Benign", 1.0), ("processing_error", None, None), ("api_error", None, None), ("success", "Heartbleed", 1.0)]
    lines = [json.loads(r.entry) for r in result_lines(results).orderBy("id").collect()]
    assert lines[0]["llm_response"] == {"final_attack_label": "Benign", "explanation": "e", "confidence": 1}
    assert lines[0]["original_alert"] == {"n": 0, "z": [1.5]} and "error" not in lines[0]
    assert lines[1]["error"] == "ValueError: lost" and lines[1]["inference_time_sec"] >= 0
    assert (lines[2]["status_code"], lines[2]["response_text"]) == (503, "busy")


def test_model_called_once_per_row(spark, tmp_path):
    folder = str(tmp_path)

    def open_model():
        def call(_system, user):
            with open(f"{folder}/calls", "a") as f:
                f.write("x")
            content = json.dumps({"label": "dirb" if "scan" in user else "normal_log", "explanation": "e"})
            return 200, json.dumps({"choices": [{"message": {"content": content}}]})

        return call

    rows = spark.createDataFrame([(1, "scan", "s", "dirb"), (2, "ok", "s", "normal_log"), (3, "ok", None, "dirb")], "qid long, log_message string, source string, label string")
    done = evaluate_model(rows, open_model, concurrency=1)
    assert done.overall.first().accuracy == pytest.approx(2 / 3) and done.summary.first().successful == 3
    assert done.report.count() == 2
    with open(f"{folder}/calls") as f:
        assert f.read() == "xxx"
    binary = evaluate_model(rows, open_model, binary=True, concurrency=1)
    assert {r.label for r in binary.report.collect()} == {"normal_log", "attack_log"}


def test_request_body(monkeypatch):
    sent = {}

    class Reply:
        status = 200

        def read(self):
            return b"body"

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    def urlopen(request, timeout):
        sent.update(json.loads(request.data), timeout=timeout)
        return Reply()

    monkeypatch.setattr(scoring.urllib.request, "urlopen", urlopen)
    call = scoring.http_model("http://model.invalid/v1", prompts.alert_options("m"))()
    assert call("sys", "usr") == (200, "body")
    assert [m["content"] for m in sent["messages"]] == ["sys", "usr"]
    assert (sent["temperature"], sent["top_p"], sent["max_tokens"], sent["timeout"]) == (0.7, 0.9, 1024, 120)
    assert sent["guided_json"]["properties"]["confidence"]["maximum"] == 1.0
    assert "guided_json" not in prompts.binary_options("m").payload("a", "b")
    assert prompts.closed_options("m").payload("a", "b")["guided_json"]["properties"]["label"]["enum"][0] == "normal_log"

    def refuse(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 429, "no", {}, io.BytesIO(b"slow down"))

    monkeypatch.setattr(scoring.urllib.request, "urlopen", refuse)
    assert call("sys", "usr") == (429, "slow down")


def test_prompt_texts(spark):
    df = spark.createDataFrame([("a \"b\"", "mail")], "log_message string, source string")
    row = prompts.direct_prompt(df).first()
    assert row.user_prompt == '\n            source: mail ,log message: "a "b""\n            '
    assert "['normal_log', 'dnsteal'" in row.system_prompt
    context = df.withColumn("context", F.array(F.struct(F.lit("l").alias("log"), F.lit("dirb").alias("label"), F.lit(0.5).alias("score"))))
    row = prompts.context_prompt(context).first()
    assert row.user_prompt.startswith('Context logs:\n            [{"log":"l","label":"dirb","score":0.5}]\n\n            Classify:\n')
    assert '"label":"dirb"' in prompts.binary_prompt(context, with_context=True).first().system_prompt
    assert prompts.direct_prompt(df, closed=True).first().system_prompt != prompts.DIRECT_SYSTEM
