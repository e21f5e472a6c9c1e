"""Prompt columns for scoring a row with a language model."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.functions.labels import ALERT_LABELS, LOG_LABELS

# The texts sent to the model and the schema its answer must follow.
ROLE = "You are a log-based Intrusion Detection System (IDS). "
NETWORK = (
    "The network includes this services: a web server, cloud file share, mail servers, VPN gateway, DNS, "
    "internal intranet, a firewall, four internal employees, three remote employees, and three external users. "
)
LABEL_LIST = f"Assign a label from the label list: {LOG_LABELS} based on the content "
ONE_LOG = "Your task is to analyze one log message and assign it an appropriate label based on its content. "
EXPLAIN_50 = (
    "In addition to the label, provide a short explanation (in plain English, max 50 words) "
    "describing the reasoning behind your decision. "
)
EXPLAIN_70 = (
    "In addition to the label, provide a short explanation (in plain English, max 70 words) "
    "describing the reasoning behind your decision. "
    "Let me know if your decision is based on the provided list of logs or not."
)
FORMAT = "Your response must strictly follow the JSON format defined in the schema provided. "
LOG_BELOW = "Only return valid labels allowed by the schema. The log message is shown below:"
CONTEXT_GIVEN = (
    "Only return valid labels allowed by the schema."
    "You will be provided with:\n"
    "1. A list of similar past logs with known labels and the similarity score.\n"
    "2. A new log message with the source to classify.\n"
    "Use the context logs to inform your prediction. "
    "If the new log is similar to known attack patterns, label it accordingly. "
)
BINARY = (
    "You are going to act as a Intrusion Detection System, labeling the logs (normal_log or attack) and explaining "
    'the attacks.Use less than 50 words for the explanation, the log is between "'
)
BINARY_CONTEXT = " Here you have a RAG with the most similar logs and their labels to help you."
NEIGHBOURS_SYSTEM = (
    "You are going to act as a Intrusion Detection System, labeling the logs (normal_log or attack) and explaining "
    'the attacks in 50 words.The log is between "\n'
    "Here you have a RAG with the most similar labeled logs: "
)
ALERT_HEAD = "Below, you find the details for an alert that requires re-evaluation:\n\nAlert:\n"
ALERT_TAIL = (
    "\n\nRe-evaluate the alert based *only* on the provided alert details "
    "(predicted label, confidence, flow features, IPs, destination port). "
    f"Assign a final label from the canonical list: {ALERT_LABELS}, provide a concise explanation, "
    "and indicate your confidence. Provide your response strictly following the agreed JSON output format."
)
LABEL_SCHEMA = {
    "properties": {
        "label": {"title": "Label", "type": "string"},
        "explanation": {"title": "Explanation", "type": "string"},
    },
    "required": ["label", "explanation"],
    "title": "Response",
    "type": "object",
}
ALERT_SCHEMA = {
    "properties": {
        "final_attack_label": {"enum": ALERT_LABELS, "title": "Final Attack Label", "type": "string"},
        "explanation": {"title": "Explanation", "type": "string"},
        "confidence": {"maximum": 1.0, "minimum": 0.0, "title": "Confidence", "type": "number"},
    },
    "required": ["final_attack_label", "explanation", "confidence"],
    "title": "LLMResponse",
    "type": "object",
}

DIRECT_SYSTEM = ROLE + NETWORK + LABEL_LIST + EXPLAIN_50 + FORMAT + LOG_BELOW
CLOSED_SYSTEM = ROLE + NETWORK + ONE_LOG + EXPLAIN_50 + FORMAT + LOG_BELOW
CONTEXT_SYSTEM = ROLE + NETWORK + LABEL_LIST + FORMAT + CONTEXT_GIVEN + EXPLAIN_70
SCHEMA_NOTE = " The JSON object must use the schema: " + json.dumps(LABEL_SCHEMA, indent=1)
INDENT = " " * 12


@dataclass(frozen=True)
class ChatOptions:
    """Request parameters of a chat completion."""

    model: str
    temperature: float = 0.3
    max_tokens: int | None = 150
    top_p: float | None = None
    schema: dict | None = None
    json_mode: bool = False
    timeout: float = 1200.0

    def payload(self, system_prompt: str, user_prompt: str) -> dict:
        body = {
            "model": self.model,
            "messages": [
                {"role": "system", "content": system_prompt},
                {"role": "user", "content": user_prompt},
            ],
            "temperature": self.temperature,
            "stream": False,
        }
        optional = {
            "max_tokens": self.max_tokens,
            "top_p": self.top_p,
            "guided_json": self.schema,
            "response_format": {"type": "json_object"} if self.json_mode else None,
        }
        return body | {name: value for name, value in optional.items() if value is not None}


# Request parameters per kind of prompt.
CLOSED_LABEL_SCHEMA = LABEL_SCHEMA | {
    "properties": LABEL_SCHEMA["properties"] | {"label": {"enum": LOG_LABELS, "title": "Label", "type": "string"}}
}


def direct_options(model: str) -> ChatOptions:
    return ChatOptions(model, schema=LABEL_SCHEMA)


def closed_options(model: str) -> ChatOptions:
    return ChatOptions(model, schema=CLOSED_LABEL_SCHEMA, timeout=60)


def binary_options(model: str) -> ChatOptions:
    return ChatOptions(model, temperature=0, max_tokens=None, json_mode=True, timeout=60)


def alert_options(model: str) -> ChatOptions:
    return replace(direct_options(model), temperature=0.7, top_p=0.9, max_tokens=1024, schema=ALERT_SCHEMA, timeout=120)


def _message(source: str, log: str) -> Column:
    return F.concat(
        F.lit(INDENT + "source: "), F.coalesce(source, F.lit("nan")), F.lit(' ,log message: "'), F.col(log), F.lit('"\n' + INDENT)
    )


def direct_prompt(df: DataFrame, closed: bool = False) -> DataFrame:
    """Classify a log line from its text and source alone; the closed form has a user text on one line."""
    source = F.coalesce("source", F.lit("nan"))
    one_line = F.concat(F.lit(" source: "), source, F.lit(' ,log message: "'), F.col("log_message"), F.lit('"'))
    user = one_line if closed else F.concat(F.lit("\n"), _message("source", "log_message"))
    return df.withColumn("system_prompt", F.lit(CLOSED_SYSTEM if closed else DIRECT_SYSTEM)).withColumn("user_prompt", user)


def context_prompt(df: DataFrame) -> DataFrame:
    """Classify a log line given its neighbours (``context``, an array of log, label and score)."""
    neighbours = F.coalesce(F.to_json("context"), F.lit("[]"))
    user = F.concat(
        F.lit("Context logs:\n" + INDENT), neighbours, F.lit("\n\n" + INDENT + "Classify:\n"), _message("source", "log_message")
    )
    return df.withColumn("system_prompt", F.lit(CONTEXT_SYSTEM)).withColumn("user_prompt", user)


def labelled_context_prompt(df: DataFrame) -> DataFrame:
    """The older form with neighbours: they stand in the system text, and the schema behind them."""
    neighbours = F.coalesce(F.to_json("context"), F.lit("[]"))
    system = F.concat(F.lit(NEIGHBOURS_SYSTEM), neighbours, F.lit(SCHEMA_NOTE))
    source = F.coalesce("source", F.lit("nan"))
    user = F.concat(F.lit("Source: "), source, F.lit(', log message: "'), F.col("log_message"), F.lit('"'))
    return df.withColumn("system_prompt", system).withColumn("user_prompt", user)


def binary_prompt(df: DataFrame, with_context: bool = False) -> DataFrame:
    """Normal or attack, at temperature zero; the neighbours go into the system text."""
    if with_context:
        neighbours = F.coalesce(F.to_json("context"), F.lit("[]"))
        system = F.concat(F.lit(BINARY + "." + BINARY_CONTEXT), neighbours, F.lit("\n" + SCHEMA_NOTE))
    else:
        system = F.lit(BINARY + "\n" + SCHEMA_NOTE)
    user = F.concat(F.lit('log message: "'), F.col("log_message"), F.lit('"'))
    return df.withColumn("system_prompt", system).withColumn("user_prompt", user)


@F.arrow_udf(T.StringType())
def pretty_json(texts: pa.Array) -> pa.Array:
    """Indented JSON with the keys in their written order; a text that Python's parser refuses stays as it is."""

    def indented(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), indent=2)
        except (ValueError, RecursionError):
            return text

    return pa.array([indented(text) for text in texts.to_pylist()], pa.string())


def alert_prompt(df: DataFrame, system_prompt: str) -> DataFrame:
    """Re-evaluate an alert (``alert``, JSON text)."""
    user = F.concat(F.lit(ALERT_HEAD), pretty_json("alert"), F.lit(ALERT_TAIL))
    return df.withColumn("system_prompt", F.lit(system_prompt)).withColumn("user_prompt", user)
