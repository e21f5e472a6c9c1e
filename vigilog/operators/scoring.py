"""Calling a scoring model for every row."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vigilog.functions.prompts import ChatOptions

Call = Callable[[str, str], tuple[int, str]]
RESULT_FIELDS = [
    T.StructField("raw_response", T.StringType()),
    T.StructField("http_status", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
]


def score_with(
    df: DataFrame,
    open_model: Callable[[], Call],
    id_col: str,
    partitions: int | None = None,
    concurrency: int = 1,
    without: Sequence[str] = (),
) -> DataFrame:
    """Send ``system_prompt`` and ``user_prompt`` of every row to a model.

    ``open_model`` runs once per task and returns a function from the two prompts to an HTTP status
    and a body. At most ``partitions * concurrency`` calls run at once. A failing call fills
    ``error`` and does not fail the task. A lost task repeats its calls, so write the result once
    (``materialize``) before several actions read it. Columns that the result does without, like the prompts, do not leave
    the task.
    """
    spread = df if partitions is None else df.repartition(partitions, id_col)
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in without], *RESULT_FIELDS])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = open_model()

        def one(prompts: tuple[str, str]) -> tuple:
            began = time.monotonic()
            try:
                status, body = call(*prompts)
                return body, status, None, time.monotonic() - began
            except Exception as failure:  # noqa: BLE001 - any failure of the call is a result
                return None, None, f"{type(failure).__name__}: {failure}", time.monotonic() - began

        with ThreadPoolExecutor(concurrency) as pool:
            each = map if concurrency == 1 else pool.map
            for batch in batches:
                answers = list(each(one, zip(batch["system_prompt"], batch["user_prompt"])))
                bodies, statuses, errors, seconds = zip(*answers) if answers else ((), (), (), ())
                yield batch.drop(columns=list(without)).assign(
                    raw_response=pd.Series(bodies, batch.index, dtype=object),
                    http_status=pd.Series(statuses, batch.index, dtype="Int64"),
                    error=pd.Series(errors, batch.index, dtype=object),
                    seconds=pd.Series(seconds, batch.index, dtype=float),
                )

    return spread.mapInPandas(score, schema)


def http_model(url: str, options: ChatOptions, headers: dict[str, str] | None = None) -> Callable[[], Call]:
    """A model behind a chat-completions endpoint."""

    def open_model() -> Call:
        def call(system_prompt: str, user_prompt: str) -> tuple[int, str]:
            body = json.dumps(options.payload(system_prompt, user_prompt)).encode()
            request = urllib.request.Request(
                url, body, {"Content-Type": "application/json", **(headers or {})}, method="POST"
            )
            try:
                with urllib.request.urlopen(request, timeout=options.timeout) as reply:
                    return reply.status, reply.read().decode()
            except urllib.error.HTTPError as refused:
                return refused.code, refused.read().decode()

        return call

    return open_model


def keyword_model(rules: list[tuple[str, str]], otherwise: str) -> Callable[[], Call]:
    """A deterministic stand-in for tests and dry runs: the first keyword found names the label."""

    def open_model() -> Call:
        def call(_system: str, user_prompt: str) -> tuple[int, str]:
            word, label = next(((w, l) for w, l in rules if w in user_prompt), ("", otherwise))
            answer = {"label": label, "explanation": f"found '{word}'" if word else "nothing found"}
            return 200, json.dumps({"choices": [{"message": {"content": json.dumps(answer)}}]})

        return call

    return open_model
