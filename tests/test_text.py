import datetime as dt

import pyarrow as pa
import pytest

from vigilog.functions import vectors
from vigilog.functions.event_time import event_time
from vigilog.functions.labels import in_domain, is_alert, to_binary
from vigilog.functions.text import has_content, has_letter, is_log_path, relaxation_chain, source_of_path, source_tokens, strip


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def values(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_content_filter(spark):
    lines = column(spark, ["", "   ", "--- ...", "a", "7"])
    assert values(lines, has_content("v")) == [False, False, False, True, True]


def test_letter_filter(spark):
    assert values(column(spark, ["123", None, "x1"]), has_letter("v")) == [False, False, True]


def test_strip_matches_python(spark):
    texts = ["  a b\t", "\u00a0x\u2003", "\x1cq\x85", "\u200bz"]
    assert values(column(spark, texts), strip("v")) == [t.strip() for t in texts]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Jan 21 00:00:09 dnsmasq[3]: query", "2022-01-21 00:00:09"),
        ("Jan  1 00:00:09 dnsmasq", "2022-01-01 00:00:09"),
        ("x [21/Jan/2022:10:00:49 +0100] GET", "2022-01-21 09:00:49"),
        ('{"timestamp"": 1642723209.5', "2022-01-21 00:00:09.500"),
        ("Feb 30 00:00:00", None),
        ("plain text", None),
        ("abc 12 10:10:10 [21/Jan/2022:10:00:49 +0000]", "2022-01-21 10:00:49"),
    ],
)
def test_event_time(spark, line, expected):
    found = values(column(spark, [line]), event_time("v"))[0]
    assert found == (expected and dt.datetime.fromisoformat(expected))


def test_path_parts(spark):
    paths = column(spark, ["C:\\x\\gather\\mail\\logs\\a.log", "/d/gather/vpn/logs/b.log", "inet-dns/logs/c.log.1"])
    assert values(paths, source_of_path("v")) == ["mail", "vpn", "inet-dns"]
    paths = column(spark, ["mail/logs/mail.log.1", "attacker_0/logs/a.log", "x/nolgs/a.log"])
    assert values(paths, is_log_path("v")) == [True, False, False]


def test_source_tokens(spark):
    names = column(spark, ["Inet-dns", "a_b", "-x-", ""])
    assert values(names, source_tokens("v")) == [["inet", "dns"], ["a_b"], ["x"], []]


def test_relaxation_chain(spark):
    names = column(spark, ["inet-dns", "a-b_c", "a_b", "mail", None, "a-"])
    assert values(names, relaxation_chain("v")) == [
        ["inet-dns", "dns", None],
        ["a-b_c", "b_c", "c", None],
        ["a_b", "b", None],
        ["mail", None],
        [None],
        ["a-", "", None],
    ]


def test_label_predicates(spark):
    labels = column(spark, ["normal_log", "dirb", "abnormal", None])
    assert values(labels, is_alert("v")) == [False, True, False, None]
    assert values(labels, to_binary("v")) == ["normal_log", "attack_log", "normal_log", None]
    assert values(labels, in_domain("v")) == [True, True, False, None]


def test_batches_are_embedded_a_few_texts_at_a_time(spark, monkeypatch):
    rows = [(k, " ".join(f"w{j * k % 31}" for j in range(k % 13))) for k in range(60)] + [(60, None), (61, "a b " * 300)]
    docs = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    whole = docs.select("id", vectors.embed_hash("text").alias("v")).orderBy("id").collect()
    monkeypatch.setattr(vectors, "TOKENS_AT_ONCE", 20)
    monkeypatch.setattr(vectors, "ROWS_AT_ONCE", 7)
    assert docs.select("id", vectors.embed_hash("text").alias("v")).orderBy("id").collect() == whole
    seen = []
    made = vectors.sliced(lambda column: seen.append(len(column)) or column)
    assert made(pa.array(range(20))).to_pylist() == list(range(20)) and seen == [7, 7, 6] and len(made(pa.array([], pa.int64()))) == 0
