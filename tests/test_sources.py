import json
import os

import pytest
from pyspark.sql import functions as F

from vigilog.functions.labels import LOG_LABELS, RARE_LABELS, SUMMARY_KEYS
from vigilog.operators.metrics import class_report, confusion, confusion_matrix, model_metrics, overall_report
from vigilog.operators.sinks import alert_entries, write_entries, write_report
from vigilog.plans.ingestion import build_dataset, ingest
from vigilog.sources import logtree, tables, vector_index
from workload import queries


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "data"
    write(f"{root}/gather/mail/logs/mail.log.1", "first line\n\n---\n  third real  \r\nfifth\n")
    write(f"{root}/gather/inet-dns/logs/sub dir/dns+1.log", "one\ntwo\nthree\nfour\nfive\nsix")
    write(f"{root}/gather/attacker_0/logs/a.log", "hidden\n")
    write(f"{root}/gather/mail/other/a.log", "hidden\n")
    write(f"{root}/gather/mail/logs/notes.txt", "hidden\n")
    entries = [
        '{"line":5,"labels":["dnsteal","attacker"]}',
        "not json",
        '{"line":6,"labels":[]}',
        "",
        '{"line":5,"labels":["dup"], "rules": {"dup": ["r1"]}}',
        '{"line":1,"labels":["a","b"]}',
        '{"labels":["nowhere"]}',
        '{"line":2}',
        '{"line":3,"labels":["cut"]} trailing',
    ]
    write(f"{root}/labels/inet-dns/logs/sub dir/dns+1.log", "\n".join(entries))
    return f"{root}/gather"


def test_labelled_tree(spark, tree):
    rows = logtree.labelled_logs(spark, tree).select("rel_path", "line_no", "log_message", "source", "label").collect()
    assert {tuple(r) for r in rows} == {
        ("mail/logs/mail.log.1", 1, "first line", "mail", "normal_log"),
        ("mail/logs/mail.log.1", 4, "third real", "mail", "normal_log"),
        ("mail/logs/mail.log.1", 5, "fifth", "mail", "normal_log"),
        *{
            ("inet-dns/logs/sub dir/dns+1.log", n, text, "inet-dns", label)
            for n, text, label in [
                (1, "one", "a | b"),
                (2, "two", ""),
                (3, "three", "normal_log"),
                (4, "four", "normal_log"),
                (5, "five", "dup"),
                (6, "six", ""),
            ]
        },
    }


def test_tree_without_sidecars(spark, tmp_path):
    write(f"{tmp_path}/gather/vpn/logs/v.log", "x\n")
    assert [r.label for r in logtree.labelled_logs(spark, f"{tmp_path}/gather").collect()] == ["normal_log"]


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = [("" if n % 7 == 0 else f"line {n}") + ("\r\n" if n % 3 == 0 else "\n") for n in range(1, 30_001)]
    write(f"{tmp_path}/gather/h/logs/big.log", "".join(lines))
    write(f"{tmp_path}/gather/h/logs/small.log", "line 1\nline 2")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        scanned = logtree.scan_lines(spark, f"{tmp_path}/gather")
        assert scanned.where("rel_path LIKE '%big.log'").select("block").distinct().count() > 5
        numbered = logtree.number_lines(scanned)
        wrong = numbered.where("value <> ''").where(F.concat(F.lit("line "), "line_no") != F.col("value"))
        assert wrong.count() == 0 and numbered.count() == 30_002
        assert logtree.clean_lines(numbered).agg(F.max("line_no")).first()[0] == 30_000
        assert logtree.clean_lines(numbered, 10_000).agg(F.max("line_no")).first()[0] == 10_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(Exception, match="splits of the log tree changed"):  # other splits must not give other numbers
        numbered.collect()


def test_numbering_writes_no_lines(spark, tmp_path):
    write(f"{tmp_path}/gather/h/logs/a.log", "secret words\n" * 50)
    write(f"{tmp_path}/gather/attacker_0/logs/b.log", "hidden words\n" * 50)
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    assert logtree.scan_logs(spark, f"{tmp_path}/gather").count() == 50
    for folder in set(os.listdir(root)) - before:
        assert set(spark.read.parquet(f"{root}/{folder}").columns) == {"rel_path", "block", "__first", "__rows", "__offset"}


def test_long_sidecar_keeps_every_entry(spark):
    entries = spark.range(1, 30_001).selectExpr("'p' AS rel_path", "id AS line_no", "concat('{\"line\": ', id, ', \"labels\": [\"x\"]}') AS value")
    lines = spark.range(1, 30_003).selectExpr("'p' AS rel_path", "id AS line_no")
    got = logtree.attach_labels(lines, logtree.parse_sidecar(entries)).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"x": 30_000, "normal_log": 2}


def test_large_sidecar_joins_only_its_files(spark, tiny_limits):
    lines = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "rel_path string, line_no long")
    side = spark.createDataFrame([("a", 2, "x")], "rel_path string, line_no long, label string")
    got = {(r.rel_path, r.line_no): r.label for r in logtree.attach_labels(lines, side).collect()}
    assert got == {("a", 1): "normal_log", ("a", 2): "x", ("b", 1): "normal_log"}


def test_log_ids_differ(spark):
    logs = spark.createDataFrame([(f"f{k % 50}", k // 50 + 1) for k in range(500)], "rel_path string, line_no long")
    assert logtree.with_log_ids(logs).select("log_id").distinct().count() == 500


def test_line_breaks_in_datasets(spark, tmp_path):
    df = spark.createDataFrame([("two\nlines", "s", "l")], tables.DATASET_SCHEMA)
    with pytest.raises(Exception, match="line break"):
        tables.write_dataset(df, f"{tmp_path}/refused")
    tables.write_dataset(df, f"{tmp_path}/escaped", line_breaks="escape")
    assert [r.log_message for r in tables.read_dataset(spark, f"{tmp_path}/escaped").collect()] == ["two\\nlines"]


def test_rare_labels_are_kept_unless_named(spark):
    report = class_report(confusion(spark.createDataFrame([(x, x) for x in ("wpscan", "dirb", "normal_log")], "label string, predicted string")))
    assert {r.label for r in model_metrics(report).collect()} == {"wpscan", "dirb", "normal_log"}
    assert {r.label for r in model_metrics(report, [*SUMMARY_KEYS, *RARE_LABELS]).collect()} == {"normal_log"}


def test_dense_form_is_refused_beyond_its_bound(spark):
    counts = confusion(spark.createDataFrame([(f"l{k}", "x") for k in range(6)], "label string, predicted string"))
    assert confusion_matrix(counts, 7).count() == 7
    with pytest.raises(ValueError, match="more than 5"):
        confusion_matrix(counts, 5)


def test_dataset_roundtrip(spark, tmp_path):
    rows = [('he said "no", twice', "mail", "normal_log"), ("  padded  ", "a,b", ""), ("back\\slash", "x", "a | b"), ("#h", None, "dirb")]
    df = spark.createDataFrame(rows, tables.DATASET_SCHEMA)
    tables.write_dataset(df, f"{tmp_path}/d")
    back = {tuple(r) for r in tables.read_dataset(spark, f"{tmp_path}/d").collect()}
    assert back == {(m, s, l or None) for m, s, l in rows}


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="label"):
        tables.require_columns(spark.range(1).selectExpr("'a' AS log_message", "'b' AS source"))


def test_alert_lines(spark, tmp_path):
    write(f"{tmp_path}/alerts.jsonl", '{"a": 1}\nnope\n  {"b": [2]}  \n')
    good, bad = tables.read_alerts(spark, f"{tmp_path}/alerts.jsonl")
    assert {json.dumps(json.loads(r.alert)) for r in good.collect()} == {'{"a": 1}', '{"b": [2]}'}
    assert [r.value for r in bad.collect()] == ["nope"]


def test_report_file(spark, tmp_path):
    scored = spark.createDataFrame([("a", "a"), ("a", "b"), ('q"t', "a")], "label string, predicted string")
    report = class_report(confusion(scored))
    write_report(report, overall_report(report), f"{tmp_path}/r")
    with open([f"{tmp_path}/r/json/{n}" for n in os.listdir(f"{tmp_path}/r/json") if n.startswith("part")][0]) as f:
        content = json.load(f)
    assert list(content) == ["a", "b", 'q"t', "accuracy", "macro avg", "weighted avg"]
    assert content["a"] == {"precision": 0.5, "recall": 0.5, "f1-score": 0.5, "support": 2}
    assert content["accuracy"] == pytest.approx(1 / 3)
    rows = {r.key: r for r in tables.read_reports(spark, {"m": f"{tmp_path}/r/json"}).collect()}
    assert rows["b"].support == 0 and rows["accuracy"].f1 == pytest.approx(1 / 3) and rows["a"].model == "m"


def test_alert_text(spark, tmp_path):
    scored = spark.createDataFrame(
        [("GET /x", "dirb", "scan"), ("ok", "normal_log", "fine"), ("lost", None, None)],
        "log_message string, predicted string, explanation string",
    )
    write_entries(alert_entries(scored), f"{tmp_path}/t")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/t").collect()]
    assert lines == ["Log query: GET /x", "Label: dirb", "Explanation: scan", "#" * 80]


def test_ingestion_job(spark, tree, tmp_path):
    build_dataset(spark, tree, f"{tmp_path}/set")
    both = [tables.read_split(spark, f"{tmp_path}/set", side) for side in ("train", "eval")]
    assert sum(df.count() for df in both) == 9
    sources = ingest(both[0], "log_id", f"{tmp_path}/index", pivots=4)
    index = vector_index.load_index(spark, f"{tmp_path}/index")
    assert sum(r.n for r in sources.collect()) == both[0].count() == index.count()
    assert index.where("size(embedding) <> 384 OR cell IS NULL OR code IS NULL").count() == 0
    ingest(both[0], "log_id", f"{tmp_path}/index", pivots=4)
    assert vector_index.load_index(spark, f"{tmp_path}/index").count() == both[0].count()
    assert not vector_index.create_index(spark, f"{tmp_path}/index")


def test_label_domain():
    assert len(LOG_LABELS) == len(set(LOG_LABELS)) == 14


def test_splits_of_a_large_tree_stay_few(spark, tmp_path):
    assert queries.split_bytes(spark, str(tmp_path)) == 32 << 10
    with open(tmp_path / "a.log", "wb") as file:
        file.truncate(1 << 30)  # no blocks are written
    assert queries.split_bytes(spark, str(tmp_path)) == (1 << 30) // queries.LOG_SPLITS
