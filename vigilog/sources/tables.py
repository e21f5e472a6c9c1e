"""Datasets, alert files and report files at the edges of the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.json import strict_json

# The header of a dataset file.
DATASET_COLUMNS = ["log_message", "source", "label"]
DATASET_SCHEMA = "log_message string, source string, label string"


def require_columns(df: DataFrame, columns: Sequence[str] = tuple(DATASET_COLUMNS)) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def read_dataset(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV dataset with a header; an empty field is missing.

    A log message is one line, so files are read in splits. ``multi_line`` reads messages with line
    breaks that another writer left in quotes, one task per file.
    """
    return (
        spark.read.schema(DATASET_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )


def write_dataset(df: DataFrame, path: str, line_breaks: str = "refuse") -> None:
    """CSV at the edge: header and the three dataset columns.

    A message with a line break would come back as two rows. It fails the job unless ``line_breaks`` is ``escape``,
    which writes ``\\n`` and ``\\r`` for them. The split tables (Parquet) keep messages as they are.
    """

    def on_one_line(name: str) -> Column:
        column = F.col(name)
        if line_breaks == "escape":
            escaped = F.replace(F.replace(column, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
            return escaped.alias(name)
        broken = F.raise_error(F.lit(f"a line break in {name}; write Parquet, or with line_breaks='escape'")).cast("string")
        return F.when(column.rlike("[\r\n]"), broken).otherwise(column).alias(name)

    (
        require_columns(df)
        .select(*[on_one_line(c) for c in DATASET_COLUMNS])
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_split(df: DataFrame, path: str) -> None:
    """Both sides of a split in one pass, one folder each (``split=train``, ``split=eval``)."""
    require_columns(df, [*DATASET_COLUMNS, "split"])
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, side: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == side)


def read_alerts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Alerts in JSON lines: the well-formed ones as ``alert`` text, and the lines that are not."""
    return split_alerts(spark.read.text(path))


def split_alerts(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    valid = strict_json(value).isNotNull()
    return (
        lines.where(valid).withColumn("alert", F.trim(F.col(value))).drop(value),
        lines.where(~F.coalesce(valid, F.lit(False))),
    )


def read_reports(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Report files of several models as rows ``model, key, precision, recall, f1, support``.

    ``accuracy`` is a bare number in such a file; it is returned as the row of that key with the
    number in every metric column.
    """
    metric = "struct<precision: double, recall: double, `f1-score`: double, support: double>"
    rows = None
    for model, path in paths.items():
        text = spark.read.option("wholetext", True).text(path)
        entries = text.select(F.explode(F.from_json("value", "map<string, string>")).alias("key", "entry"))
        parsed = F.from_json(F.when(F.col("key") != "accuracy", F.col("entry")), metric)
        number = F.when(F.col("key") == "accuracy", F.col("entry").try_cast("double"))
        one = entries.withColumn("m", parsed).select(
            F.lit(model).alias("model"),
            "key",
            F.coalesce("m.precision", number).alias("precision"),
            F.coalesce("m.recall", number).alias("recall"),
            F.coalesce(F.col("m").getField("f1-score"), number).alias("f1"),
            F.col("m.support").cast("bigint").alias("support"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows
