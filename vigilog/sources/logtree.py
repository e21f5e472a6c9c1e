"""Raw log trees and their label sidecars to one labelled table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.functions.json import strict_json
from vigilog.functions.labels import NORMAL_LABEL
from vigilog.functions.text import has_content, is_log_path, source_of_path, strip
from vigilog.operators.joins import as_lookup, lookup_join
from vigilog.session import materialize

# Fixed value: the separator of several labels on one line.
LABEL_SEPARATOR = " | "
SIDECAR_SCHEMA = "line bigint, labels array<string>"


def _below(root: str) -> Column:
    """Path of a scanned file relative to the scanned folder."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    inside = F.lit(root.rstrip("/") + "/")
    return F.substr(path, F.locate(root.rstrip("/") + "/", path) + F.length(inside))


def scan_lines(spark: SparkSession, root: str, name_pattern: str = "*.log*", logs_only: bool = False) -> DataFrame:
    """Every line below a folder with its position inside the input split it was read from.

    With ``logs_only`` files that are no logs by their path are not opened.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name_pattern).text(root)
    if logs_only:
        files = files.where(is_log_path(_below(root)))
    return files.select(
        _below(root).alias("rel_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
        "value",
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Physical line number, from 1, also for files read in many splits.

    A first pass counts the rows of each split; only these counts are written and ordered. The second
    pass reads the lines and gives them the offset of their split. Both plan the same splits as long as
    the settings that decide them stay; a line that meets no split of the first pass, or lies beyond
    its end, fails the job instead of getting a wrong number.
    """
    splits = lines.groupBy("rel_path", "block").agg(
        F.min("position").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    earlier = Window.partitionBy("rel_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(splits.withColumn("__offset", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))), "splits")
    inside = F.col("position") - F.col("__first")
    known = F.coalesce(inside.between(0, F.col("__rows") - 1), F.lit(False))
    changed = F.raise_error(F.lit("the splits of the log tree changed between two scans")).cast("bigint")
    number = F.when(known, F.col("__offset") + inside + 1).otherwise(changed)
    numbered = lookup_join(lines, as_lookup(offsets), ["rel_path", "block"], ["position"], "left")
    return numbered.select("rel_path", number.alias("line_no"), "value")


def clean_lines(numbered: DataFrame, lines_per_file: int | None = None) -> DataFrame:
    """Lines, within a limit per file if one is given, that hold a letter or digit, stripped; numbers stay physical."""
    kept = numbered if lines_per_file is None else numbered.where(F.col("line_no") <= lines_per_file)
    return kept.withColumn("value", strip("value")).where(has_content("value"))


def scan_logs(spark: SparkSession, root: str, lines_per_file: int | None = None) -> DataFrame:
    """``rel_path, line_no, log_message, source`` of a ``gather`` folder."""
    numbered = number_lines(scan_lines(spark, root, logs_only=True))
    return clean_lines(numbered, lines_per_file).select(
        "rel_path", "line_no", F.col("value").alias("log_message"), source_of_path("rel_path").alias("source")
    )


def parse_sidecar(numbered: DataFrame) -> DataFrame:
    """``rel_path, line_no, label`` from numbered sidecar lines.

    Each is a JSON object naming a line and its labels. Lines that are not, or name no line, are
    skipped; of several entries for one line the last wins; an empty list is an empty label.
    """
    entry = F.from_json(F.when(strict_json("value").isNotNull(), F.col("value")), SIDECAR_SCHEMA)
    labels = F.coalesce(F.col("entry.labels"), F.array().cast("array<string>"))
    return (
        numbered.select("rel_path", F.col("line_no").alias("entry_no"), entry.alias("entry"))
        .where("entry.line IS NOT NULL")
        .select("rel_path", "entry_no", F.col("entry.line").alias("line_no"), F.array_join(labels, LABEL_SEPARATOR).alias("label"))
        .groupBy("rel_path", "line_no")
        .agg(F.max_by("label", "entry_no").alias("label"))
    )


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    return parse_sidecar(number_lines(scan_lines(spark, root)))


def attach_labels(logs: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Label of each line; without a sidecar entry it is normal.

    Sidecars hold the few attack lines: measured small they are broadcast. Otherwise only the lines of files
    that have a sidecar go through the join by path and line.
    """
    sidecar = materialize(sidecar, "sidecar")
    entries = as_lookup(sidecar)
    if entries.fits:
        found = lookup_join(logs, entries, ["rel_path", "line_no"], ["line_no"], "left")
    else:
        paths = as_lookup(sidecar.select("rel_path").distinct().withColumn("__labelled", F.lit(True)))
        marked = lookup_join(logs, paths, ["rel_path"], ["line_no"], "left")
        labelled = marked.where("__labelled").drop("__labelled").join(sidecar, ["rel_path", "line_no"], "left")
        others = marked.where("__labelled IS NULL").drop("__labelled").withColumn("label", F.lit(None).cast("string"))
        found = labelled.unionByName(others)
    return found.withColumn("label", F.coalesce("label", F.lit(NORMAL_LABEL)))


def labelled_logs(
    spark: SparkSession, gather: str, labels: str | None = None, lines_per_file: int | None = None
) -> DataFrame:
    """The labelled log table of a tree; sidecars lie at the same paths below the labels folder."""
    labels = gather.replace("gather", "labels") if labels is None else labels
    logs = scan_logs(spark, gather, lines_per_file)
    if not path_exists(spark, labels):
        return logs.withColumn("label", F.lit(NORMAL_LABEL))
    return attach_labels(logs, read_sidecars(spark, labels))


def with_log_ids(logs: DataFrame) -> DataFrame:
    """Add ``log_id``: the file's number, then the line's in the low 32 bits, so no two lines share one.

    Files are numbered within hash buckets, whatever their number.
    """
    buckets = 1_024
    files = logs.select("rel_path").distinct().withColumn("__bucket", F.pmod(F.xxhash64("rel_path"), F.lit(buckets)))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("rel_path")) - 1
    files = materialize(files.select("rel_path", (place * buckets + F.col("__bucket")).alias("__file")), "files")
    numbered = lookup_join(logs, as_lookup(files), ["rel_path"], ["line_no"])
    return numbered.withColumn("log_id", F.shiftleft("__file", 32) + F.col("line_no")).drop("__file")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
