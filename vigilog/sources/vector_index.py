"""The stored vector index: a Parquet table of documents, its pivots, and an inverted list from source tokens to places.

Beside each batch of documents lies its list ``term, source, cell, documents``: which cells hold documents of a source with that
token. A search for a token reads the batches' cells that the list names, and in their files only the row groups whose Bloom
filters and bounds admit one of the token's sources.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.text import source_tokens
from vigilog.functions.vectors import embed_hash, sign_code, to_matrix
from vigilog.operators.joins import Lookup, as_lookup
from vigilog.operators.knn import Pivots, assign_cells, choose_pivots, rank_copies
from vigilog.session import materialize
from vigilog.sources.logtree import path_exists

INDEX_SCHEMA = (
    "doc_id bigint, log string, source string, label string, embedding array<float>, code binary, "
    "cell_distance double, copy_rank int, batch string, cell int"
)


TERM_SCHEMA = "term string, source string, documents bigint, batch string, cell int"

#: Files that a batch gives a cell at most.
FILES_PER_CELL = 4
#: Batches and sources beyond which a filter names cells only, and the sources are left to the join behind it.
NAMED_BATCHES = 100
NAMED_SOURCES = 1_000


def create_index(spark: SparkSession, path: str) -> bool:
    """Create an empty index unless it exists; tells whether it was created."""
    if path_exists(spark, f"{path}/docs"):
        return False
    spark.createDataFrame([], INDEX_SCHEMA).drop("batch", "cell").write.parquet(f"{path}/docs/batch=0/cell=0")
    return True


def document(df: DataFrame, id_col: str) -> DataFrame:
    """Index fields of a labelled log row, with its vector if it has one."""
    vector = ["embedding"] if "embedding" in df.columns else []
    return df.select(F.col(id_col).alias("doc_id"), F.col("log_message").alias("log"), "source", "label", *vector)


def append_documents(
    docs: DataFrame,
    path: str,
    batch: str,
    embedder: Callable[[str], Column] = embed_hash,
    pivots: int = 256,
    seed: int = 42,
) -> None:
    """Embed documents, unless they come with a vector, and add them to the index as one batch.

    The batch is a folder of its own that a repeated call replaces, so a retried job leaves no
    duplicates; so is its part of the inverted list, written after it. Inside it each cell is a folder, so that a search reads the cells it visits. The first batch
    with a document picks the pivots; ``rebuild_index`` picks new ones for an index that has outgrown them.
    """
    spark = docs.sparkSession
    create_index(spark, path)
    embedded = docs
    if "embedding" not in docs.columns:
        embedded = materialize(docs.withColumn("embedding", embedder("log")), "embedded")
    if not load_pivots(spark, path).count:
        centres = choose_pivots(embedded, pivots, seed)
        if not centres.count:
            return  # nothing to index, and nothing to choose pivots from
        _store_pivots(spark, path, centres)
    if not path_exists(spark, f"{path}/terms"):  # an index from before it had a list
        load_terms(spark, path).write.partitionBy("batch").parquet(f"{path}/terms")
    _write_batch(rank_copies(embedded), load_pivots(spark, path), f"{path}/docs/batch={batch}")
    _write_terms(spark, f"{path}/docs/batch={batch}", f"{path}/terms/batch={batch}")


def rebuild_index(spark: SparkSession, path: str, into: str, pivots: int = 256, seed: int = 42) -> None:
    """The documents of an index as one batch of a new one, with pivots chosen from all and copies ranked over all.

    For an index that has grown far beyond its first batch, or by very many small ones.
    """
    stored = load_index(spark, path).select("doc_id", "log", "source", "label", "embedding")
    create_index(spark, into)
    append_documents(stored, into, "rebuilt", pivots=pivots, seed=seed)


def _store_pivots(spark: SparkSession, path: str, centres: Pivots) -> None:
    rows = [(cell, int(centres.seniority[cell]), vector.tolist()) for cell, vector in enumerate(centres.vectors)]
    spark.createDataFrame(rows, "cell int, seniority int, vector array<double>").write.mode("overwrite").parquet(f"{path}/pivots")


def _write_batch(ranked: DataFrame, pivots: Pivots, folder: str) -> None:
    """One folder a cell; a cell's rows are spread over a few files, so that a full one is not one task's.

    Files are sorted by source and carry a Bloom filter of their sources.
    """
    placed = assign_cells(ranked, pivots).withColumn("code", sign_code("embedding"))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(FILES_PER_CELL))
    (
        placed.select([f.split()[0] for f in INDEX_SCHEMA.split(", ") if not f.startswith("batch")])
        .repartition("cell", spread)
        .sortWithinPartitions("cell", "source")
        .write.mode("overwrite")
        .partitionBy("cell")
        .option("parquet.bloom.filter.enabled#source", "true")
        .option("parquet.bloom.filter.expected.ndv#source", "10000")
        .parquet(folder)
    )


def _terms_of(docs: DataFrame, *place: str) -> DataFrame:
    """``term, source, documents`` and the place; a source without a token has a null term."""
    sizes = docs.groupBy("source", *place).agg(F.count(F.lit(1)).alias("documents"))
    terms = F.explode_outer(F.coalesce(source_tokens("source"), F.array().cast("array<string>")))
    return sizes.select(terms.alias("term"), "source", "documents", *place)


def _write_terms(spark: SparkSession, docs: str, folder: str) -> None:
    """The list of a batch, from what was written. It is sorted, so that a term is looked up in few row groups."""
    found = _terms_of(spark.read.schema("source string, cell int").parquet(docs), "cell")
    found.repartition("term").sortWithinPartitions("term", "source").write.mode("overwrite").parquet(folder)


def load_terms(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """The inverted list of all batches (but one); counted from the documents where an index has none."""
    if path_exists(spark, f"{path}/terms"):
        found = spark.read.schema(TERM_SCHEMA).parquet(f"{path}/terms")
    else:
        found = _terms_of(load_index(spark, path), "batch", "cell")
    return found if without is None else found.where(F.col("batch") != without)


def load_documents_of(spark: SparkSession, path: str, terms: DataFrame, wanted: Lookup) -> DataFrame:
    """The documents of an index whose source carries one of the wanted terms (``wanted`` has ``term``).

    The list names their batches, cells and sources, which become filters of the scan. Nothing is left out that carries a term:
    where there are too many to name, the filter is coarser and a join on the source decides.
    """
    found = terms.join(F.broadcast(wanted.table) if wanted.fits else wanted.table, "term").select("batch", "cell", "source")
    places, index = as_lookup(found.distinct()), load_index(spark, path)
    if not places.fits or places.rows is None:
        return index.join(places.table.select("source").distinct(), "source", "left_semi")
    batches: dict[str, set[int]] = {}
    for batch, cell in zip(places.rows["batch"].to_pylist(), places.rows["cell"].to_pylist()):
        batches.setdefault(batch, set()).add(cell)
    cells = F.col("cell").isin(sorted({c for some in batches.values() for c in some}))
    if len(batches) <= NAMED_BATCHES:
        each = [(F.col("batch") == batch) & F.col("cell").isin(sorted(some)) for batch, some in sorted(batches.items())]
        cells = functools.reduce(operator.or_, each, F.lit(False))
    sources = sorted(set(places.rows["source"].to_pylist()))
    if len(sources) <= NAMED_SOURCES:
        return index.where(cells & F.col("source").isin(sources))
    return index.where(cells).join(F.broadcast(places.table.select("source").distinct()), "source", "left_semi")


def load_pivots(spark: SparkSession, path: str) -> Pivots:
    """At most ``MAX_PIVOTS`` vectors; none before the first document."""
    if not path_exists(spark, f"{path}/pivots/_SUCCESS"):
        return Pivots(np.zeros((0, 0)), np.zeros(0, np.int64))
    stored = spark.read.parquet(f"{path}/pivots").toArrow().sort_by("cell")
    return Pivots(to_matrix(stored["vector"]), stored["seniority"].to_numpy().astype("int64"))


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/docs")
