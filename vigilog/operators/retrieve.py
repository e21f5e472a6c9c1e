"""Retrieval restricted to the query's source, with the filter relaxed until documents exist."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.labels import MISSING_LABEL
from vigilog.functions.text import relaxation_chain, source_tokens
from vigilog.operators.joins import as_lookup, lookup_join, salted_join
from vigilog.operators.knn import ANY_SCOPE, Pivots, search
from vigilog.session import materialize
from vigilog.sources.vector_index import load_documents_of, load_index, load_pivots, load_terms

_NULL_SOURCE = "\u0000"
#: Before every scope that is a term, so that no source can be taken for ANY_SCOPE.
_TERM = "="
#: How many bytes of neighbours' texts ``with_context`` fetches at a time: so many times those of the index, and at least so many.
TEXTS_AT_ONCE = 1.5
LEAST_BYTES = 128 << 20


def resolve_sources(sources: DataFrame, index_sources: DataFrame) -> DataFrame:
    """For every distinct query source, the first term of its chain that some document carries.

    A search filtered by a term is empty exactly when no document has that token, so the choice
    needs the distinct sources only. Result: ``source, scope``; ANY_SCOPE stands for no filter.
    """
    known = index_sources.select("source").distinct().select(F.explode(source_tokens("source")).alias("term"))
    known = known.distinct().withColumn("__known", F.lit(True))
    chains = sources.select("source").distinct().select("source", F.posexplode(relaxation_chain("source")))
    tried = chains.select("source", F.col("pos"), F.col("col").alias("term")).join(known, "term", "left")
    usable = tried.where(F.col("__known") | F.col("term").isNull())
    return usable.groupBy("source").agg(F.min_by(_scope(F.col("term")), "pos").alias("scope"))


def _scope(term: Column) -> Column:
    return F.coalesce(F.concat(F.lit(_TERM), term), F.lit(ANY_SCOPE))


def scopes_of(queries: DataFrame, sources: DataFrame, relax: bool = True) -> DataFrame:
    """``source, scope`` of every distinct query source.

    Without ``relax`` a query keeps its own source as the term and may find nothing; a query
    without a source searches everything in both cases.
    """
    if relax:
        return resolve_sources(queries, sources)
    return queries.select("source").distinct().withColumn("scope", _scope(F.col("source")))


def with_scopes(
    queries: DataFrame, index: DataFrame, relax: bool = True, sources: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Give both sides a ``scope``: queries their resolved source term, documents one row per wanted token.

    ``sources`` are the index's distinct sources, where a list of them is at hand; else they are read from the index.
    """
    sources = index.select("source").distinct() if sources is None else sources
    resolved = scopes_of(queries, sources, relax)
    keyed = as_lookup(resolved.select(F.coalesce("source", F.lit(_NULL_SOURCE)).alias("__source"), "scope"))
    asked = lookup_join(
        queries.withColumn("__source", F.coalesce("source", F.lit(_NULL_SOURCE))), keyed, ["__source"], ["qid"]
    ).drop("__source")
    wanted = keyed.with_table(keyed.table.select("scope").distinct())
    # which scopes a source's documents are wanted in is settled per source, before their vectors are read
    terms = F.transform(F.coalesce(source_tokens("source"), F.array().cast("array<string>")), lambda t: F.concat(F.lit(_TERM), t))
    by_source = sources.withColumn("scope", F.explode(F.array_append(F.array_distinct(terms), F.lit(ANY_SCOPE))))
    by_source = lookup_join(by_source, wanted, ["scope"], ["source"])
    scopes = by_source.groupBy(F.coalesce("source", F.lit(_NULL_SOURCE)).alias("__source")).agg(F.collect_set("scope").alias("__scopes"))
    indexed = index.withColumn("__source", F.coalesce("source", F.lit(_NULL_SOURCE)))
    found = lookup_join(indexed, as_lookup(scopes), ["__source"], ["doc_id"])
    found = found.withColumn("scope", F.explode("__scopes")).drop("__source", "__scopes")
    return asked, found


def retrieve(
    queries: DataFrame,
    index: DataFrame,
    pivots: Pivots,
    k: int = 3,
    size: int | None = None,
    probe: int | None = None,
    relax: bool = True,
    carry: Sequence[str] = ("label",),
) -> DataFrame:
    """Source-filtered nearest neighbours: ``qid, doc_id, <carry>, score, rank``.

    ``k`` neighbours are searched and ``size`` of them (all unless given) are returned.
    """
    return _found(*with_scopes(queries, index, relax), pivots, k, size, probe, carry)


def retrieve_stored(
    queries: DataFrame,
    path: str,
    k: int = 3,
    size: int | None = None,
    probe: int | None = None,
    relax: bool = True,
    carry: Sequence[str] = ("label",),
    without: str | None = None,
) -> DataFrame:
    """``retrieve`` from a stored index, of which only what the queries' terms name is read.

    The index's inverted list resolves the queries' sources and names the batches, cells and sources of the resolved terms. A
    query that resolves to no filter has the whole index read. ``without`` leaves out a batch.
    """
    spark = queries.sparkSession
    listed, pivots = load_terms(spark, path, without), load_pivots(spark, path)
    sources = materialize(listed.select("source").distinct(), "sources")
    wanted = materialize(scopes_of(queries, sources, relax).select("scope").distinct(), "scopes")
    if wanted.where(F.col("scope") == ANY_SCOPE).isEmpty():
        terms = wanted.select(F.substr("scope", F.lit(len(_TERM) + 1)).alias("term"))
        index = load_documents_of(spark, path, listed, as_lookup(terms))
    else:
        index = load_index(spark, path)
    if without is not None:
        index = index.where(F.col("batch") != without)
    return _found(*with_scopes(queries, index, relax, sources), pivots, k, size, probe, carry)


def _found(
    asked: DataFrame, found: DataFrame, pivots: Pivots, k: int, size: int | None, probe: int | None, carry: Sequence[str]
) -> DataFrame:
    hits = search(asked, found, pivots, k, probe, carry)
    if "label" in carry:
        hits = hits.withColumn("label", F.coalesce("label", F.lit(MISSING_LABEL)))
    return hits if size is None else hits.where(F.col("rank") <= size)


def retrieve_context(hits: DataFrame, index: DataFrame) -> DataFrame:
    """One row per query: ``qid, context`` with its neighbours as array<struct<log,label,score>>, best first.

    The texts are fetched for the neighbours only. A text that is a neighbour of very many queries is
    a hot key of that join and is spread.
    """
    return _contexts(_kept(hits), index)


def with_context(
    queries: DataFrame, hits: DataFrame, index: DataFrame, use: Callable[[DataFrame], DataFrame], name: str
) -> DataFrame:
    """What ``use`` makes of the queries with their ``context`` (null without neighbours), written.

    A text is fetched once for each query that it is a neighbour of, so all of them may be many times the index's
    own. They are fetched for a share of the queries at a time, and go when what is made of that share is written:
    the disk that they take follows the index's texts. ``use`` works row by row and is called for each share.
    """
    kept = _kept(hits)
    sizes = index.select("doc_id", F.octet_length("log").alias("bytes"))
    wanted = salted_join(kept, sizes, ["doc_id"], ["qid"]).agg(F.sum("bytes")).first()[0] or 0
    at_once = max(int(TEXTS_AT_ONCE * (sizes.agg(F.sum("bytes")).first()[0] or 0)), LEAST_BYTES)
    shares = max(1, -(-wanted // at_once))
    done = []
    for share in range(shares):
        asked, found = (df.where(F.pmod(F.xxhash64("qid"), F.lit(shares)) == share) for df in (queries, kept))
        done.append(materialize(use(asked.join(_contexts(found, index), "qid", "left")), name))
    return functools.reduce(DataFrame.unionByName, done)


def _kept(hits: DataFrame) -> DataFrame:
    return materialize(hits.select("qid", "doc_id", "label", "score", "rank"), "hits")


def _contexts(kept: DataFrame, index: DataFrame) -> DataFrame:
    texts = salted_join(kept, index.select("doc_id", "log"), ["doc_id"], ["qid"])
    entry = F.struct("rank", "log", "label", "score")
    return (
        texts.groupBy("qid")
        .agg(F.sort_array(F.collect_list(entry)).alias("__hits"))
        .select(
            "qid",
            F.transform("__hits", lambda h: F.struct(h["log"].alias("log"), h["label"].alias("label"), h["score"].alias("score"))).alias(
                "context"
            ),
        )
    )
