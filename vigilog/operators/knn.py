"""Nearest-neighbour join of two tables of unit vectors.

The index is divided into cells around pivots (a seeded sample of its own rows). A query visits

* with ``probe=None`` every cell that can hold one of its k nearest documents. The k-th distance is
  bounded from the cell sizes and radii before anything is compared, cells beyond that bound (by the
  triangle inequality, or by the bisector between their pivot and the query's) are left out, and the
  result is exact;
* with ``probe=n`` its n nearest cells (approximate).

Cells that lie near each other are packed into areas of about BLOCK_ROWS documents, so that a query is
sent to an area once and not to each of its small cells. An area (a full cell may make several times
that size) is cut into blocks of documents and its queries into chunks; a block and a chunk make one
unit of at most about BLOCK_ROWS by CHUNK_ROWS rows. Units are hashed into bundles of about
BUNDLE_ROWS rows, the groups Spark hands to a task; a task makes matrices of one unit's documents and of a few
queries at a time. A unit returns k rows per query; one ranking per
query merges them.

Rows sent to units grow with documents times queries. Where they are many times the rows of both sides, slices of the queries are
searched one after another and what was sent for a slice goes when its hits are written, so that disk follows the input.

``scope`` splits the search further: a query only meets documents of its own scope.

Logs repeat themselves. Documents with one and the same vector are ranked when the index is built, and
a search reads only as many copies as it can return.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions.vectors import cosine_score, sliced, to_matrix
from vigilog.operators.joins import Lookup, as_lookup, lookup_join, salted_join
from vigilog.operators.sampling import order_key
from vigilog.session import materialize

BLOCK_ROWS = 16_384
CHUNK_ROWS = 16_384
BUNDLE_ROWS = 16_384
#: Rows sent to units at a time: so many times those of the index and the queries, and at least so many.
ROUTED_AT_ONCE = 4
LEAST_ROUTED = 1_000_000
SCORES_AT_ONCE = 1_000_000
CANDIDATES_AT_ONCE = 20_000
GROUPS = 256
MAX_PIVOTS = 8_192
COPIES_RANKED = 64
NO_DOCUMENT = -1
ANY_SCOPE = "*"


@dataclass(frozen=True)
class Pivots:
    """Cell centres; the position is the cell number. Neighbouring numbers are neighbouring cells.

    ``seniority`` is each pivot's place in seeded order, which decides between equally near cells.
    """

    vectors: np.ndarray
    seniority: np.ndarray

    @property
    def count(self) -> int:
        return len(self.vectors)


def choose_pivots(docs: DataFrame, count: int, seed: int = 42, id_col: str = "doc_id") -> Pivots:
    """The ``count`` documents lowest in seeded order: a sample whose size does not grow with the data."""
    if count > MAX_PIVOTS:
        raise ValueError(f"at most {MAX_PIVOTS} pivots")
    found = (
        docs.where(F.col("embedding").isNotNull())
        .select(order_key(seed, id_col).alias("key"), F.col(id_col).alias("id"), "embedding")
        .orderBy("key", "id")
        .limit(count)
        .toArrow()
        .sort_by([("key", "ascending"), ("id", "ascending")])
    )
    vectors = to_matrix(found["embedding"])
    tour = _tour(vectors)
    return Pivots(vectors[tour], tour)


def _tour(vectors: np.ndarray) -> np.ndarray:
    """An order in which each vector is followed by the nearest one not yet taken."""
    near = vectors @ vectors.T if len(vectors) else np.empty((0, 0))
    order = np.zeros(len(vectors), np.int64)
    for place in range(1, len(vectors)):
        near[:, order[place - 1]] = -np.inf
        order[place] = near[order[place - 1]].argmax()
    return order


def _nearest_first(vectors: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Rounded scores against the pivots as integers that order by score, then by seniority."""
    scaled = np.rint((1 + vectors @ pivots.vectors.T) / 2 * 1e6).astype(np.int64)
    return scaled * pivots.count + (pivots.count - 1 - pivots.seniority)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (vectors @ pivots.T), 0))


def assign_cells(docs: DataFrame, pivots: Pivots) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``cell_distance``; rows without a vector are dropped."""
    centres = pivots.vectors

    @F.arrow_udf("struct<cell: int, cell_distance: double>")
    @sliced
    def nearest(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.struct([("cell", pa.int32()), ("cell_distance", pa.float64())]))
        matrix = to_matrix(vectors)
        cells = _nearest_first(matrix, pivots).argmax(axis=1)
        gap = np.sqrt(np.maximum(2 - 2 * (matrix * centres[cells]).sum(axis=1), 0))
        return pa.StructArray.from_arrays(
            [pa.array(cells.astype(np.int32)), pa.array(gap)], names=["cell", "cell_distance"]
        )

    placed = docs.where(F.col("embedding").isNotNull()).withColumn("__near", nearest("embedding"))
    return placed.select(*docs.columns, "__near.cell", "__near.cell_distance")


def rank_copies(docs: DataFrame) -> DataFrame:
    """Add ``copy_rank``: place among the documents of the same source with the very same vector.

    Copies score alike and the lower id wins, so a search for k neighbours needs the first k copies
    only. Places beyond COPIES_RANKED stay null: each task keeps that many rows of a group before the
    shuffle, so a group of copies of any size ends as a few rows.
    """
    same = [F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")]
    source = [F.coalesce("source", F.lit(""))] if "source" in docs.columns else []
    narrow = docs.where(F.col("embedding").isNotNull()).select(
        "doc_id", F.struct(*[c.alias(f"h{i}") for i, c in enumerate((*same, *source))]).alias("__copy")
    )
    place = F.row_number().over(Window.partitionBy("__copy").orderBy("doc_id"))
    ranked = narrow.withColumn("copy_rank", place).where(F.col("copy_rank") <= COPIES_RANKED)
    return docs.join(ranked.select("doc_id", "copy_rank"), "doc_id", "left")


def build_index(docs: DataFrame, count: int, seed: int = 42) -> tuple[DataFrame, Pivots]:
    """Choose pivots for stored vectors and write the documents with their cells."""
    pivots = choose_pivots(docs, count, seed)
    return materialize(assign_cells(rank_copies(docs), pivots), "index"), pivots


def _cells_in_reach(
    matrix: np.ndarray, centres: np.ndarray, between: np.ndarray, cells: np.ndarray, sizes, closest, furthest, k: int
) -> np.ndarray:
    """For each query, which of the given cells may hold one of its k nearest documents."""
    everywhere = _distances(matrix, centres)
    to_cell = everywhere[:, cells]
    # k-th smallest upper bound: a cell offers one document within its closest member's reach and
    # the others within its radius
    reach = np.concatenate([to_cell + closest, to_cell + furthest], axis=1)
    amount = np.concatenate([np.ones_like(sizes), sizes - 1])
    # a cell of one document adds nothing by its radius: 2k entries hold k documents if there are so many
    few = min(2 * k, reach.shape[1])
    order = np.argpartition(reach, few - 1, axis=1)[:, :few]
    order = np.take_along_axis(order, np.take_along_axis(reach, order, axis=1).argsort(axis=1), axis=1)
    enough = amount[order].cumsum(axis=1) >= k
    kth = np.take_along_axis(reach, order, axis=1)[np.arange(len(matrix)), enough.argmax(axis=1)]
    kth[~enough.any(axis=1)] = np.inf
    by_radius = np.maximum(to_cell - furthest, 0)
    home = everywhere.argmin(axis=1)
    apart = between[home][:, cells]
    gap = to_cell**2 - everywhere[np.arange(len(matrix)), home][:, None] ** 2 - 4e-6
    by_bisector = np.where(apart > 0.01, gap / (2 * np.maximum(apart, 0.01)), 0)
    lower = np.maximum(by_radius, np.maximum(by_bisector, 0))
    return lower**2 <= kth[:, None] ** 2 + 1e-5  # scores that agree in 6 digits still compete


VISIT = "struct<areas: array<int>, cells: array<int>>"
VISIT_ARROW = pa.struct([("areas", pa.list_(pa.int32())), ("cells", pa.list_(pa.int32()))])


def _visitor(pivots: Pivots, k: int, probe: int | None):
    """Function from query vectors and the filled cells, in order, to a mask of the cells to visit."""
    centres = pivots.vectors
    between = _distances(centres, centres) if probe is None else None

    def visits(matrix: np.ndarray, number: np.ndarray, sizes, closest, furthest) -> np.ndarray:
        if probe is None:
            return _cells_in_reach(matrix, centres, between, number, sizes, closest, furthest, k)
        rank = _nearest_first(matrix, pivots)[:, number]
        nth = min(probe, len(number))
        return rank >= np.partition(rank, len(number) - nth, axis=1)[:, [len(number) - nth]]

    return visits


def _lists(rows: np.ndarray, values: np.ndarray, count: int, known: bool = True) -> pa.Array:
    """List column of the values that belong to each of ``count`` rows; all null unless known."""
    if not known:
        return pa.nulls(count, pa.list_(pa.int32()))
    offsets = np.concatenate([[0], np.bincount(rows, minlength=count).cumsum()]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values[rows.argsort(kind="stable")].astype(np.int32)))


CELL_FIELDS = ["cell", "area", "size", "closest", "furthest"]


def _visit(queries: DataFrame, cells: Lookup, pivots: Pivots, k: int, probe: int | None) -> DataFrame:
    """One row per query and ``area`` it visits, with the ``cells`` it may look at (null: all).

    The filled cells of all scopes go along with the function when they were measured small, else
    each query gets those of its scope by a join.
    """
    visits = _visitor(pivots, k, probe)
    scoped = "scope" in queries.columns
    if cells.fits or not scoped:  # without scopes: one row per pivot
        filled = (cells.rows or cells.table.toArrow()).to_pandas()
        known = {
            name: [rows[field].to_numpy() for field in CELL_FIELDS]
            for name, rows in (filled.groupby("scope") if scoped else [(ANY_SCOPE, filled)])
        }

        @F.arrow_udf(VISIT)
        @sliced
        def visited(vectors: pa.Array, scopes: pa.Array) -> pa.Array:
            return _by_scope(vectors, scopes, lambda name, _row: known.get(name), visits, probe is not None)

        scope = F.col("scope") if scoped else F.lit(ANY_SCOPE)
        placed = queries.withColumn("__visit", visited("embedding", scope))
    else:

        @F.arrow_udf(VISIT)
        def visited_joined(vectors: pa.Array, scopes: pa.Array, own: pa.Array) -> pa.Array:
            def known(_name: str, row: int) -> list[np.ndarray]:
                return [own[row].values.field(i).to_numpy() for i in range(len(CELL_FIELDS))]

            return _by_scope(vectors, scopes, known, visits, probe is not None)

        per_scope = cells.table.groupBy("scope").agg(F.collect_list(F.struct(*CELL_FIELDS)).alias("__filled"))  # <= pivots
        placed = salted_join(queries, per_scope, ["scope"], ["qid"]).withColumn(
            "__visit", visited_joined("embedding", "scope", "__filled")
        )
    return placed.withColumn("area", F.explode("__visit.areas")).withColumn("cells", F.col("__visit.cells"))


def _by_scope(vectors: pa.Array, scopes: pa.Array, known, visits, approximate: bool) -> pa.Array:
    """Areas (and cells) for the queries of one batch, scope by scope; unknown scopes visit nothing."""
    if len(vectors) == 0:
        return pa.array([], VISIT_ARROW)
    matrix = to_matrix(vectors)
    coded = scopes.dictionary_encode()
    codes = coded.indices.to_numpy()
    nothing = np.empty(0, np.int64)
    areas, cells = [(nothing, nothing)], [(nothing, nothing)]
    for code, name in enumerate(coded.dictionary.to_pylist()):
        rows = np.flatnonzero(codes == code)
        filled = known(name, int(rows[0])) if len(rows) else None
        if filled is None or not len(filled[0]):
            continue
        number, area, *rest = (field[filled[0].argsort()] for field in filled)
        mask = visits(matrix[rows], number, *rest)
        first = np.flatnonzero(np.diff(area, prepend=-1))  # areas are runs of cells
        at, which = np.nonzero(np.logical_or.reduceat(mask, first, axis=1))
        areas.append((rows[at], area[first][which]))
        if approximate:
            at, which = np.nonzero(mask)
            cells.append((rows[at], number[which]))
    parts = [tuple(np.concatenate(part) for part in zip(*found)) for found in (areas, cells)]
    columns = [_lists(*parts[0], len(matrix)), _lists(*parts[1], len(matrix), approximate)]
    return pa.StructArray.from_arrays(columns, fields=list(VISIT_ARROW))


Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # query row, document row, integer rank value (higher is better)


def _best_vectors(left: np.ndarray, right: np.ndarray, k: int) -> Found:
    """The k best documents per query by score in 6 digits, then by position.

    Single precision finds everything that may be among them: its error is below the margin, which
    also covers scores that agree in 6 digits. The few candidates are scored in double precision.
    """
    keep = min(k, len(right))
    products = left @ right.T
    rows, columns = np.nonzero(products >= at_least(products, keep) - margin_of(left.shape[1]))
    return first_per_row((rows, columns, exact_values(left, right, rows, columns)), keep)


def at_least(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that its k-th highest score reaches, as a column.

    The k-th highest of the maxima of groups of columns is one, as each of these is a score, and few others
    reach it. It takes two passes over the scores, where their exact order takes many.
    """
    width = scores.shape[1]
    groups = max(GROUPS, 4 * k)
    size = width // groups
    if size < 2:
        return np.partition(scores, width - k, axis=1)[:, [width - k]]
    maxima = scores[:, : groups * size].reshape(len(scores), groups, size).max(axis=2)
    return np.partition(maxima, groups - k, axis=1)[:, [groups - k]]


def margin_of(size: int) -> np.float32:
    """How far products in single precision may be off, and apart while their scores agree in 6 digits."""
    return np.float32(2 * size * 2.0**-24 + 4e-6)


def exact_values(left: np.ndarray, right: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Scores of the pairs in millionths, computed in double precision."""
    exact = np.empty(len(rows))
    for start in range(0, len(rows), CANDIDATES_AT_ONCE):
        part = slice(start, start + CANDIDATES_AT_ONCE)
        exact[part] = np.einsum("ij,ij->i", left[rows[part]].astype(np.float64), right[columns[part]].astype(np.float64))
    return np.rint((1 + exact) / 2 * 1e6).astype(np.int64)


def first_per_row(found: Found, k: int) -> Found:
    """The k entries of each row with the highest value, then the lowest column."""
    rows, columns, values = found
    order = np.lexsort((columns, -values, rows))
    place = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order])
    return tuple(part[order][place < k] for part in found)


def _best_codes(left: np.ndarray, right: np.ndarray, k: int) -> Found:
    """The k documents per query with most equal bits, then by position; bits are given as -1 and 1."""
    width, keep = len(right), min(k, len(right))
    equal = np.rint((left @ right.T + right.shape[1]) / 2).astype(np.int64)
    unique = equal * width + np.arange(width - 1, -1, -1)
    columns = np.argpartition(unique, width - keep, axis=1)[:, width - keep :].ravel()
    rows = np.repeat(np.arange(len(left)), keep)
    return rows, columns, equal[rows, columns]


def _groups(rows: np.ndarray, keys: np.ndarray) -> dict[int, np.ndarray]:
    """The rows of each key, in their order."""
    order = keys.argsort(kind="stable")
    known, first = np.unique(keys[order], return_index=True)
    return dict(zip(known.tolist(), np.split(rows[order], first[1:])))


def _meetings(mine: np.ndarray, theirs: np.ndarray, visited: pa.ListArray, cells: np.ndarray):
    """Query rows and document rows of one unit that are compared: all, or cell by cell when cells are listed."""
    if visited.null_count:
        yield mine, theirs
        return
    asked = np.repeat(mine, np.diff(visited.offsets.to_numpy()))
    asking = _groups(asked, visited.flatten().to_numpy())
    answering = _groups(theirs, cells[theirs])
    for cell in asking.keys() & answering.keys():
        yield asking[cell], answering[cell]


def _signs(column: pa.Array) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1


def _floats(column: pa.Array) -> np.ndarray:
    return to_matrix(column, np.float32)


@dataclass(frozen=True)
class Comparison:
    """What rows are compared by: a column of both sides, how a task reads it, and which pairs it keeps."""

    payload: str
    of_queries: Callable[[pa.Array], np.ndarray]
    of_documents: Callable[[pa.Array], np.ndarray]
    best: Callable[[np.ndarray, np.ndarray, int], Found]
    score: Callable[[np.ndarray, int], np.ndarray]  # from rank values and the width of a document's row
    ascending: bool = False
    ranked: bool = True  # only the k best of a query count; else every pair that ``best`` keeps


VECTORS = Comparison("embedding", _floats, _floats, _best_vectors, lambda values, _width: values / 1e6)
CODES = Comparison("code", _signs, _signs, _best_codes, lambda values, width: (width - values).astype(np.float64), True)


def _compare(k: int, by: Comparison):
    """Compare the queries and documents of one bundle, unit by unit, keeping k rows per query and unit."""

    def rows_by_unit(table: pa.Table, order: np.ndarray) -> dict[str, np.ndarray]:
        coded = table["unit"].combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        grouped = _groups(order, coded.indices.to_numpy()[order])
        return {names[code]: rows for code, rows in grouped.items()}

    def compare(_key: tuple, queries: pa.Table, docs: pa.Table) -> pa.Table:
        carried = [c for c in docs.column_names if c not in ("bundle", "unit", "cell", "vector")]
        nothing = np.empty(0, np.int64)
        found: list[Found] = [(nothing, nothing, nothing)]
        width = 0
        by_id = pc.sort_indices(docs, sort_keys=[("doc_id", "ascending")]).to_numpy().astype(np.int64)
        if queries.num_rows and docs.num_rows:
            asking, answering = rows_by_unit(queries, np.arange(queries.num_rows)), rows_by_unit(docs, by_id)
            visited, cells = queries["cells"].combine_chunks(), docs["cell"].to_numpy()
            place = by_id.argsort()  # orders like the id
            vectors, asked = docs["vector"].combine_chunks(), queries["vector"].combine_chunks()
            for unit in asking.keys() & answering.keys():
                looked_at = visited.take(pa.array(asking[unit]))
                for mine, theirs in _meetings(asking[unit], answering[unit], looked_at, cells):
                    right = by.of_documents(vectors.take(pa.array(theirs)))
                    width = right.shape[1]
                    step = max(1, SCORES_AT_ONCE // len(theirs))
                    for start in range(0, len(mine), step):
                        part = mine[start : start + step]
                        rows, columns, values = by.best(by.of_queries(asked.take(pa.array(part))), right, k)
                        found.append((part[rows], np.where(columns < 0, NO_DOCUMENT, place[theirs[columns]]), values))
        rows, columns, values = (np.concatenate(part) for part in zip(*found))
        if by.ranked:
            rows, columns, values = first_per_row((rows, columns, values), k)
        taken = by_id[columns] if docs.num_rows else columns
        hits = docs.select(carried).take(pa.array(taken, mask=columns < 0))
        scores = pa.array(by.score(values, width))
        return pa.table([queries["qid"].take(pa.array(rows)), *hits.columns, scores], names=["qid", *carried, "score"])

    return compare


def search(
    queries: DataFrame,
    index: DataFrame,
    pivots: Pivots,
    k: int,
    probe: int | None = None,
    carry: Sequence[str] = ("label",),
    by: Comparison = VECTORS,
) -> DataFrame:
    """The k nearest documents of every query: ``qid, doc_id, <carry>, score, rank``.

    ``queries`` has ``qid, embedding`` and ``index`` has ``doc_id, embedding, cell, cell_distance``
    and the carried columns; both may have ``scope``, and the index a ``copy_rank``. Compared ``by`` CODES both
    have a ``code`` too, which is compared instead of the vector; the score is the number of bits that
    differ.
    """
    return _search(queries, index, pivots, k, probe, carry, by)


def _search(
    queries: DataFrame,
    index: DataFrame,
    pivots: Pivots,
    k: int,
    probe: int | None,
    carry: Sequence[str],
    by: Comparison,
    is_slice: bool = False,
) -> DataFrame:
    payload = by.payload
    scope = ["scope"] if "scope" in queries.columns else []
    types = {f.name: f.dataType.simpleString() for f in (*queries.schema.fields, *index.schema.fields)}
    schema = ", ".join([f"qid {types['qid']}", f"doc_id {types['doc_id']}"])
    schema += "".join(f", `{c}` {types[c]}" for c in carry) + ", score double"
    if not pivots.count:  # nothing was ever indexed
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int" if by.ranked else schema)
    asked = queries.where(F.col("embedding").isNotNull())
    if "copy_rank" in index.columns and k <= COPIES_RANKED:
        index = index.where(F.col("copy_rank") <= k)
    docs = index.select(*scope, "cell", "cell_distance", "doc_id", *carry, payload)

    earlier = Window.partitionBy(*(scope or [F.lit(0)])).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = docs.groupBy(*scope, "cell").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("cell_distance").alias("closest"),
        F.max("cell_distance").alias("furthest"),
    )
    area = F.floor(F.coalesce(F.sum("size").over(earlier), F.lit(0)) / F.lit(BLOCK_ROWS)).cast("int")
    lookup = as_lookup(sizes.withColumn("area", area))  # the window runs over at most one row per pivot
    cells = lookup.table
    visits = _visit(asked, lookup, pivots, k, probe).select(*scope, "area", "cells", "qid", payload)
    if probe is not None:  # at most as many as pivots; a stored index reads these partitions only
        visited = [r.cell for r in visits.select(F.explode("cells").alias("cell")).distinct().collect()]
        docs = docs.where(F.col("cell").isin(visited))
    load = visits.groupBy(*scope, "area").agg(F.count(F.lit(1)).alias("visitors"))
    areas = as_lookup(
        load.join(cells.groupBy(*scope, "area").agg(F.sum("size").alias("size")), [*scope, "area"]).select(
            *scope,
            "area",
            F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("blocks"),
            F.ceil(F.col("visitors") / CHUNK_ROWS).cast("int").alias("chunks"),
            "size",
            "visitors",
        )
    )
    routed = _rows_routed(areas)
    if not is_slice and routed > LEAST_ROUTED:
        both = (cells.agg(F.sum("size")).first()[0] or 0) + asked.count()
        slices = -(-routed // max(LEAST_ROUTED, ROUTED_AT_ONCE * both))
        if slices > 1:
            own = F.pmod(F.xxhash64("qid", F.lit("slice")), F.lit(slices))
            each = (_search(asked.where(own == n), index, pivots, k, probe, carry, by, True) for n in range(slices))
            return functools.reduce(DataFrame.unionByName, [materialize(hits, "slice") for hits in each])
    bundles = max(-(-routed // BUNDLE_ROWS), int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = areas.with_table(areas.table.drop("size", "visitors"))
    unit = F.concat_ws("|", *scope, "area", "block", "chunk")
    left = (
        lookup_join(visits, cut, [*scope, "area"], ["qid"])
        .withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(unit.alias("unit"), "qid", "cells", F.col(payload).alias("vector"))
    )
    in_area = lookup_join(docs, lookup.with_table(cells.select(*scope, "cell", "area")), [*scope, "cell"], ["doc_id"])
    right = (
        lookup_join(in_area, cut, [*scope, "area"], ["doc_id"])
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(unit.alias("unit"), "doc_id", "cell", *carry, F.col(payload).alias("vector"))
    )
    # fresh column identities: both sides may stem from one table
    left, right = (
        side.select(F.pmod(F.xxhash64("unit"), F.lit(bundles)).alias("bundle"), *[F.col(c).alias(c) for c in side.columns])
        for side in (left, right)
    )
    hits = left.groupBy("bundle").cogroup(right.groupBy("bundle")).applyInArrow(_compare(k, by), schema)
    return rank_hits(hits, k, F.col("score").asc() if by.ascending else F.col("score").desc()) if by.ranked else hits


def probe_for(
    queries: DataFrame, index: DataFrame, pivots: Pivots, k: int, recall: float, sample: int = 200, seed: int = 42
) -> int:
    """How many cells a query must visit for a share ``recall`` of its k nearest, measured on a seeded sample of queries.

    A neighbour counts as found if the approximate search offers k at least as near.
    """
    asked = queries.where(F.col("embedding").isNotNull()).orderBy(order_key(seed, "qid"), "qid").limit(sample)
    asked = materialize(asked, "probe-sample")
    exact = materialize(search(asked, index, pivots, k).groupBy("qid").agg(F.min("score").alias("kth")), "probe-exact")
    probe = max(1, pivots.count // 16)
    while probe < pivots.count:
        near = search(asked, index, pivots, k, probe).groupBy("qid").agg(F.min("score").alias("near"), F.count(F.lit(1)).alias("n"))
        found = exact.join(near, "qid", "left").select(((F.col("n") >= k) & (F.col("near") >= F.col("kth"))).alias("found"))
        if (found.agg(F.avg(F.coalesce("found", F.lit(False)).cast("double"))).first()[0] or 0.0) >= recall:
            return probe
        probe = min(pivots.count, 2 * probe)
    return probe


def _rows_routed(areas: Lookup) -> int:
    """Rows both sides send to the units."""
    if areas.fits:
        size, chunks, visitors, blocks = (areas.rows[c].to_numpy() for c in ("size", "chunks", "visitors", "blocks"))
        return int((size * chunks + visitors * blocks).sum())
    return areas.table.agg(F.sum(F.expr("size * chunks + visitors * blocks"))).first()[0] or 0


def rank_hits(hits: DataFrame, size: int, best_first) -> DataFrame:
    """Keep the ``size`` best hits per query; document ids break ties."""
    order = Window.partitionBy("qid").orderBy(best_first, F.col("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def search_quantized(
    queries: DataFrame,
    index: DataFrame,
    pivots: Pivots,
    k: int,
    probe: int,
    oversample: int = 10,
    carry: Sequence[str] = ("label",),
) -> DataFrame:
    """Nearest cells, then sign bits to find k * oversample candidates, then full vectors to rank them."""
    candidates = materialize(
        search(queries, index, pivots, k * oversample, probe, (), CODES).select("qid", "doc_id"), "candidates"
    )
    return rescore(candidates, queries, index, k, carry)


def rescore(candidates: DataFrame, queries: DataFrame, index: DataFrame, k: int, carry: Sequence[str] = ("label",)) -> DataFrame:
    """The k best of each query's candidates (``qid, doc_id``) by their full vectors."""
    documents = index.select("doc_id", *carry, F.col("embedding").alias("__doc"))
    asked = queries.select("qid", F.col("embedding").alias("__query"))
    pairs = salted_join(candidates, documents, ["doc_id"], ["qid"]).join(asked, "qid")
    hits = pairs.select("qid", "doc_id", *carry, cosine_score("__query", "__doc").alias("score"))
    return rank_hits(hits, k, F.col("score").desc())
