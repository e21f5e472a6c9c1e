"""Periodic runs of words, found from a grid of candidates by extensions on a recompression grammar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from vigilog.llm.common import beside
from vigilog.llm.recompression import Grammar
from vigilog.llm.strings import gathered

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
#: Characters whose words share one grammar, and candidates that are extended at once.
CHARACTERS = 1 << 21
CANDIDATES = 1 << 20

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
MADE = ("n_words", "runs", "collapsed")


def _grid(codes: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``g`` and periods ``q``, in portions, such that every run of period q holds one of its places.

    A run of three periods holds three multiples of q (counted from its text's start), and the words there agree.
    """
    order = np.argsort(-sizes, kind="stable")
    offsets, sizes = offsets[order], sizes[order]
    places, periods, held = [], [], 0
    for q in range(1, int(sizes.max(initial=0)) // LEAST_EXPONENT + 1):
        n = int(np.searchsorted(-sizes, -max(LEAST_LENGTH, LEAST_EXPONENT * q), side="right"))
        if not n:
            break
        counts = (sizes[:n] - 1) // q - 1
        ends = np.cumsum(counts)
        g = np.repeat(offsets[:n] - q * (ends - counts), counts) + q * np.arange(ends[-1])
        g = g[(codes[g] == codes[g + q])]
        g = g[(codes[g] == codes[g + 2 * q]) & (codes[g + 1] == codes[g + q + 1])]
        if len(g):
            places.append(g)
            periods.append(np.full(len(g), q))
            held += len(g)
            if held >= CANDIDATES:
                yield np.concatenate(places), np.concatenate(periods)
                places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def _least_periods(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different stretch once, with its least period: a stretch that is maximal for a multiple is maximal for the period too."""
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return start[fresh], stop[fresh], period[fresh]


def runs_of(words: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs as rows ``start, length, period``, by start, then period."""
    sizes = np.array([len(w) for w in words], np.int64)
    offsets = np.cumsum(sizes + 1) - sizes
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [x for w in words for x in w]
    named, different = pd.factorize(flat)
    # a code of its own before, between and behind the texts ends every extension there
    codes = len(different) + np.arange(int(sizes.sum()) + len(words) + 1, dtype=np.int64)
    inside = np.ones(len(codes), bool)
    inside[np.append(0, offsets + sizes)] = False
    codes[inside] = named
    found = (np.zeros(0, np.int64),) * 3
    if len(flat) and int(sizes.max()) >= LEAST_LENGTH:
        grammar = Grammar(codes, enough=16 + 4 * len(words))
        for g, q in _grid(codes, offsets, sizes):
            ahead = grammar.after(g, g + q)
            near = ahead > q
            g, q, ahead = g[near], q[near], ahead[near]
            start, stop = g - grammar.before(g, g + q), g + q + ahead
            long = stop - start >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * q)
            found = _least_periods(*(np.concatenate(x) for x in zip(found, (start[long], stop[long], q[long]))))
    start, stop, period = found
    order = np.lexsort((period, start))
    start, stop, period = start[order], stop[order], period[order]
    cuts = np.searchsorted(start, np.append(offsets, len(codes)))
    shifted = np.repeat(offsets, np.diff(cuts))
    rows = np.stack((start - shifted, stop - start, period), axis=1)
    return [rows[cuts[k] : cuts[k + 1]] for k in range(len(words))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``n_words``, its ``runs`` (array of start, length, period by start, then period) and its ``collapsed`` text.

    A run is a stretch of consecutive words whose least period is ``period``, of at least LEAST_LENGTH words and
    LEAST_EXPONENT periods, that no neighbouring word extends. Words are those of ``[^\\x20\\x09-\\x0D]+``; they are compared
    as they stand. Map-only: the texts of a batch share one grammar, and a text of any length is taken whole (a very long one
    has a grammar of its own, of about four symbols a word).

    A null, empty or blank text has no words, no runs and an empty collapsed text. Equal rows give equal rows; an empty
    table gives no rows; null keys stay. Columns named like the operator's own are replaced, all others are carried.
    """
    docs = beside(docs, *(c for c in MADE if c != text))
    schema = StructType(
        [*docs.schema.fields, StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]
    )
    at = docs.columns.index(text)
    types = pa.struct([(f.name, pa.int64()) for f in RUN.fields])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            for begin, end in gathered(map(len, texts), CHARACTERS):
                words = [t.split() for t in texts[begin:end]]
                runs = runs_of(words)
                rows = np.concatenate([np.zeros((0, 3), np.int64), *runs])
                ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
                values = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(types))
                made = [
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.ListArray.from_arrays(ends, values),
                    pa.array([collapsed(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string()),
                ]
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], schema.names)

    return docs.mapInArrow(found, schema)


def greatest(runs: Column) -> Column:
    """The run of the greatest exact length over period; of equal ones the first in order. Null without runs."""
    higher = lambda best, run: run["length"] * best["period"] > best["length"] * run["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, run: F.when(higher(best, run), run).otherwise(best))
