"""Jaccard join on word shingles by adaptive prefixes of which several tokens must match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from vigilog.llm.common import materialize
from vigilog.llm.setjoin import classes_of, in_parts, linked, named, shingle_sets, signatures, verified
from vigilog.session import tidy

SHINGLE = 3
PERCENT = 90
#: Parity bits for each shingle of a set, at least.
PARITIES = 2
#: Counters of token frequencies. They only order tokens and estimate costs, so their collisions cost time, never links.
SLOTS = 1 << 20
BLOCK = 1 << 12
#: Tokens that a task gathers before it counts them.
TOKENS_AT_ONCE = 1 << 18
#: The most tokens that a prefix asks for, and the cost of carrying a token further, in that of comparing one token of a pair.
MOST_MATCHES = 8
CARRIED = 0.05


def slot_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """In how many rows the tokens of each slot occur, over all rows; SLOTS numbers.

    Tasks sum their own rows; sums meet block by block, first of a few tasks each, then of all.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(SLOTS, np.int64), [np.zeros(0, np.uint64)], 0

        def add() -> None:
            nonlocal total
            total += np.bincount((np.concatenate(held) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)

        for batch in batches:
            for part in in_parts(batch, 0):
                sets = shingle_sets(part.column(0).to_pylist(), SHINGLE)
                held, n = held + sets, n + sum(map(len, sets))
                if n >= TOKENS_AT_ONCE:
                    add()
                    held, n = held[:1], 0
        add()
        blocks = [part.tobytes() for part in total.reshape(-1, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for counts in table["counts"]:
            total += np.frombuffer(counts.as_buffer(), np.int64)
        return pa.table({"block": table["block"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select(text).mapInArrow(counted, "block int, counts binary")
    few = parts.groupBy("block", F.pmod(F.spark_partition_id(), F.lit(64)).alias("part"))
    few = few.applyInArrow(lambda table: summed(table), "block int, counts binary")
    found = few.groupBy("block").applyInArrow(lambda table: summed(table), "block int, counts binary").orderBy("block").toArrow()
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in found["counts"])])


def least_common(n: int) -> int:
    """What a set of n tokens must share with any set that it links with."""
    return -(-PERCENT * n // 100)


def prefix_of(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """A set's first tokens, rarest first, and how many of them another set's prefix must share.

    A set of n tokens that links shares at least c of them, so its first n - c + m tokens hold at least m shared ones. The
    candidates that share m of a prefix are at most the tokens' other rows over m; the prefix is lengthened while the
    comparisons that this spares are worth more than the tokens it carries along.
    """
    n, c = len(tokens), least_common(len(tokens))
    held = counts[(tokens % np.uint64(SLOTS)).astype(np.int64)]
    tokens = tokens[np.lexsort((tokens, held))]
    others = np.maximum(np.sort(held) - 1 - counts.sum() / SLOTS, 0.0)
    shortest, most = n - c + 1, min(MOST_MATCHES, c)
    matches = np.arange(1, most + 1)
    candidates = np.cumsum(others)[shortest - 1 : shortest - 1 + most] / matches
    cost = n * candidates + CARRIED * shortest * matches
    best = int(cost.argmin()) + 1
    return tokens[: shortest + best - 1], best


def _meets(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the prefixes of a pair share as many tokens as the lesser extension of both asks for."""
    listed = table["tokens"].combine_chunks()
    ends, flat = listed.offsets.to_numpy(), listed.values.to_numpy()
    n, matches = table["n"].to_numpy(), table["matches"].to_numpy()
    kept = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(i, j)):
        asked = min(matches[x], matches[y])
        common = -(-PERCENT * (n[x] + n[y]) // (100 + PERCENT))
        left = flat[ends[x] : ends[x] + n[x] - common + asked]
        shared = np.isin(left, flat[ends[y] : ends[y] + n[y] - common + asked])
        kept[k] = shared.sum() >= asked
    return kept


@tidy("jaccard-join")
def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row; texts link whose shingle sets have a Jaccard of PERCENT or more.

    Rows with one set form a class. A class is listed under its shortest prefix's tokens, rarest first by counts over all rows; so two
    classes that link share the list of their first common token. Each class also carries its adaptive prefix, and a pair is
    verified only if both prefixes, cut to the lesser extension, share the number of tokens that this extension asks
    for. In a list all meet its first class, then members of different components meet, in units however long the list; sizes and
    parities, which cannot hide a link, rule pairs out before.

    A null, empty or blank text has no shingles and links with nothing: its component is its own key. Equal rows share a
    component. A null key is never the least of a component with other keys. An empty table gives no rows. Texts of any
    length are taken whole. No other columns are read or returned, so their names do not matter. Intermediates go when the
    result is written.
    """
    docs = docs.select(key, text)
    counts = slot_counts(docs, text)

    def prefixes(sets: list[np.ndarray]) -> list[pa.Array]:
        found = [prefix_of(s, counts) if len(s) else (s, 0) for s in sets]
        ends = pa.array(np.cumsum([0, *(len(tokens) for tokens, _ in found)]), pa.int32())
        flat = np.concatenate([np.zeros(0, np.uint64), *(tokens for tokens, _ in found)]).view(np.int64)
        return [pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array([best for _, best in found], pa.int64())]

    payload = {"tokens": ArrayType(LongType()), "matches": LongType()}
    signed = materialize(signatures(docs, key, text, SHINGLE, PARITIES, payload, prefixes), "signatures")
    classes = classes_of(signed, key, list(payload))
    shortest = F.col("n") - F.expr(f"({PERCENT} * n + 99) div 100") + 1
    lists = classes.select(F.explode(F.slice("tokens", F.lit(1), shortest.cast("int"))).alias("bucket"), "cid")
    confirm = lambda pairs: verified(pairs, classes, docs, key, text, SHINGLE, PERCENT)
    return named(signed, classes, linked(lists, classes, confirm, PERCENT, list(payload), _meets), key)
