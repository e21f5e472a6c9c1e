"""Train an n-gram model on part of a corpus and score all of it, with the model sharded over the cluster."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from vigilog.llm import elias_fano
from vigilog.llm.common import parts
from vigilog.llm.elias_fano import EliasFano
from vigilog.llm.ngram_trie import CONTEXT_BITS, KEY_BITS, ORDER, WORD_BITS, Level, Words, frequencies, pack_counts, summed, unpack_counts
from vigilog.llm.strings import FACTOR, distinct, mixed, word_hashes

CHUNK_BYTES = 8 << 20
CHUNKS_PER_SHARD = 2
#: Strength of the lower order: PRIOR * count of the context ** (log V / log N).
PRIOR = 4.0
END = np.uint64(0x656E64656E64656E)
MOST_SHARDS = 1 << (64 - KEY_BITS)

REQUEST = StructType(
    [
        StructField("shard", IntegerType()),
        StructField("chunk", IntegerType()),
        *[StructField(f"{kind}{n}", BinaryType()) for n in range(1, ORDER + 1) for kind in ("keys", "counts")],
    ]
)
REPLY = StructType(
    [
        StructField("chunk", IntegerType()),
        StructField("shard", IntegerType()),
        StructField("tokens", LongType()),
        StructField("types", LongType()),
        *[StructField(f"found{n}", BinaryType()) for n in range(1, ORDER + 1)],
    ]
)


class Tokens:
    """The tokens of a chunk of texts: each text's words, then one end; and the n-grams that end at each token."""

    def __init__(self, texts: list[str | None], shards: int):
        words, firsts = word_hashes(texts)
        sizes = np.diff(firsts)
        self.firsts = firsts + np.arange(len(firsts))
        self.codes = np.full(len(words) + len(texts), END, np.uint64)
        self.doc = np.repeat(np.arange(len(texts)), sizes + 1)
        place = np.arange(len(self.codes)) - self.firsts[:-1][self.doc]
        self.codes[place < sizes[self.doc]] = words
        self.place, self.shards = place, np.uint64(shards)

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """For all tokens with ``order - 1`` predecessors: a key that sorts by shard, and the token."""
        if order == 1:
            return self.codes, np.arange(len(self.codes))
        at = np.flatnonzero(self.place >= order - 1)
        context = self.codes[at - order + 1]
        for k in range(order - 2, 0, -1):
            context = mixed(context * np.uint64(FACTOR) + self.codes[at - k])
        word = self.codes[at]
        whole = mixed(context * np.uint64(FACTOR) + word)
        shard = ((whole >> np.uint64(32)) * self.shards) >> np.uint64(32)
        key = (mixed(context) >> np.uint64(64 - CONTEXT_BITS)) << np.uint64(WORD_BITS) | whole & np.uint64((1 << WORD_BITS) - 1)
        return shard << np.uint64(KEY_BITS) | key, at

    def shard_of(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order == 1:
            return ((keys >> np.uint64(32)) * self.shards) >> np.uint64(32)
        return keys >> np.uint64(KEY_BITS)


def _requests(chunk: int, texts: list, learn: np.ndarray, shards: int) -> list[tuple]:
    """For each shard the chunk's distinct n-grams in order, and how often its learning texts hold each."""
    tokens = Tokens(texts, shards)
    rows: list[list] = [[s, chunk] for s in range(shards)]
    for order in range(1, ORDER + 1):
        keys, at = tokens.keys(order)
        taught = learn[tokens.doc[at]]
        known, times = distinct(keys[taught])
        every, _ = distinct(np.concatenate((known, keys[~taught])))
        counts = np.zeros(len(every), np.int64)
        counts[np.searchsorted(every, known)] = times
        cuts = np.searchsorted(tokens.shard_of(order, every), np.arange(shards + 1).astype(np.uint64))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            own = every[a:b] if order == 1 else every[a:b] & np.uint64((1 << KEY_BITS) - 1)
            rows[s] += [elias_fano.encode(own, 64 if order == 1 else KEY_BITS), pack_counts(counts[a:b])]
    return [tuple(r) for r in rows]


def _answers(requests: pa.Table) -> list[tuple]:
    """Build the shard's levels from what all chunks have counted, and look up each chunk's n-grams."""
    chunks, shard = requests.column("chunk").to_pylist(), requests.column("shard")[0].as_py()
    rows: list[list] = [[c, shard] for c in chunks]
    for order in range(1, ORDER + 1):
        keys = [EliasFano(x.as_buffer()).all() for x in requests.column(f"keys{order}")]
        distinct, counts = summed(keys, [unpack_counts(x.as_py()) for x in requests.column(f"counts{order}")])
        if order == 1:
            level = Words(distinct, counts)
            for row in rows:
                row += [int(counts.sum()), len(distinct)]
        else:
            level = Level(distinct, counts)
        for row, asked in zip(rows, keys):
            row.append(pack_counts(level.find(asked).astype(np.int64)))
    return [tuple(r) for r in rows]


def _scores(texts: list, replies: pa.Table, shards: int) -> tuple[np.ndarray, ...]:
    """Each text's tokens, known tokens, base score and score, and the size of the training part."""
    tokens = Tokens(texts, shards)
    replies = replies.sort_by("shard")
    if replies.column("shard").to_pylist() != list(range(shards)):
        raise RuntimeError("a shard has not answered")
    total, types = sum(replies.column("tokens").to_pylist()), sum(replies.column("types").to_pylist())
    heaps = math.log(types) / math.log(total) if types > 1 and total > 1 else 1.0
    chance = counts = None
    n_known = base = None
    n = len(tokens.codes)
    for order in range(1, ORDER + 1):
        keys, at = tokens.keys(order)
        answered = np.concatenate([unpack_counts(x.as_py()) for x in replies.column(f"found{order}")])
        by_key = np.argsort(keys)
        keys = keys[by_key]
        number = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        if len(answered) != (number[-1] + 1 if len(keys) else 0):
            raise RuntimeError("the answers are those of another chunk")
        found = np.empty(len(keys), np.int64)
        found[by_key] = answered[number]
        if order == 1:
            counts = found.astype(float)
            chance = (counts + 1) / (total + types + 1)
            n_known = np.bincount(tokens.doc, found > 0, len(texts)).astype(np.int64)
            base = np.bincount(tokens.doc, np.log10(chance), len(texts))
            continue
        # counts still holds the frequency of the n-gram that is one word shorter, at its last token
        of_context = counts[at - 1]
        seen = of_context > 0
        at, of_context, own = at[seen], of_context[seen], frequencies(found[seen])
        strength = PRIOR * of_context**heaps
        chance[at] = (own + strength * chance[at]) / (np.maximum(of_context, own) + strength)
        longer = np.zeros(n)
        longer[at] = own
        counts = longer
    score = np.bincount(tokens.doc, np.log10(chance), len(texts))
    return np.diff(tokens.firsts), n_known, base, score, total


def score_texts(docs: DataFrame, learns: Column, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``key, learned, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model is learned from the rows where ``learns`` holds. Texts are dealt to chunks of about ``chunk_bytes``;
    a chunk counts its n-grams of one to ORDER tokens and sends each shard of the model its distinct ones.
    A shard sums what all chunks have counted into a trie level for each length, looks up every chunk's n-grams
    there and answers with 8-bit log-scale frequencies (exact counts of words). The chunk, whose texts
    were shuffled once, then scores its texts: p(w | h) = (c(hw) + s p(w | shorter h)) / (c(h) + s) with
    s = PRIOR * c(h) ** heaps, where heaps = log V / log N; the base score's add-one chance of the word ends
    the recursion, and an unseen context leaves the shorter one's chance. N-grams are dealt to shards by
    a hash of all their words, so a frequent word or context is spread like any other, and each chunk
    sends an n-gram once however often it holds it. N-grams of two and more words are compared by 46 bits of a
    hash within a shard, words by 64.

    A null text is an empty one, of the end token alone. Equal rows are scored and learned from as often
    as they occur. Without rows to learn from every chance is 1 by the base formula. An empty table gives no rows.
    """
    docs = docs.select(F.col(key), F.col(text), F.coalesce(learns, F.lit(False)).alias("__learns"))
    chunks = parts(docs, text, chunk_bytes)
    n = min(-(-chunks // CHUNKS_PER_SHARD), MOST_SHARDS)
    keyed = docs.withColumn("__chunk", F.pmod(F.xxhash64(key, text), F.lit(chunks)).cast("int"))

    def ask(group: tuple, rows: pa.Table) -> pa.Table:
        learn = rows.column("__learns").to_numpy()
        found = _requests(group[0].as_py(), rows.column(text).to_pylist(), learn, n)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), REQUEST_TYPES)], REQUEST.names)

    def answer(group: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*_answers(rows)), REPLY_TYPES)], REPLY.names)

    schema = StructType(
        [
            docs.schema[key],
            StructField("learned", BooleanType()),
            StructField("n_tokens", LongType()),
            StructField("n_known", LongType()),
            StructField("train_tokens", LongType()),
            StructField("base_score", DoubleType()),
            StructField("score", DoubleType()),
        ]
    )

    def score(group: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        sizes, known, base, total_score, total = _scores(rows.column(text).to_pylist(), replies, n)
        made = [sizes.astype(np.int64), known, np.full(len(sizes), total, np.int64), base, total_score]
        return pa.Table.from_arrays([rows.column(key), rows.column("__learns"), *map(pa.array, made)], schema.names)

    replies = keyed.groupBy("__chunk").applyInArrow(ask, REQUEST).groupBy("shard").applyInArrow(answer, REPLY)
    return keyed.groupBy("__chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, schema)


REQUEST_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * (2 * ORDER)]
REPLY_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * ORDER]
