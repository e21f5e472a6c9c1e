"""Token sequences of a fixed length out of whole documents: best-two-fit packing."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from vigilog.llm.common import parts

SEQUENCE = 1024
END_ID = 2
PART_BYTES = 24 << 20
#: Pieces whose ids have 32 bits at a time.
PIECES_AT_ONCE = 1024

Encode = Callable[[str], list]


def byte_bpe(ranks: str, vocabulary: str, pattern: str) -> Callable[[], Encode]:
    """A loader of the byte-level BPE encoder stored as merge ranks, which is three times as fast as the JSON form.

    Both files hold the same vocabulary. A text that spells a special token goes to the JSON form,
    which knows those.
    """

    def load() -> Encode:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        exact: list[Tokenizer] = []

        def encode(text: str) -> list:
            if "<|" not in text:
                return fast.encode_ordinary(text)
            if not exact:
                exact.append(Tokenizer.from_file(vocabulary))
            return exact[0].encode(text, add_special_tokens=False).ids

        return encode

    return load


def token_pieces(
    docs: DataFrame, load: Callable[[], Encode], key: str, text: str, longest: int, end_id: int, narrow: bool = False
) -> DataFrame:
    """``key, piece, start, length, ids``: the token ids (little-endian unsigned 32-bit) of each document's pieces.

    A document of more than ``longest`` ids is cut so that all pieces but the first are full. If ``narrow``, the ids of
    documents whose ids allow it have 16 bits.
    """
    schema = StructType(
        [
            docs.schema[key],
            StructField("piece", IntegerType()),
            StructField("start", LongType()),
            StructField("length", LongType()),
            StructField("ids", BinaryType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                rows: list[list] = [[], [], [], [], []]
                for place, value in enumerate(some.column(1)):
                    ids = encode(value.as_py() or "")
                    ids.append(end_id)
                    stored = np.array(ids, dtype="<u2" if narrow and max(ids) < 1 << 16 else "<u4")
                    start, piece = 0, 0
                    while start < len(stored):
                        end = start + ((len(stored) - start) % longest or longest)
                        for column, x in zip(rows, (place, piece, start, end - start, stored[start:end].tobytes())):
                            column.append(x)
                        start, piece = end, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(rows[0], pa.int64())),
                        pa.array(rows[1], pa.int32()),
                        pa.array(rows[2], pa.int64()),
                        pa.array(rows[3], pa.int64()),
                        pa.array(rows[4], pa.binary()),
                    ],
                    [key, "piece", "start", "length", "ids"],
                )

    return docs.select(key, text).mapInArrow(cut, schema)


def _widened(some: pa.RecordBatch) -> pa.RecordBatch:
    """The pieces with ids of 32 bits each."""
    lengths, stored = some.column("length").to_pylist(), some.column("ids")
    ids = [np.frombuffer(x.as_buffer(), f"<u{len(x.as_buffer()) // n}").astype("<u4").tobytes() for x, n in zip(stored, lengths)]
    return some.set_column(some.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each item; every length is from 1 to ``size``.

    A bin is filled greedily, largest fitting item first. Then its smallest item gives way to the two
    waiting items with the largest sum that fits the widened gap, if they fill it better.
    Items of one length are interchangeable, so they wait in a stack for each length.
    """
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(size + 2))
    waiting = np.diff(ends)  # by length
    free = ends[:-1].copy()  # the next item of each length
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    every = np.arange(size + 1)

    def below() -> np.ndarray:
        """For each room the largest waiting length that fits it, 0 if none."""
        return np.maximum.accumulate(np.where(waiting > 0, every, 0))

    left, current = len(lengths), 0
    while left:
        fitting, room, taken = below(), size, []
        while room and (most := int(fitting[room])):
            n = min(int(waiting[most]), room // most)
            waiting[most] -= n
            room -= n * most
            taken += [most] * n
            if not waiting[most]:
                fitting = below()
        if room and len(taken) > 1:
            taken = _exchanged(taken, room, waiting, below(), every)
        place = 0
        for length in taken:
            item = order[free[length]]
            free[length] += 1
            bins[item], places[item] = current, place
            place += length
        left -= len(taken)
        current += 1
    return bins, places


def _exchanged(taken: list[int], room: int, waiting: np.ndarray, fitting: np.ndarray, every: np.ndarray) -> list[int]:
    """The bin's lengths after its smallest made room for the best two that wait; ``waiting`` follows."""
    smallest = taken[-1]
    wide = room + smallest
    first = every[1:wide][waiting[1:wide] > 0]
    second = np.minimum(fitting[wide - first], first)
    alone = (second == first) & (waiting[first] < 2)
    second = np.where(alone, fitting[np.maximum(first - 1, 0)], second)
    sums = np.where(second > 0, first + second, 0)
    if not len(sums) or sums.max() <= smallest:
        return taken
    best = int(sums.argmax())
    two = [int(first[best]), int(second[best])]
    waiting[smallest] += 1
    for length in two:
        waiting[length] -= 1
    return [*taken[:-1], *two]


def pack(
    docs: DataFrame,
    load: Callable[[], Encode],
    key: str = "doc_id",
    text: str = "text",
    size: int = SEQUENCE,
    end_id: int = END_ID,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    Gives ``key, piece, start, length, ids, sequence_id, offset`` for each piece. Pieces are dealt
    evenly to parts of about ``part_bytes`` of text, whatever keys they carry, and each part packs its
    own: only the last sequences of a part are less full than those of one packing of everything.

    A null text is an empty one, of the end id alone. Repeated rows are packed as often as they occur.
    An empty table gives no rows. The order of the pieces in a part decides which of equal lengths go
    together, so a part that is computed again may place them otherwise: write the result once.
    """
    docs = docs.select(key, text)
    pieces = token_pieces(docs, load, key, text, size, end_id, narrow=True)  # a part's ids are held, and moved, in half the bytes
    dealt = pieces.repartition(parts(docs, text, part_bytes))
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        found = pa.Table.from_batches(rows)
        bins, places = best_two_fit(found.column("length").to_numpy(), size)
        bins = bins + (TaskContext.get().partitionId() << 32)
        found = found.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(places))
        yield from map(_widened, found.to_batches(PIECES_AT_ONCE))

    return dealt.mapInArrow(packed, schema)
