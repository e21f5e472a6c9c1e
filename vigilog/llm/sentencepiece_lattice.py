"""SentencePiece encoding and decoding as joins: a lattice of pieces for each distinct word, folded by Spark."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from vigilog.llm.common import let, parts

BLANK = "▁"
#: Words of up to so many characters go through the lattice, whose cuts are the bits of a long; longer
#: ones, of any length, are encoded by the library in the task that answers.
LATTICE = 48
CHUNK_BYTES = 24 << 20
SHARDS_PER_CHUNK = 4
LEVEL = 3
#: Characters of a place in a word by which the longest piece that can begin there is known.
HEAD = 4
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Pieces:
    """What a model file says: its kind, ordinary pieces with id and score, and the id of each byte."""

    kind: int
    ids: dict[str, int]
    scores: dict[str, float]
    bytes_at: list[int]
    unknown: int
    path: str

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as data:
            model.ParseFromString(data.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that leave texts as they are and add a blank before them")
        ordinary = {p.piece: k for k, p in enumerate(model.pieces) if p.type == 1}
        if any(BLANK in p.lstrip(BLANK) for p in ordinary) or any("\n" in p for p in ordinary):
            raise ValueError("only models whose pieces hold blanks at their start and no line ends")
        in_bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == 6}
        unknown = next(k for k, p in enumerate(model.pieces) if p.type == 2)
        scores = {p: model.pieces[k].score for p, k in ordinary.items()}
        return cls(model.trainer_spec.model_type, ordinary, scores, [in_bytes.get(b, unknown) for b in range(256)], unknown, path)

    def table(self, spark: SparkSession) -> DataFrame:
        """``piece, score``; as large as the model's vocabulary."""
        return spark.createDataFrame(pa.table({"piece": list(self.ids), "score": [self.scores[p] for p in self.ids]}))

    def spelled(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes_at[b] for b in piece.encode("utf-8", "surrogatepass")]

    def meanings(self) -> list[bytes]:
        """The bytes that each id stands for."""
        size = max([*self.ids.values(), *self.bytes_at, self.unknown]) + 1
        found = [b""] * size
        for piece, k in self.ids.items():
            found[k] = piece.replace(BLANK, " ").encode()
        for b, k in enumerate(self.bytes_at):
            if k != self.unknown:
                found[k] = bytes([b])
        return found


_SEGMENT = re.compile(" *[^ \n]+| +|\n+")


def segments(text: str) -> list[str]:
    """The words of a text that no piece crosses, with spaces for the model's blanks: blanks and what follows them, and line ends apart."""
    return _SEGMENT.findall(" " + text.replace(BLANK, " ")) if text else []


def numbered(texts: list[str | None]) -> tuple[dict[str, int], list[np.ndarray]]:
    """The distinct words of texts with their numbers, in the order first met, and each text's words as numbers."""
    number: defaultdict[str, int] = defaultdict(count().__next__)
    each = [np.fromiter(map(number.__getitem__, found), np.int32, len(found)) for found in (segments(t or "") for t in texts)]
    return dict(number), each


def lattice(words: DataFrame, pieces: DataFrame, longest: int, shortest: int) -> DataFrame:
    """``shard, number, start, end, score``: all pieces of ``shortest`` characters and more in each word.

    Substrings of up to ``longest`` characters, and no longer than the longest piece with the same HEAD first characters, are
    exploded and joined with the pieces by equality. Single characters that are no piece have a null score. The rows keep the
    partitioning of the words.
    """
    start = words.select("shard", "number", "word", F.explode(F.sequence(F.lit(0), F.length("word") - shortest)).alias("start"))
    heads = pieces.groupBy(F.substring("piece", 1, HEAD).alias("head")).agg(F.max(F.length("piece")).alias("most"))
    start = start.withColumn("head", F.substring("word", F.col("start") + 1, F.lit(HEAD))).join(F.broadcast(heads), "head", "left")
    # without that head, pieces here are shorter than it
    most = F.greatest(F.lit(shortest), F.least(F.lit(longest), F.length("word") - F.col("start"), F.coalesce("most", F.lit(HEAD - 1))))
    each = start.select("shard", "number", "word", "start", F.explode(F.sequence(F.lit(shortest), most)).alias("n"))
    each = each.select("shard", "number", "start", "n", F.substring("word", F.col("start") + 1, F.col("n")).alias("piece"))
    edges = each.join(F.broadcast(pieces), "piece", "left" if shortest == 1 else "inner")
    if shortest == 1:
        edges = edges.where(F.col("score").isNotNull() | (F.col("n") == 1))
    return edges.select("shard", "number", "start", (F.col("start") + F.col("n")).alias("end"), "score")


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)


def merged(edges: DataFrame) -> DataFrame:
    """``shard, number, cuts`` by the merge rule: as long as two neighbours together are a piece, the one of
    the best score, of equal ones the leftmost, takes their place. Cuts are the set bits of a long, those of the
    word's ends left out; a word without an edge of two characters keeps all and has no row.

    An edge is packed into one long that orders by score (a whole number, as merge ranks are), then by start.
    """
    packed = (-F.col("score")).cast("bigint") * 65_536 + F.col("start") * 256 + F.col("end")
    words = edges.groupBy("shard", "number").agg(F.collect_list(packed).alias("edges"))

    def opened(edge: Column) -> Column:
        start, end = F.call_function("shiftright", edge, F.lit(8)).bitwiseAND(F.lit(255)), edge.bitwiseAND(F.lit(255))
        first, last = _bit(start.cast("int")), _bit(end.cast("int"))
        return F.struct((first + last).alias("outer"), (last - first * 2).alias("inner"))

    def step(cuts: Column, open_: Column) -> Column:
        may = F.filter(
            open_,
            lambda e: (cuts.bitwiseAND(e["outer"]) == e["outer"]) & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1),
        )
        return let(F.get(may, F.lit(0)), lambda e: F.coalesce(cuts - cuts.bitwiseAND(e["inner"]), F.bitwise_not(cuts)))

    every = _bit(F.lit(LATTICE + 1)) - 1
    # each merge removes the cut between its two parts, and there is an edge for it; a complement says that none is left
    folded = let(
        F.transform(F.sort_array("edges"), opened),
        lambda x: F.aggregate(
            F.sequence(F.lit(1), F.least(F.size(x), F.lit(LATTICE))),
            every,
            lambda cuts, _: F.when(cuts < 0, cuts).otherwise(step(cuts, x)),
            lambda cuts: F.when(cuts < 0, F.bitwise_not(cuts)).otherwise(cuts),
        ),
    )
    return words.select("shard", "number", folded.alias("cuts"))


def best_path(edges: DataFrame, unknown: float) -> DataFrame:
    """``shard, number, cuts`` of each word's best path (Viterbi): the largest sum of scores, of equal ones the longest last piece."""
    edge = F.struct("start", "end", F.coalesce("score", F.lit(unknown)).cast("double").alias("score"))
    words = edges.groupBy("shard", "number").agg(F.collect_list(edge).alias("edges"), F.max("end").alias("length"))
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))

    def reached(best: Column, end: Column) -> Column:
        into = F.transform(
            F.filter("edges", lambda e: e["end"] == end),
            lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("back")),
        )
        return F.concat(best, F.array(F.array_max(into)))

    paths = F.aggregate(F.sequence(F.lit(1), F.col("length")), first, reached)
    state = F.struct(F.col("length").alias("at"), F.lit(0).cast("bigint").alias("cuts"))

    def back(best: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.col("length")),
            state,
            lambda s, _: F.when(
                s["at"] > 0,
                F.struct((-F.get(best, s["at"])["back"]).alias("at"), (s["cuts"] + _bit(-F.get(best, s["at"])["back"])).alias("cuts")),
            ).otherwise(s),
            lambda s: s["cuts"],
        )

    return words.select("shard", "number", let(paths, back).alias("cuts"))


def cut_words(words: DataFrame, model: Pieces) -> DataFrame:
    """``shard, number, cuts`` of words of 1 to LATTICE characters."""
    longest, pieces = max(map(len, model.ids)), model.table(words.sparkSession)
    if model.kind == BPE:
        return merged(lattice(words.where(F.length("word") > 1), pieces, longest, 2))
    unknown = min(model.scores.values()) - UNKNOWN_PENALTY
    return best_path(lattice(words, pieces, longest, 1), unknown)


def _stored(value) -> bytes:
    return zstandard.ZstdCompressor(LEVEL).compress(pickle.dumps(value, 5))


def _restored(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _shard(word: str, shards: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % shards


def _chunks_of(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, list[pa.Array], list[str | None]]]:
    """The number, keys and texts of a task's chunks: the same ones whenever its rows come in the same order."""
    number, size, keys, texts = TaskContext.get().partitionId() << 32, 0, [], []
    for batch in batches:
        for k, value in enumerate(batch.column(1).to_pylist()):
            keys.append(batch.column(0).slice(k, 1))
            texts.append(value)
            size += len(value or "")
            if size >= chunk_bytes:
                yield number, keys, texts
                number, size, keys, texts = number + 1, 0, [], []
    if texts:
        yield number, keys, texts


def _chunked(docs: DataFrame, key: str, text: str, chunk_bytes: int) -> DataFrame:
    schema = StructType([StructField("chunk", LongType()), StructField("keys", ArrayType(docs.schema[key].dataType)), StructField("texts", BinaryType())])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, keys, texts in _chunks_of(batches, chunk_bytes):
            every = pa.concat_arrays(keys)
            lists = pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)
            yield pa.RecordBatch.from_arrays([pa.array([number]), lists, pa.array([_stored(texts)], pa.binary())], schema.names)

    return docs.select(key, text).mapInArrow(chunked, schema)


def encode(docs: DataFrame, model: Pieces, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``key, ids, round_trip`` for every row: its piece ids, and whether decoding them gives the text again.

    Texts are packed into chunks, which move once, to where their answers come; each chunk sends every shard the distinct words it
    needs, once, from where it is made. A shard's distinct words are cut by the lattice (the merge rule for BPE models, the best path for
    unigram models), and the answers go back to the chunks. The input should be a stored table, so that a chunk that
    is made again is the same.

    A null text has null ids, an empty one no ids; both are round trips. Characters the model lacks become
    its byte pieces. Equal rows are encoded alike. An empty table gives no rows.
    """
    n = SHARDS_PER_CHUNK * parts(docs, text, chunk_bytes)
    chunks = _chunked(docs, key, text, chunk_bytes)
    asked = StructType([StructField("shard", IntegerType()), StructField("chunk", LongType()), StructField("words", BinaryType())])
    blob = pa.binary()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in _chunks_of(batches, chunk_bytes):
            wanted: list[list[str]] = [[] for _ in range(n)]
            for word in sorted({word for value in texts for word in segments(value or "")}):
                wanted[_shard(word, n)].append(word.replace(" ", BLANK))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([number] * n, pa.int64()), pa.array(map(_stored, wanted), blob)], asked.names
            )
    found = StructType([StructField("shard", IntegerType()), StructField("number", IntegerType()), StructField("word", StringType())])

    def short(rows: pa.Table) -> list[str]:
        words: set[str] = set()
        for x in rows.column("words"):
            words.update(w for w in _restored(x.as_py()) if len(w) <= LATTICE)
        return sorted(words)

    def distinct(group: tuple, rows: pa.Table) -> pa.Table:
        words = short(rows)
        columns = [pa.array([group[0].as_py()] * len(words), pa.int32()), pa.array(range(len(words)), pa.int32()), pa.array(words, pa.string())]
        return pa.Table.from_arrays(columns, found.names)

    # one exchange, which the words and the answers both read
    requests = docs.select(key, text).mapInArrow(ask, asked).repartition(n, "shard")
    words = requests.groupBy("shard").applyInArrow(distinct, found).repartition(n, "shard")
    cut = cut_words(words, model)
    answered = StructType([StructField("chunk", LongType()), StructField("shard", IntegerType()), StructField("ids", BinaryType())])
    path, kind_of = model.path, np.uint16 if len(model.ids) < 65_000 else np.uint32
    ids_of, bytes_at, means = model.ids, model.bytes_at, model.meanings()

    def answer(group: tuple, cuts: pa.Table, rows: pa.Table) -> pa.Table:
        library, known, odd = None, {}, set()
        masks = dict(zip(cuts.column("number").to_pylist(), cuts.column("cuts").to_pylist()))

        def check(word: str, ids: list[int]) -> None:
            if b"".join([means[i] for i in ids]) != word.replace(BLANK, " ").encode("utf-8", "surrogatepass"):
                odd.add(word)

        for number, word in enumerate(short(rows)):
            last, ids, at, ordinary = 1 << len(word), [], 0, True
            left = masks.get(number, -1) & (last - 2) | last
            while left:
                end = (left & -left).bit_length() - 1
                left &= left - 1
                piece = word[at:end]
                if piece in ids_of:
                    ids.append(ids_of[piece])
                else:
                    ids += [bytes_at[b] for b in piece.encode("utf-8", "surrogatepass")]
                    ordinary = False
                at = end
            known[word] = ids
            if not ordinary:  # ordinary pieces stand for what they spell
                check(word, ids)
        replies = []
        for x in rows.column("words"):
            wanted = _restored(x.as_py())
            for word in wanted:
                if word not in known:
                    library = library or _Library(path)
                    known[word] = library.encode(word)
                    check(word, known[word])
            lists = [known[w] for w in wanted]
            flat = np.fromiter(chain.from_iterable(lists), kind_of)
            replies.append(_stored((np.fromiter(map(len, lists), np.int32), flat, [w in odd for w in wanted] if odd else None)))
        shard = [group[0].as_py()] * rows.num_rows
        return pa.Table.from_arrays([rows.column("chunk"), pa.array(shard, pa.int32()), pa.array(replies, blob)], answered.names)

    replies = cut.groupBy("shard").cogroup(requests.groupBy("shard")).applyInArrow(answer, answered)
    schema = StructType([docs.schema[key], StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])

    def assemble(group: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        texts = _restored(rows.column("texts")[0].as_py())
        number, each = numbered(texts)
        wanted: list[list[str]] = [[] for _ in range(n)]
        for word in sorted(number):
            wanted[_shard(word, n)].append(word)
        shards = {s: _restored(x.as_py()) for s, x in zip(replies.column("shard").to_pylist(), replies.column("ids"))}
        if [len(shards[s][0]) for s in range(n)] != [len(w) for w in wanted]:
            raise RuntimeError("the answers are those of another chunk")
        place = np.array([number[w] for words in wanted for w in words], np.int64)
        lengths, starts, odd = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        answered = np.concatenate([shards[s][0] for s in range(n)]).astype(np.int64)
        lengths[place], starts[place] = answered, np.cumsum(answered) - answered
        odd[place] = [x for s in range(n) for x in shards[s][2] or [False] * len(wanted[s])]
        flat = np.concatenate([shards[s][1] for s in range(n)])
        words = np.concatenate(each)
        sizes = lengths[words]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(starts[words] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        of_text = np.cumsum([0, *map(len, each)])
        offsets = pa.array(np.concatenate(([0], ends))[of_text], pa.int32())
        odd_before = np.concatenate(([0], np.cumsum(odd[words])))[of_text]
        back = (np.diff(odd_before) == 0) & ~np.array([BLANK in (t or "") for t in texts])
        gone = pa.array([t is None for t in texts])
        lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=gone)
        keys = rows.column("keys").combine_chunks().flatten()
        return pa.Table.from_arrays([keys, lists, pa.array(back)], schema.names)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(assemble, schema)


class _Library:
    """The library's own encoder for one word, without the blank it would put before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path, num_threads=1)

    def encode(self, word: str) -> list[int]:
        if word.startswith(BLANK):
            return self.processor.encode(word[1:].replace(BLANK, " "))
        # words after a line end have no blank: the ids after that of a line end
        return self.processor.encode("\n" + word.replace(BLANK, " "))[2:]


def decode(encoded: DataFrame, model: Pieces, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` of the piece ids: each id's bytes in a row, without the blank before the first.

    Null ids give a null text. Bytes that are no UTF-8 are replaced by the replacement character.
    """
    schema = StructType([encoded.schema[key], StructField("text", StringType())])
    path = model.path

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = Pieces.load(path).meanings()
        for batch in batches:
            texts = [None if i is None else b"".join(map(means.__getitem__, i))[1:].decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema.names)

    return encoded.select(key, ids).mapInArrow(decoded, schema)
