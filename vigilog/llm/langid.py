"""The language of a text: known words first, then shorter and shorter character runs."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from vigilog.llm.common import materialize
from vigilog.llm.strings import Rolling, edges, gathered

LONGEST = 4
# Characters whose runs are held at once: a task's memory follows it, unless one text is longer.
AT_ONCE = 1 << 18
FIT_DOCS = 4_000
WORDS = 200_000
GRAMS = 50_000
SMOOTHING = 0.5
UNDETERMINED = "und"


@dataclass(frozen=True)
class Table:
    """Sorted hashes, and for each a log frequency in every language."""

    hashes: np.ndarray
    scores: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 if unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


@dataclass(frozen=True)
class LanguageModel:
    """``tables[0]`` has words, ``tables[n]`` runs of n letters."""

    languages: list[str]
    tables: list[Table]


def _letters() -> np.ndarray:
    """Over all code points: 0 other, 1 mark, 2 letter."""
    kinds = np.zeros(0x110000, np.int8)
    for c in range(0x110000):
        x = chr(c)
        kinds[c] = 2 if x.isalpha() else unicodedata.category(x)[0] == "M"
    return kinds


@dataclass
class Words:
    """The words (runs of letters and marks, lower-cased) of some texts."""

    rolling: Rolling
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    lettered: np.ndarray

    @classmethod
    def of(cls, texts: list[str], letters: np.ndarray) -> Words:
        lower = [t.lower() for t in texts]
        codes = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = letters[codes]
        starts, ends = edges(kinds > 0)
        offsets = np.cumsum([0, *[len(t) + 1 for t in lower]])
        doc = np.searchsorted(offsets, starts, "right") - 1
        has = np.add.reduceat(kinds == 2, offsets[:-1]) > 0
        return cls(Rolling(codes), starts, ends, doc, has)

    def hashes(self) -> np.ndarray:
        return self.rolling.runs(self.starts, self.ends)

    def grams(self, n: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` letters in the chosen words, and each one's place among these."""
        counts = np.maximum(self.ends[chosen] - self.starts[chosen] - n + 1, 0)
        of = np.repeat(np.arange(len(chosen)), counts)
        first = np.cumsum(counts) - counts
        at = self.starts[chosen][of] + np.arange(len(of)) - first[of]
        return self.rolling.runs(at, at + n), of


def _score(words: Words, model: LanguageModel, n_docs: int) -> np.ndarray:
    """Summed log frequencies, documents by languages."""
    kinds = len(model.languages)
    each = np.zeros((len(words.starts), kinds), np.float32)
    row = model.tables[0].find(words.hashes())
    each[row >= 0] = model.tables[0].scores[row[row >= 0]]
    unseen = np.flatnonzero(row < 0)
    for n in range(LONGEST, 0, -1):
        if not len(unseen):
            break
        hashes, of = words.grams(n, unseen)
        row = model.tables[n].find(hashes)
        known = row >= 0
        times = np.bincount(of[known], minlength=len(unseen))
        some = times > 0
        for k in range(kinds):
            sums = np.bincount(of[known], model.tables[n].scores[row[known], k], len(unseen))
            each[unseen[some], k] = sums[some] / times[some]
        unseen = unseen[~some]
    return np.stack([np.bincount(words.doc, each[:, k], n_docs) for k in range(kinds)], axis=1)


def fit_languages(
    docs: DataFrame,
    may_learn: Column,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    fit_docs: int = FIT_DOCS,
    max_words: int = WORDS,
    max_grams: int = GRAMS,
    seed: int = 4,
) -> LanguageModel:
    """Log frequencies of words and character runs, learned from about ``fit_docs`` documents of each language.

    The sample is drawn by a seeded hash of key and text among rows that may be learned from and have a
    language. Words that the sample holds twice are known, the ``max_words`` most frequent of them;
    ``max_grams`` runs of each length from 1 to LONGEST. So the model's size has a bound.
    """
    rows = docs.where(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).agg(F.count(F.lit(1))).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], [])
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, fit_docs / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(seed), key, text), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < share).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    schema = StructType(
        [
            StructField("order", IntegerType()),
            StructField("hash", LongType()),
            StructField("lang", IntegerType()),
            StructField("n", LongType()),
        ]
    )
    place = {name: k for k, name in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), np.array([place[x] for x in batch.column(1).to_pylist()])
            for low, high in gathered(map(len, texts), AT_ONCE):
                words = Words.of(texts[low:high], letters)
                of_doc = names[low:high]
                every = np.arange(len(words.starts))
                for order in range(LONGEST + 1):
                    hashes, of = words.grams(order, every) if order else (words.hashes(), every)
                    spoken = of_doc[words.doc[of]]
                    for k in np.unique(spoken):
                        found, times = np.unique(hashes[spoken == k], return_counts=True)
                        rows = np.full(len(found), order, np.int32), found.view(np.int64), np.full(len(found), k, np.int32), times
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], schema.names)

    columns = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(languages))]
    tallies = materialize(
        sample.mapInArrow(counted, schema).groupBy("order", "hash").agg(F.sum("n").alias("n"), *columns).where("order > 0 or n > 1"),
        "language-counts",
    )
    tables = []
    for order in range(LONGEST + 1):
        most = tallies.where(F.col("order") == order).orderBy(F.desc("n"), "hash").limit(max_grams if order else max_words)
        found = most.drop("order", "n").orderBy("hash").toArrow()
        hashes = found.column("hash").to_numpy().view(np.uint64)
        times = np.stack([found.column(f"n{k}").to_numpy() for k in range(len(languages))], axis=1).astype(float)
        order_of = np.argsort(hashes)
        scores = np.log((times + SMOOTHING) / (times.sum(axis=0) + SMOOTHING * max(1, len(times))))
        tables.append(Table(hashes[order_of], scores[order_of].astype(np.float32)))
    return LanguageModel(languages, tables)


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The input's columns with ``lang_pred`` and ``score``, from the text alone.

    ``score`` is the posterior of the predicted language under equal priors. A text that is null or
    has no letter, and every text if nothing could be learned, gets ``und`` with score 0; of equally
    likely languages the first by name wins. Rows are independent of each other. Input columns with
    the names of result columns are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = StructType([*docs.select(*kept).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at = kept.index(text)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, [(t.hashes, t.scores) for t in model.tables]))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, (languages, tables) = _letters(), sent.value
        model = LanguageModel(languages, [Table(*t) for t in tables])
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            names, sure = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            for low, high in gathered(map(len, texts), AT_ONCE) if model.languages else ():
                words = Words.of(texts[low:high], letters)
                totals = _score(words, model, high - low)
                best = totals.argmax(axis=1)
                odds = np.exp(totals - totals.max(axis=1, keepdims=True))
                share = 1 / odds.sum(axis=1)
                for k in np.flatnonzero(words.lettered):
                    names[low + k], sure[low + k] = model.languages[best[k]], share[k]
            made = [pa.array(names, pa.string()), pa.array(sure)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(predicted, schema)
