"""What the joins on shingle sets share: classes of equal sets, lossless bounds, verification on full sets, components.

Rows with one set form a class and only classes are compared. An operator puts classes into lists (a band's bucket, a
shared token) such that any two classes that link share a list. Each list's members first meet its first class only.
Then, in lists whose members still lie in several components, members of different components meet, in units
of UNIT by UNIT classes: first, in a few of its lists, each with the few whose parities are nearest, then, as what links has merged,
with more, at last with all in all its lists. Before two sets are compared in full, their sizes and their parities must allow the link;
first their parities over few places, so that pairs that share a list by chance move little.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType, StructField, StructType

from vigilog.llm.common import materialize
from vigilog.llm.graph import components
from vigilog.llm.strings import gathered, sequence_hashes, word_hashes

UNIT = 256
#: Pairs of places in units of one task, and 64-bit words of parities and bytes of texts that it works on at once.
BUNDLE_ROWS = 20_000
WORDS_AT_ONCE = 1 << 18
TEXT_AT_ONCE = 1 << 18
BROADCAST_ROWS = 500_000
#: How many others of different components a class is compared with in each round, in how many of its lists; after these, with all in all.
ROUNDS = (2, 32)
LISTS = 4
#: How many times fewer places (64 at least) the parities have that every pair of a list meets by.
COARSER = 4

Payload = Callable[[list[np.ndarray]], list[pa.Array]]
Meets = Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; of a shorter text, of all its words as one."""
    return np.unique(sequence_hashes(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    words, firsts = word_hashes(texts)
    return [shingle_set(words[firsts[k] : firsts[k + 1]], size) for k in range(len(texts))]


def in_parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about TEXT_AT_ONCE bytes of its texts, one row at least; only a slice's texts need be Python strings."""
    for begin, end in gathered(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist(), TEXT_AT_ONCE):
        yield batch.slice(begin, end - begin)


def digest(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def parities(found: np.ndarray, each: int) -> bytes | None:
    """For each of a power of two of places (``each`` for an element at least), whether an odd number of the set's hashes falls there.

    Two sets differ in at least as many elements as their parities differ in places, so parities never hide a link.
    """
    if not len(found):
        return None
    places = 64
    while places < each * len(found):
        places *= 2
    odd = np.bincount((found & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities (rows of 64-bit words) over fewer places."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def coarser(bits: bytes | None) -> bytes | None:
    """A set's parities over COARSER times fewer places, 64 at least; like all parities they never hide a link."""
    if bits is None:
        return None
    words = np.frombuffer(bits, np.uint64)[None]
    return folded(words, max(1, words.shape[1] // COARSER)).tobytes()


def may_link(
    sizes: tuple[np.ndarray, np.ndarray], bits: tuple[list[bytes], list[bytes]], percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes and parities of pairs of sets allow 100 * common >= percent * union, and in how many places parities differ."""
    total = sizes[0] + sizes[1]
    distance = np.zeros(len(total), np.int64)
    possible = 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
    lengths = np.array([[len(x) // 8 for x in side] for side in bits], np.int64).reshape(2, -1)
    kinds = lengths[0] << 32 | lengths[1]
    for kind in np.unique(kinds[possible]):
        rows = np.flatnonzero(possible & (kinds == kind))
        widths = (int(kind) >> 32, int(kind) & 0xFFFFFFFF)
        step = max(1, WORDS_AT_ONCE // max(widths))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            left, right = (
                folded(np.frombuffer(b"".join([side[k] for k in part]), np.uint64).reshape(len(part), width), min(widths))
                for side, width in zip(bits, widths)
            )
            distance[part] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            possible[part] = (total[part] - distance[part]) * (100 + percent) >= 2 * percent * total[part]
    return possible, distance


def signatures(
    docs: DataFrame, key: str, text: str, size: int, each: int, payload: dict[str, DataType], made: Payload
) -> DataFrame:
    """For each row its key, a hash of its text, its set's size ``n``, digest ``set``, parities ``bits`` and ``coarse``, and the payload."""
    own = [StructField("n", LongType()), *(StructField(c, BinaryType()) for c in ("set", "bits", "coarse"))]
    schema = StructType([docs.schema[key], StructField("text_hash", LongType()), *own, *(StructField(c, t) for c, t in payload.items())])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 2):
                sets = shingle_sets(part.column(2).to_pylist(), size)
                bits = [parities(s, each) for s in sets]
                own = [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) for s in sets], pa.binary()),
                    pa.array(bits, pa.binary()),
                    pa.array(map(coarser, bits), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *own, *made(sets)], schema.names)

    return docs.select(key, F.xxhash64(text).alias("text_hash"), text).mapInArrow(signed, schema)


def classes_of(signed: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """One row ``cid, doc, text_hash, set, n, bits, coarse`` and the payload for each different set; ``doc, text_hash`` lead to one of its rows."""
    row = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("doc"), "text_hash")
    grouped = signed.where("n > 0").groupBy("set").agg(F.min(row).alias("row"), *[F.first(c).alias(c) for c in ("n", "bits", "coarse", *payload)])
    named = grouped.select("set", "row.doc", "row.text_hash", "n", "bits", "coarse", *payload)
    return materialize(named.withColumn("cid", F.monotonically_increasing_id()), "classes")


def texts_of(wanted: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``cid, set, __text`` of a row of each wanted class (more rows where key and text repeat)."""
    few = wanted.count() <= BROADCAST_ROWS
    ids = wanted.select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), "set", "cid")
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__text_hash"), F.col(text).alias("__text"))
    same = F.col("__key").eqNullSafe(F.col("__doc")) & (F.col("__text_hash") == F.col("__hash"))
    return rows.join(F.broadcast(ids) if few else ids, same).select("cid", "set", "__text")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """The distinct pairs ``a, b`` of classes whose full sets link."""
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    wanted = materialize(wanted.join(classes.select("cid", "set", "doc", "text_hash"), "cid"), "wanted")
    schema = StructType([StructField("cid", LongType()), StructField("shingles", BinaryType())])

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 2):
                sets = shingle_sets(part.column(2).to_pylist(), size)
                own = [(c, s.tobytes()) for c, s, name in zip(part.column(0).to_pylist(), sets, part.column(1).to_pylist()) if digest(s) == name]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], schema.names)

    sets = texts_of(wanted, docs, key, text).mapInArrow(rebuilt, schema).dropDuplicates(["cid"])
    sets = materialize(sets, "sets")
    beside = pairs.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("right")), "b")
    beside = beside.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("left")), "a")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((left, right))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                links[k] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(links), batch.column(1).filter(links)], ["a", "b"])

    return materialize(beside.select("a", "b", "left", "right").mapInArrow(compared, "a long, b long"), "links")


def _met(pairs: DataFrame, classes: DataFrame, percent: int, carried: list[str], meets: Meets | None, coarse: bool) -> DataFrame:
    """The distinct pairs that sizes, parities and ``meets`` allow; parities over few places (if ``coarse``) are tried before all is fetched."""
    pairs = pairs.select("a", "b").distinct()
    if coarse:
        pairs = _allowed(pairs, classes, percent, "coarse", [], None)
    pairs = materialize(pairs, "met")
    wanted = materialize(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "asked")
    few = wanted.count() <= BROADCAST_ROWS
    fetched = classes.select("cid", "n", "bits", *carried).join(F.broadcast(wanted) if few else wanted, "cid")
    return _allowed(pairs, materialize(fetched, "fetched"), percent, "bits", carried, meets)


def _allowed(pairs: DataFrame, classes: DataFrame, percent: int, bits: str, carried: list[str], meets: Meets | None) -> DataFrame:
    kept = ["n", bits, *carried]
    sides = [classes.select(F.col("cid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in kept]) for s in "ab"]
    close = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    rows = pairs.join(sides[0], "a").join(sides[1], "b").where(close)

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, m = pa.Table.from_batches([batch]), batch.num_rows
            both = pa.table({c: pa.chunked_array([table[f"{c}_a"].combine_chunks(), table[f"{c}_b"].combine_chunks()]) for c in kept})
            n, held = both["n"].to_numpy(), both[bits].to_pylist()
            keep = np.flatnonzero(may_link((n[:m], n[m:]), (held[:m], held[m:]), percent)[0])
            if meets is not None:
                keep = keep[meets(both, keep, m + keep)]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep))], ["a", "b"])

    return rows.select("a", "b", *[f"{c}_{s}" for c in kept for s in "ab"]).mapInArrow(allowed, "a long, b long")


def _across(units: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs of members of a unit in different components that sizes and parities over few places allow.

    Each member meets the ``most`` nearest of these in a unit.
    """
    most = 1 << 62 if most is None else most

    def compare(_key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        unit = table["unit"].combine_chunks().dictionary_encode().indices.to_numpy()
        left, right, cid, label, n = (table[c].to_numpy() for c in ("left", "right", "cid", "label", "n"))
        bits = table["coarse"].to_pylist()
        found = [np.zeros((0, 3), np.int64)]

        def settle(pairs: list[np.ndarray]) -> None:
            i, j = np.concatenate(pairs, axis=1)
            keep, distance = may_link((n[i], n[j]), ([bits[k] for k in i], [bits[k] for k in j]), percent)
            i, j, distance = i[keep], j[keep], distance[keep]
            order = np.lexsort((distance, i))
            i, j = i[order], j[order]
            starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
            counts = np.diff(np.append(starts, len(i)))
            near = np.arange(len(i)) - np.repeat(starts, counts) < most
            found.append(np.stack((cid[i], cid[j], distance[order]), axis=1)[near])

        order = np.argsort(unit, kind="stable")
        held, pending = [], 0
        for rows in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            mine, theirs = rows[left[rows]], rows[right[rows]]
            apart = label[mine][:, None] != label[theirs][None, :]
            both = left[rows] & right[rows]
            if both.any():  # a block with itself: each pair once
                apart &= cid[mine][:, None] < cid[theirs][None, :]
            apart &= 100 * np.minimum.outer(n[mine], n[theirs]) >= percent * np.maximum.outer(n[mine], n[theirs])
            i, j = np.nonzero(apart)
            held.append(np.stack((mine[i], theirs[j])))
            pending += len(i)
            if pending >= UNIT * UNIT:
                settle(held)
                held, pending = [], 0
        if held:
            settle(held)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table(list(pairs.T), names=["a", "b", "distance"])

    return units.groupBy("bundle").applyInArrow(lambda key, table: compare(key, table), "a long, b long, distance long")


def linked(
    lists: DataFrame,
    classes: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    percent: int,
    carried: list[str],
    meets: Meets | None,
) -> DataFrame:
    """``node, label`` of all classes that link, from their lists (``bucket, cid``).

    ``meets`` says, for rows i and j of a table of classes with the carried columns, which pairs go on to be verified.
    """
    hubs = lists.groupBy("bucket").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialize(lists.join(hubs, "bucket"), "lists")
    star = shared.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b"))
    links = verify(_met(star, classes, percent, carried, meets, True))
    labels = components(links)
    # members of lists of two have met
    shared, quiet = shared.where("members > 2").select("bucket", "cid"), False
    for most in (*ROUNDS, None):
        if quiet and most is not None:
            continue
        if not quiet:
            shared = materialize(_apart(shared, labels), "apart")
        pairs = materialize(_across(_units(shared, classes, most), percent, most), "across")
        quiet = pairs.isEmpty()
        if quiet:
            continue
        if most is not None:
            near = Window.partitionBy("a").orderBy("distance", "b")
            pairs = materialize(pairs.groupBy("a", "b").agg(F.min("distance").alias("distance")).withColumn("place", F.row_number().over(near)), "near")
            pairs = pairs.where(F.col("place") <= most)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = verify(_met(pairs, classes, percent, carried, meets, False))
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    return labels


def _apart(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The members ``bucket, cid`` of lists that hold several components, under their ``label``.

    Components only merge, so a later round finds its lists among these.
    """
    under = lists.select("bucket", "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    under = materialize(under.select("bucket", "cid", F.coalesce("label", "cid").alias("label")), "labelled")
    several = under.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    return under.join(several, "bucket")


def _units(apart: DataFrame, classes: DataFrame, most: int | None) -> DataFrame:
    """The members of lists that hold several components, in each unit that their block is in.

    While only the nearest are asked for, a class is in the LISTS of its lists whose hashes are least, which classes that share most of
    their lists have in common; and a block meets itself, and is dealt anew in each round.
    """
    if most is not None:
        drawn = Window.partitionBy("cid").orderBy(F.xxhash64("bucket", F.lit(most)), "bucket")
        apart = materialize(apart.withColumn("turn", F.row_number().over(drawn)).where(F.col("turn") <= LISTS).drop("turn"), "drawn")
    several = apart.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("x"), F.max("label").alias("y"))
    several = several.where("x <> y").select("bucket", F.ceil(F.col("size") / UNIT).cast("int").alias("blocks"))
    apart = apart.join(several, "bucket").withColumn("block", F.pmod(F.xxhash64("cid", F.lit(most or 0)), "blocks").cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1) if most is None else F.array("block")
    rows = apart.agg(F.sum(F.size(others)).alias("n")).first()["n"] or 0
    bundles = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUNDLE_ROWS))
    placed = apart.join(classes.select("cid", "n", "coarse"), "cid").withColumn("other", F.explode(others))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    unit = F.xxhash64("bucket", low, high)
    return placed.select(
        F.pmod(unit, F.lit(bundles)).alias("bundle"), unit.alias("unit"), (F.col("block") == low).alias("left"),
        (F.col("block") == high).alias("right"), "cid", "label", "n", "coarse",
    )


def named(signed: DataFrame, classes: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row: the least key of its component; its own for a row without shingles."""
    of_class = classes.select("set", "doc", F.col("cid").alias("node")).join(labels, "node", "left")
    of_class = of_class.select("set", "doc", F.coalesce("label", "node").alias("label"))
    least = of_class.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_class = of_class.join(least, "label").select("set", "component_id")
    done = signed.select(key, F.col("n").alias("n_shingles"), "set").join(of_class, "set", "left")
    done = done.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(key)))
    kept = F.coalesce(F.col(key) == F.col("component_id"), F.lit(False))
    return done.select(key, "n_shingles", "component_id", kept.alias("kept"))


