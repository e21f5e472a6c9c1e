"""Small tables and plain re-statements of what the operators must give."""

from __future__ import annotations

import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(40_000)) + " " + "z" * 200_000

DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)

PROSE = "the quick brown fox jumps over the lazy dog while many other small birds are singing in the old green trees"


def edge_rows() -> list[tuple]:
    texts = [None, "", "   \n\t ", PROSE, PROSE, "a", "éè \U0001f600 字 no", LONG, "x\ny\nx\n\nx", PROSE + " today"]
    rows = [(k, t, "en", "s1", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, PROSE, None, None, None), (None, None, None, None, None)]


def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text: str | None) -> frozenset:
    w = words(lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(texts: dict) -> dict:
    """The least id of each text's component, by comparing all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {k: find(k) for k in sets}


def documents(spark, folder: str = "/root/testdata/sf0.001"):
    return spark.read.parquet(f"{folder}/documents.parquet")
