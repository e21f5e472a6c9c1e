"""Quality rules for documents, and for hosts by their documents' failures. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import SPACES, let, materialize

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_HOST_RATE = 0.5
#: Of the prior, in documents: a host of a few documents is never judged by them alone.
LEAST_PRIOR, LARGEST_PRIOR = 10.0, 1e6

#: Failures beside the base rules that count towards a host's rates.
RULES = ("short", "repeats", "symbols", "dup_lines", "long_words")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    blanks = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(blanks, " ", -1), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that occurs twice or more, the first included.

    Windows are compared by a 64-bit hash; texts without a repeated one are done after one pass.
    """

    def covered(hashes: Column) -> Column:
        numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        alike = let(
            F.sort_array(numbered),
            lambda rows: F.filter(
                F.transform(
                    rows,
                    lambda row, j: F.when(
                        F.coalesce(F.get(rows, j - 1)["h"] == row["h"], F.lit(False))
                        | F.coalesce(F.get(rows, j + 1)["h"] == row["h"], F.lit(False)),
                        row["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        reach = let(
            F.sort_array(alike),
            lambda starts: F.transform(
                starts, lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - s, F.lit(WINDOW)))
            ),
        )
        total = F.aggregate(reach, F.lit(0).cast("bigint"), lambda total, n: total + n)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(total)

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )
    return F.when(F.size(words) >= WINDOW, let(hashes, covered)).otherwise(F.lit(0).cast("bigint"))


def rule_counts(text: Column) -> Column:
    """A struct of COUNTS (long) of one whole text; a null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    of_words = let(
        words_of(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("repeated"))
    )
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(
        of_words,
        lambda w: F.struct(
            w["n"].alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            dup_lines.cast("bigint").alias("n_dup_lines"),
            w["repeated"].alias("n_repeat_words"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_failures() -> dict[str, Column]:
    """Each rule over COUNTS: true where a document fails it."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": F.col("n_symbols") * 2 > F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") * 5 > F.col("n_words"),
        "long_words": F.col("word_chars") > 25 * F.col("n_words"),
    }


def host_rates(rated: DataFrame, host: str, rules: tuple[str, ...] = RULES) -> DataFrame:
    """One row a host: ``n`` and for each rule its failure rate, shrunk towards the hosts' own spread.

    A beta prior is fitted to the hosts' rates by their mean and variance, hosts weighted by documents: where
    hosts agree, a host's documents say little about it; where they differ, its own rate counts more.
    """
    hosts = rated.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"fails_{r}").cast("bigint")).alias(f"f_{r}") for r in rules]
    )
    hosts = materialize(hosts, "hosts")
    totals = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"f_{r}").alias(r) for r in rules]).first()
    means = {r: (totals[r] or 0) / totals["n"] if totals["n"] else 0.0 for r in rules}
    off = {r: F.col("n") * F.pow(F.col(f"f_{r}") / F.col("n") - means[r], F.lit(2)) for r in rules}
    spreads = hosts.agg(*[F.sum(off[r]).alias(r) for r in rules]).first()
    rates = []
    for r in rules:
        mean, spread = means[r], (spreads[r] or 0.0) / (totals["n"] or 1)
        strength = mean * (1 - mean) / spread - 1 if spread > 0 else LARGEST_PRIOR
        strength = min(max(strength, LEAST_PRIOR), LARGEST_PRIOR)
        rates.append(((F.col(f"f_{r}") + mean * strength) / (F.col("n") + strength)).alias(f"rate_{r}"))
    return hosts.select(host, "n", *rates)


def host_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    carry: list[str] | None = None,
    max_host_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """Rule counts of every document, the verdict on its host, and both together.

    Gives the ``carry`` columns (all of the input's by default) with COUNTS, ``base_failed``,
    ``host_rejected`` (a shrunk rate of the host is above ``max_host_rate``) and ``kept``. The counts
    are made once, written to the shared scratch folder, and summed by host from there; the table of
    hosts is written too, so that Spark knows its size when it chooses how to join it.

    A null text is an empty one, which fails for its length. A document without host has no host
    verdict. Equal rows count as often as they occur. An empty table gives no rows. Input columns that
    carry the name of a result column are replaced.
    """
    kept = list(docs.columns if carry is None else carry)
    fails = rule_failures()
    made = [*COUNTS, "base_failed", "host_rejected", "kept", "__host", *[f"fails_{r}" for r in fails]]
    kept = [c for c in kept if c.lower() not in made]
    counted = docs.select(*kept, F.col(host).cast("string").alias("__host"), rule_counts(F.col(text)).alias("__counts"))
    counted = counted.select(*kept, "__host", *[F.col(f"__counts.{c}").alias(c) for c in COUNTS])
    counted = counted.withColumns({f"fails_{r}": rule for r, rule in fails.items()} | {"base_failed": base_failed()})
    rated = materialize(counted, "rated")
    hosts = host_rates(rated, "__host")
    rejected = F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > max_host_rate
    verdicts = materialize(hosts.where(rejected).select("__host", F.lit(True).alias("host_rejected")), "verdicts")
    judged = rated.join(verdicts, "__host", "left").withColumn(
        "host_rejected", F.coalesce("host_rejected", F.lit(False))
    )
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    return judged.select(*kept, *COUNTS, "base_failed", "host_rejected", "kept")
