"""Personal data in texts: fixed patterns, and candidates that boosted trees select. DataFrame functions and JVM trees only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import let, materialize

KINDS = ("email", "ip", "card", "phone")

#: Java patterns. Possessive runs find what greedy ones find, without trying a long run from each of
#: its characters: a run that fails from its start fails from within. \G allows a start right after a match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates: looser forms of each kind, found beside the fixed ones.
CANDIDATES = {
    "email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++",
    ),
    "ip": (r"(?<![0-9])[0-9]{1,3}+(?:[.,:-][0-9]{1,3}+){3}(?![0-9])",),
    "card": (
        r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,23}+(?![0-9])",
        r"(?<![0-9])[0-9]{12,19}+(?![0-9])",
        r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])",
    ),
    "phone": (r"(?<![0-9])(?:\+|\()?[0-9](?:[\x20()./-]{0,2}[0-9]){6,16}+(?![0-9])",),
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
#: Words before a candidate that tell its kind.
HINTS = {
    "email": r"\b(?:e-?)?mails?\b|\bcontact|\baddr|\bwrite\b",
    "ip": r"\bip\b|\bhost|\bserver|\baddr",
    "card": r"\bcards?\b|\bvisa\b|\bmastercard\b|\baccount",
    "phone": r"\b(?:tele)?phone|\btel\b|\bcall|\bfax|\bmobil|\bcontact",
}
AREA = r"\([0-9]{2,4}\)[\x20.-]?[0-9]{3}"
DATE = r"^(?:(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][0-3]?[0-9][./-](?:19|20)[0-9]{2})(?![0-9])"
SPELLED = r"[(\[](?:at|dot)[)\]]"
ADDRESS = r"^[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$"
ONE_MARK = r"^[0-9]+([.,:-])[0-9]+\1[0-9]+\1[0-9]+$"
SHORT = r"(?<![0-9])[0-9]{1,2}(?![0-9])"
CONTEXT = 24
#: Doubling steps that cover an array of any size.
SCAN_ROUNDS = 31
#: Rows of a task when trees are fitted.
FIT_ROWS = 20_000
TREES = 20
DEPTH = 3
PRECISION = 0.98
BINS = 100


def _scanned(values: Column, combine) -> Column:
    """Running totals of an array by doubling steps."""

    def step(current: Column, reach: Column) -> Column:
        moved = F.transform(current, lambda x, i: F.when(i >= reach, combine(x, F.get(current, i - reach))).otherwise(x))
        return F.when(F.size(current) > reach, moved).otherwise(current)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(SCAN_ROUNDS)]), values, step)


def found(text: Column, pattern: str) -> Column:
    """An array of ``start, end, match`` of all matches, in code points, ends exclusive."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(matches: Column, gaps: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)).cast("bigint") + F.length(m))
        return let(
            _scanned(steps, lambda a, b: a + b),
            lambda ends: F.transform(
                matches,
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match")
                ),
            ),
        )

    return let(whole, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(m, gaps))))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits have a valid check digit."""

    def total(backwards: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(backwards)), lambda i: F.substring(backwards, i, F.lit(1)).cast("int"))
        doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
        return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0

    return F.when(F.length(digits).between(12, 19), let(F.reverse(digits), total)).otherwise(F.lit(False))


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _nothing() -> Column:
    return F.expr("cast(array() as array<struct<start: bigint, end: bigint, match: string>>)")


def _look(text: Column, kind: str, pattern: str) -> Column:
    return F.coalesce(F.when(text.rlike(NEEDS[kind]), found(text, pattern)), _nothing())


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(_look(text, kind, BASE[kind]), lambda s: valid(kind, s["match"]))


def _before(text: Column, span: Column) -> Column:
    return F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(span["start"], F.lit(CONTEXT)).cast("int"))


def _hinted(text: Column, kind: str, span: Column) -> Column:
    return F.lower(_before(text, span)).rlike(HINTS[kind])


def _dotted(match: Column) -> Column:
    return F.regexp_replace(match, "[,:-]", ".")


def evidence(text: Column, kind: str, span: Column) -> Column:
    """Whether a candidate is personal data once its notation is normalised, by check digits, ranges and the words before it."""
    match, hinted = span["match"], _hinted(text, kind, span)
    if kind == "email":
        plain = F.regexp_replace(match, r"\x20?[(\[]at[)\]]\x20?", "@")
        plain = F.regexp_replace(plain, r"\x20?[(\[]dot[)\]]\x20?", ".")
        return plain.rlike(ADDRESS) | (hinted & F.regexp_replace(plain, r"\x20?@\x20?", "@").rlike(ADDRESS))
    if kind == "ip":
        return match.rlike(OCTETS) | (hinted & match.rlike(ONE_MARK) & _dotted(match).rlike(OCTETS))
    if kind == "card":
        return luhn(_digits(match)) & (hinted | ~match.rlike(SHORT))
    plausible = valid(kind, match) & ~match.rlike(OCTETS) & ~match.rlike(DATE)
    return plausible & (match.startswith("+") | match.rlike(AREA) | hinted)


FEATURES = (
    *[f"is_{k}" for k in KINDS], "chars", "digits", "letters", "marks", "groups", "plus", "luhn", "octets", "at", "name_end",
    "touches_left", "touches_right", "hinted", "spelled", "spaced", "area", "short", "one_mark", "dotted", "date",
)


def features(text: Column, kind: str, span: Column) -> Column:
    """Format and context of a candidate, as a struct of doubles in the order of FEATURES."""
    match = span["match"]
    before = _before(text, span)
    after = F.substring(text, (span["end"] + 1).cast("int"), F.lit(1))
    values = {f"is_{k}": F.lit(k == kind) for k in KINDS} | {
        "chars": F.length(match),
        "digits": F.length(_digits(match)),
        "letters": F.length(F.regexp_replace(match, "[^A-Za-z]", "")),
        "marks": F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")),
        "groups": F.size(F.split(match, "[^A-Za-z0-9]+")),
        "plus": match.startswith("+"),
        "luhn": luhn(_digits(match)),
        "octets": _dotted(match).rlike(OCTETS),
        "at": F.contains(match, F.lit("@")),
        "name_end": match.rlike(r"[.)\]]\x20?[A-Za-z]{2,24}$"),
        "touches_left": before.rlike(r"[\p{L}\p{N}_+.-]$"),
        "touches_right": after.rlike(r"^[\p{L}\p{N}_]"),
        "hinted": _hinted(text, kind, span),
        "spelled": match.rlike(SPELLED),
        "spaced": match.rlike(r"\x20[@.]|[@.]\x20"),
        "area": match.rlike(AREA),
        "short": match.rlike(SHORT),
        "one_mark": match.rlike(ONE_MARK),
        "dotted": match.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"),
        "date": match.rlike(DATE),
    }
    return F.struct(*[values[name].cast("double").alias(name) for name in FEATURES])


def candidates(text: Column, score=None) -> Column:
    """All candidates as ``start, end, kind`` with ``label`` and ``features``, or with ``score``, a function of the features.

    Features stand in the plan once for each kind and the score, which may be large, once.
    """

    def of(rank: int, kind: str) -> Column:
        def described(span: Column) -> Column:
            made = [span["start"].alias("start"), span["end"].alias("end"), F.lit(rank).alias("kind")]
            if score is None:
                made.append(F.coalesce(evidence(text, kind, span), F.lit(False)).cast("double").alias("label"))
            return F.struct(*made, features(text, kind, span).alias("features"))

        return F.transform(F.concat(*[_look(text, kind, pattern) for pattern in CANDIDATES[kind]]), described)

    every = F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)])
    if score is None:
        return every
    return F.transform(
        every, lambda c: F.struct(*[c[name].alias(name) for name in ("start", "end", "kind")], score(c["features"]).alias("score"))
    )


@dataclass(frozen=True)
class Selector:
    """Boosted trees as nested conditions, and the least score for each kind (None: never)."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, features: Column) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, at, low, high = node
            return F.when(features[name] <= at, value(low)).otherwise(value(high))

        margin = F.lit(0.0)
        for weight, tree in zip(self.weights, self.trees):
            margin = margin + weight * value(tree)
        return 1 / (1 + F.exp(-2 * margin))


def _unfold(node) -> tuple | float:
    """A fitted JVM tree as (feature, threshold, low side, high side) or a leaf's value."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    split = node.split()
    return FEATURES[split.featureIndex()], split.threshold(), _unfold(node.leftChild()), _unfold(node.rightChild())


def _fit_trees(groups: DataFrame, seed: int) -> Selector:
    """Boosted trees on groups of candidates alike, each as heavy as it has candidates; none without both classes."""
    if groups.select("label").distinct().count() < 2:
        return Selector()
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(groups).select("x", "label", "n")
    trees = GBTClassifier(featuresCol="x", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=seed)
    model = trees.fit(assembled)
    return Selector([_unfold(tree._call_java("rootNode")) for tree in model.trees], list(model.treeWeights))


def fit_selector(docs: DataFrame, key: str = "doc_id", text: str = "text", precision: float = PRECISION, seed: int = 3) -> Selector:
    """Boosted trees on all candidates, and thresholds from all of them, each scored by trees that have not seen it.

    A candidate is positive by its evidence, loose notations as well as those of a base pattern. Candidates with the same features and
    label are one row with their number as its weight. They are dealt into halves; trees of either half score the other, and a kind's
    threshold is the least score above which at least ``precision`` of all its candidates are positive. The trees
    that select are those of both halves. Without candidates of both classes nothing is selected.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("row"), F.explode(candidates(body)).alias("c"))
    half = F.pmod(F.xxhash64(F.lit(seed + 1), "row", "c.start", "c.end", "c.kind"), F.lit(2)).alias("half")
    groups = rows.select("c.kind", "c.label", "c.features.*", half).groupBy("kind", "label", *FEATURES, "half")
    groups = materialize(groups.agg(F.count(F.lit(1)).cast("double").alias("n")), "candidates")
    parts = -(-groups.count() // FIT_ROWS)  # a fit passes over its rows many times: no more tasks than they need
    groups = groups.coalesce(max(1, parts))
    whole = _fit_trees(groups, seed)
    if not whole.trees:
        return whole
    tally = []
    for side in (0, 1):
        other = _fit_trees(groups.where(F.col("half") != side), seed)
        if not other.trees:
            return Selector()
        scored = groups.where(F.col("half") == side).select("kind", "label", "n", F.floor(other.score(F.struct(*FEATURES)) * BINS).alias("bin"))
        tally += scored.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("right")).collect()
    thresholds = {}
    for rank, kind in enumerate(KINDS):
        n = right = 0.0
        for at in sorted({r["bin"] for r in tally if r["kind"] == rank}, reverse=True):
            both = [r for r in tally if r["kind"] == rank and r["bin"] == at]
            n, right = n + sum(r["n"] for r in both), right + sum(r["right"] for r in both)
            if right < precision * n:
                break
            thresholds[kind] = at / BINS
    return Selector(whole.trees, whole.weights, thresholds)


def find_spans(docs: DataFrame, selector: Selector, text: str = "text") -> DataFrame:
    """The input's columns with ``n_<kind>`` and ``base`` (fixed patterns) and ``spans`` (those and the selected candidates).

    ``base`` and ``spans`` are arrays of ``start, kind, end`` in order, kind as its place in KINDS, in
    code points with exclusive ends; spans may overlap. A null or empty text has none. Rows are
    independent of each other. Input columns with the names of result columns are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    names = [f"n_{k}" for k in KINDS]
    kept = [c for c in docs.columns if c.lower() not in (*names, "base", "spans")]

    def of(rank: int, kind: str) -> Column:
        return F.transform(
            base_spans(body, kind), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end"))
        )

    base = docs.select(*kept, *[of(rank, k).alias(f"__{k}") for rank, k in enumerate(KINDS)])
    base = base.select(
        *kept,
        *[F.size(f"__{k}").cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.concat(*[F.col(f"__{k}") for k in KINDS])).alias("base"),
    )
    if not selector.thresholds:
        return base.withColumn("spans", F.col("base"))

    def enough(c: Column) -> Column:
        need = F.lit(2.0)
        for rank, kind in enumerate(KINDS):
            if kind in selector.thresholds:
                need = F.when(c["kind"] == rank, F.lit(selector.thresholds[kind])).otherwise(need)
        return c["score"] >= need

    def code(span: Column) -> Column:
        return F.concat_ws(":", span["start"].cast("string"), span["kind"].cast("string"), span["end"].cast("string"))

    def decoded(text: Column) -> Column:
        part = F.split(text, ":")
        return F.struct(part[0].cast("bigint").alias("start"), part[1].cast("int").alias("kind"), part[2].cast("bigint").alias("end"))

    chosen = F.transform(F.filter(candidates(body, selector.score), enough), code)
    added = F.transform(F.array_except(chosen, F.transform("base", code)), decoded)
    return base.withColumn("spans", F.sort_array(F.concat("base", added)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span as ``[KIND]``; of overlapping spans, one mark of the first for their union."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def marked(spans: Column, reach: Column) -> Column:
        opens = F.filter(
            F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), i.alias("i"))),
            lambda s: F.coalesce(F.get(reach, s["i"] - 1) <= s["start"], F.lit(True)),
        )

        def pieces(opens: Column) -> Column:
            each = F.transform(
                opens,
                lambda o, j: let(
                    F.when(j == 0, F.lit(0).cast("bigint")).otherwise(F.get(reach, o["i"] - 1)),
                    lambda at: F.concat(
                        F.substring(text, (at + 1).cast("int"), (o["start"] - at).cast("int")), F.get(marks, o["kind"])
                    ),
                ),
            )
            last = F.element_at(reach, -1)
            return F.concat(F.array_join(each, ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

        return let(opens, pieces)

    reach = _scanned(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, let(spans, lambda s: let(reach, lambda r: marked(s, r)))).otherwise(text)
