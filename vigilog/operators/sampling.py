"""Seeded, exact-size splits and samples that never sort a whole class in one task.

Rows are ordered by ``md5(seed|id)``. To find the row at which a quota is reached, the leading hex
digits of that key are counted per group, the running counts name the one digit bucket that holds
the boundary, and only the rows of that bucket are ranked. Every row is then compared with the
boundary, so the wide columns are read once and are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions.labels import is_normal
from vigilog.operators.joins import as_lookup, lookup_join

KEY_DIGITS = 4
_NULL_GROUP = "\u0000"


def order_key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def shuffle_rows(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """All rows in a seeded random order (a distributed range sort)."""
    return df.orderBy(order_key(seed, id_col), id_col)


def mark_lowest(
    df: DataFrame,
    quota: Column | DataFrame,
    id_col: str,
    seed: int,
    groups: Sequence[str] = (),
    among: Column | None = None,
    flag: str = "picked",
) -> DataFrame:
    """Add a boolean: is this row one of the ``quota`` lowest of its group in seeded order?

    ``quota`` is an expression that may use ``group_rows`` (the size of the group), or a table of
    the group columns and a ``quota`` column. ``among`` restricts the rows that take part.
    """
    among = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    names = [f"__g{i}" for i in range(len(groups))]

    def group_values(columns: Sequence[str]) -> list[Column]:
        return [F.coalesce(F.col(g).cast("string"), F.lit(_NULL_GROUP)).alias(n) for g, n in zip(columns, names)]

    keyed = (
        df.where(among)
        .select(*group_values(groups), F.col(id_col).alias("__id"), order_key(seed, id_col).alias("__key"))
        .withColumn("__digits", F.substring("__key", 1, KEY_DIGITS))
    )
    counted = keyed.groupBy(*names, "__digits").agg(F.count(F.lit(1)).alias("__n"))
    if not names:
        counted = counted.withColumn("__all", F.lit(0))
    within = Window.partitionBy(*(names or ["__all"]))
    running = counted.select(
        *names,
        "__digits",
        "__n",
        F.sum("__n").over(within).alias("group_rows"),
        F.coalesce(
            F.sum("__n").over(within.orderBy("__digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
    )
    if isinstance(quota, DataFrame):
        wanted = quota.select(*group_values(groups), F.col("quota").cast("long").alias("__quota"))
        running = running.join(wanted, names)
    else:
        running = running.withColumn("__quota", quota.cast("long"))
    running = running.withColumn("__quota", F.least("__quota", "group_rows"))
    boundary = as_lookup(
        running.where("__before < __quota AND __quota <= __before + __n").select(
            *names, "__digits", (F.col("__quota") - F.col("__before")).alias("__need")
        )
    )
    in_bucket = Window.partitionBy(*names, "__digits").orderBy("__key", "__id")
    ranked = lookup_join(keyed, boundary, [*names, "__digits"], ["__id"]).withColumn(
        "__rank", F.row_number().over(in_bucket)
    )
    last = as_lookup(
        ranked.where("__rank = __need").select(
            *names, F.col("__key").alias("__last_key"), F.col("__id").alias("__last_id")
        )
    )
    if names:
        out = lookup_join(df.select("*", *group_values(groups)), last, names, [id_col], "left")
        end_key, end_id = F.col("__last_key"), F.col("__last_id")
    else:
        one = (last.rows or last.table.toArrow()).to_pylist()  # at most one row
        end_key, end_id = map(F.lit, one[0].values()) if one else (F.lit(None).cast("string"), F.lit(None))
        out = df
    key, row_id = order_key(seed, id_col), F.col(id_col)
    reached = (key < end_key) | ((key == end_key) & (row_id <= end_id))
    return out.withColumn(flag, among & F.coalesce(reached, F.lit(False))).drop(*names, "__last_key", "__last_id")


def random_split(df: DataFrame, id_col: str, eval_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: ceil(fraction * n) rows are ``eval``, the others ``train``."""
    quota = F.ceil(F.lit(float(eval_fraction)) * F.col("group_rows"))
    marked = mark_lowest(df, quota, id_col, seed, flag="__eval")
    return marked.withColumn("split", F.when(F.col("__eval"), "eval").otherwise("train")).drop("__eval")


def eval_quotas(df: DataFrame, label_col: str, eval_fraction: float) -> DataFrame:
    """Rows per class of an exact split, by largest remainder over the training share."""
    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row per class
    share = sizes.select(
        label_col,
        "n",
        F.sum("n").over(everything).alias("total"),
    ).withColumn("train_total", F.col("total") - F.ceil(F.lit(float(eval_fraction)) * F.col("total")))
    exact = F.col("n") * F.col("train_total") / F.col("total")
    floored = share.withColumn("base", F.floor(exact)).withColumn(
        "rest", F.round(F.col("n") * F.col("train_total") / F.col("total") - F.col("base"), 9)
    )
    order = everything.orderBy(F.col("rest").desc(), F.col(label_col))
    extra = F.row_number().over(order) <= F.col("train_total") - F.sum("base").over(everything)
    return floored.select(label_col, (F.col("n") - F.col("base") - extra.cast("long")).cast("long").alias("quota"))


def stratified_split(
    df: DataFrame, id_col: str, label_col: str = "label", eval_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` keeping the class shares; class sizes are exact."""
    quotas = eval_quotas(df, label_col, eval_fraction)
    marked = mark_lowest(df, quotas, id_col, seed, groups=[label_col], flag="__eval")
    return marked.withColumn("split", F.when(F.col("__eval"), "eval").otherwise("train")).drop("__eval")


def downsample_uniform(
    df: DataFrame, id_col: str, drop_fraction: float = 0.80, seed: int = 42, label_col: str = "label"
) -> DataFrame:
    """Drop int(fraction * normals) normal rows at random; every other class passes through."""
    quota = F.floor(F.lit(float(drop_fraction)) * F.col("group_rows"))
    marked = mark_lowest(df, quota, id_col, seed, among=is_normal(label_col), flag="__drop")
    return marked.where(~F.col("__drop")).drop("__drop")


def _mark_first(
    df: DataFrame, groups: Sequence[str], id_col: str, seed: int, among: Column, flag: str
) -> tuple[DataFrame, int]:
    """Flag the first row of every group in seeded order; also return the number of groups."""
    known = [f"__f{i}" for i in range(len(groups))]
    firsts = (
        df.where(among)
        .groupBy(*[F.col(g).alias(n) for g, n in zip(groups, known)])
        .agg(F.min(F.struct(order_key(seed, id_col).alias("key"), F.col(id_col).alias("id"))).alias("__first"))
        .select(*known, F.col("__first.id").alias("__first_id"))
    )
    for name in known:
        firsts = firsts.where(F.col(name).isNotNull())
    lookup = as_lookup(firsts)
    groups_found = lookup.rows.num_rows if lookup.fits else lookup.table.count()
    rows = df.select("*", *[F.col(g).alias(n) for g, n in zip(groups, known)])
    joined = lookup_join(rows, lookup, known, [id_col], "left")
    first = among & (F.col("__first_id") == F.col(id_col))
    return joined.withColumn(flag, F.coalesce(first, F.lit(False))).drop(*known, "__first_id"), groups_found


def downsample_preserving(
    df: DataFrame,
    id_col: str,
    drop_fraction: float = 0.50,
    seed: int = 42,
    label_col: str = "label",
    source_col: str = "source",
) -> DataFrame:
    """Downsample normal rows but keep one of every source.

    In all max(int(n * (1 - fraction)), number of sources) normal rows stay.
    """
    normal = is_normal(label_col)
    flagged, sources = _mark_first(df, [source_col], id_col, seed, normal, "__first")
    rest = normal & ~F.col("__first")
    # group_rows counts the normal rows that are not already kept
    keep = F.greatest(
        F.floor((F.col("group_rows") + F.lit(sources)) * F.lit(1 - float(drop_fraction))), F.lit(sources)
    ) - F.lit(sources)
    marked = mark_lowest(flagged, keep, id_col, seed, among=rest, flag="__keep")
    stays = ~F.coalesce(normal, F.lit(False)) | F.col("__first") | F.col("__keep")
    return marked.where(stays).drop("__first", "__keep")


def diverse_sample(
    df: DataFrame,
    id_col: str,
    size: int = 1000,
    seed: int = 42,
    label_col: str = "label",
    source_col: str = "source",
) -> DataFrame:
    """``size`` rows: one of every (label, source) first, then random ones.

    With more pairs than rows wanted, ``size`` of the pair picks are returned.
    """
    flagged, pairs = _mark_first(df, [label_col, source_col], id_col, seed, F.lit(True), "__first")
    first = F.col("__first")
    if pairs > size:
        marked = mark_lowest(flagged, F.lit(size), id_col, seed, among=first, flag="__keep")
        return marked.where("__keep").drop("__first", "__keep")
    marked = mark_lowest(flagged, F.lit(size - pairs), id_col, seed, among=~first, flag="__keep")
    return marked.where("__first OR __keep").drop("__first", "__keep")

