"""Exact stratified sampling and splitting by hash rank.

A row's rank within its stratum follows a hash of its id. The rank itself is
never computed for all rows: counts per hash prefix locate the prefix that
holds a wanted rank, only that prefix is sorted, and the outcome is one
threshold per stratum and cut. Rows are then assigned by comparing their hash
with the thresholds, so the texts are never shuffled, however large a stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import content_key, rank_key
from plumbline.plans.small import Fitted, fitted

# Hex digits of the hash that form a prefix: 65,536 prefixes per stratum.
PREFIX = 4


KEY = "_stratum"

#: Copies of one row that a task writes at once.
COPIES = 10_000


def numbered_copies(df: DataFrame, columns: Sequence[str], into: str = "_id", copies: int = COPIES) -> DataFrame:
    """The rows of ``columns`` with an id made of their content and a number among exact copies.

    The ids depend on nothing but the rows, however these are laid out. Copies are counted, not
    ranked: they collapse per task before the shuffle, and a row that occurs more than ``copies``
    times is written out again by several tasks. Nulls count as values of their own. Only
    ``columns`` and the id come back, as copies do not differ in anything else.
    """
    n, block = fresh_names(columns, "_n", "_block")
    parts = [F.coalesce(content_key(F.col(c).cast("string")), F.lit("-")) for c in columns]
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(n))
    first = F.col(block) * copies
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / copies)))
    few = counts.where(F.col(n) <= copies).withColumn(block, F.lit(0).cast("long"))
    many = counts.where(F.col(n) > copies).withColumn(block, blocks).repartition(*columns, block)
    number = F.explode(F.sequence(first, F.least(first + copies, F.col(n)) - 1))
    both = few.unionByName(many).select(*columns, F.sha2(F.concat(*parts), 256).alias(into), number.alias(n))
    return both.select(*columns, F.concat_ws("-", into, F.col(n).cast("string")).alias(into))


def fresh_names(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, lengthened until none is among ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _with_stratum(df: DataFrame, strata: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add the stratum as one struct, so that null values join like any other."""
    if not strata:
        return df, []
    return df.withColumn(KEY, F.struct(*strata)), [KEY]


def allocate(sizes: DataFrame, by: Sequence[str], quota: str, n: str, total: Column) -> DataFrame:
    """Split ``total`` over strata in proportion to ``n`` by largest remainder.

    Integer arithmetic only; ties go to the first stratum in sort order. The
    windows run over one row per stratum.
    """
    everywhere = Window.partitionBy()
    out = (
        sizes.withColumn("_share", F.col(n).cast("decimal(19,0)") * total.cast("decimal(19,0)"))
        .withColumn("_whole", F.nullif(F.sum(n).over(everywhere), F.lit(0)).cast("decimal(19,0)"))
        .withColumn("_base", F.expr("coalesce(cast(_share div _whole as bigint), 0)"))
        .withColumn("_rest", F.expr("coalesce(_share % _whole, 0)"))
    )
    order = Window.orderBy(F.col("_rest").desc(), *by)
    left = total.cast("bigint") - F.sum("_base").over(everywhere)
    return out.withColumn(
        quota, F.col("_base") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)
    ).drop("_share", "_whole", "_base", "_rest")


def stratum_sizes(keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per stratum."""
    return fitted(keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))).df


def rank_thresholds(
    keyed: DataFrame, id_col: str, by: Sequence[str], seed: int, quotas: DataFrame, cuts: Sequence[str]
) -> Fitted:
    """Per stratum and cut, ``{cut}_key`` and ``{cut}_id`` of the row at rank ``quota``."""
    by = list(by)
    ids = keyed.select(
        *by, rank_key(id_col, seed).alias("key"), F.col(id_col).alias("id")
    ).withColumn("prefix", F.substring("key", 1, PREFIX))
    before = Window.partitionBy(*by).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    prefixes = (
        ids.groupBy(*by, "prefix")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).alias("rank")) for c in cuts])
    ).alias("w")
    targets = fitted(
        fitted(quotas.select(*by, *cuts))
        .attach(prefixes, by, *cuts)
        .select(*by, "prefix", "n", "offset", wanted)
        .select(*by, "prefix", "n", "offset", "w.cut", "w.rank")
        .where((F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("offset") + F.col("n")))
        .select(*by, "prefix", "cut", (F.col("rank") - F.col("offset")).alias("rank"))
    )
    held = targets.df.select(*by, "prefix").distinct()
    order = Window.partitionBy(*by, "prefix").orderBy("key", "id")
    ranked = ids.join(
        F.broadcast(held) if targets.small else held, [*by, "prefix"], "left_semi"
    ).withColumn("position", F.row_number().over(order))
    found = ranked.join(targets.hinted(), [*by, "prefix"]).where(F.col("position") == F.col("rank"))
    return fitted(
        found.groupBy(*by).agg(
            *[
                F.max(F.when(F.col("cut") == c, F.col(part))).alias(f"{c}_{part}")
                for c in cuts
                for part in ("key", "id")
            ]
        )
    )


def _within(cut: str, id_col: str) -> Column:
    """Whether a row's rank is at or before the cut; a cut of zero rows has no threshold."""
    here, mark = F.col("_key"), F.col(f"{cut}_key")
    reached = (here < mark) | ((here == mark) & (F.col(id_col) <= F.col(f"{cut}_id")))
    return F.coalesce(reached, F.lit(False))


def _assign(keyed: DataFrame, id_col: str, by: Sequence[str], seed: int, marks: Fitted, cuts: Sequence[str]) -> DataFrame:
    columns = [f"{c}_{part}" for c in cuts for part in ("key", "id")]
    return marks.attach(keyed, by, *columns, how="left").withColumn("_key", rank_key(id_col, seed))


def stratified_sample(
    df: DataFrame, id_col: str, n: int, strata: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """``n`` rows, each stratum in its share of all rows; a smaller input stays whole."""
    keyed, by = _with_stratum(df, strata)
    whole = F.sum("n").over(Window.partitionBy())
    quotas = allocate(stratum_sizes(keyed, by), by, "quota", "n", F.least(F.lit(n), whole))
    marks = rank_thresholds(keyed, id_col, by, seed, quotas, ["quota"])
    return (
        _assign(keyed, id_col, by, seed, marks, ["quota"])
        .where(_within("quota", id_col))
        .select(*df.columns)
    )


def stratified_split(
    df: DataFrame,
    id_col: str,
    label: str | None,
    holdout: float = 0.01,
    test_share: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: train, val or test.

    ``holdout`` of all rows (rounded up) are held out, ``test_share`` of those
    (rounded up) are test rows and the rest validation rows, both in
    proportion to the labels. Without a label the split is simply random.
    """
    keyed, by = _with_stratum(df, [label] if label else [])
    everywhere = Window.partitionBy()
    held = F.ceil(F.lit(float(holdout)) * F.sum("n").over(everywhere).cast("double"))
    quotas = allocate(stratum_sizes(keyed, by), by, "held", "n", held)
    test = F.ceil(F.lit(float(test_share)) * F.sum("held").over(everywhere).cast("double"))
    quotas = allocate(quotas, by, "test", "held", test)
    marks = rank_thresholds(keyed, id_col, by, seed, quotas, ["held", "test"])
    split = (
        F.when(_within("test", id_col), "test").when(_within("held", id_col), "val").otherwise("train")
    )
    return (
        _assign(keyed, id_col, by, seed, marks, ["held", "test"])
        .withColumn("split", split)
        .select(*df.columns, "split")
    )


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
