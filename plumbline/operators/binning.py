"""Bin edges and frequencies of numeric and categorical columns.

Edges follow the NumPy conventions: linear interpolated quantiles, bins closed
on the left and open on the right except the last, which is closed on both.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.psi import EPSILON, valid_number
from plumbline.plans.small import Fitted, fitted, written

# Edges of the confidence bins used while there is no training score.
DEFAULT_CONFIDENCE_EDGES = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)
DEFAULT_BINS = 10
# Rows of one slice that a task may sort, and the parts a larger slice is cut into.
BAND_ROWS, PARTS = 1_000_000, 12
# Up to this many edges are matched by flat comparisons.
FLAT_EDGES = 17


# ---------------------------------------------------------------- bin of a value


def count_reached(value: str, edges: str, op: str, first: int, last: int) -> str:
    """SQL text counting the edges ``first..last`` that ``value`` has reached.

    Flat comparisons instead of an array lambda keep this in generated code.
    Positions past the end of the array compare as null and count nothing.
    """
    return " + ".join(
        f"if({value} {op} get({edges}, {i}), 1, 0)" for i in range(first, last + 1)
    ) or "0"


def bin_index(value: str, edges: str, n_edges: int | None = None, open_ends: bool = False) -> Column:
    """0-based bin of column ``value``; null outside the edges unless ``open_ends``.

    ``n_edges`` is the greatest number of edges any row meets. Without it, or
    when it is large, a lambda over the array takes any number.
    """
    if n_edges is not None and n_edges <= FLAT_EDGES:
        # The last edge closes the last bin, so it opens no bin of its own.
        reached = count_reached(value, edges, ">=", 1, n_edges - 2)
    else:
        reached = f"size(filter({edges}, e -> e <= {value})) - 1"
    inner = f"greatest(least({reached}, size({edges}) - 2), 0)"
    ok = f"{value} is not null and not isnan({value}) and {edges} is not null"
    if not open_ends:
        ok += f" and {value} >= get({edges}, 0) and {value} <= get({edges}, size({edges}) - 1)"
    return F.expr(f"case when {ok} then {inner} end")


def most_edges(params: Fitted, *columns: str) -> int | None:
    """The longest edge array of a fitted frame, if its rows are known."""
    if not params.small:
        return None
    return max((len(r[c]) for r in params.rows for c in columns if r[c] is not None), default=2)


# ---------------------------------------------------------------- edges


def clean_edges(edges: Column) -> Column:
    """Sorted distinct edges; none give [0, 1], a single one is widened by a half."""
    distinct = F.array_sort(F.array_distinct(F.filter(edges, lambda e: e.isNotNull())))
    return (
        F.when(edges.isNull() | (F.size(distinct) == 0), F.array(F.lit(0.0), F.lit(1.0)))
        .when(
            F.size(distinct) == 1,
            F.array(F.get(distinct, F.lit(0)) - 0.5, F.get(distinct, F.lit(0)) + 0.5),
        )
        .otherwise(distinct)
    )


def quantile_edges(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    n_bins: int = DEFAULT_BINS,
    slack: float = 0.001,
    accuracy: int = 10_000,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """``by..., edges`` with exact interpolated quantiles of ``column``.

    Nothing holds a whole column in one place. A mergeable sketch places a
    narrow band around each wanted rank, one counting pass over the bands and
    gaps tells which of them contains which rank and how many rows lie before
    it, and only those few bands are sorted, each on its own. A band of more
    than ``band_rows`` rows is narrowed first, so no task sorts a fixed share of
    the column. The sketch only decides how narrow the bands are; the counts
    make the result exact.
    """
    keys = list(by)
    rows = df.select(*keys, F.col(column).cast("double").alias("x"))
    fractions = [i / n_bins for i in range(n_bins + 1)]
    probes = sorted(
        {min(1.0, max(0.0, f + d)) for f in fractions for d in (-slack, slack)}
    )
    x = F.when(valid_number("x"), F.col("x"))
    cuts = fitted(
        rows.groupBy(*keys).agg(
            F.array_distinct(F.percentile_approx(x, probes, accuracy)).alias("cuts")
        )
    )
    sliced = cuts.attach(rows.where(valid_number("x")), keys, "cuts").select(
        *keys, "x", F.expr(count_reached("x", "cuts", ">", 0, len(probes) - 1)).alias("slice")
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        sliced.groupBy(*keys, "slice")
        .agg(F.count(F.lit(1)).alias("n"), (F.min("x") < F.max("x")).alias("varied"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("last", (F.sum("n").over(group) - 1).cast("double"))
    )
    wanted = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("k"),
                    F.lit(side).alias("side"),
                    (F.col("last") * f - F.floor(F.col("last") * f)).alias("weight"),
                    nearest(F.col("last") * f).alias("rank"),
                )
                for k, f in enumerate(fractions)
                for side, nearest in (("lo", F.floor), ("hi", F.ceil))
            ]
        )
    ).alias("w")
    targets = fitted(
        slices.select(*keys, F.col("slice").cast("long").alias("slice"), "n", "varied", "offset", wanted)
        .select(*keys, "slice", "n", "varied", "offset", "w.*")
        .where((F.col("rank") >= F.col("offset")) & (F.col("rank") < F.col("offset") + F.col("n")))
        .withColumn("rank", F.col("rank") - F.col("offset"))
        .drop("offset")
    )
    sliced, targets = narrowed(sliced.withColumn("slice", F.col("slice").cast("long")), targets, keys, band_rows, accuracy)
    upto = Window.partitionBy(*keys, "slice").orderBy("x").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = (
        in_bands(sliced, targets, keys)
        .groupBy(*keys, "slice", "x")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
    )
    picked = (
        running.join(targets.hinted().drop("n", "varied"), [*keys, "slice"])
        .where((F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto")))
        .groupBy(*keys, "k", "weight")
        .agg(
            F.max(F.when(F.col("side") == "lo", F.col("x"))).alias("lo"),
            F.max(F.when(F.col("side") == "hi", F.col("x"))).alias("hi"),
        )
        .withColumn("edge", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("weight"))
    )
    quantiles = picked.groupBy(*keys).agg(F.collect_list("edge").alias("q"))
    if keys:
        # A group without a single number keeps its row.
        quantiles = cuts.df.select(*keys).join(quantiles, keys, "left")
    return quantiles.select(*keys, clean_edges(F.col("q")).alias("edges"))


def in_bands(sliced: DataFrame, targets: Fitted, keys: Sequence[str]) -> DataFrame:
    """The rows of those slices that hold a wanted rank."""
    bands = targets.df.select(*keys, "slice").distinct()
    return sliced.join(F.broadcast(bands) if targets.small else bands, [*keys, "slice"], "left_semi")


def narrowed(
    sliced: DataFrame, targets: Fitted, keys: Sequence[str], band_rows: int, accuracy: int
) -> tuple[DataFrame, Fitted]:
    """Rows and wanted ranks in slices that hold at most ``band_rows`` rows or a single value.

    Each round writes the rows of the wanted slices, a fraction of the last round's, cuts every
    slice by a sketch of its own and keeps the parts that hold a rank. A value that a slice is cut
    at is a part by itself, so a frequent value is no obstacle and every round makes progress.
    """
    group = [*keys, "slice"]
    probes = [i / PARTS for i in range(PARTS + 1)]
    while targets.small and any(r["varied"] and r["n"] > band_rows for r in targets.rows):
        inside = written(in_bands(sliced, targets, keys).select(*group, "x"), "bands")
        cuts = fitted(
            inside.groupBy(*group).agg(F.array_distinct(F.percentile_approx("x", probes, accuracy)).alias("cuts"))
        )
        place = " + ".join(count_reached("x", "cuts", op, 0, PARTS) for op in (">", ">="))
        parts = cuts.attach(inside, group, "cuts").select(*group, "x", F.expr(place).alias("part"))
        before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = (
            parts.groupBy(*group, "part")
            .agg(F.count(F.lit(1)).alias("n"), (F.min("x") < F.max("x")).alias("varied"))
            .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        )
        held = fitted(
            sizes.join(F.broadcast(targets.df.drop("n", "varied")), group)
            .where((F.col("rank") >= F.col("offset")) & (F.col("rank") < F.col("offset") + F.col("n")))
            .withColumn("rank", F.col("rank") - F.col("offset"))
            .drop("offset")
        )
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("slice", "part")).cast("long")
        numbers = fitted(held.df.select(*group, "part").distinct().withColumn("to", number)).hinted()
        targets = fitted(held.df.join(numbers, [*group, "part"]).withColumn("slice", F.col("to")).drop("part", "to"))
        sliced = parts.join(numbers, [*group, "part"]).select(*keys, "x", F.col("to").alias("slice"))
    return sliced, targets


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., x, n``: how often each number occurs; null and NaN are one row without a number.

    For columns with few distinct values (lengths, labels, rounded scores) these counts stand for
    the rows: edges and histograms come from them, so the rows are read once, and counts of several
    batches add up to those of all (``merged_counts``).
    """
    x = F.when(valid_number(column), F.col(column).cast("double")).alias("x")
    return df.select(*by, x).groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"))


def merged_counts(*counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Value counts of several batches as those of all their rows."""
    whole = reduce(lambda a, b: a.unionByName(b), counts)
    return whole.groupBy(*by, "x").agg(F.sum("n").alias("n"))


def counted_quantile_edges(counts: DataFrame, by: Sequence[str], n_bins: int = DEFAULT_BINS) -> DataFrame:
    """``by..., edges`` as ``quantile_edges`` gives them for the counted rows.

    One window per group adds up the distinct values in order; each wanted rank is found by
    comparison in the same pass. A group without a number keeps its row.
    """
    keys, fractions = list(by), [i / n_bins for i in range(n_bins + 1)]
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("x").isNotNull(), F.col("n")).otherwise(0)
    ranked = counts.select(*keys, "x", known.alias("n")).withColumns(
        {"upto": F.sum("n").over(upto), "last": (F.sum("n").over(whole) - 1).cast("double")}
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")), F.col("x")))

    picks = {}
    for k, f in enumerate(fractions):
        picks[f"lo{k}"], picks[f"hi{k}"] = (at(side(F.col("last") * f)) for side in (F.floor, F.ceil))
    found = ranked.groupBy(*keys).agg(F.max("last").alias("last"), *(c.alias(name) for name, c in picks.items()))
    place = [F.col("last") * f - F.floor(F.col("last") * f) for f in fractions]
    edges = [F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * w for k, w in enumerate(place)]
    return found.select(*keys, clean_edges(F.array(*edges)).alias("edges"))


def equal_width_edges(
    df: DataFrame, column: str, by: Sequence[str] = (), n_bins: int = DEFAULT_BINS
) -> DataFrame:
    """``by..., edges, measured``: equal steps from the least to the greatest value.

    Without a value the fixed confidence edges apply and ``measured`` is false.
    """
    x = F.when(valid_number(column), F.col(column).cast("double"))
    span = df.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(n_bins))
    points = F.array(
        *[F.col("lo") + F.lit(float(i)) * step for i in range(n_bins)], F.col("hi")
    )
    default = F.array(*[F.lit(e) for e in DEFAULT_CONFIDENCE_EDGES])
    return span.select(
        *by,
        F.when(F.col("lo").isNull(), default).otherwise(clean_edges(points)).alias("edges"),
        F.col("lo").isNotNull().alias("measured"),
    )


def edge_bins(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per bin ``by..., bin, lo, hi`` of an edges frame."""
    inner = F.slice("edges", F.lit(1), F.size("edges") - 1)
    return edges.select(
        *by, "edges", F.posexplode(inner).alias("bin", "lo")
    ).select(*by, "bin", "lo", F.get("edges", F.col("bin") + 1).alias("hi"))


# ---------------------------------------------------------------- frequencies


def share(n: Column, total: Column, bins: Column) -> Column:
    """Share of a bin; every bin gets the same tiny share when nothing was counted."""
    return F.when(total == 0, F.lit(EPSILON) / bins).otherwise(
        n.cast("double") / total.cast("double")
    )


def histogram(
    df: DataFrame,
    column: str,
    edges: DataFrame | Fitted,
    by: Sequence[str] = (),
    open_ends: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """``by..., bin, lo, hi, n, freq`` of ``column`` over given edges.

    Values outside the edges are left out of the counts and of the total. ``weight`` names a column
    that says how many rows a row stands for.
    One narrow pass: rows meet the checked, broadcast edges and are counted
    before the only shuffle, which carries one row per bin and task.
    """
    keys = list(by)
    params = fitted(edges)
    each = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(*keys, F.col(column).cast("double").alias("x"), each.alias("_each"))
    index = bin_index("x", "edges", most_edges(params, "edges"), open_ends)
    counts = (
        params.attach(rows, keys, "edges")
        # -1 stands for "outside": dropping such rows by a filter would evaluate the bin twice.
        .select(*keys, F.coalesce(index, F.lit(-1)).alias("bin"), "_each")
        .groupBy(*keys, "bin")
        .agg(F.sum("_each").alias("n"))
    )
    whole = Window.partitionBy(*keys)
    return (
        edge_bins(params.df, keys)
        .join(counts, [*keys, "bin"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn(
            "freq",
            share(F.col("n"), F.sum("n").over(whole), F.count(F.lit(1)).over(whole)),
        )
    )


def categories(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values, one row each; they are never gathered in one array."""
    return df.where(F.col(column).isNotNull()).select(*by, column).distinct()


def categorical_frequency(
    df: DataFrame, column: str, listed: DataFrame, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """``by..., column, n, freq`` over the listed categories.

    Values that are not listed count in the total only; null values count nowhere. ``weight`` names
    a column that says how many rows a row stands for.
    """
    keys = list(by)
    each = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(each.alias("n"))
    totals = fitted(counts.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")))
    bins = listed.select(*keys, column).join(counts, [*keys, column], "left")
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0))
    return totals.attach(bins, keys, "total", how="left").select(
        *keys,
        column,
        n.alias("n"),
        share(n, total, F.count(F.lit(1)).over(Window.partitionBy(*keys))).alias("freq"),
    )
