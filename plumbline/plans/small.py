"""Small fitted tables and skewed lookups.

Fitted parameters (bin edges, rank cuts, quotas) come out of aggregates with a
few rows per model or stratum. ``fitted`` checks that size before anything is
broadcast; ``lookup_join`` spreads keys that hold a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import work_path

MAX_FITTED_ROWS = 20_000


class Fitted:
    """A frame of fitted parameters, with its rows when their number was checked."""

    def __init__(self, df: DataFrame, rows: list | None):
        self.df = df
        self.rows = rows

    @property
    def small(self) -> bool:
        return self.rows is not None

    def hinted(self) -> DataFrame:
        """The frame, marked for broadcast only when its size was checked."""
        return F.broadcast(self.df) if self.small else self.df

    def attach(self, rows: DataFrame, by: Sequence[str], *columns: str, how: str = "inner") -> DataFrame:
        """Add parameter columns to rows of the same group.

        Without groups there is one row of parameters and it becomes literals,
        so no join is planned at all.
        """
        if by:
            return rows.join(self.hinted().select(*by, *columns), list(by), how)
        record = self.df.first() if self.rows is None else self.rows[0]
        types = self.df.schema
        return rows.withColumns(
            {c: F.lit(record[c]).cast(types[c].dataType) for c in columns}
        )


def fitted(df: DataFrame | Fitted, max_rows: int = MAX_FITTED_ROWS) -> Fitted:
    """Evaluate a parameter frame once if it is small, keep it lazy if it is not.

    At most ``max_rows + 1`` rows ever reach the driver. A larger frame is
    returned as the plan it is and joined by shuffle.
    """
    if isinstance(df, Fitted):
        return df
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return Fitted(df, rows=None)
    local = df.sparkSession.createDataFrame(table, schema=df.schema)
    return Fitted(local, rows=table.to_pylist())


def stored(df: DataFrame, name: str) -> DataFrame:
    """A frame that is evaluated once: as local rows if it is small, else as a table in the work folder."""
    found = fitted(df)
    return found.df if found.small else written(df, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared work folder.

    For frames that several jobs read: their shuffles run once, lineage ends at
    the files, and a lost executor costs the current stage only.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the filter that ``likely`` broadcasts, in at most 262,144 rows of 64.
FILTER_BITS = 1 << 24


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be one of ``wanted``; an inner join on the key then decides.

    Wanted keys set one bit each of a filter of fixed size, which is broadcast, so that wide rows
    that no key asks for stay out of the shuffle. A key that is wanted always passes.
    """
    if rows.schema[key].dataType != wanted.schema[key].dataType:
        return rows  # other types, other hashes
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    word, place = F.shiftright(bit, 6).alias("_filter_word"), bit.bitwiseAND(F.lit(63)).cast("int")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_place"))).alias("_filter_bits")
    filled = wanted.where(F.col(key).isNotNull()).select(word, place.alias("_place")).groupBy("_filter_word").agg(bits)
    met = rows.withColumn("_filter_word", word).join(F.broadcast(filled), "_filter_word")
    return met.where(F.getbit("_filter_bits", place) == 1).select(*rows.columns)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread: Column,
    how: str = "inner",
    hot_share: float = 0.001,
    salts: int = 64,
) -> DataFrame:
    """Join rows to a lookup with one row per key, however skewed the rows are.

    A key above ``hot_share`` of all rows is hot, so there are fewer than
    ``1 / hot_share`` of them: that bounds the broadcast set of hot keys. Rows
    of a hot key are dealt over ``salts`` shuffle keys by ``spread`` and its
    lookup row is repeated once per salt; all other rows keep a single key.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    hot = fitted(
        counts.where(F.col("_n") > total * F.lit(hot_share)).select(key, F.lit(True).alias("_hot")),
        max_rows=int(1 / hot_share),
    )
    if hot.df.isEmpty():
        return rows.join(lookup, key, how)
    salted_rows = (
        rows.join(hot.hinted(), key, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0),
        )
        .drop("_hot")
    )
    salted_lookup = (
        lookup.join(hot.hinted(), key, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
                    F.array(F.lit(0))
                )
            ),
        )
        .drop("_hot")
    )
    return salted_rows.join(salted_lookup, [key, "_salt"], how).drop("_salt")
