"""Shards of near-equal bytes by sampled splitters.

Records are ordered by a hash of their text, then of their id, so equal texts are
neighbours. Size-weighted samples of these keys give splitters of many fine ranges;
exact sizes of the ranges are then counted, ranges above their share are subdivided
by samples of their own, and shards are runs of ranges cut at equal sums of bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import col
from plumbline.plans.small import written

RANGES_PER_SHARD = 256
RANGE_ROWS = 250_000
OVERSAMPLE = 24
#: A group of equal texts above this share of a shard is placed as a whole before the ranges.
HEAVY = 1 / 64

KEYS = "shard_key", "shard_tie"


def keyed(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(doc_id, size, text_crc32, shard_key, shard_tie)``: all that sharding moves; texts stay where they are."""
    content = F.coalesce(col(text).cast("binary"), F.lit(b""))
    return docs.select(
        col(id).alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.xxhash64(col(text).isNull(), content).alias(KEYS[0]),
        F.xxhash64(F.lit("tie"), col(id)).alias(KEYS[1]),
    )


def uniform(*columns) -> Column:
    """A reproducible number in [0, 1) of a record."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *columns), 11)).cast("double") / F.lit(float(1 << 53))


def sampled(records: DataFrame, total: int, wanted: int) -> np.ndarray:
    """Keys drawn with a probability in proportion to size: about ``wanted``, at most one a record."""
    share = F.col("size") * F.lit(wanted / max(total, 1))
    drawn = records.where(uniform(*KEYS, F.col("doc_id")) < share).select(*KEYS).toArrow()
    pairs = np.empty(drawn.num_rows, dtype=[("a", "i8"), ("b", "i8")])
    pairs["a"], pairs["b"] = drawn.column(0).to_numpy(), drawn.column(1).to_numpy()
    pairs.sort(order=("a", "b"))
    return pairs


def quantiles(pairs: np.ndarray, parts: int) -> np.ndarray:
    """Up to ``parts - 1`` boundaries at equal steps of the sorted sample, without doubles."""
    if not len(pairs) or parts <= 1:
        return pairs[:0]
    at = (np.arange(1, parts) * len(pairs)) // parts
    return np.unique(pairs[np.unique(at)])


def whole_groups(pairs: np.ndarray, divisible: set[int]) -> np.ndarray:
    """Keys moved to the first of their group, except in groups that may be cut."""
    out = pairs.copy()
    out["b"][~np.isin(out["a"], np.fromiter(divisible, np.int64, len(divisible)))] = np.iinfo(np.int64).min
    return out


def in_range(records: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Records with ``range``: how many splitters are at or below their key."""
    shared = records.sparkSession.sparkContext.broadcast((splitters["a"].copy(), splitters["b"].copy()))
    names = records.columns
    schema = T.StructType([*records.schema.fields, T.StructField("range", T.LongType())])
    key, tie = names.index(KEYS[0]), names.index(KEYS[1])

    def run(batches):
        a, b = shared.value
        whole = np.empty(len(a), dtype=[("a", "i8"), ("b", "i8")])
        whole["a"], whole["b"] = a, b
        for batch in batches:
            x = np.empty(batch.num_rows, dtype=whole.dtype)
            x["a"], x["b"] = batch.column(key).to_numpy(), batch.column(tie).to_numpy()
            # A pair lies in the run of splitters that share its first number.
            lo, hi = np.searchsorted(a, x["a"], "left"), np.searchsorted(a, x["a"], "right")
            place = lo.copy()
            for i in np.flatnonzero(hi > lo):
                place[i] = lo[i] + np.searchsorted(b[lo[i] : hi[i]], x["b"][i], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*names, "range"])

    return records.mapInArrow(run, schema)


def cut(sizes: np.ndarray, loads: np.ndarray) -> np.ndarray:
    """Shard of each range: runs of ranges that fill every shard, over its load so far, to the same total."""
    shards = len(loads)
    target = np.maximum((sizes.sum() + loads.sum()) / shards - loads, 0)
    if target.sum() > 0:
        target = target * (sizes.sum() / target.sum())
    ends = np.cumsum(target)
    middle = np.cumsum(sizes) - sizes / 2
    return np.minimum(np.searchsorted(ends, middle, "left"), shards - 1)


def shard(
    docs: DataFrame,
    shards: int = 8,
    text: str = "text",
    id: str = "doc_id",
    ranges_per_shard: int = RANGES_PER_SHARD,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus one. Shards differ by about a range, a 256th of a
    shard. Equal texts share a shard unless one text alone makes up more than a shard's share;
    then its copies are dealt over shards by their ids. ``slot`` numbers a shard's records from 0
    in key order.

    The driver holds splitters and one sum per range: ``shards * ranges_per_shard`` of them, or
    one per ``range_rows`` records if that is more, and ``24`` sampled keys for each; groups above
    1/64 of a shard in bytes or rows, at most ``128 * shards``, are listed too. Numbering sorts within a range.

    Null texts count as empty but are a group of their own; null ids are keys like others. Fully
    repeated rows are adjacent and numbered like any others; they are the one thing that a range
    cannot be divided by. An empty table gives no rows. Only id and text are read.
    """
    records = written(keyed(docs, text, id), "shard-keys")
    totals = records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
    rows, total = int(totals["n"]), int(totals["s"])
    share = total / shards

    groups = records.groupBy(KEYS[0]).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    many = (F.col("bytes") > share * HEAVY) | (F.col("n") > rows / shards * HEAVY)
    heavy = groups.where(many & (F.col("n") > 1)).orderBy(F.desc("bytes"), KEYS[0]).collect()
    divisible = {g[KEYS[0]] for g in heavy}
    loads, home = np.zeros(shards), {}
    for g in heavy:
        if g["bytes"] <= share:  # a larger one is cut like everything else
            least = int(np.argmin(loads))
            loads[least] += g["bytes"]
            home[g[KEYS[0]]] = least

    parts = max(shards * ranges_per_shard, -(-rows // range_rows))
    splitters = quantiles(whole_groups(sampled(records, total, parts * OVERSAMPLE), divisible), parts)
    splitters = np.unique(np.concatenate([splitters, around(home)]))
    again = overfull(records, splitters, total / parts, rows / parts, divisible)
    splitters = np.unique(np.concatenate([splitters, again]))
    ranged = in_range(records, splitters)

    sums = ranged.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(KEYS[0]).alias("k")
    )
    sums = sums.orderBy("range").collect()
    free = [r for r in sums if r["k"] not in home]
    placed = dict(zip((r["range"] for r in free), cut(np.array([r["bytes"] for r in free], float), loads)))
    table, used = [], [0] * shards
    for r in sums:
        at = int(placed.get(r["range"], home.get(r["k"])))
        table.append((r["range"], at, used[at]))
        used[at] += r["n"]
    places = records.sparkSession.createDataFrame(table, "range long, shard int, before long")
    order = W.partitionBy("range").orderBy(*KEYS, "doc_id", "size", "text_crc32")
    return (
        ranged.withColumn("_at", F.row_number().over(order))
        .join(F.broadcast(places), "range")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("_at") - 1).alias("slot"))
    )


def around(home: dict[int, int]) -> np.ndarray:
    """Splitters that give each placed group a range of its own."""
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    pairs = [(k, least) for k in home] + [(k + 1, least) for k in home if k < most]
    out = np.array(pairs, dtype=[("a", "i8"), ("b", "i8")]) if pairs else np.empty(0, dtype=[("a", "i8"), ("b", "i8")])
    return np.unique(out)


def overfull(records: DataFrame, splitters: np.ndarray, bytes_: float, rows: float, divisible: set[int]) -> np.ndarray:
    """Further splitters inside ranges with more than twice their share of bytes or of rows.

    Rows count here because many empty texts weigh little; such ranges are sampled by row.
    """
    ranged = in_range(records, splitters)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    full = sums.where((F.col("bytes") > 2 * bytes_) | (F.col("n") > 2 * rows)).where("n > 1").collect()
    if not full:
        return splitters[:0]
    spark = records.sparkSession
    plan = []
    for r in full:
        pieces = int(np.ceil(max(r["bytes"] / max(bytes_, 1), r["n"] / max(rows, 1))))
        plan.append((r["range"], pieces, min(1.0, pieces * OVERSAMPLE / r["n"])))
    chosen = F.broadcast(spark.createDataFrame(plan, "range long, pieces int, rate double"))
    drawn = (
        ranged.join(chosen, "range")
        .where(uniform(F.lit("again"), *KEYS, F.col("doc_id")) < F.col("rate"))
        .select("range", "pieces", *KEYS)
        .toPandas()
    )
    out = [splitters[:0]]
    for _, x in drawn.groupby("range"):
        pairs = np.empty(len(x), dtype=splitters.dtype)
        pairs["a"], pairs["b"] = x[KEYS[0]], x[KEYS[1]]
        pairs.sort(order=("a", "b"))
        out.append(quantiles(whole_groups(pairs, divisible), int(x["pieces"].iloc[0])))
    return np.unique(np.concatenate(out))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id: str = "doc_id") -> None:
    """The documents as Parquet, one folder per shard; ids must be distinct and not null."""
    docs.join(placed.select(F.col("doc_id").alias(id), "shard"), id).write.partitionBy("shard").parquet(path)
