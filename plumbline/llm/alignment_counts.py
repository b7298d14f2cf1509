"""How often pairs of tokens of two tokenizers are linked, and each document against these counts.

First pass: every task aligns its documents and counts, in how many of them each pair of ids is
linked. The distinct pairs, in shards by the first tokenizer's id, get a minimal perfect hash; the
tasks' counts become dense vectors indexed by it, which are added up in a tree of 64. A shard
holds all pairs of its ids, so it also knows each id's highest count. Second pass: documents are
aligned again and their links looked up, in a copy of the shards where their size allows that, or
else by sending links to the shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import as_bytes, col, fresh, mixed, pin_batches
from plumbline.llm.perfect_hash import PerfectHash
from plumbline.llm.token_alignment import A_SHIFT, Aligner, Parts, parts_of
from plumbline.plans.small import written

SHARDS = 64
FAN_IN = 64
HELD_PAIRS = 4_000_000  # pairs a task holds before it sends them on
COPIED_BYTES = 48 << 20  # the most that every worker gets a copy of
TEXT_BYTES = 2 << 20  # texts that are aligned together

PARTIAL = "shard int, part long, keys binary, counts binary"


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed((keys >> A_SHIFT).view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def runs(texts: list[bytes | None]):
    """Places of texts in runs of about ``TEXT_BYTES``."""
    here, size = [], 0
    for i, x in enumerate(texts):
        here.append(i)
        size += len(x or b"")
        if size > TEXT_BYTES:
            yield here
            here, size = [], 0
    if here:
        yield here


def parts_in(text: bytes | None) -> list[str]:
    return parts_of(text.decode()) if text else []


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys once, their counts added up."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def partial_counts(docs: DataFrame, models, text: str, shards: int) -> DataFrame:
    """Document counts of the pairs that each task has seen, packed per shard."""

    def run(batches):
        from pyspark import TaskContext

        part, aligner = TaskContext.get().partitionId(), Aligner(*models.value)

        def find(keys):
            found = aligner.align(keys, with_groups=False)
            ends = np.cumsum(found.n_links)
            raw = found.links.tobytes()
            return [raw[8 * (e - n) : 8 * e] if g else None for e, n, g in zip(ends.tolist(), found.n_links.tolist(), found.good)]

        memo, keys, counts, held = Parts(find, lambda x: len(x or b"")), [], [], 0

        def out():
            all_keys, all_counts = summed(keys, counts)
            of = shard_of(all_keys, shards)
            order = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[order], np.arange(shards + 1))
            rows = [(s, order[a:b]) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s for s, _ in rows], pa.int32()),
                    pa.array([part] * len(rows), pa.int64()),
                    pa.array([all_keys[i].tobytes() for _, i in rows], pa.binary()),
                    pa.array([all_counts[i].tobytes() for _, i in rows], pa.binary()),
                ],
                names=["shard", "part", "keys", "counts"],
            )

        for batch in batches:
            texts = as_bytes(batch.column(0))
            for places in runs(texts):
                found = []
                for links in memo.of([parts_in(texts[i]) for i in places]):
                    if links and None not in links:
                        found.append(np.unique(np.frombuffer(b"".join(links), np.int64)))
                if found:
                    new, n = np.unique(np.concatenate(found), return_counts=True)
                    keys.append(new)
                    counts.append(n)
                    held += len(new)
                if held > HELD_PAIRS:
                    keys[:], counts[:] = ([x] for x in summed(keys, counts))
                    held = len(keys[0])
                    if held > HELD_PAIRS // 2:
                        yield from out()
                        keys.clear(), counts.clear()
                        held = 0
        if keys:
            yield from out()

    return docs.select(col(text).cast("string")).mapInArrow(run, PARTIAL)


def arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in column.to_pylist()]


def tree(df: DataFrame, name: str, levels: int, merge) -> DataFrame:
    """``(shard, part, name)`` merged 64 parts at a time until each shard is one row."""
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int64()), (name, pa.binary())])

    def run(key, rows):
        out = merge(arrays(rows.column(name)))
        return pa.table([[key[0].as_py()], [key[1].as_py()], [out.tobytes()]], schema=schema)

    for _ in range(levels):
        df = df.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).select("shard", "part", name)
        df = df.groupBy("shard", "part").applyInArrow(run, f"shard int, part long, {name} binary")
    return df


class Counts:
    """The hash, the counts and what is highest of one shard."""

    def __init__(self, hash: bytes, counts: bytes):
        self.hash, self.counts = PerfectHash.from_bytes(hash), np.frombuffer(counts, np.int64)
        a = self.hash.keys >> A_SHIFT
        ids, at = np.unique(a, return_inverse=True)
        highest = np.zeros(len(ids), np.int64)
        np.maximum.at(highest, at, self.counts)
        self.best = self.counts == highest[at]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pairs, and whether they are the highest of their first id."""
        at = self.hash.index(keys)
        if len(at) and at.min() < 0:
            raise ValueError("a pair that the first pass has not seen: the documents changed in between")
        return self.counts[at], self.best[at]


def looked_up(keys: np.ndarray, shards: list[Counts | None]) -> tuple[np.ndarray, np.ndarray]:
    counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    of = shard_of(keys, len(shards))
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(len(shards) + 1))
    for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if b > a:
            counts[order[a:b]], best[order[a:b]] = shards[s].of(keys[order[a:b]])
    return counts, best


def pair_table(docs: DataFrame, models, text: str, shards: int = SHARDS) -> DataFrame:
    """``(shard, hash, counts)``: a perfect hash of the shard's pairs, and their counts in its order."""
    partial = written(partial_counts(docs, models, text, shards), "pair-parts")
    most = partial.agg(F.max("part")).first()[0] or 0
    levels = 1
    while FAN_IN**levels <= most:
        levels += 1
    keys = tree(partial, "keys", levels, lambda x: np.unique(np.concatenate(x)))

    def build(batches):
        for batch in batches:
            found = [PerfectHash.of(np.frombuffer(x, np.int64)).to_bytes() for x in batch.column("keys").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(found, pa.binary())], names=["shard", "hash"])

    hashes = written(keys.select("shard", "keys").mapInArrow(build, "shard int, hash binary"), "pair-hashes")
    # Every block of tasks makes one dense vector a shard out of its tasks' counts.
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most // FAN_IN).cast("long")))
    by_block = hashes.withColumn("block", blocks).groupBy("shard", "block")
    parts = partial.withColumn("block", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("shard", "block")

    def dense(key, rows, hash):
        if not rows.num_rows:
            return schema.empty_table()
        index = PerfectHash.from_bytes(hash.column("hash")[0].as_py())
        vector = np.zeros(len(index.keys), np.int64)
        for k, n in zip(arrays(rows.column("keys")), arrays(rows.column("counts"))):
            vector[index.index(k)] += n
        return pa.table({"shard": [key[0].as_py()], "part": [key[1].as_py()], "vector": [vector.tobytes()]}, schema)

    schema = pa.schema([("shard", pa.int32()), ("part", pa.int64()), ("vector", pa.binary())])
    vectors = parts.cogroup(by_block).applyInArrow(dense, "shard int, part long, vector binary")
    whole = tree(vectors, "vector", levels, lambda x: np.sum(x, axis=0))
    return written(hashes.join(whole.select("shard", F.col("vector").alias("counts")), "shard"), "pair-table")


def pair_counts(table: DataFrame) -> DataFrame:
    """``(a_id, b_id, n_documents, best)``: the rows of a pair table."""

    def run(batches):
        for batch in batches:
            for hash, counts in zip(batch.column("hash").to_pylist(), batch.column("counts").to_pylist()):
                found = Counts(hash, counts)
                for i in range(0, len(found.counts), 1 << 16):
                    keys = found.hash.keys[i : i + (1 << 16)]
                    columns = [keys >> A_SHIFT, keys & 0xFFFFFFFF, found.counts[i : i + (1 << 16)], found.best[i : i + (1 << 16)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a_id", "b_id", "n_documents", "best"])

    return table.select("hash", "counts").mapInArrow(run, "a_id long, b_id long, n_documents long, best boolean")


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
RESULT = T.StructType([T.StructField(c, T.LongType()) for c in NUMBERS] + [T.StructField("groups_sha256", T.StringType())])


def hashed_groups(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts)[:-1].encode()).hexdigest() if parts else ""


def documents_against(docs: DataFrame, models, text: str, into: str, shards, with_links: bool) -> DataFrame:
    """Documents with ``into``: numbers and the groups' hash. Without a copy of the shards the two
    counts are 0 and ``into`` also has the document's distinct links and how often each occurs."""
    keep = [c for c in docs.columns if c.lower() != into.lower()]
    kind = T.StructType([*RESULT.fields, *T.StructType.fromDDL("links binary, times binary").fields]) if with_links else RESULT
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(into, kind)])
    at = len(keep)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        aligner = Aligner(*models.value)
        table = None if with_links else [x and Counts(*x) for x in shards.value]

        def find(keys):
            x = aligner.align(keys)
            counts, best = looked_up(x.links, table) if table is not None else (np.zeros(len(x.links), np.int64),) * 2
            upto = np.append(0, np.cumsum(x.n_links))
            part = lambda v: np.diff(np.append(0, np.cumsum(v.astype(np.int64)))[upto])
            numbers = np.stack([x.n_a, x.n_b, x.n_groups, x.n_links, part(best), part(counts)], axis=1).astype(np.int64)
            raw, links, ends = numbers.tobytes(), x.links.tobytes() if with_links else b"", (8 * upto).tolist()
            return [
                (raw[48 * i : 48 * i + 48], x.groups[i], links[ends[i] : ends[i + 1]]) if good else None
                for i, good in enumerate(x.good.tolist())
            ]

        memo = Parts(find, lambda x: sum(map(len, x)) + 150 if x else 0)

        def result(records):
            good = bool(records) and None not in records
            numbers = np.frombuffer(b"".join([r[0] for r in records]), np.int64).reshape(-1, 6).sum(axis=0) if good else np.zeros(6, np.int64)
            out = dict(zip(NUMBERS, numbers.tolist()), groups_sha256=hashed_groups([r[1] for r in records]) if good else "")
            if with_links:
                links = np.frombuffer(b"".join([r[2] for r in records]) if good else b"", np.int64)
                keys, n = np.unique(links, return_counts=True)
                out |= {"links": keys.tobytes(), "times": n.astype(np.int64).tobytes()}
            return out

        for batch in batches:
            texts = as_bytes(batch.column(at))
            found: list = [None] * len(texts)
            for places in runs(texts):
                for i, records in zip(places, memo.of([parts_in(texts[i]) for i in places])):
                    found[i] = result(records)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, arrow)], names=[*keep, into])

    return docs.select(*map(col, keep), col(text).cast("string").alias(fresh(docs, "text"))).mapInArrow(run, schema)


def sent_to_shards(docs: DataFrame, models, text: str, into: str, table: DataFrame, shards: int) -> DataFrame:
    """The same by sending each document's links, packed per shard, to the shards' counts."""
    row = fresh(docs, "row")
    found = documents_against(docs, models, text, into, None, True).withColumn(row, F.monotonically_increasing_id())
    found = written(found, "aligned-documents")

    def split(batches):
        for batch in batches:
            out = {"shard": [], "row": [], "links": [], "times": []}
            for id, links, times in zip(*(c.to_pylist() for c in batch.columns)):
                keys, n = np.frombuffer(links, np.int64), np.frombuffer(times, np.int64)
                of = shard_of(keys, shards)
                for s in np.unique(of).tolist():
                    here = of == s
                    for name, x in zip(out, (s, id, keys[here].tobytes(), n[here].tobytes())):
                        out[name].append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["shard"], pa.int32()), pa.array(out["row"], pa.int64()), pa.array(out["links"], pa.binary()), pa.array(out["times"], pa.binary())],
                names=list(out),
            )

    sent = found.select(F.col(row).alias("row"), F.col(f"`{into}`.links").alias("links"), F.col(f"`{into}`.times").alias("times"))
    sent = sent.mapInArrow(split, "shard int, row long, links binary, times binary")
    # A shard is asked by many rows: they are dealt over salts, and the shard is there once a salt.
    salts = 16
    asked = sent.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int")).groupBy("shard", "salt")
    held = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).groupBy("shard", "salt")

    def answer(key, rows, shard):
        out = []
        if rows.num_rows and shard.num_rows:
            counts = Counts(shard.column("hash")[0].as_py(), shard.column("counts")[0].as_py())
            for id, keys, times in zip(rows.column("row").to_pylist(), arrays(rows.column("links")), arrays(rows.column("times"))):
                n, best = counts.of(keys)
                out.append((id, int(times[best].sum()), int((times * n).sum())))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["id", "n_best", "count_sum"])

    sums = asked.cogroup(held).applyInArrow(answer, "id long, n_best long, count_sum long")
    sums = sums.groupBy("id").agg(F.sum("n_best").alias("n_best_"), F.sum("count_sum").alias("count_sum_"))
    new = {c: F.coalesce(F.col(f"{c}_"), F.lit(0)) if c in ("n_best", "count_sum") else F.col(f"`{into}`.{c}") for c in RESULT.names}
    rows = found.join(sums.withColumnRenamed("id", row + "_"), F.col(row) == F.col(row + "_"), "left")
    keep = [c for c in docs.columns if c.lower() != into.lower()]
    return rows.select(*map(col, keep), F.struct(*(v.alias(c) for c, v in new.items())).alias(into))


def align(
    docs: DataFrame,
    a_model: bytes,
    b_model: bytes,
    text: str = "text",
    into: str = "alignment",
    keep: list[str] | None = None,
    shards: int = SHARDS,
    copied_bytes: int = COPIED_BYTES,
) -> DataFrame:
    """Documents with ``into``: ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``a_model`` is the JSON of a byte-level tokenizer, ``b_model`` a SentencePiece model that adds a
    space; A encodes a space and the text, B the text, special strings are plain text. Groups end
    where tokens of both end; A and B tokens whose bytes overlap are linked. A pair's count is the
    number of documents (rows) in which it is linked; ``n_best`` counts links with the highest count
    of their A id, ``count_sum`` adds up the counts of all links. ``groups_sha256`` hashes
    ``a1,a2|b1;a3|b2``.

    Null and empty texts, and those that either tokenization does not give back byte by byte, have
    zeros, an empty hash and no part in the counts. Repeated rows are documents each; null ids and
    further columns pass through (one called ``into`` is replaced). An empty table stays empty. The
    documents are read twice and must not change in between. A text is one row in one task; it is
    aligned part by part between spaces, so only a text without any is long work at once. The pair
    table is copied to the workers only if it takes at most ``copied_bytes``.
    """
    spark = docs.sparkSession
    pin_batches(spark)
    models = spark.sparkContext.broadcast((a_model, b_model))
    table = pair_table(docs, models, text, shards)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]
    some = docs.select(*map(col, dict.fromkeys([*keep, text])))
    size = table.agg(F.coalesce(F.sum(F.octet_length("hash") + F.octet_length("counts")), F.lit(0)).alias("s")).first()["s"]
    if size > copied_bytes:
        return sent_to_shards(some, models, text, into, table, shards).select(*map(col, keep), col(into))
    copy: list = [None] * shards
    for row in table.toArrow().to_pylist():
        copy[row["shard"]] = row["hash"], row["counts"]
    shared = spark.sparkContext.broadcast(copy)
    return documents_against(some, models, text, into, shared, False).select(*map(col, keep), col(into))
