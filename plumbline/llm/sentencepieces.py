"""SentencePiece encoding and decoding as a max-plus scan.

Each text's best path through the lattice of pieces (``pieces``) is found in chunks:
giant texts are cut anywhere, every chunk yields the transfer matrix between the states
at its two cuts, the matrices combine associatively, and once the states at all cuts are
known each chunk is traced back by itself (``token_chunks``).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import token_chunks as C
from plumbline.llm.common import as_bytes, col, fresh, map_rows, quoted, task
from plumbline.llm.pieces import SPACE, STATES, decode, decode_known, encoder_of, lattice_of
from plumbline.llm.token_counts import longest_text

IDS = T.ArrayType(T.IntegerType(), containsNull=True)


def id_lists(packed: list[bytes]) -> pa.Array:
    """Packed ids as a list column."""
    sizes = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
    flat = np.frombuffer(b"".join(packed), np.int32)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if ends[-1] < 2**31:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat))


def traced(piece: dict, entry: tuple, exit_: tuple, model: bytes, states: int = STATES) -> bytes:
    """Ids of the pieces that begin in a chunk, on the best way between two states."""
    encoder, lattice = encoder_of(model, states), lattice_of(model)
    v, core = lattice.v, piece["core"]
    known = C.boundaries(core, piece["before"], piece["after"], piece["first"], piece["last"], lattice)

    def way(text, start, key, stop, end, end_key):
        back: dict = {}
        nodes = {start: {key: {0: (0.0, 0)}}}
        C.spread(text, nodes, stop, lattice, back=back)
        if end_key is None:
            end_key = max(nodes[end], key=lambda k: nodes[end][k][0][0])
        out = []
        while (end, end_key) != (start, key):
            end, end_key, p = back[end, end_key, 0]
            out.append(p)
        return out[::-1]

    def ids(found):
        return encoder.pack([i for p in found for i in v.token_ids(p)])

    if known is None:
        end = len(core) + exit_[0]
        return ids(way(core + piece["after"], *entry, len(core), end, exit_[1]))
    lo, hi = known
    out = [ids(way(core[:lo], *entry, lo, lo, None))] if lo else []
    led = piece["first"] and v.dummy
    inner = core[lo:hi]
    if inner:
        plain = (inner[1:] if led else inner).replace(SPACE, " ").encode()
        out.append(encoder.text(plain, led) if plain or not led else encoder.unit(SPACE))
    if hi < len(core):
        run = len(core[hi:]) - len(core[hi:].lstrip(SPACE))
        tail, _, _ = C.tail_start(core[hi:], lattice)
        found = way(tail + piece["after"], 0, "", len(tail), len(tail) + exit_[0], exit_[1])
        if run >= 2 and v.merges:
            own = run if found[0] == SPACE else run - 1
            out.append(encoder.unit(SPACE * own))
            found = found[1:] if found[0] == SPACE else found
        out.append(ids(found))
    return b"".join(out)


def id_rows(lists: pa.Array):
    """A list column as Python lists, one at a time: a batch of them would be large."""
    values = lists.flatten()
    if values.null_count or lists.null_count:
        yield from lists.to_pylist()
        return
    flat, ends = values.to_numpy(), np.cumsum(np.concatenate([[0], pc.list_value_length(lists).to_numpy()]))
    for a, b in zip(ends[:-1], ends[1:]):
        yield flat[a:b].tolist()


def encoded_chunks(
    chunks: DataFrame, ways: DataFrame, model, decoded: bool, states: int = STATES, held: bool = True
) -> DataFrame:
    """``(digest, chunk, ids, text)`` of all chunks; the text only if asked for."""

    def run(batches):
        v = lattice_of(model.value).v
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            rows = zip(pieces, batch.column("entry").to_pylist(), batch.column("exit").to_pylist())
            found = [traced(p, tuple(json.loads(e)), tuple(json.loads(x)), model.value, states) for p, e, x in rows]
            ids = id_lists(found)
            texts = [decode_known(i, v, p["first"]) if decoded else None for i, p in zip(id_rows(ids), pieces)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("chunk"), ids, pa.array(texts, pa.string())],
                names=["digest", "chunk", "ids", "text"],
            )

    joined = chunks.join(ways.withColumnRenamed("at", "chunk"), ["digest", "chunk"])
    return joined.mapInArrow(task(run, held), "digest string, chunk long, ids array<int>, text string")


def encode(
    docs: DataFrame,
    model: bytes,
    text: str = "text",
    into: str = "ids",
    chunk: int = C.CHUNK,
    keep: list[str] | None = None,
    decoded: str | None = None,
    states: int = STATES,
    held: bool = True,
) -> DataFrame:
    """Documents with the token ids of their whole text, as the library gives them.

    No begin, end or special tokens. A text of at most ``chunk`` bytes is one chunk and encoded
    where it is; longer ones are cut and dealt over the cluster. Equal long texts are encoded once.
    A document's ids come together in one row, as its text does. ``decoded`` names a further column
    for the text that the ids decode to, chunk by chunk. ``states`` bounds what a worker remembers of
    the tokenizer (about 400 bytes each, and words and pairs in proportion): fewer take more time, the ids are the same. ``held``: workers
    keep the tokenizer for their next task, which takes memory while they are idle.

    Null texts have null ids, empty texts none. Rows are encoded one by one, repeated rows each;
    null ids and further columns pass through (those named like the results are replaced).
    """
    results = [into, *([decoded] if decoded else [])]
    taken = {c.lower() for c in results}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    giant = F.octet_length(col(text)) > chunk
    longest = longest_text(docs, text)
    both = fresh(docs, "encoded")
    kind = T.StructType([T.StructField("ids", IDS), T.StructField("text", T.StringType())])

    def make():
        encoder = encoder_of(shared.value, states)
        v = encoder.lattice.v

        def run(texts):
            raw = as_bytes(texts)
            found = id_lists([encoder.text(x, v.dummy) if x else b"" for x in raw])
            back = pa.array([decode_known(i, v) for i in id_rows(found)] if decoded else [None] * len(raw), pa.string())
            if texts.null_count:
                found = pa.array([None if x is None else i for x, i in zip(raw, found.to_pylist())], pa.list_(pa.int32()))
                back = pc.if_else(texts.is_valid(), back, None)
            return pa.StructArray.from_arrays([found, back], names=["ids", "text"])

        return run

    def parts(df):
        fields = zip(("ids", "text"), results)
        return df.select(*map(col, keep), *(F.col(f"{quoted(both)}.{f}").alias(name) for f, name in fields))

    out = parts(map_rows(docs.where(F.coalesce(~giant, F.lit(True))), make, [text], both, kind, keep=keep, held=held))
    if longest <= chunk:
        return out
    digest = fresh(docs, "digest")
    named = docs.where(giant).withColumn(digest, F.sha2(col(text).cast("binary"), 256))
    chunks = C.chunked(named, text, digest, shared, chunk, held)
    ways = C.ways(C.transferred(chunks, shared, with_counts=False, held=held), C.most_chunks(longest, chunk))
    rows = encoded_chunks(chunks, ways, shared, bool(decoded), states, held).groupBy("digest")
    joined = rows.agg(F.array_sort(F.collect_list(F.struct("chunk", "ids", "text"))).alias("parts"))
    whole = F.struct(F.flatten("parts.ids").alias("ids"), F.array_join("parts.text", "").alias("text"))
    found = joined.select(F.col("digest").alias(digest), whole.alias(both))
    return out.unionByName(parts(named.join(found, digest, "left")))


def decode_ids(
    docs: DataFrame, model: bytes, ids: str = "ids", into: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Rows with the text of their token ids.

    Bytes that form no character become one replacement character each; control ids give nothing;
    null, unknown and foreign ids give the unknown mark. Null lists give null, empty ones an empty
    text. ``decode_ids(encode(x))`` gives back every text without a space mark of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        v = lattice_of(shared.value).v

        return lambda lists: [None if x is None else decode(x, v) for x in id_rows(lists)]

    return map_rows(docs, make, [ids], into, T.StringType(), keep=keep)
