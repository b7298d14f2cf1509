"""Substring deduplication by fixed-block anchors.

Reference blocks are the non-overlapping seven-word blocks of every document (words 0-6,
7-13, ...). Any 13 consecutive words hold a whole block, so a passage of 13 words that a
document shares with a reference is hit by probing with every rolling seven-word window:
where a window equals a block of another document, there is an anchor. Around anchors hits
are extended: every 13-word window that holds an anchor is compared in full, and windows in
a row make maximal repeats. A window is removed where the least document that has it is a
smaller one.

Both comparisons are exchanges between units of documents (``units``): a block or window
that a third of all documents hold is one entry per unit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import units as U
from plumbline.llm.common import WordHash, as_bytes, covered, text_bytes, window_hashes

WINDOW = 13
SPARE = 8


def block_size(window: int) -> int:
    """The longest block of which every window holds a whole one."""
    return (window + 1) // 2


class Texts:
    """The documents of a unit in order of their ids, those without an id last, and their hashed words."""

    def __init__(self, table: pa.Table):
        order = table.column("id").combine_chunks()
        self.unit = table.column("unit")[0].as_py()
        by = np.array(sorted(range(len(order)), key=lambda i: (not order[i].is_valid, order[i].as_py())))
        table = table.take(pa.array(by))
        self.ids = table.column("id").combine_chunks()
        self.known = len(self.ids) - self.ids.null_count
        self.raw = as_bytes(table.column("t").combine_chunks())

    def words(self):
        memo = WordHash()
        for x in self.raw:
            words = x.split() if x else []
            yield words, memo.array(words)


def rolling(texts: Texts, size: int, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Word hashes and cut rolling hashes of every document that has an id."""
    hashed, rolled = [], []
    for (_, h), _ in zip(texts.words(), range(texts.known)):
        hashed.append(h)
        rolled.append(window_hashes(h, size) >> np.uint64(64 - bits))
    return hashed, rolled


def joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def extended(texts: Texts, hashed, rolled, distinct, inverse, anchor, window, block):
    """Full hashes of the windows around anchors, each with its document's place in the unit and its own start."""
    at, hashes, docs, starts = 0, [], [], []
    hit = anchor[inverse] if len(distinct) else np.empty(0, bool)
    for k, (h, r) in enumerate(zip(hashed, rolled)):
        mine = hit[at : at + len(r)]
        at += len(r)
        n = len(h) - window + 1
        if n > 0 and mine.any():
            near = np.cumsum(np.concatenate([[0], mine]))
            inside = window - block + 1
            some = np.flatnonzero(near[inside : inside + n] > near[:n])
            hashes.append(window_hashes(h, window)[some])
            docs.append(np.full(len(some), k, np.int64))
            starts.append(some)
    return joined(hashes), joined(docs, np.int64), joined(starts, np.int64)


def remove_repeats(
    docs: DataFrame, text: str = "text", id: str = "doc_id", window: int = WINDOW, with_text: bool = True,
    unit_bytes: int = U.UNIT_BYTES, part_bytes: int = U.PART_BYTES,
) -> DataFrame:
    """One row per document: ``id, n_words, n_removed, spans, kept_sha256`` and, if asked for, ``kept``.

    Words are runs without ASCII white space, unchanged. A word is removed if it lies in a window
    of ``window`` consecutive words whose word sequence also starts in a document with a smaller id;
    windows are judged on the input. ``spans`` are the removed runs of words (from, to), ``kept`` the
    other words joined by single spaces, ``kept_sha256`` the digest of that text.

    Anchors are found by cut hashes and may be false; windows are compared by 64-bit hashes of
    their words. Texts are shuffled once, into units.

    Null and empty texts and texts shorter than a window lose nothing. A document without an id is
    neither smaller nor greater than others: it loses nothing and costs others nothing. Rows that
    share an id do not remove each other. An empty table gives no rows.
    """
    layout = U.Layout(text_bytes(docs, text), unit_bytes, part_bytes)
    block, bits, parts = block_size(window), layout.bits(SPARE), layout.parts
    kind = docs.schema[id].dataType.simpleString()
    units = U.in_units(docs, id, text, layout)

    def distinct_blocks(rolled):
        return np.unique(joined(rolled), return_inverse=True)

    def probe(table: pa.Table) -> pa.Table:
        """Distinct rolling hashes: is it a reference block somewhere here, is it in several documents here."""
        texts = Texts(table)
        _, rolled = rolling(texts, block, bits)
        distinct, inverse = distinct_blocks(rolled)
        is_block, last, several = (np.zeros(len(distinct), t) for t in (bool, np.int64, bool))
        last -= 1
        at = 0
        for k, r in enumerate(rolled):
            own = inverse[at : at + len(r)]
            at += len(r)
            is_block[own[::block]] = True
            several[own[(last[own] >= 0) & (last[own] != k)]] = True
            last[own] = k
        return U.sent(texts.unit, distinct, parts, bits, is_block + 2 * several.astype(np.uint64))

    def meet(table: pa.Table) -> pa.Table:
        """Anchors: blocks that several documents hold."""
        unit, starts, hashes, (facts,) = U.received(table, 1)
        distinct, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        is_block, several = np.zeros(len(distinct), bool), counts > 1
        is_block[inverse[facts & 1 == 1]] = True
        several[inverse[facts & 2 == 2]] = True
        anchor = (is_block & several)[inverse]
        return U.answers("anchors", table.column("part")[0].as_py(), unit, starts, lambda a, b: np.packbits(anchor[a:b]).tobytes())

    def around(table: pa.Table, replies: pa.Table):
        texts = Texts(table)
        hashed, rolled = rolling(texts, block, bits)
        distinct, inverse = distinct_blocks(rolled)
        anchor = U.flags(U.answered(replies, "anchors"), U.part_sizes(distinct, parts, bits))
        hashes, where, starts = extended(texts, hashed, rolled, distinct, inverse, anchor, window, block)
        whole, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        return texts, whole, where[first], where, starts, inverse

    def extend(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Distinct whole windows with the least document that has each here."""
        texts, whole, least, *_ = around(table, replies)
        ids = texts.ids.take(pa.array(least, pa.int64())).to_numpy(zero_copy_only=False).astype(np.int64)
        # Ids keep their order as unsigned numbers.
        return U.sent(texts.unit, whole, parts, 64, ids.view(np.uint64) ^ np.uint64(1 << 63))

    def judge(table: pa.Table) -> pa.Table:
        """Windows whose least document is in another unit."""
        unit, starts, hashes, (ids,) = U.received(table, 1)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        least = np.full(len(distinct), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, inverse, ids)
        earlier = least[inverse] < ids
        return U.answers("repeats", table.column("part")[0].as_py(), unit, starts, lambda a, b: np.packbits(earlier[a:b]).tobytes())

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        texts, whole, least, where, starts, inverse = around(table, replies)
        earlier = U.flags(U.answered(replies, "repeats"), U.part_sizes(whole, parts, 64))
        ids = texts.ids.to_pylist()
        owner = np.searchsorted(np.array([i for i in ids if i is not None]), [i for i in ids if i is not None]) if texts.known else np.empty(0, np.int64)
        # Within the unit a window goes where its document comes after the least one that has it.
        gone = (earlier[inverse] | (owner[where] > owner[least[inverse]])) if len(where) else np.empty(0, bool)
        edges = np.searchsorted(where, np.arange(len(ids) + 1))
        out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "spans", "kept_sha256", "kept")}
        for k, x in enumerate(texts.raw):
            words = x.split() if x else []
            mine = slice(edges[k], edges[k + 1])
            lost = covered(starts[mine][gone[mine]], window, len(words)) if gone[mine].any() else np.zeros(len(words), bool)
            step = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
            kept = b" ".join([w for w, gone_ in zip(words, lost) if not gone_] if lost.any() else words)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(lost.sum()))
            out["spans"].append([{"from": int(a), "to": int(b)} for a, b in step.reshape(-1, 2)])
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode() if with_text else None)
        span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        return pa.table(
            [
                texts.ids,
                pa.array(out["n_words"], pa.int64()),
                pa.array(out["n_removed"], pa.int64()),
                pa.array(out["spans"], span),
                pa.array(out["kept_sha256"], pa.string()),
                pa.array(out["kept"], pa.string()),
            ],
            names=["id", "n_words", "n_removed", "spans", "kept_sha256", "kept"],
        )

    by_unit = units.groupBy("unit")
    anchors = by_unit.applyInArrow(probe, U.SENT).groupBy("part").applyInArrow(meet, U.ANSWER)
    windows = by_unit.cogroup(anchors.groupBy("unit")).applyInArrow(extend, U.SENT)
    repeats = windows.groupBy("part").applyInArrow(judge, U.ANSWER)
    replies = anchors.unionByName(repeats)
    schema = f"id {kind}, n_words long, n_removed long, spans array<struct<`from`:int,`to`:int>>, kept_sha256 string, kept string"
    done = by_unit.cogroup(replies.groupBy("unit")).applyInArrow(cut, schema)
    return done if with_text else done.drop("kept")
