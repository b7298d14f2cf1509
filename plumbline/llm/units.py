"""Documents in units, and numbers exchanged between units by hash.

Statistics over all windows of all documents need each window's hash to meet its equals.
Rows of single windows are too many to shuffle, so documents are dealt into units of a few
megabytes, and a unit sends one packed array to each hash partition: its distinct hashes in
order, with their local facts. The partition answers with one packed array per unit, in the
same order, which the unit, having its texts at hand again, can line up with its own hashes.
The exchange that deals out the texts is the same for every step, so Spark runs it once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import col, pin_batches

UNIT_BYTES = 8 << 20
PART_BYTES = 8 << 20

SENT = "part int, unit int, n int, hashes binary, facts binary"
ANSWER = "unit int, step string, part int, facts binary"


class Layout:
    """How many units and hash partitions a text table gets, from its bytes."""

    def __init__(self, total_bytes: int, unit_bytes: int = UNIT_BYTES, part_bytes: int = PART_BYTES):
        self.units = max(1, -(-total_bytes // unit_bytes))
        self.parts = max(1, -(-total_bytes // part_bytes))
        self.scale = max(1, total_bytes).bit_length()

    def bits(self, spare: int) -> int:
        """Bits of a hash so that equal hashes of different things are one in ``2 ** spare``."""
        return min(64, self.scale + spare)


def in_units(docs: DataFrame, id: str, text: str, layout: Layout, **more) -> DataFrame:
    """``(unit, id, t, ...)``, dealt out by unit."""
    pin_batches(docs.sparkSession)
    unit = F.pmod(F.xxhash64(col(id), col(text)), F.lit(layout.units)).cast("int")
    rows = docs.select(unit.alias("unit"), col(id).alias("id"), col(text).alias("t"), *(c.alias(n) for n, c in more.items()))
    return rows.repartition(layout.units, "unit")


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, the empty high ones left out: what a shuffle's compression likes."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(packed: bytes) -> np.ndarray:
    width = packed[0]
    n = (len(packed) - 1) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack_sorted(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unplanes(packed), dtype=np.uint64)


def part_starts(hashes: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each partition's hashes begin (and the last ends) among sorted hashes of so many bits."""
    lows = [-(-(p << bits) // parts) for p in range(parts)]
    return np.append(np.searchsorted(hashes, np.array(lows, np.uint64)), len(hashes))


def sent(unit: int, hashes: np.ndarray, parts: int, bits: int, *facts: np.ndarray) -> pa.Table:
    """A unit's sorted hashes and the facts of each, cut by partition."""
    starts = part_starts(hashes, parts, bits)
    rows = []
    for p, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        if b > a:
            packed = [planes(f[a:b]) for f in facts]
            head = np.array([len(x) for x in packed], "<u4").tobytes()
            rows.append((p, unit, int(b - a), pack_sorted(hashes[a:b]), head + b"".join(packed)))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) or [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "unit", "n", "hashes", "facts"])


def received(table: pa.Table, facts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Everything sent to a partition: units, where each one's entries begin, hashes, facts."""
    units = table.column("unit").to_numpy()
    starts = np.concatenate([[0], np.cumsum(table.column("n").to_numpy())]).astype(np.int64)
    hashes = np.concatenate([unpack_sorted(x) for x in table.column("hashes").to_pylist()])
    out = [[] for _ in range(facts)]
    for x in table.column("facts").to_pylist():
        sizes = np.frombuffer(x, "<u4", facts)
        at = 4 * facts
        for k, size in enumerate(sizes):
            out[k].append(unplanes(x[at : at + size]))
            at += size
    return units, starts, hashes, [np.concatenate(x) for x in out]


def answers(step: str, part: int, units, starts, packed) -> pa.Table:
    """One answer per unit; ``packed(a, b)`` gives it for the entries from a to b."""
    facts = [packed(a, b) for a, b in zip(starts[:-1], starts[1:])]
    return pa.table(
        [pa.array(units, pa.int32()), pa.array([step] * len(facts)), pa.array([part] * len(facts), pa.int32()), pa.array(facts, pa.binary())],
        names=["unit", "step", "part", "facts"],
    )


def answered(table: pa.Table, step: str) -> list[bytes]:
    """A unit's answers of one step in the order of partitions, which is that of its hashes."""
    rows = zip(table.column("step").to_pylist(), table.column("part").to_pylist(), table.column("facts").to_pylist())
    return [facts for _, facts in sorted((p, f) for s, p, f in rows if s == step)]


def flags(rows: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Bit masks of answers, one after another, as booleans."""
    out = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(rows, sizes)]
    return np.concatenate(out) if out else np.empty(0, bool)


def part_sizes(hashes: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Entries per partition that has any, in order."""
    sizes = np.diff(part_starts(hashes, parts, bits))
    return sizes[sizes > 0]
