"""Giant texts in chunks: transfer matrices between boundary states, combined by scan.

A chunk may begin inside a piece. Its boundary states are the pieces that can lie
across (or end at) the cut, read off the few characters around it; at a hard boundary
there is one state. A chunk's transfer matrix says, for each entry and exit state, what
the best way through is worth and how many tokens it has. Matrices combine
associatively (max-plus), so a document is a scan over its chunks, in groups of a
fixed number, level by level.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, col, task
from plumbline.llm.pieces import SPACE, Lattice

CHUNK = 65_536
FAN = 64

OPEN = (0, "")  # the only state at a hard boundary: nothing hangs over
PIECE = "struct<before:string,core:string,after:string,first:boolean,last:boolean>"
PIECE_ARROW = pa.struct(
    [(n, pa.string()) for n in ("before", "core", "after")] + [(n, pa.bool_()) for n in ("first", "last")]
)


def cuts(text: str, size: int) -> list[int]:
    """Ends of chunks of about ``size``; none follows a space, so runs of spaces stay whole."""
    out, at = [], 0
    while len(text) - at > size:
        end = at + size
        while end > at and text[end - 1] == SPACE:
            end -= 1
        if end == at:
            end = at + size
            while end < len(text) and text[end] == SPACE:
                end += 1
            end = min(end + 1, len(text))  # with one character of the word that follows
        if end >= len(text):
            break
        out.append(end)
        at = end
    return [*out, len(text)]


def normal(text: bytes, dummy: bool) -> str:
    """The text as the lattice reads it: spaces marked, led by one if the model says so."""
    marked = text.decode().replace(" ", SPACE)
    return SPACE + marked if dummy and marked else marked


def chunked(docs: DataFrame, text: str, digest: str, model, size: int, held: bool = True) -> DataFrame:
    """``(digest, chunk, piece)`` of every distinct text, dealt out by both: the one time that giant texts move."""

    def run(batches):
        from plumbline.llm.pieces import lattice_of

        v = lattice_of(model.value).v
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                whole, start = normal(raw, v.dummy), 0
                for n, end in enumerate(cuts(whole, size)):
                    piece = {
                        "before": whole[max(0, start - v.longest) : start],
                        "core": whole[start:end],
                        "after": whole[end : end + v.longest],
                        "first": start == 0,
                        "last": end == len(whole),
                    }
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([n], pa.int64()), pa.array([piece], PIECE_ARROW)], names=["digest", "chunk", "piece"]
                    )
                    start = end

    parts = docs.select(F.col(digest).alias("digest"), col(text).alias("t")).mapInArrow(
        task(run, held), f"digest string, chunk long, piece {PIECE}"
    )
    return parts.groupBy("digest", "chunk").agg(F.first("piece").alias("piece"))


def hard(left: str, right: str, lattice: Lattice) -> bool:
    """Whether no piece can hold both characters."""
    chars = lattice.v.chars
    return (right == SPACE and left != SPACE) or left not in chars or right not in chars


def states(before: str, after: str, lattice: Lattice) -> list[tuple[int, str]]:
    """States at a cut: how far a piece hangs over it, and what its successor must know of it."""
    if not before or not after or hard(before[-1], after[0], lattice):
        return [OPEN]
    found = set()
    around = before + after
    for start in range(max(0, len(before) - lattice.v.longest), len(before)):
        for piece in lattice.at(around, start):
            over = start + len(piece) - len(before)
            if over >= 0:
                found.add((over, lattice.key(piece)))
    return sorted(found)


def spread(text: str, nodes: dict, stop: int, lattice: Lattice, costs=None, back=None) -> dict:
    """Best ways from ``nodes`` (``{place: {key: {entry: (worth, tokens)}}}``) to places at or beyond ``stop``.

    ``costs(piece, place)`` gives a piece's tokens; ``back`` collects ``(place, key, entry) -> (place, key, piece)``.
    """
    width = costs or (lambda piece, place: lattice.v.width(piece))
    for place in range(stop):
        here = nodes.get(place)
        if not here:
            continue
        for piece in lattice.at(text, place):
            end, key, worth, n = place + len(piece), lattice.key(piece), lattice.worth(piece), width(piece, place)
            for left, ways in here.items():
                if lattice.compatible(left, piece):
                    there = nodes.setdefault(end, {}).setdefault(key, {})
                    for entry, (w, k) in ways.items():
                        if entry not in there or w + worth > there[entry][0]:
                            there[entry] = (w + worth, k + n)
                            if back is not None:
                                back[end, key, entry] = (place, left, piece)
    return {place: keys for place, keys in nodes.items() if place >= stop}


def boundaries(core: str, before: str, after: str, first: bool, last: bool, lattice: Lattice) -> tuple[int, int] | None:
    """First and last hard boundary of a chunk, or None if it has none."""
    n = len(core)
    if first:
        lo = 0
    else:
        whole = before[-1:] + core
        lo = next((i for i in range(n) if hard(whole[i], whole[i + 1], lattice)), None)
        if lo is None and (last or hard(core[-1], after[0], lattice)):
            lo = n
    if lo is None:
        return None
    if last or hard(core[-1], after[0], lattice):
        return lo, n
    return lo, next((i for i in range(n - 1, lo, -1) if hard(core[i - 1], core[i], lattice)), lo)


def tail_start(tail: str, lattice: Lattice) -> tuple[str, int, int]:
    """A tail without the spaces that are surely their own tokens, what these cost, and what the last costs if alone."""
    run = len(tail) - len(tail.lstrip(SPACE))
    if run < 2 or not lattice.v.merges:
        return tail, 0, 1
    fewer, all_ = len(lattice.v.run(run - 1)), len(lattice.v.run(run))
    return tail[run - 1 :], fewer, all_ - fewer


def transfer(piece: dict, lattice: Lattice, inner) -> list[list]:
    """The matrix of a chunk as ``[entry over, entry key, exit over, exit key, worth, tokens]`` rows.

    ``inner(text, first)`` gives worth and tokens of what lies between two hard boundaries.
    """
    before, core, after = piece["before"], piece["core"], piece["after"]
    entries = [OPEN] if piece["first"] else states(before, core + after, lattice)
    sources: dict = {}
    for over, key in entries:
        sources.setdefault(over, {})[key] = {(over, key): (0.0, 0)}
    known = boundaries(core, before, after, piece["first"], piece["last"], lattice)
    if known is None:
        ends = spread(core + after, sources, len(core), lattice)
        return rows(ends, len(core), set(states(before + core, after, lattice)))
    lo, hi = known
    head = spread(core[:lo], sources, lo, lattice)
    arrived = {e: w for keys in head.get(lo, {}).values() for e, w in keys.items()} if lo else sources[0][""]
    if lo:
        arrived = best_of(head.get(lo, {}))
    worth, n = inner(core[lo:hi], piece["first"])
    arrived = {e: (w + worth, k + n) for e, (w, k) in arrived.items()}
    if hi == len(core):
        return [[*e, *OPEN, w, k] for e, (w, k) in arrived.items()]
    tail, spent, alone = tail_start(core[hi:], lattice)
    arrived = {e: (w, k + spent) for e, (w, k) in arrived.items()}

    def costs(p, place):
        return alone if p == SPACE and place == 0 and tail[0] == SPACE else lattice.v.width(p)

    ends = spread(tail + after, {0: {"": arrived}}, len(tail), lattice, costs)
    return rows(ends, len(tail), set(states(before + core, after, lattice)))


def best_of(keys: dict) -> dict:
    out: dict = {}
    for ways in keys.values():
        for e, w in ways.items():
            if e not in out or w[0] > out[e][0]:
                out[e] = w
    return out


def rows(ends: dict, stop: int, allowed: set) -> list[list]:
    return [
        [*entry, place - stop, key, w, k]
        for place, keys in ends.items()
        for key, ways in keys.items()
        if (place - stop, key) in allowed
        for entry, (w, k) in ways.items()
    ]


def through(vector: dict, matrix: list[list], back: dict | None = None) -> dict:
    """A max-plus vector over states times a matrix."""
    out: dict = {}
    for eo, ek, xo, xk, w, k in matrix:
        if (eo, ek) in vector:
            before, n = vector[eo, ek]
            if (xo, xk) not in out or before + w > out[xo, xk][0]:
                out[xo, xk] = (before + w, n + k)
                if back is not None:
                    back[xo, xk] = (eo, ek)
    return out


def product(matrices: list[list]) -> list[list]:
    """The matrices of neighbours as one."""
    out = []
    for entry in {(m[0], m[1]) for m in matrices[0]}:
        vector = {entry: (0.0, 0)}
        for m in matrices:
            vector = through(vector, m)
        out += [[*entry, *x, w, k] for x, (w, k) in vector.items()]
    return out


def states_between(matrices: list[list], entry: tuple, exit_: tuple | None) -> list[tuple]:
    """States at all cuts of a run of chunks on the best way from ``entry`` to ``exit_`` (None: the best end)."""
    vector, backs = {entry: (0.0, 0)}, []
    for m in matrices:
        backs.append({})
        vector = through(vector, m, backs[-1])
    at = exit_ if exit_ is not None else max(vector, key=lambda x: vector[x][0])
    out = [at]
    for back in reversed(backs):
        at = back[at]
        out.append(at)
    return out[::-1]


def transferred(chunks: DataFrame, model, with_counts: bool, held: bool = True) -> DataFrame:
    """``(digest, at, matrix)`` of all chunks."""

    def run(batches):
        from plumbline.llm.pieces import counts_of, lattice_of

        lattice = lattice_of(model.value)
        counts = counts_of(model.value) if with_counts else None

        def inner(text, first):
            if not with_counts or not text:
                return 0.0, 0
            # The text's own mark of the model's leading space is taken off again: counting adds it.
            led = first and lattice.v.dummy
            plain = (text[1:] if led else text).replace(SPACE, " ").encode()
            return 0.0, counts.text(plain, led) if plain or not led else counts.unit(SPACE)

        for batch in batches:
            found = [json.dumps(transfer(p, lattice, inner)) for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("chunk"), pa.array(found, pa.string())], names=["digest", "at", "matrix"]
            )

    return chunks.mapInArrow(task(run, held), "digest string, at long, matrix string")


def ordered(table: pa.Table) -> tuple[list[int], list[list]]:
    pairs = sorted(zip(table.column("at").to_pylist(), table.column("matrix").to_pylist()))
    return [a for a, _ in pairs], [json.loads(m) for _, m in pairs]


def combined(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """Every ``fan`` neighbours as one matrix."""

    def run(table: pa.Table) -> pa.Table:
        _, found = ordered(table)
        return pa.table(
            {"digest": table.column("digest")[:1], "at": table.column("block")[:1], "matrix": [json.dumps(product(found))]}
        )

    blocks = matrices.withColumn("block", F.expr(f"at div {fan}"))
    return blocks.groupBy("digest", "block").applyInArrow(run, "digest string, at long, matrix string")


def totals(matrices: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """``(digest, n_tokens)``: all matrices of a text as one; ``most`` bounds the chunks of any text."""
    while most > 1:
        matrices, most = combined(matrices, fan), -(-most // fan)

    def run(batches):
        for batch in batches:
            n = [max(json.loads(m), key=lambda r: r[4])[5] for m in batch.column("matrix").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return matrices.mapInArrow(run, "digest string, n_tokens long")


WAYS = "digest string, at long, entry string, exit string"


def ways(matrices: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """``(digest, at, entry, exit)``: the states at both ends of every chunk on the best way through its text.

    Up: matrices of ``fan`` neighbours combine until one is left. Down: within each group, the states
    between its ends follow from the matrices alone.
    """

    def out(digest, at, path):
        return pa.table(
            {
                "digest": pa.array([digest] * len(at), pa.string()),
                "at": pa.array(at, pa.int64()),
                "entry": pa.array([json.dumps(x) for x in path[:-1]], pa.string()),
                "exit": pa.array([json.dumps(x) for x in path[1:]], pa.string()),
            }
        )

    if most <= fan:

        def top(table: pa.Table) -> pa.Table:
            at, found = ordered(table)
            return out(table.column("digest")[0].as_py(), at, states_between(found, OPEN, None))

        return matrices.groupBy("digest").applyInArrow(top, WAYS)

    def down(table: pa.Table, given: pa.Table) -> pa.Table:
        at, found = ordered(table)
        ends = [tuple(json.loads(given.column(c)[0].as_py())) for c in ("entry", "exit")]
        return out(table.column("digest")[0].as_py(), at, states_between(found, *ends))

    outer = ways(combined(matrices, fan), -(-most // fan), fan).withColumnRenamed("at", "block")
    inner = matrices.withColumn("block", F.expr(f"at div {fan}"))
    return inner.groupBy("digest", "block").cogroup(outer.groupBy("digest", "block")).applyInArrow(down, WAYS)


def most_chunks(longest: int, size: int) -> int:
    """A bound on the chunks of a text of so many bytes: two neighbours are longer than ``size`` together."""
    return 2 * (longest // size) + 2
