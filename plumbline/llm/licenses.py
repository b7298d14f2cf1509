"""Licence scans: winnowed fingerprints pick candidates, banded alignment measures them.

Of every two neighbouring four-word hashes of a template the smaller is a fingerprint, so
any five words in a row that a text shares with a template hold one; short templates keep all
hashes, so four words do, and templates of three words are looked up whole. Fingerprints of all
templates form an inverted index; every four-word window of a text is looked up. Hits of one
template on neighbouring diagonals are a candidate, and the template is aligned with that
stretch of text within a band around them (longest common subsequence). Hits that lie on several
diagonals, as words were inserted or left out between them, are chained and aligned together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WordHash, as_bytes, map_rows, window_hashes
from plumbline.llm.decontaminate import words
from plumbline.llm.license_texts import built_in

GRAM, NEAR = 4, 2
LEAST_WORDS = 3  # templates between this and a window's length are matched as whole sequences
SHORT = 20  # templates of fewer words keep all their windows
BAND = 8
COVERAGE = 0.8
LEAST_HITS = 0.0  # every run of hits is aligned
BLOCK_BYTES = 4 << 20

MATCHES = T.ArrayType(
    T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("matched", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("stop", T.IntegerType()),
            T.StructField("best", T.BooleanType()),
        ]
    )
)


def winnowed(hashes: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Places of the least hash of every ``near`` neighbours, the last on ties."""
    if near == 1:
        return np.arange(len(hashes))
    if len(hashes) <= near:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.empty(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(hashes, near)
    return np.unique(np.arange(len(rows)) + near - 1 - np.argmin(rows[:, ::-1], axis=1))


class Index:
    """Templates as hashed words, and where each fingerprint stands in which of them."""

    def __init__(self, templates: list[tuple[str, str]]):
        memo = WordHash()
        self.names, self.hashed, self.prints, self.whole = [], [], [], []
        found = []
        for name, text in templates:
            w = words(text.encode())
            h = memo.array(w)
            grams = window_hashes(h, min(GRAM, len(w))) if w else h
            at = winnowed(grams, NEAR if len(w) >= SHORT else 1)
            if len(w) >= LEAST_WORDS:
                if len(w) >= GRAM:
                    found += [(int(grams[i]), len(self.names), int(i)) for i in at]
                else:
                    self.whole.append(len(self.names))
                self.names.append(name)
                self.hashed.append(h)
                self.prints.append(len(at))
        found.sort()
        self.keys = np.array([f[0] for f in found], np.uint64)
        self.template = np.array([f[1] for f in found], np.int64)
        self.place = np.array([f[2] for f in found], np.int64)


def hits_of(h: np.ndarray, index: Index) -> dict[int, np.ndarray]:
    """For each template hit: ``(diagonal, place in the template)`` of its fingerprints in the text, sorted."""
    grams = window_hashes(h, GRAM)
    lo, hi = np.searchsorted(index.keys, grams, "left"), np.searchsorted(index.keys, grams, "right")
    at = np.flatnonzero(hi > lo)
    if not len(at):
        return {}
    n = hi[at] - lo[at]
    entry = np.repeat(lo[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
    t, place = index.template[entry], index.place[entry]
    diagonal = np.repeat(at, n) - place
    order = np.lexsort((place, diagonal, t))
    rows = np.stack([diagonal, place], axis=1)[order]
    names, starts = np.unique(t[order], return_index=True)
    return dict(zip(names.tolist(), np.split(rows, starts[1:])))


def runs(found: np.ndarray, own: int) -> list[np.ndarray]:
    """Hits in runs of neighbouring diagonals: a run ends at a gap, or when it grows too wide for one band."""
    d, out, start = found[:, 0].tolist(), [], 0
    for k in range(1, len(d) + 1):
        if k == len(d) or d[k] - d[k - 1] > own or d[k] - d[start] > 2 * own:
            out.append(found[start:k])
            start = k
    return out


def chains(found: np.ndarray, reach: int) -> list[np.ndarray]:
    """Hits in chains that go forward in template and text, those with the most hits first.

    Two hits in a row are at most ``reach`` words of text apart. Of chains with equally many hits
    the one that changes its diagonal least is taken; every hit is in one chain.
    """
    text = found[:, 0] + found[:, 1]
    order = np.lexsort((found[:, 1], text))
    hits, text = found[order], text[order]
    first = np.searchsorted(text, text - reach, "left")
    score, back = np.ones(len(hits)), np.full(len(hits), -1)
    for k in range(1, len(hits)):
        near = slice(first[k], k)
        moved = np.abs(hits[near, 0] - hits[k, 0])
        gain = score[near] - np.where(moved > 0, 0.01 + 0.001 * np.minimum(moved, reach) / reach, 0.0)
        gain[(text[near] >= text[k]) | (hits[near, 1] >= hits[k, 1])] = -1
        if len(gain) and gain.max() > 0:
            best = len(gain) - 1 - int(np.argmax(gain[::-1]))
            score[k], back[k] = 1 + gain[best], first[k] + best
    used, out = np.zeros(len(hits), bool), []
    for k in np.argsort(-score, kind="stable").tolist():
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = int(back[k])
        if chain:
            out.append(hits[chain[::-1]])
    return out


def whole_places(template: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where the text holds the template's words in a row."""
    n = len(text) - len(template) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.logical_and.reduce([text[i : i + n] == x for i, x in enumerate(template)]))


def narrowed(band: int, length: int) -> int:
    """The band of a template: at most a quarter of it, so that a notice said twice in a row is found twice."""
    return min(band, max(1, length // 4))


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Longest common subsequence on the diagonals ``low`` to ``high``: matched words, and the text's span."""
    return align_on(template, text, np.arange(low, high + 1))


def align_on(template: np.ndarray, text: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int]:
    """Longest common subsequence on the given diagonals (ascending): matched words, and the text's span.

    Row i of the table is a word of the template, a column one of the diagonals. Gaps cost
    nothing, so a row is a running maximum; the span is read off the way back. Skipping words of
    the template leads to the next column on the right, as many rows up as the diagonals differ.
    """
    m, width = len(template), len(diagonals)
    table = np.zeros((m + 1, width + 2), np.int32)  # one column of margin on both sides
    up = np.append(np.diff(diagonals), 1)
    apart = np.flatnonzero(up > 1)
    for i in range(m):
        j = diagonals + i
        inside = (j >= 0) & (j < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[j[inside]] == template[i]
        # Diagonal step: same column; skipping template words: the column to the right, some rows up.
        row = np.maximum(table[i, 1:-1] + same, table[i, 2:])
        if len(apart):
            row[apart] = np.maximum(
                table[i, apart + 1] + same[apart], table[np.maximum(i + 1 - up[apart], 0), apart + 2]
            )
        table[i + 1, 1:-1] = np.maximum.accumulate(row)
        table[i + 1, -1] = table[i + 1, 0] = 0
    matched = int(table[m, 1:-1].max())
    j = int(np.argmax(table[m, 1:-1])) + 1
    i, first, last = m, None, None
    while i > 0 and table[i, j] > 0:
        step = int(up[j - 1])
        if j > 1 and table[i, j - 1] == table[i, j]:
            j -= 1
        elif i >= step and table[i - step, j + 1] == table[i, j]:
            i, j = i - step, j + 1
        else:
            at = int(diagonals[j - 1]) + i - 1
            if 0 <= at < len(text) and text[at] == template[i - 1] and table[i - 1, j] + 1 == table[i, j]:
                first, last = at, at + 1 if last is None else last
            i -= 1
    return (matched, first, last) if matched else (0, 0, 0)


def in_bands(diagonals: np.ndarray, band: int) -> np.ndarray:
    """All diagonals within ``band`` of the given ones."""
    return np.unique(np.unique(diagonals)[:, None] + np.arange(-band, band + 1)[None, :])


def aligned(template: np.ndarray, h: np.ndarray, found: np.ndarray, prints: int, coverage: float, band: int, least: float):
    """``(matched, start, stop)`` of the stretches that hold enough of a template.

    Each run of hits on neighbouring diagonals is aligned by itself; the hits outside what that
    finds whole are chained across diagonals (words inserted or left out between them) and each chain is
    aligned on the bands of its hits. Left out is only what cannot reach the coverage, as too few
    words of the template stand on the diagonals at all.
    """
    m, own = len(template), narrowed(band, len(template))
    need = coverage * m
    # Words of the text that the template has, added up, so that a stretch's share is two lookups.
    vocabulary = np.unique(template)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    known = np.concatenate([[0], np.cumsum(vocabulary[at] == h)])
    if known[-1] < need:
        return []

    def enough(diagonals: np.ndarray) -> bool:
        """Whether enough words of the template stand in the text on some of these diagonals."""
        low, high = min(max(0, int(diagonals[0])), len(h)), min(max(0, int(diagonals[-1]) + m), len(h))
        if known[high] - known[low] < need:
            return False
        met = np.zeros(m, bool)
        for d in diagonals.tolist():
            i, j = max(0, -d), min(m, len(h) - d)
            if i < j:
                met[i:j] |= template[i:j] == h[i + d : j + d]
        return int(met.sum()) >= need

    out = []
    for run in runs(found, own):
        if len(np.unique(run[:, 1])) < least * prints:
            continue
        low, high = int(run[0, 0]) - own, int(run[-1, 0]) + own
        if enough(np.arange(low, high + 1)):
            matched, start, stop = align(template, h, low, high)
            if matched >= need:
                out.append((matched, start, stop))
    alone = len(out)
    text = found[:, 0] + found[:, 1]
    free = np.ones(len(found), bool)
    for _, start, stop in (o for o in out if o[0] == m):
        free &= (text + GRAM <= start) | (text >= stop)
    if len(np.unique(found[free, 0])) > 1:
        for chain in chains(found[free], m + GRAM):
            bands = in_bands(chain[:, 0], own)
            if np.ptp(chain[:, 0]) and enough(bands):
                matched, start, stop = align_on(template, h, bands)
                # A chain may complete one run's match, but not join two copies of the template.
                if matched >= need and sum(start < o[2] and o[1] < stop for o in out[:alone]) < 2:
                    out.append((matched, start, stop))
    return out


def scan(text: bytes | None, index: Index, memo: WordHash, coverage: float, band: int, least: float) -> list[dict]:
    """Matches in a text in order of their place; overlapping ones of the same template count once."""
    h = memo.array(words(text))
    found = []
    for t in index.whole:
        m = len(index.hashed[t])
        found += [(1.0, m, -int(i), int(i) + m, t) for i in whole_places(index.hashed[t], h)]
    for t, hits in hits_of(h, index).items() if len(index.keys) else ():
        template = index.hashed[t]
        for matched, start, stop in aligned(template, h, hits, index.prints[t], coverage, band, least):
            found.append((matched / len(template), matched, -start, stop, t))
    found.sort(key=lambda r: (-r[1], -r[0], -r[2], r[4]))
    out: list[dict] = []
    for share, matched, start, stop, t in found:
        over = [o for o in out if o["start"] < stop and -start < o["stop"]]
        if all(o["t"] != t for o in over):
            best = not any(o["best"] for o in over)
            out.append({"license": index.names[t], "coverage": share, "matched": matched, "start": -start, "stop": stop, "best": best, "t": t})
    return [{k: v for k, v in r.items() if k != "t"} for r in sorted(out, key=lambda r: (r["start"], r["stop"], r["license"]))]


def blocks_of(templates: list[tuple[str, str]], block_bytes: int) -> list[list[tuple[str, str]]]:
    """Templates in blocks of so many bytes, one template at least."""
    out: list[list[tuple[str, str]]] = [[]]
    held = 0
    for name, text in templates:
        if out[-1] and held + len(text) > block_bytes:
            out.append([])
            held = 0
        out[-1].append((name, text))
        held += len(text)
    return out


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    text: str = "text",
    into: str = "licenses",
    coverage: float = COVERAGE,
    band: int = BAND,
    least_hits: float = LEAST_HITS,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Documents with an array ``into`` of matches: license, coverage, matched words, start, stop, best.

    ``coverage`` is the share of the template's words matched in order within ``band`` words of the
    hits; ``start`` and ``stop`` count the text's words (lower-cased runs of letters, digits and
    characters outside ASCII). Between two parts of a licence at most as many words as the template
    has may be inserted. ``least_hits`` above 0 passes over runs with a smaller share of the
    template's fingerprints. ``best`` marks matches that no larger one overlaps. Templates are sent out in blocks of
    ``block_bytes``, and every document passes every block; ``best`` holds within a block.
    Nothing is shuffled.

    Null and empty texts, templates of fewer than three words and empty sets of templates match
    nothing; a template of three words is matched as a whole. Rows are scanned one by one, repeated rows alike; further columns pass through (one
    named ``into`` is replaced).
    """
    chosen = blocks_of(sorted((templates if templates is not None else built_in()).items()), block_bytes)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]
    out = docs
    for k, block in enumerate(chosen):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))

        def make(shared=shared, first=k == 0):
            memo = WordHash()

            def run(texts, before=None):
                mine = [scan(x, shared.value, memo, coverage, band, least_hits) for x in as_bytes(texts)]
                return mine if first else [a + b for a, b in zip(before.to_pylist(), mine)]

            return run

        uses = [text] if k == 0 else [text, into]
        columns = keep if k == len(chosen) - 1 else list(dict.fromkeys([*keep, text]))
        out = map_rows(out, make, uses, into, MATCHES, keep=columns)
    return out


def matches(scanned: DataFrame, id: str = "doc_id", into: str = "licenses") -> DataFrame:
    """One row per match."""
    return scanned.select(id, F.explode(into).alias("m")).select(id, "m.*")
