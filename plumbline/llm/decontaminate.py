"""Benchmark decontamination: which words of a text stand in a benchmark passage.

Prefix-filtered set join. A window of an item is contained in a document only if
every one of its words is, so the prefix that must be shared has length one: the
window's rarest word, by its frequency over all documents. Document words are
probed against these anchors; the anchor's place in the window bounds where the
window can lie (it must fit into the document), and only then is the sequence
compared.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import LETTERS, as_bytes, col, fresh, make_room, map_rows, text_bytes
from plumbline.plans.small import written

WINDOW = 10
BLOCK_BYTES = 8 << 20

#: Letters in lower case; what is no digit, letter or character outside ASCII separates words.
WORD_TABLE = bytes(
    0x20 if i < 0x30 or 0x3A <= i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7F else i for i in range(256)
).translate(bytes.maketrans(*LETTERS))

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])),
        ),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a text; a missing text has none."""
    return text.translate(WORD_TABLE).split() if text else []


def item_windows(rows, size: int) -> dict[bytes, set[str | None]]:
    """Each distinct window (words joined by a space) with the items that hold it."""
    out: dict[bytes, set[str | None]] = defaultdict(set)
    for item, text in rows:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out[b" ".join(w[i : i + size])].add(item)
    return out


def anchored(windows: dict[bytes, set], counts: dict[bytes, int]) -> dict[bytes, dict]:
    """``{rarest word: {(place, length): {window: items}}}``; ties by the word, then the first place."""
    out: dict[bytes, dict] = {}
    for window, items in windows.items():
        w = window.split(b" ")
        place = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
        if counts.get(w[place], 0):  # a word that no document has cannot be found
            known = tuple(sorted(i for i in items if i is not None))
            out.setdefault(w[place], {}).setdefault((place, len(w)), {})[window] = known
    return out


def find(w: list[bytes], anchors: dict[bytes, dict]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of ``w`` that are windows, and the items they come from."""
    spans, items = [], set()
    if anchors and not anchors.keys().isdisjoint(w):
        for j, word in enumerate(w):
            if word in anchors:
                for (place, length), windows in anchors[word].items():
                    start = j - place
                    if start >= 0 and start + length <= len(w):
                        window = b" ".join(w[start : start + length])
                        if window in windows:
                            spans.append((start, start + length))
                            items.update(windows[window])
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order, touching ones joined."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


def vocabulary_counts(docs: DataFrame, vocabulary: frozenset[bytes], text: str) -> dict[bytes, int]:
    """How often all documents use the words of one block of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        make_room()
        known, total = shared.value, Counter()
        for batch in batches:
            for x in as_bytes(batch.column(0)):
                total.update(filter(known.__contains__, words(x)))
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total.keys()), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["w", "n"]
            )

    found = docs.select(col(text).alias("t")).mapInArrow(count, "w binary, n long")
    return {bytes(r["w"]): r["n"] for r in found.groupBy("w").agg(F.sum("n").alias("n")).toLocalIterator()}


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    into: str = "contamination",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Documents with a column ``into``: ``n_words``, merged ``spans`` of hit words, ``items`` hit.

    The benchmark, repeated items taken out, is dealt by hash into blocks of about ``block_bytes``
    of text (one item at least); each block is collected, its windows are broadcast and all
    documents pass it, so no collect or broadcast exceeds a block however large the benchmark
    grows or however often it repeats an item. Texts are read twice per block and
    shuffled never. Every row is judged by itself, so repeated rows each get their result.

    Null or word-less texts: no words, no spans. Null or word-less items: nothing to find. Items
    without an id hit words but have no name to list. Repeated items count once. An empty
    benchmark hits nothing. Further columns pass through; one named ``into`` is replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    passages = benchmark.select(col(item).cast("string").alias("i"), col(item_text).alias("t")).where("t is not null")
    passages = written(passages.distinct(), "passages")
    blocks = max(1, -(-text_bytes(passages, "t") // block_bytes))
    out, done = docs, fresh(docs, into)
    for block in range(blocks):
        mine = passages.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        table = mine.toArrow()
        windows = item_windows(zip(table.column(0).to_pylist(), as_bytes(table.column(1).combine_chunks())), window)
        vocabulary = frozenset(w for x in windows for w in x.split(b" "))
        counts = vocabulary_counts(docs, vocabulary, text) if vocabulary else {}
        shared = spark.sparkContext.broadcast(anchored(windows, counts))
        first = block == 0

        def make(shared=shared, first=first):
            def run(texts, before=None):
                rows, earlier = [], None if first else before.to_pylist()
                for k, x in enumerate(as_bytes(texts)):
                    w = words(x)
                    spans, items = find(w, shared.value)
                    if earlier:
                        spans += [(s["start"], s["stop"]) for s in earlier[k]["spans"]]
                        items.update(earlier[k]["items"])
                    rows.append({"n_words": len(w), "spans": merged(spans), "items": sorted(items)})
                return rows

            return rows_to_struct(run)

        last = block == blocks - 1
        uses = [text] if first else [text, done]
        columns = keep if last else list(dict.fromkeys([*keep, text]))
        out = map_rows(out, make, uses, done, RESULT, keep=columns)
        if not last:
            out = written(out, "decontaminate")
    return out.withColumnRenamed(done, into) if done != into else out


def rows_to_struct(run):
    """Spans given as pairs become structs."""

    def fn(*columns):
        return [
            r | {"spans": [{"start": a, "stop": b} for a, b in r["spans"]]} if r["spans"] else r for r in run(*columns)
        ]

    return fn


def digest(df: DataFrame, into: str = "contamination") -> list:
    """The columns of the query from the operator's result."""
    hit = F.aggregate(
        f"{into}.spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]).cast("long")
    )
    return [
        F.col(f"{into}.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(f"{into}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{into}.items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    ]


def brute_force(docs: list[tuple], benchmark: list[tuple], size: int = WINDOW) -> list[tuple]:
    """The same digest by comparing every window with every place (small fixtures only)."""
    windows = item_windows(benchmark, size)
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for window, names in windows.items():
            x = window.split(b" ")
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    items.update(n for n in names if n is not None)
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(items), sha, bool(hit)))
    return out
