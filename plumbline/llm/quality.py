"""Quality rules by distribution divergence.

A document is compared with the reference of its language in two histograms: how
its characters spread over classes, and how its words spread over the language's
common words. The distance is Jensen-Shannon's (base 2, so 0 to 1). References are
learned from all documents of at least ``least_words`` words; documents too short for a histogram
are not judged by it. A text without a reference of its own language is compared with all documents
in what does not depend on language or script: letters of any script, digits and marks.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import as_bytes, col, make_room, map_rows
from plumbline.plans.small import written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CLASSES = ("lower", "upper", "digit", "space", "sentence mark", "symbol", "other mark", "beyond ASCII")


def _classes() -> np.ndarray:
    """Class of each byte; continuation bytes have none (8), so code points are counted."""
    out = np.full(256, 6, np.int64)
    for k, group in enumerate((range(97, 123), range(65, 91), range(48, 58), SPACES, b".,;:!?'\"()-", SYMBOLS)):
        out[list(group)] = k
    out[0x80:0xC0] = 8
    out[0xC0:] = 7
    return out


CLASS_OF = _classes()


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules.

    ``common_share``: a word is common if it makes up at least this share of its language's
    words, so a language has at most ``1 / common_share`` of them. ``least_language``: words a
    language needs for a reference; texts of smaller ones are judged by script-neutral classes.
    """

    least_words: int = 50
    most_repeated: float = 0.5
    common_share: float = 0.002
    least_language: int = 20_000
    least_chars: int = 200
    least_common_words: int = 100
    class_distance: float = 0.30
    word_distance: float = 0.47


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [
        T.StructField("class_distance", T.DoubleType()),
        T.StructField("word_distance", T.DoubleType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)
NAMES = RESULT.fieldNames()


def histogram(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def class_counts(bytes_histogram: np.ndarray) -> np.ndarray:
    return np.bincount(CLASS_OF, weights=bytes_histogram, minlength=9)[:8]


def script_neutral(classes: np.ndarray) -> np.ndarray:
    """Letters of any case and script as one class, without spaces (some scripts have none)."""
    lower, upper, digit, _, sentence, symbol, other, beyond = classes
    return np.array([lower + upper + beyond, digit, sentence, symbol, other])


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    distinct = set(windows)
    if len(distinct) == len(windows):
        return 0
    counts = Counter(windows)
    total, reach = 0, 0  # reach: end of what is counted
    for i, x in enumerate(windows):
        if counts[x] > 1:
            total += i + size - max(i, reach)
            reach = i + size
    return total


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 (same) to 1 (nothing shared)."""
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def corpus_counts(docs: DataFrame, text: str, lang: str, least_words: int) -> DataFrame:
    """``(lang, kind, word, n)``: kind 'w' counts words, 'c' character classes, over all documents of some length.

    Each task adds up its documents and hands on at most a quarter million words at a time.
    """

    def count(batches):
        make_room()
        words: dict[str | None, Counter] = {}
        classes: dict[str | None, np.ndarray] = {}
        held = 0

        def rows():
            out = [(lg, "w", w, n) for lg, c in words.items() for w, n in c.items()]
            out += [(lg, "c", str(k).encode(), int(n)) for lg, c in classes.items() for k, n in enumerate(c)]
            words.clear()
            classes.clear()
            cols = list(zip(*out)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.int64()))],
                names=["lang", "kind", "word", "n"],
            )

        for batch in batches:
            for x, lg in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                w = x.lower().split() if x else []
                if len(w) < least_words:
                    continue
                own = words.setdefault(lg, Counter())
                before = len(own)
                own.update(w)
                held += len(own) - before
                classes[lg] = classes.get(lg, 0) + class_counts(histogram(x))
                if held > 250_000:
                    yield rows()
                    held = 0
        yield rows()

    found = docs.select(col(text).alias("t"), col(lang).cast("string").alias("l")).mapInArrow(
        count, "lang string, kind string, word binary, n long"
    )
    return found.groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))


def references(
    docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits(), overall: bool = True
) -> dict:
    """``{lang: (class histogram, common words, their histogram with the rest last)}``; ``...`` is that of all (``overall``).

    Counts are added up once and stored. Only common words reach the driver, at most
    ``1 / common_share`` for a language of ``least_language`` words or more; the smaller
    languages count as one. What is common over all is common in one of these, so the
    overall reference needs no further pass over all words. Documents are judged by its
    characters alone, and without it (``overall`` false) its words are not counted.
    """
    spark = docs.sparkSession
    counts = written(corpus_counts(docs, text, lang, limits.least_words), "word-counts")
    is_word, n, share = F.col("kind") == "w", F.sum("n").alias("n"), F.lit(limits.common_share)
    totals = counts.where(is_word).groupBy("lang").agg(F.sum("n").alias("total"))
    large = totals.where(F.col("total") >= limits.least_language).collect()
    # Arrow tables: of rows, Spark would start Python workers of another kind, which stay in every executor.
    big = pa.table([pa.array([r["lang"] for r in large], pa.string()), pa.array([r["total"] for r in large], pa.int64())], ["big", "total"])
    names = spark.createDataFrame(big, "big string, total long")
    keyed = counts.join(F.broadcast(names), F.col("lang").eqNullSafe(F.col("big")), "left")
    own = keyed.where(F.col("total").isNotNull() & (~is_word | (F.col("n") >= share * F.col("total"))))
    out = {r["lang"]: ({}, np.zeros(8), r["total"]) for r in large}
    candidates = set()
    for r in own.select("lang", "kind", "word", "n").collect():
        if r["kind"] == "c":
            out[r["lang"]][1][int(bytes(r["word"]))] += r["n"]
        else:
            out[r["lang"]][0][bytes(r["word"])] = r["n"]
            candidates.add(bytes(r["word"]))
    common, total = {}, 0
    if overall:
        small = totals.where(F.col("total") < limits.least_language)
        rest_total = small.agg(F.sum("total").alias("t")).first()["t"] or 0
        rest = keyed.where(F.col("total").isNull() & is_word).groupBy("word").agg(n)
        candidates |= {bytes(r["word"]) for r in rest.where(F.col("n") >= share * F.lit(rest_total)).collect()}
        total = rest_total + sum(r["total"] for r in large)
    if total:
        chosen = F.broadcast(spark.createDataFrame(pa.table([pa.array(sorted(candidates), pa.binary())], ["word"]), "word binary"))
        words = counts.where(is_word).join(chosen, "word", "left_semi").groupBy("word").agg(n)
        common = {bytes(r["word"]): r["n"] for r in words.where(F.col("n") >= share * F.lit(total)).collect()}
    classes = np.zeros(8)
    for r in counts.where(~is_word).groupBy("word").agg(n).collect():
        classes[int(bytes(r["word"]))] = r["n"]
    if classes.any():
        out[...] = (common, classes, total)
    done = {}
    for key, (words, classes, total) in out.items():
        order = sorted(words)
        spread = np.array([*(words[w] for w in order), total - sum(words.values())], float)
        done[key] = (classes, {w: i for i, w in enumerate(order)}, spread)
    return done


def judge(text: bytes | None, lang: str | None, known: dict, limits: Limits) -> tuple:
    """All measures and the verdict of one document."""
    text = text or b""
    words = text.split()
    n = len(words)
    h = histogram(text)
    chars = int(h.sum() - h[0x80:0xC0].sum())
    spaces = int(h[list(SPACES)].sum())
    symbols = int(h[list(SYMBOLS)].sum())
    repeats = repeated_words(words)
    failed = n < limits.least_words or repeats > limits.most_repeated * n
    by_class = by_word = None
    reference = None if lang is None else known.get(lang)
    if chars >= limits.least_chars:
        if reference:
            by_class = distance(class_counts(h), reference[0])
        elif ... in known and chars > spaces:
            by_class = distance(script_neutral(class_counts(h)), script_neutral(known[...][0]))
    if reference and n >= limits.least_common_words:
        index, spread = reference[1], reference[2]
        found = Counter(filter(index.__contains__, text.lower().split()))
        counts = np.zeros(len(spread))
        for w, k in found.items():
            counts[index[w]] = k
        counts[-1] = n - sum(found.values())
        by_word = distance(counts, spread)
    odd = (by_class is not None and by_class > limits.class_distance) or (
        by_word is not None and by_word > limits.word_distance
    )
    return (n, chars - spaces, symbols, duplicate_lines(text), repeats, by_class, by_word, failed, not failed and not odd)


def quality(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    into: str = "quality",
    limits: Limits = Limits(),
    known: dict | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Documents with a column ``into`` of measures, distances and the verdict ``kept``.

    Base rules: fewer than ``least_words`` words, or more than half of them in repeated
    three-word windows, reject. Then the two distances reject what is unlike its language,
    each only above its own minimum length (the distance is null below it). ``known`` gives
    references; by default they are learned from these documents, all that have ``least_words``.

    Null or empty texts have no words and fail the base rules. Words are compared
    with the text's own language only: where that is null or has no reference (fewer than
    ``least_language`` words), the word distance is null and the class distance is that of
    ``script_neutral`` classes to all documents. Without any reference (empty table, tiny corpus of
    short texts) only the base rules judge. Rows are judged one by one, repeated ones alike.
    """
    known = references(docs, text, lang, limits, overall=False) if known is None else known
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def make():
        make_room()
        known = shared.value

        def run(texts, langs):
            return [
                dict(zip(NAMES, judge(x, lg, known, limits))) for x, lg in zip(as_bytes(texts), langs.to_pylist())
            ]

        return run

    typed = docs.withColumn(lang, col(lang).cast("string")) if dict(docs.dtypes)[lang] != "string" else docs
    return map_rows(typed, make, [text, lang], into, RESULT, keep=keep)
