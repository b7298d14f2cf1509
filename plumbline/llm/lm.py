"""Language-model scores by deleted interpolation.

A word's probability after another is a mixture of the bigram's maximum-likelihood estimate,
the word's own, and a uniform one:

    p(w | v) = a * c(v, w) / c(v) + b * c(w) / N + d / (V + 1)

with a + b + d = 1 chosen by how often the context v was seen, in buckets that double. The
weights are learned by expectation-maximisation on deleted counts: each training token is
held out in turn, so its estimates use the counts less one. For this the training tokens are
gathered in a table of how often each combination of (context count, word count, bigram
count) occurs, with counts above a few rounded to eighths of an octave; the table's size is bounded
by these steps, whatever the corpus, and covers every training token. Each bucket of contexts learns
its weights by itself.

Counts meet in exchanges between units of documents (``units``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm import units as U
from plumbline.llm.common import MIX, WordHash, as_bytes, col, mixed, text_bytes

END, START = np.uint64(0xE0D), np.uint64(0x57A7)  # no word's hash, but for one chance in 2 ** 63
SPARE = 24
STEPS = 8  # per octave
FIELD = 10  # bits of a step: counts up to 2 ** 127
BUCKETS = 48
ROUNDS = 100
LEARNED = "bucket int, facts binary"
LEARNED_TABLE = pa.schema([("bucket", pa.int32()), ("facts", pa.binary())])


def level(counts: np.ndarray) -> np.ndarray:
    """A count's step: 0 for none, then eighths of octaves."""
    out = np.zeros(len(counts), np.int64)
    some = counts > 0
    out[some] = 1 + np.rint(STEPS * np.log2(counts[some].astype(float))).astype(np.int64)
    return out


def _value_of_level() -> np.ndarray:
    """What a step stands for: the mean of the whole numbers that round to it."""
    out = np.concatenate([[0.0], 2.0 ** (np.arange(1 << FIELD) / STEPS)])
    small = np.arange(1, 2049)
    steps = level(small)
    for s in np.unique(steps):
        out[s] = small[steps == s].mean()
    return out


VALUE = _value_of_level()


def bucket(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context by how often it was seen: none, 1, 2-3, 4-7, ..."""
    out = np.zeros(len(counts), np.int64)
    some = counts >= 1
    out[some] = 1 + np.minimum(np.floor(np.log2(counts[some].astype(float))).astype(np.int64), BUCKETS - 2)
    return out


def estimates(context, word, pair, tokens, vocabulary) -> np.ndarray:
    """The three estimates of a token, one row each; a context that was never seen has no first one."""
    seen = context > 0
    return np.stack(
        [
            np.where(seen, pair / np.maximum(context, 1), 0.0),
            word / max(tokens, 1) if tokens > 0 else np.zeros(len(word)),
            np.full(len(word), 1.0 / (vocabulary + 1)),
        ]
    )


def learn(cells: np.ndarray, times: np.ndarray, tokens: float, vocabulary: float) -> np.ndarray:
    """Mixture weights per bucket from rows ``(context step, word step, pair step)`` and how often each occurs."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = [0.0, 0.5, 0.5]
    if not len(cells):
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1)) if tokens <= 0 else weights
    context, word, pair = (np.maximum(VALUE[cells[:, k]] - 1, 0) for k in range(3))
    parts = estimates(context, word, np.minimum(pair, context), tokens - 1, vocabulary)
    where = bucket(np.rint(context))
    total = np.bincount(where, weights=times, minlength=BUCKETS)
    for _ in range(ROUNDS):
        share = weights[where].T * parts
        share = share / share.sum(axis=0) * times
        new = np.stack([np.bincount(where, weights=s, minlength=BUCKETS) for s in share], axis=1)
        new = np.where(total[:, None] > 0, new / np.maximum(total, 1e-300)[:, None], weights)
        done = np.abs(new - weights).max() < 1e-6
        weights = new
        if done:
            break
    # A bucket without any token takes the weights of the next rarer one that has some.
    for k in range(1, BUCKETS):
        if total[k] == 0 and k > 1:
            weights[k] = weights[k - 1]
    return weights


class Texts:
    """A unit's documents as hashed tokens: lower-cased words, then the end."""

    def __init__(self, table: pa.Table):
        memo = WordHash()
        self.unit = table.column("unit")[0].as_py()
        self.ids = table.column("id").combine_chunks()
        self.held = np.array(table.column("held").to_pylist(), bool)
        self.tokens = []
        for x in as_bytes(table.column("t").combine_chunks()):
            words = x.lower().split() if x else []
            self.tokens.append(np.append(memo.array(words), END))
        self.sizes = np.array([len(x) for x in self.tokens], np.int64)
        self.flat = np.concatenate(self.tokens)
        self.trains = np.repeat(~self.held, self.sizes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]

    def pairs(self, bits: int) -> np.ndarray:
        before = np.concatenate([[START], self.flat[:-1]])
        before[self.starts] = START
        return mixed((before * MIX + self.flat) * MIX + np.uint64(2)) >> np.uint64(64 - bits)

    def contexts(self, counts: np.ndarray, documents: int) -> np.ndarray:
        """Of every token, how often training has what stands before it; a text's start once per document."""
        before = np.concatenate([[0], counts[:-1]])
        before[self.starts] = documents
        return before


def counted(distinct: np.ndarray, inverse: np.ndarray, trains: np.ndarray) -> np.ndarray:
    return np.bincount(inverse[trains], minlength=len(distinct)).astype(np.uint64)


def scores(
    docs: DataFrame, text: str = "text", id: str = "doc_id", held_out=None,
    unit_bytes: int = U.UNIT_BYTES, part_bytes: int = U.PART_BYTES,
) -> DataFrame:
    """One row per document: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the documents where ``held_out`` (a column expression; by default CRC-32
    of the id as text, modulo 7, is 2) is false and scores all. Tokens are words without ASCII white
    space, lower-cased in A-Z, and one end per document. ``base_score`` is the log10 probability
    under single words with one added to every count, ``score`` that of the interpolated model.

    Null and empty texts have the end alone. A null id counts as an empty one. Rows that share an
    id are scored row by row and, in training, counted each. An empty table gives no rows; without
    any training document both models are uniform over the one unknown word, so scores are 0.
    Words are told apart by 64-bit hashes, pairs by hashes that grow with the corpus.
    """
    layout = U.Layout(text_bytes(docs, text), unit_bytes, part_bytes)
    parts, bits = layout.parts, layout.bits(SPARE)
    kind = docs.schema[id].dataType.simpleString()
    if held_out is None:
        held_out = F.crc32(F.coalesce(col(id).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    scored = pa.schema(
        [("id", to_arrow_type(docs.schema[id].dataType)), ("held_out", pa.bool_())]
        + [(n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")]
        + [(n, pa.float64()) for n in ("base_score", "score")]
    )
    units = U.in_units(docs, id, text, layout, held=F.coalesce(held_out, F.lit(False)))

    def send_words(table: pa.Table) -> pa.Table:
        texts = Texts(table)
        distinct, inverse = np.unique(texts.flat, return_inverse=True)
        return U.sent(texts.unit, distinct, parts, 64, counted(distinct, inverse, texts.trains))

    def add_words(table: pa.Table) -> pa.Table:
        """Counts of every unit's words; to every unit also this part's tokens and distinct words."""
        unit, starts, hashes, (counts,) = U.received(table, 1)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.uint64)
        part = table.column("part")[0].as_py()
        sums = pa.table(
            {
                "unit": pa.array([-1], pa.int32()),
                "step": ["sums"],
                "part": pa.array([part], pa.int32()),
                "facts": pa.array([np.array([total.sum(), (total > 0).sum()], "<u8").tobytes()], pa.binary()),
            }
        )
        return pa.concat_tables([U.answers("words", part, unit, starts, lambda a, b: U.planes(total[inverse[a:b]])), sums])

    def known(table: pa.Table, replies: pa.Table):
        texts = Texts(table)
        distinct, inverse = np.unique(texts.flat, return_inverse=True)
        counts = np.concatenate([U.unplanes(x) for x in U.answered(replies, "words")]).astype(np.int64)[inverse]
        sums = np.frombuffer(U.answered(replies, "totals")[0], "<i8")
        ends = counts[texts.starts + texts.sizes - 1]
        return texts, counts, texts.contexts(counts, int(ends[0])), int(sums[0]), int(sums[1])

    def send_pairs(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:  # a unit without documents is told the totals too
            return U.sent(-1, np.empty(0, np.uint64), 1, bits)
        texts, counts, contexts, *_ = known(table, replies)
        distinct, first, inverse = np.unique(texts.pairs(bits), return_index=True, return_inverse=True)
        return U.sent(
            texts.unit, distinct, parts, bits,
            counted(distinct, inverse, texts.trains), level(contexts)[first].astype(np.uint64), level(counts)[first].astype(np.uint64),
        )

    def add_pairs(table: pa.Table) -> pa.Table:
        """Counts of every unit's pairs; of the training tokens, how often each combination of steps occurs."""
        unit, starts, hashes, (counts, context, word) = U.received(table, 3)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
        part = table.column("part")[0].as_py()
        some = total > 0
        cell = (context[first][some].astype(np.int64) << 2 * FIELD) | (word[first][some].astype(np.int64) << FIELD) | level(total[some])
        cells, at = np.unique(cell, return_inverse=True)
        times = np.bincount(at, weights=total[some], minlength=len(cells)).astype(np.int64)
        learned = pa.table(
            {
                "unit": pa.array([-1], pa.int32()),
                "step": ["cells"],
                "part": pa.array([part], pa.int32()),
                "facts": pa.array([np.stack([cells, times]).astype("<i8").tobytes()], pa.binary()),
            }
        )
        return pa.concat_tables(
            [U.answers("pairs", part, unit, starts, lambda a, b: U.planes(total[inverse[a:b]].astype(np.uint64))), learned]
        )

    def to_rows(batches):
        for batch in batches:
            for facts in batch.column("facts").to_pylist():
                cells, times = np.frombuffer(facts, "<i8").reshape(2, -1)
                where = bucket(np.rint(np.maximum(VALUE[cells >> 2 * FIELD] - 1, 0))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(cells), pa.array(times)], names=["bucket", "cell", "times"])

    def to_weights(table: pa.Table, totals: pa.Table) -> pa.Table:
        """One context bucket's combinations of steps and the totals: the bucket's weights."""
        if not table.num_rows:
            return LEARNED_TABLE.empty_table()
        table = table.combine_chunks()
        sums = np.frombuffer(totals.column("facts")[0].as_py(), "<i8")
        cells, times = table.column("cell").to_numpy(), table.column("times").to_numpy().astype(float)
        order = np.argsort(cells)
        cells, times = cells[order], times[order]
        low = (1 << FIELD) - 1
        split = np.stack([cells >> 2 * FIELD, (cells >> FIELD) & low, cells & low], axis=1)
        k = table.column("bucket")[0].as_py()
        mine = learn(split, times, float(sums[0]), float(sums[1]))[k]
        return pa.table({"bucket": pa.array([k], pa.int32()), "facts": pa.array([mine.astype("<f8").tobytes()], pa.binary())})

    def all_weights(table: pa.Table) -> pa.Table:
        """Weights of all buckets, at most ``BUCKETS`` rows; one without tokens takes those of the next rarer."""
        learned = {k: np.frombuffer(x, "<f8") for k, x in zip(table.column("bucket").to_pylist(), table.column("facts").to_pylist())}
        weights = learn(np.empty((0, 3), int), np.empty(0), 1, 0)
        for k in range(BUCKETS):
            if k in learned:
                weights[k] = learned[k]
            elif k > 1:
                weights[k] = weights[k - 1]
        return pa.table({"facts": pa.array([weights.astype("<f8").tobytes()], pa.binary())})

    def give(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return scored.empty_table()
        texts, counts, contexts, tokens, vocabulary = known(table, replies)
        distinct, inverse = np.unique(texts.pairs(bits), return_inverse=True)
        pairs = np.concatenate([U.unplanes(x) for x in U.answered(replies, "pairs")]).astype(np.int64)[inverse]
        weights = np.frombuffer(U.answered(replies, "weights")[0], "<f8").reshape(BUCKETS, 3) if tokens else learn(np.empty((0, 3), int), np.empty(0), 0, 0)
        mixture = (weights[bucket(contexts)].T * estimates(contexts, counts, pairs, tokens, vocabulary)).sum(axis=0)
        base = np.log10((counts + 1) / (tokens + vocabulary + 1))
        by_document = lambda x: np.add.reduceat(x, texts.starts)
        return pa.table(
            [
                texts.ids,
                pa.array(texts.held),
                pa.array(texts.sizes),
                pa.array(by_document((counts > 0).astype(np.int64))),
                pa.array(np.full(len(texts.sizes), tokens, np.int64)),
                pa.array(by_document(base)),
                pa.array(by_document(np.log10(mixture))),
            ],
            schema=scored,
        )

    by_unit = units.groupBy("unit")
    everyone = F.explode(F.sequence(F.lit(0), F.lit(layout.units - 1))).alias("unit")
    to_all = lambda df, step: df.select(everyone, F.lit(step).alias("step"), F.lit(0).alias("part"), "facts")

    words = by_unit.applyInArrow(send_words, U.SENT).groupBy("part").applyInArrow(add_words, U.ANSWER)
    sums = words.where("step = 'sums'").groupBy(F.lit(0).alias("one")).applyInArrow(add_sums, "facts binary")
    first = words.where("unit >= 0").unionByName(to_all(sums, "totals"))
    pairs = by_unit.cogroup(first.groupBy("unit")).applyInArrow(send_pairs, U.SENT).groupBy("part").applyInArrow(add_pairs, U.ANSWER)
    cells = pairs.where("step = 'cells'").select("facts").mapInArrow(to_rows, "bucket int, cell long, times long")
    cells = cells.groupBy("bucket", "cell").agg(F.sum("times").alias("times"))
    every = F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket")
    weights = cells.groupBy("bucket").cogroup(sums.select(every, "facts").groupBy("bucket")).applyInArrow(to_weights, LEARNED)
    weights = weights.groupBy(F.lit(0).alias("one")).applyInArrow(all_weights, "facts binary")
    replies = first.unionByName(pairs.where("unit >= 0")).unionByName(to_all(weights, "weights"))
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_unit.cogroup(replies.groupBy("unit")).applyInArrow(give, schema)


def add_sums(table: pa.Table) -> pa.Table:
    """Tokens and distinct words of all parts: two numbers a part."""
    total = sum(np.frombuffer(x, "<i8") for x in table.column("facts").to_pylist())
    return pa.table({"facts": pa.array([np.asarray(total, "<i8").tobytes()], pa.binary())})
