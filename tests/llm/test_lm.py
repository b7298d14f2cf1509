import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import SF, crowded, plain
from pyspark.sql import functions as F

from plumbline.llm import lm as L
from plumbline.llm.queries import QUERIES


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute_force(rows):
    """Counts, deleted-interpolation weights and scores with dictionaries, without rounding of counts."""
    held = {i: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for i, (d, _) in enumerate(rows)}
    texts = [tokens(t) for _, t in rows]
    one, two = Counter(), Counter()
    for i, t in enumerate(texts):
        if not held[i]:
            one.update(t)
            two.update(zip([0, *t], t))
    n, v = sum(one.values()), len(one)
    context = lambda w: one[None] if w == 0 else one[w]
    place = lambda c: 0 if c < 1 else 1 + int(math.log2(c))
    rowsets = []
    for (a, b), k in two.items():
        c = context(a) - 1
        rowsets.append((place(c), (two[a, b] - 1) / c if c else 0.0, (one[b] - 1) / max(n - 1, 1), 1 / (v + 1), k))
    weights = np.full((L.BUCKETS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]
    if rowsets:
        where, parts, k = np.array([r[0] for r in rowsets]), np.array([r[1:4] for r in rowsets]), np.array([r[4] for r in rowsets])
        for _ in range(L.ROUNDS):
            share = weights[where] * parts
            share = share / share.sum(axis=1, keepdims=True) * k[:, None]
            for b in set(where):
                weights[b] = share[where == b].sum(axis=0) / k[where == b].sum()
        for b in range(2, L.BUCKETS):
            if b not in where:
                weights[b] = weights[b - 1]
    out = []
    for i, ((d, _), t) in enumerate(zip(rows, texts)):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for a, b in zip([0, *t], t):
            c = context(a)
            w = weights[place(c)] if n else (0, 0, 1)
            p = w[0] * (two[a, b] / c if c else 0) + w[1] * (one[b] / n if n else 0) + w[2] / (v + 1)
            score += math.log10(p)
        out.append((d, held[i], len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


def rows_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def agrees(got, rows, tolerance):
    want = plain(brute_force(rows))
    got = plain(got)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(a[6], b[6], rel_tol=tolerance, abs_tol=1e-6)
    return got


def test_query_equals_brute_force(spark, documents):
    got = agrees(QUERIES["op7_interpolated_lm"](spark, SF).collect(), rows_of(documents), 0.01)
    held = [r for r in got if r[1]]
    # On texts that training has not seen the mixture beats single words.
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


@pytest.mark.parametrize("unit", [3000, 1 << 20])
def test_units_do_not_matter(documents, unit):
    df = documents.where("doc_id < 60")
    got = L.scores(df, unit_bytes=unit, part_bytes=2 * unit).collect()
    agrees(got, rows_of(df), 0.01)


def test_edge_cases(spark, edge, empty):
    df = crowded(edge, "id", "unit", "t", "held", "score")
    agrees(L.scores(df, unit_bytes=60_000).collect(), rows_of(edge), 0.02)
    assert L.scores(empty).collect() == []
    unseen = L.scores(edge, held_out=F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in unseen} == {(0, 0, 0.0, 0.0)}


def test_probabilities_sum_to_one():
    weights = L.learn(np.array([[9, 5, 2], [1, 1, 1], [13, 9, 5]]), np.array([5.0, 3.0, 4.0]), 1000.0, 50.0)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and weights[0, 0] == 0


def test_levels():
    n = np.arange(1, 9)
    assert (L.VALUE[L.level(n)] == n).all() and L.level(np.array([0]))[0] == 0
    assert (L.bucket(np.array([0, 1, 2, 3, 4, 7, 8])) == [0, 1, 2, 2, 3, 3, 4]).all()
