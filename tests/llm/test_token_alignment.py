import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from conftest_llm import SF, crowded, plain
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import alignment_counts as C
from plumbline.llm import token_alignment as A
from plumbline.llm.perfect_hash import PerfectHash
from plumbline.llm.queries import QUERIES, tokenizer
from plumbline.llm.word_ids import BYTE_CHARS

A_MODEL, B_MODEL = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
LIB_A = Tokenizer.from_str(A_MODEL.decode())
LIB_A.encode_special_tokens = True
LIB_B = sentencepiece.SentencePieceProcessor(model_proto=B_MODEL)
BACK = {chr(BYTE_CHARS.get(b, b)): b for b in range(256)}
BITS = ["a", "the", "ing", "'s", "'ll", " ", "  ", "\n", "\n\n", "\t", " \n", "é", "ß", "日本", "\U0001f600", "<|endoftext|>", "<s>", "<0x0A>",
        "\x00", "\x1c", "\x85", "\xa0", "　", "́", "1", "23", "½", "_", "-", "...", ".", ",", "”", "K", "don't", "▁"]


def piece_bytes(i):
    p = LIB_B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if LIB_B.is_byte(i) else p.replace("▁", " ").encode()


def by_libraries(text):
    """``(a, b, groups, links)`` of a text, token by token; None if it has no tokens."""
    if not text:
        return None
    a = LIB_A.encode(" " + text, add_special_tokens=False).ids
    b = LIB_B.encode(text)
    raw_a = [bytes(BACK[c] for c in LIB_A.id_to_token(i)) for i in a]
    raw_b = [piece_bytes(i) for i in b]
    if not (b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode()):
        return None
    # The token of each byte; pairs of token places that share a byte are linked.
    at_a, at_b = ([i for i, x in enumerate(raw) for _ in x] for raw in (raw_a, raw_b))
    links = [(a[i], b[j]) for i, j in sorted(set(zip(at_a, at_b)))]
    groups, i, j, n, m = [], 0, 0, 0, 0
    while i < len(a):
        own_a, own_b = [a[i]], []
        n, i = n + len(raw_a[i]), i + 1
        while n != m:
            if m < n:
                own_b.append(b[j])
                m, j = m + len(raw_b[j]), j + 1
            else:
                own_a.append(a[i])
                n, i = n + len(raw_a[i]), i + 1
        groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
    return a, b, groups, links


def expected(texts):
    """The contract's columns of all texts, counts included."""
    found = [by_libraries(t) for t in texts]
    counts = Counter(p for x in found if x for p in set(x[3]))
    highest: dict[int, int] = {}
    for (a, _), n in counts.items():
        highest[a] = max(highest.get(a, 0), n)
    for x in found:
        if x is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            a, b, groups, links = x
            best = sum(counts[p] == highest[p[0]] for p in links)
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
            yield (len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), sha)


def odd_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def short(documents):
    return documents.where("length(text) < 1500").select("doc_id", "text")


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=400), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=20))
def test_perfect_hash(keys, others):
    keys = np.array(sorted(keys), np.int64)
    found = PerfectHash.from_bytes(PerfectHash.of(keys).to_bytes())
    assert sorted(found.index(keys).tolist()) == list(range(len(keys)))
    others = np.array([k for k in others if k not in set(keys.tolist())], np.int64)
    assert (found.index(others) == -1).all()


def test_perfect_hash_is_small():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**62, 100_000))
    assert 64 * len(PerfectHash.of(keys).words) < 4 * len(keys)
    with pytest.raises(ValueError):
        PerfectHash.of(np.array([5, 5]))


def test_parts_make_up_the_text():
    for text in odd_texts(5_000, 1):
        if text:
            assert "".join(map(A.spelled, A.parts_of(text))) == " " + text


def test_alignment_of_odd_texts_equals_the_libraries():
    aligner, texts = A.Aligner(A_MODEL, B_MODEL), [t for t in odd_texts(4_000, 2) if t]
    for text in texts:
        keys = A.parts_of(text)
        found = aligner.align(keys)
        want = by_libraries(text)
        assert found.good.all() == (want is not None), text
        if want:
            a, b, groups, links = want
            assert (found.n_a.sum(), found.n_b.sum(), found.n_groups.sum()) == (len(a), len(b), len(groups)), text
            assert "".join(found.groups)[:-1] == ";".join(groups), text
            assert sorted(zip((found.links >> 32).tolist(), (found.links & 0xFFFFFFFF).tolist())) == sorted(links), text


def test_query_against_the_libraries(spark, documents):
    rows = documents.orderBy("doc_id").select("doc_id", "text").collect()
    got = QUERIES["op11_token_alignment"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == list(expected([r.text for r in rows]))


def test_edges_and_both_ways_to_the_counts(spark, documents):
    texts = [None, "", " ", "\n", "a▁b", "same text again", "same text again", "x" * 3_000, *odd_texts(80, 3)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [tuple(r) for r in short(documents).limit(20).collect()]
    table = crowded(spark.createDataFrame(rows, "doc_id long, text string"), "alignment", "row", "links", "shard").repartition(4)
    want = sorted(expected([t for _, t in rows]))
    copied = C.align(table, A_MODEL, B_MODEL, shards=3)
    sent = C.align(table, A_MODEL, B_MODEL, shards=3, copied_bytes=0)
    assert copied.columns == sent.columns == [c for c in table.columns if c != "alignment"] + ["alignment"]
    assert sorted(tuple(r) for r in copied.select("alignment.*").collect()) == want
    assert sorted(tuple(r) for r in sent.select("alignment.*").collect()) == want
    names = lambda df: plain(df.select("doc_id", "text").collect())
    assert names(copied) == names(sent) == plain(rows)


def test_pair_counts_and_more_than_one_level(spark, documents, monkeypatch):
    monkeypatch.setattr(C, "FAN_IN", 2)
    rows = [r.text for r in short(documents).orderBy("doc_id").limit(30).collect()]
    table = spark.createDataFrame([(t,) for t in rows], "text string").repartition(7)
    models = spark.sparkContext.broadcast((A_MODEL, B_MODEL))
    got = C.pair_counts(C.pair_table(table, models, "text", 4)).collect()
    counts = Counter(p for t in rows if (x := by_libraries(t)) for p in set(x[3]))
    assert {(r.a_id, r.b_id): r.n_documents for r in got} == dict(counts)
    highest = {a: max(n for (x, _), n in counts.items() if x == a) for a, _ in counts}
    assert all(r.best == (r.n_documents == highest[r.a_id]) for r in got)


def test_empty_table(spark, empty):
    assert C.align(empty, A_MODEL, B_MODEL).collect() == []
    assert C.align(empty, A_MODEL, B_MODEL, copied_bytes=-1).where(F.lit(True)).collect() == []
