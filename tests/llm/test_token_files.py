import json
import random
import zlib

import numpy as np
import pytest
from conftest_llm import EDGE, SF, crowded
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import token_files as W
from plumbline.llm.elias_fano import EliasFano
from plumbline.llm.memo import Memo
from plumbline.llm.queries import QUERIES, tokenizer
from plumbline.llm.word_ids import WordIds

MODEL = tokenizer("word_bpe_49k.json")
LIB = Tokenizer.from_str(MODEL.decode())
BYTES = tokenizer("byte_bpe_50k.json")
BITS = ["a", "B", "the", "ing", "'s", "'", " ", "  ", "\n", "\t", "é", "É", "İ", "ß", "Σ", "ς", "日本", "\U0001f600", "<|endoftext|>",
        "<|", "\x00", "\x01", "\x1c", "\x85", " ", "́", "ﬁ", "1", "½", "²", "ª", "_", "-", "...", ".", ",", "”", "…", "»", "K",
        "ı", "ŉ", "ſ", "'ll", "'RE", "don't", "I'm", "ǅ"]


def library(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300), st.sampled_from([1, 1 << 20, 1 << 44]))
def test_elias_fano_gives_back_every_number(values, by):
    values = sorted(v // by for v in values)
    code = EliasFano.from_bytes(EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert code.slice(0, len(values)).tolist() == values
    for i in (0, len(values) // 2, len(values) - 1):
        if values:
            assert code.select(i).tolist() == [values[i]]


def test_elias_fano_is_small_and_rejects_what_falls():
    ends = np.cumsum(np.random.default_rng(1).integers(0, 900, 100_000)).astype(np.uint64)
    code = EliasFano.of(ends)
    assert (code.slice(0, len(ends)) == ends).all()
    assert code.bits() / len(ends) < 2.6 + np.log2(int(ends[-1]) / len(ends))
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1], np.uint64))
    with pytest.raises(IndexError):
        code.select(len(ends))


def test_memo_is_bounded_and_right():
    memo = Memo(lambda k: k * 2, most=40_000)
    for i in range(5_000):
        k = str(i % 700).encode()
        assert memo[k] == k * 2
    assert len(memo) + len(memo.old) < 220


def test_ids_equal_the_library():
    words, rnd = WordIds(MODEL), random.Random(3)
    assert words.loop is not None
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    found = words.texts([t.encode() for t in texts])
    assert [np.frombuffer(x, words.kind).tolist() for x in found] == [library(t) for t in texts]


def test_other_tokenizers_encode_whole_texts():
    words, lib = WordIds(BYTES), Tokenizer.from_str(BYTES.decode())
    texts = [t or "" for _, t, *_ in EDGE]
    found = words.texts([t.encode() for t in texts])
    assert not words.by_words
    assert [np.frombuffer(x, words.kind).tolist() for x in found] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def expected(rows):
    """By the library, one document after another; rows of one name in any order."""
    out, start = [], 0
    for id, text in rows:
        ids = library(text) + [2]
        out.append((id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, documents):
    rows = documents.orderBy("doc_id").select("doc_id", "text").collect()
    got = [tuple(r) for r in QUERIES["op13_token_files"](spark, SF).orderBy("doc_id").collect()]
    assert got == expected(rows)


def test_parts_edge_cases_and_order(spark, edge, tmp_path):
    docs = crowded(edge, "ids", "start", "n_tokens", "h", "row")
    path = W.write_token_ids(docs, MODEL, str(tmp_path / "files"), end=2, part_bytes=4_000)
    about = json.loads((tmp_path / "files" / "manifest.json").read_text())
    assert len(about["parts"]) > 1 and about["docs"] == len(EDGE) and about["width"] == 2
    got = W.read_token_ids(spark, path).orderBy("start", F.size("ids").desc()).collect()
    names = [r.doc_id for r in got]
    assert names == sorted(names, key=lambda x: (x is not None, x or 0))
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), library(t) + [2]) for i, t, *_ in EDGE)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    assert at == about["tokens"]


def test_random_access_and_raw_array(spark, documents, tmp_path):
    path = W.write_token_ids(documents, MODEL, str(tmp_path / "files"), end=2)
    about = W.manifest(path)
    part = W.TokenPart(path, about["parts"][0], about["width"])
    raw = np.fromfile(tmp_path / "files" / f"{about['parts'][0]['file']}.ids", "<u2")
    texts = [r.text for r in documents.orderBy("doc_id").collect()]
    for i in (0, 17, part.part["docs"] - 1):
        a, b = part.bounds(i, i + 1)
        assert part.ids(a, b).tolist() == raw[a:b].tolist() == library(texts[i]) + [2]


def test_names_of_other_types_and_empty_tables(spark, empty, tmp_path):
    named = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, ""), ("a", "one")], "doc_id string, text string")
    path = W.write_token_ids(named, MODEL, str(tmp_path / "names"))
    got = [(r.doc_id, r.ids) for r in W.read_token_ids(spark, path).orderBy("start", "n_tokens").collect()]
    assert got == [(None, []), ("a", library("one")), ("a", library("one")), ("b", library("two words"))]
    path = W.write_token_ids(empty, MODEL, str(tmp_path / "none"), end=2)
    assert W.read_token_ids(spark, path, packed=True).collect() == []


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    path = W.write_token_ids(docs, MODEL, str(tmp_path / "files"))
    (tmp_path / "files" / "part-000000-stray.ids").write_bytes(b"\x01\x02")
    assert W.read_token_ids(spark, path).count() == 20
    assert sum(1 for p in (tmp_path / "files").iterdir() if p.name == "manifest.json") == 1
