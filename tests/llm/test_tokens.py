import os
import random
import subprocess
import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import EDGE, SF, crowded, plain

import corpus_pipeline as P
from plumbline.llm import common
from plumbline.llm import pieces as K
from plumbline.llm import sentencepieces as E
from plumbline.llm import token_chunks as C
from plumbline.llm import token_counts as N
from plumbline.llm.common import task
from plumbline.llm.queries import QUERIES

MODEL = N.read_model(public_tokenizers.path("piece_bpe_32k.model"))
LIB = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def as_unigram():
    """The same pieces scored as a unigram model (steps of 1/64, exact in single precision)."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    proto = schema.ModelProto()
    proto.ParseFromString(MODEL)
    proto.trainer_spec.model_type = 1
    rnd = random.Random(5)
    for p in proto.pieces:
        if p.type == 1:
            p.score = -8 + 2 * min(len(p.piece), 4) - rnd.randrange(256) / 64
    return proto.SerializeToString()


UNIGRAM = as_unigram()
UNI = sentencepiece.SentencePieceProcessor(model_proto=UNIGRAM)
PIECES = list(K.lattice_of(MODEL).v.ids)
BITS = ["a", "b", "e", "th", "in", "the", " ", "  ", "\n", "\t", "é", "ß", "日", "\U0001f600", "<0x0A>", "<s>", "\x00",
        "​", "S", "ing", "1", "23", ".", "...", "!!", "|", "-", "====", "//", K.SPACE]


def texts(n, seed, spaces=True):
    rnd = random.Random(seed)
    for i in range(n):
        kind = rnd.random()
        if kind < 0.4:
            yield "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 40)))
        elif kind < 0.7:
            yield "".join(rnd.choice(PIECES).replace(K.SPACE, " " if spaces and rnd.random() < 0.3 else "") for _ in range(rnd.randint(1, 20)))
        elif kind < 0.85 or not spaces:
            yield "".join(rnd.choice("abcdehinorst") for _ in range(rnd.randint(1, 120)))
        else:
            yield " " * rnd.randint(0, 70) + rnd.choice(["", "x", "the", "\n", "日"]) + " " * rnd.randint(0, 40)


def ids(packed):
    return np.frombuffer(packed, np.int32).tolist()


def by_chunks(text, model, size):
    """Ids and count of a text through cuts, matrices and traces, without Spark."""
    lattice, whole, start, parts = K.lattice_of(model), C.normal(text.encode(), True), 0, []
    counts = K.counts_of(model)
    for end in C.cuts(whole, size):
        parts.append({"before": whole[max(0, start - lattice.v.longest):start], "core": whole[start:end],
                      "after": whole[end:end + lattice.v.longest], "first": start == 0, "last": end == len(whole)})
        start = end

    def inner(t, first):
        if not t:
            return 0.0, 0
        plain_ = (t[1:] if first else t).replace(K.SPACE, " ").encode()
        return 0.0, counts.text(plain_, first) if plain_ or not first else counts.unit(K.SPACE)

    matrices = [C.transfer(p, lattice, inner) for p in parts]
    path = C.states_between(matrices, C.OPEN, None)
    got = b"".join(E.traced(p, a, b, model) for p, a, b in zip(parts, path, path[1:]))
    total = C.product([C.product(matrices[:2]), *matrices[2:]])
    return ids(got), max(total, key=lambda r: r[4])[5]


def test_kernels_equal_the_library():
    enc, counts, v = K.encoder_of(MODEL), K.counts_of(MODEL), K.lattice_of(MODEL).v
    for text in texts(6000, 1):
        want = LIB.encode(text)
        assert ids(enc.text(text.encode())) == want and counts.text(text.encode()) == len(want)
        assert K.decode(want, v) == LIB.decode(want)


def test_machine_equals_lattice():
    lattice, machine = K.lattice_of(MODEL), K.Transducer(K.lattice_of(MODEL), limit=500)
    for text in texts(3000, 2, spaces=False):
        word = text.replace(" ", "").replace(K.SPACE, "")
        assert machine.path(word) == lattice.path(word)
        assert machine.count(word) == sum(map(lattice.v.width, lattice.path(word)))


def test_neighbours():
    lattice, rnd = K.lattice_of(MODEL), random.Random(8)
    words = [p for p in PIECES if p.strip(K.SPACE) and lattice.usable(p)]
    tails = [p for p in words if not p.startswith(K.SPACE)]
    pairs = [(rnd.choice(words), rnd.choice(tails)) for _ in range(4000)]
    pairs += [(p[:i], p[i:]) for p in rnd.sample(words, 800) for i in range(1, len(p)) if lattice.usable(p[:i]) and lattice.usable(p[i:])]
    pairs += [(x, y) for x in ("a", "aa", "ab", "s", "ss", "in", "=", "==", "====") for y in ("a", "aa", "ab", "s", "ss", "in", "=", "==", "====")]
    for a, b in pairs:
        if a in lattice.v.ids and b in lattice.v.ids:
            assert lattice.apart(a, b) == (lattice.v.merge(a + b) == [a, b]), (a, b)


def test_runs_of_spaces():
    for n in range(150):
        for text in (" " * n, " " * n + "x", "x" + " " * n, "x" + " " * n + "the"):
            assert ids(K.encoder_of(MODEL).text(text.encode())) == LIB.encode(text)
            assert K.counts_of(MODEL).text(text.encode()) == len(LIB.encode(text))


@pytest.mark.parametrize("model,lib", [(MODEL, LIB), (UNIGRAM, UNI)])
def test_chunks_equal_the_library(model, lib):
    rnd = random.Random(3)
    for text in texts(1500, 4):
        text += "".join(texts(1, rnd.random(), spaces=False))
        if text:
            got, n = by_chunks(text, model, rnd.choice([1, 2, 3, 7, 16, 40]))
            assert got == lib.encode(text) and n == len(got), text


def test_unigram_equals_the_library():
    enc = K.encoder_of(UNIGRAM)
    for text in texts(3000, 6):
        assert ids(enc.text(text.encode())) == UNI.encode(text), text


def test_count_query(spark, documents):
    got = plain(QUERIES["op5_token_counts"](spark, SF).collect())
    want = []
    for r in documents.collect():
        n = len(LIB.encode(r["text"]))
        want.append((r["doc_id"], len(r["text"].encode()), n, n > 4096))
    assert got == plain(want)


def test_encode_query(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op1_sentencepiece"](spark, SF).collect()}
    assert len(rows) == documents.count()
    assert all(r["round_trip"] and r["n_tokens"] == len(LIB.encode(t)) for r, t in ((rows[d["doc_id"]], d["text"]) for d in documents.collect()))


@pytest.mark.parametrize("chunk", [50, 1000])
def test_giants(spark, edge, chunk):
    rows = [*EDGE, (20, "x" * 9000, "en", "a", 1), (21, " " * 7000 + "end", "en", "a", 1), (22, "日本" * 4000, "en", "a", 1)]
    rows += [rows[9], rows[9]]
    df = crowded(spark.createDataFrame(rows, edge.schema).repartition(4), "digest", "chunk", "ids", "n_tokens", "piece")
    want = plain((r["doc_id"], None if r["text"] is None else LIB.encode(r["text"])) for r in df.collect())
    found = E.encode(df, MODEL, chunk=chunk, decoded="again")
    assert found.where("not (again <=> replace(text, '\u2581', ' '))").count() == 0
    assert plain(found.select("doc_id", "ids").collect()) == want
    counted = N.token_counts(df, MODEL, chunk=chunk)
    assert plain(counted.select("doc_id", "n_tokens").collect()) == plain((d, len(i or [])) for d, i in want)
    assert {"digest", "chunk", "piece"} <= set(counted.columns)
    back = E.decode_ids(found.drop("text"), MODEL).select("doc_id", "text").collect()
    assert plain(back) == plain((r["doc_id"], r["text"] and r["text"].replace(K.SPACE, " ")) for r in df.collect())


def test_empty_tables(empty):
    assert E.encode(empty, MODEL).collect() == [] and N.token_counts(empty, MODEL).collect() == []


def test_decode_odd_ids(spark):
    rows = [(1, [3 + 0xE6, 3 + 0x97]), (2, None), (3, []), (4, [1, 2]), (5, [259 + 12, None, 99_999])]
    got = dict(E.decode_ids(spark.createDataFrame(rows, "k int, ids array<int>"), MODEL).select("k", "text").collect())
    assert got[1] == LIB.decode(rows[0][1]) and got[2] is None and got[3] == got[4] == ""
    assert got[5].endswith(" ⁇  ⁇ ")


def test_a_tokenizer_goes_with_its_task():
    def run(batches):
        for batch in batches:
            yield len(K.encoder_of(MODEL).text(batch))

    want = [len(LIB.encode(x)) * 4 for x in ("some words", "of a text")]
    assert list(task(run, True)([b"some words", b"of a text"])) == want and K._KERNELS
    assert list(task(run, False)([b"some words", b"of a text"])) == want and not K._KERNELS
    left = task(run, False)([b"some words", b"of a text"])
    next(left)
    assert K._KERNELS
    left.close()  # a task that is not read to its end
    assert not K._KERNELS


def test_no_task_of_the_pipeline_leaves_its_tokenizer(spark, edge, monkeypatch):
    seen = []
    for module in (common, C, E):
        monkeypatch.setattr(module, "task", lambda run, held: seen.append(held) or task(run, held))
    coded = P.sentencepiece_codes(spark, edge, SF)
    assert seen == [False] * 4  # short texts; cutting, matrices and ids of long ones
    assert all(r["ids"] == (r["text"] if r["text"] is None else LIB.encode(r["text"])) for r in coded.collect())


def test_chunks_keep_to_the_bound_of_states():
    text = C.normal(b"some words of a text", True)
    piece = {"before": "", "core": text, "after": "", "first": True, "last": True}
    assert ids(E.traced(piece, C.OPEN, C.OPEN, MODEL, 77)) == LIB.encode("some words of a text")
    assert K.lattice_of(MODEL).encoder.states == 77
    assert K.encoder_of(MODEL).states == K.STATES


def test_pandas_is_there_before_memos_fill():
    code = "import sys; from plumbline.llm.common import give_back; give_back(); assert 'pandas' in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(P.__file__))


def test_an_encoder_of_few_states_remembers_little():
    """Words and pairs were remembered in full whatever the states, and a state took twice as much."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9))) for _ in range(40_000)]
    text = " ".join(words).encode()
    vocabulary, want = K.lattice_of(MODEL).v, LIB.encode(text.decode())
    encoder = K.Encoder(K.Lattice(vocabulary), 5000)
    tracemalloc.start()
    try:
        got = encoder.text(text, vocabulary.dummy)
        held = tracemalloc.get_traced_memory()[0] - len(got)
        assert ids(got) == want and held < 8 << 20
        machine = K.Transducer(K.Lattice(vocabulary))
        machine.lattice.most_pairs = 0
        before = tracemalloc.get_traced_memory()[0]
        for w in words[:10_000]:
            machine.count(K.SPACE + w)
        taken = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert len(machine.states) > 10_000 and taken < 550 * len(machine.states)


def test_a_move_holds_any_number_of_emitted_tokens():
    machine = K.Transducer(K.lattice_of(MODEL))
    machine.moves[0 << K.CHAR | ord("x")] = 10**7 << K.STATE | 0  # far more than a byte or two could hold
    assert machine.count("xx") == 2 * 10**7 + machine.last[0] and machine.ends("xx") == [0, 0]
