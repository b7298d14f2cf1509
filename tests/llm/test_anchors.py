import hashlib
import random

import duckdb
import numpy as np
import pytest
from conftest_llm import SF, crowded, plain

from plumbline.llm import anchors as A
from plumbline.llm import units as U
from plumbline.llm.queries import QUERIES, SQL


def brute_force(rows, size=13):
    """Every window against every document's windows."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - size + 1):
            if d is not None:
                x = tuple(w[i : i + size])
                least[x] = min(least.get(x, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return plain(out)


def rows_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def digests(found):
    return plain(found.select("id", "n_words", "n_removed", "kept_sha256").collect())


def test_query_equals_brute_force(spark, documents):
    got = plain(QUERIES["op8_block_anchors"](spark, SF).collect())
    assert got == brute_force(rows_of(documents))
    assert sum(r[2] > 0 for r in got) > 10


def test_sql(documents):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert plain(con.execute(SQL["op8_block_anchors"]).fetchall()) == brute_force(rows_of(documents))


@pytest.fixture(scope="module")
def shared_passages():
    """Passages of 12 to 60 words at odd places, some twice in a text, exact copies, tiny vocabularies."""
    rnd = random.Random(4)
    word = lambda k=3000: f"w{rnd.randrange(k)}"
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 19, 20, 27, 60)]
    rows = []
    for d in rnd.sample(range(-50, 1000), 220):
        text = []
        for _ in range(rnd.randrange(4)):
            text += [word() for _ in range(rnd.randrange(15))] + rnd.choice(passages)
        rows.append((d, " ".join(text + [word() for _ in range(rnd.randrange(9))])))
    rows += [(2000 + i, rows[5][1]) for i in range(30)]
    rows += [(3000 + i, " ".join(word(2) for _ in range(60))) for i in range(20)]
    return rows


@pytest.mark.parametrize("unit,part", [(U.UNIT_BYTES, U.PART_BYTES), (4000, 9000)])
def test_passages_equal_brute_force(spark, shared_passages, unit, part):
    df = spark.createDataFrame(shared_passages, "doc_id long, text string").repartition(3)
    found = A.remove_repeats(df, unit_bytes=unit, part_bytes=part)
    assert digests(found) == brute_force(shared_passages)
    words = dict((d, t.split()) for d, t in shared_passages)
    for r in found.collect():
        gone = {i for s in r["spans"] for i in range(s["from"], s["to"])}
        assert len(gone) == r["n_removed"] and r["kept"] == " ".join(w for i, w in enumerate(words[r["id"]]) if i not in gone)


def test_other_windows(spark, shared_passages):
    df = spark.createDataFrame(shared_passages, "doc_id long, text string")
    for size in (1, 2, 6, 20):
        assert digests(A.remove_repeats(df, window=size, unit_bytes=20_000)) == brute_force(shared_passages, size)


def test_edge_cases(edge, empty):
    found = A.remove_repeats(crowded(edge, "id", "t", "unit", "n_words", "kept"), unit_bytes=50_000)
    assert digests(found) == brute_force(rows_of(edge))
    assert A.remove_repeats(empty).collect() == []


def test_text_moves_once(documents):
    plan = A.remove_repeats(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 2


def test_packing():
    rnd = np.random.default_rng(1)
    for values in (rnd.integers(0, 2**63, 1000, dtype=np.uint64), np.array([0], np.uint64), np.array([2**64 - 1, 5], np.uint64)):
        assert (U.unplanes(U.planes(values)) == values).all()
        ordered = np.sort(values)
        assert (U.unpack_sorted(U.pack_sorted(ordered)) == ordered).all()
        starts = U.part_starts(ordered, 7, 64)
        assert starts[0] == 0 and starts[-1] == len(ordered)
