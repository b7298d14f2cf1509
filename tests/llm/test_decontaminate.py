import duckdb
from conftest_llm import SF, crowded, plain

from plumbline.llm import decontaminate as D
from plumbline.llm.queries import QUERIES, SQL


def pairs(df, *names):
    return [(r[0], None if r[1] is None else r[1].encode()) for r in df.select(*names).collect()]


def digests(found):
    return plain(found.select("doc_id", *D.digest(found)).collect())


def test_query_equals_brute_force(spark, documents, benchmark):
    got = plain(QUERIES["op2_decontaminate"](spark, SF).collect())
    want = plain(D.brute_force(pairs(documents, "doc_id", "text"), [(str(i), t) for i, t in pairs(benchmark, "item_id", "text")]))
    assert got == want
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_sql(documents, benchmark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = D.brute_force(pairs(documents, "doc_id", "text"), [(str(i), t) for i, t in pairs(benchmark, "item_id", "text")])
    assert plain(con.execute(SQL["op2_decontaminate"]).fetchall()) == plain(want)


def test_edge_cases(spark, edge, empty):
    items = [(1, "Quick brown fox jumps over the lazy dog and runs"), (1, "brown, FOX"), (None, "old house"), (3, None),
             (4, "..."), (5, "quick brown fox jumps over the lazy dog and runs away from"), (5, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.decontaminate(crowded(edge, "contamination", "spans", "items", "n_words"), bench)
    want = D.brute_force(pairs(edge, "doc_id", "text"), [(str(i) if i is not None else None, t.encode() if t else None) for i, t in items])
    assert digests(found) == plain(want)
    assert {"spans", "items", "n_words"} <= set(found.columns)
    assert D.decontaminate(empty, bench).collect() == []
    none = D.decontaminate(edge, bench.limit(0))
    assert {r["n_items"] for r in none.select(*D.digest(none)).collect()} == {0}


def test_blocks_give_the_same(documents, benchmark):
    one = D.decontaminate(documents, benchmark)
    many = D.decontaminate(documents, benchmark, block_bytes=3000)
    assert digests(one) == digests(many)


def test_repeated_items_are_dealt_once(spark, edge, monkeypatch):
    """A third of the benchmark repeats one item: no block collects the copies."""
    same = "brown fox jumps over the lazy dog and runs away"
    items = [(i, f"item {i} with a text of its own that no document has {i}") for i in range(60)] + [(99, same)] * 30
    taken, windows = [], D.item_windows

    def counted(rows, size):
        rows = list(rows)
        taken.append(len(rows))
        return windows(rows, size)

    monkeypatch.setattr(D, "item_windows", counted)
    found = D.decontaminate(edge, spark.createDataFrame(items, "item_id long, text string").repartition(3), block_bytes=2500)
    got = digests(found)
    assert sum(taken) == 61 and len(taken) > 1
    monkeypatch.undo()
    assert got == plain(D.brute_force(pairs(edge, "doc_id", "text"), [(str(i), t.encode()) for i, t in items]))
