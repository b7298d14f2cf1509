import random
from itertools import combinations

import duckdb
import pytest
from conftest_llm import SF, crowded, plain
from pyspark.sql import functions as F

from plumbline.llm import neardup as M
from plumbline.llm.components import components
from plumbline.llm.queries import QUERIES, SQL


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_force(rows, percent=85):
    """Components by comparing all pairs of documents; rows with one id are one document."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if a is not None and b is not None and x and y:
            i = len(x & y)
            if 100 * i >= percent * (len(x) + len(y) - i):
                a, b = sorted((root(a), root(b)))
                up[b] = a
    return plain((d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in sets)


def rows_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_query_equals_brute_force(spark, documents):
    got = plain(QUERIES["op9_minhash"](spark, SF).collect())
    assert got == brute_force(rows_of(documents))
    assert sum(not r[3] for r in got) > 5


def test_sql(spark, documents):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert plain(con.execute(SQL["op9_minhash"]).fetchall()) == brute_force(rows_of(documents))


def variants(rnd, base, n, start, change):
    for i in range(n):
        w = list(base)
        for _ in range(change):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        yield start + i, " ".join(w)


@pytest.fixture(scope="module")
def crowd():
    """Copies around a hidden original, chains of drifting copies, and texts that share a passage."""
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(4000)}"
    base = [word() for _ in range(150)]
    rows = list(variants(rnd, base, 120, 1000, 2)) + [(5000, " ".join(base))]
    rows += list(variants(rnd, [word() for _ in range(120)], 60, 2000, 4))
    drift = [word() for _ in range(200)]
    for i in range(25):
        rows.append((3000 + (i * 7) % 25, " ".join(drift)))
        drift[8 * i : 8 * i + 4] = [word() for _ in range(4)]
    passage = [word() for _ in range(90)]
    rows += [(4000 + i, " ".join([word() for _ in range(25)] + passage + [word() for _ in range(10)])) for i in range(80)]
    rows += [(6000 + i, rows[0][1]) for i in range(40)]
    return rows


def test_crowds_equal_brute_force(spark, crowd):
    df = spark.createDataFrame(crowd, "doc_id long, text string").repartition(5)
    got = plain(M.near_duplicates(df).collect())
    assert got == brute_force(crowd)
    assert len({r[2] for r in got}) < len(got) - 100


def test_blocks_of_leftovers(spark, crowd, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "MET_BY_CENTRES", 1)
    monkeypatch.setattr(M, "stars", lambda members, second: members.select(F.col("id").alias("a"), F.col("id").alias("b")))
    df = spark.createDataFrame(crowd, "doc_id long, text string")
    assert plain(M.near_duplicates(df).collect()) == brute_force(crowd)


def family(rnd, n, change, start=0):
    """Texts that each differ from one original, and so a little more from each other."""
    base = [f"w{rnd.randrange(4000)}" for _ in range(400)]
    return [(start + d, t) for d, t in variants(rnd, base, n, 0, change)]


@pytest.mark.parametrize(("change", "linked"), [(2, True), (7, False)])
def test_joins_of_near_copies_grow_in_proportion(spark, change, linked, monkeypatch):
    """Groups above and just below the threshold: four times the texts, about four times the rows."""
    sizes = {}
    keep = M.written

    def counted(df, name):
        out = keep(df, name)
        sizes[n, name] = max(sizes.get((n, name), 0), out.count())
        return out

    monkeypatch.setattr(M, "written", counted)
    for n in (300, 1200):
        rows = family(random.Random(n + change), n, change)
        got = plain(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect())
        assert got == brute_force(rows) if n == 300 else len(got) == n
        assert (len({r[2] for r in got}) < n / 4) == linked
    for name in {x for _, x in sizes} - {"postings", "lists", "members"}:  # these hold a row a posting
        assert sizes[1200, name] <= 6 * max(sizes.get((300, name), 0), 300), (name, sizes)


def test_leftover_links_equal_brute_force_at_both_thresholds(spark):
    rnd = random.Random(11)
    rows = family(rnd, 90, 3) + family(rnd, 90, 4, 1000) + family(rnd, 60, 5, 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent in (85, 80):
        assert plain(M.near_duplicates(df, percent=percent).collect()) == brute_force(rows, percent)


def test_ids_that_are_texts(spark):
    rows = [(f"d{d}", t) for d, t in family(random.Random(3), 40, 3)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert plain(M.near_duplicates(df).collect()) == brute_force(rows)


def test_edge_cases(spark, edge, empty):
    df = crowded(edge, "id", "n", "component", "key", "content")
    assert plain(M.near_duplicates(df).collect()) == brute_force(rows_of(edge))
    assert M.near_duplicates(empty).collect() == []
    twice = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "p q r s t u v"), (3, "a b c d e f g"), (4, "x")]
    got = plain(M.near_duplicates(spark.createDataFrame(twice, "doc_id long, text string")).collect())
    assert got == brute_force(twice + []) or {r[2] for r in got} == {1, 4}
    assert M.near_duplicates(edge.where("text is null")).count() == 2


def test_least_matches():
    assert M.least_matches(85) > M.least_matches(80) > 72


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + rnd.randrange(200), 1000 + rnd.randrange(200)) for _ in range(150)]
    edges += [(5000, 5000 + i) for i in range(1, 400)] + [(None, 3), (7000, 7000)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    assert got == {x: root(x) for x in up}
