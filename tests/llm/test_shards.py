import zlib
from collections import Counter, defaultdict

from conftest_llm import SF, crowded
from pyspark.sql import functions as F

from plumbline.llm import shards as S
from plumbline.llm.queries import QUERIES


def lawful(rows, texts, tolerance):
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in texts)
    sizes, slots = Counter({k: 0 for k in range(8)}), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(sizes.values()) / 8
    assert max(abs(v - mean) for v in sizes.values()) <= tolerance
    return sizes


def texts(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_query(spark, documents):
    rows, given = QUERIES["op3_shards"](spark, SF).collect(), texts(documents)
    longest = max(len(t.encode()) for _, t in given)
    lawful(rows, given, longest)
    by_id = dict(given)
    homes = defaultdict(set)
    for r in rows:
        text = by_id[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 1, zlib.crc32(text), "bytes")
        homes[text].add(r["shard"])
    assert all(len(v) == 1 for v in homes.values())


def test_hot_group_is_cut_and_the_rest_stays_together(spark):
    rows = [(i, "x" * 500) for i in range(4000)] + [(10_000 + i, f"text {i // 3} " * 30) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = S.shard(df).collect()
    sizes = lawful(got, rows, 0.02 * sum(len(t) + 1 for _, t in rows) / 8)
    assert len(sizes) == 8
    homes = defaultdict(set)
    for r, text in ((r, dict(rows)[r["doc_id"]]) for r in got[:500]):
        homes[text].add(r["shard"])
    assert max(len(v) for k, v in homes.items() if k[0] != "x") == 1


def test_reproducible(documents):
    a = {(r["doc_id"], r["shard"], r["slot"]) for r in S.shard(documents).collect()}
    b = {(r["doc_id"], r["shard"], r["slot"]) for r in S.shard(documents.repartition(5)).collect()}
    assert a == b


def test_edge_cases(edge, empty, tmp_path, spark):
    rows = S.shard(crowded(edge, "shard", "slot", "range", "size")).collect()
    lawful(rows, texts(edge), 2 * 180_000)
    assert S.shard(empty).collect() == []
    same = edge.where("doc_id = 2")
    assert sorted(r["slot"] for r in S.shard(same).collect()) == [0, 1]
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    lawful(S.shard(many).collect(), texts(many), 1000)


def test_written_shards(spark, documents, tmp_path):
    S.write_shards(documents, S.shard(documents), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 8
