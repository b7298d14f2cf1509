import public_tokenizers
import sentencepiece
from conftest_llm import SF, crowded, plain
from test_decontaminate import D
from test_neardup import brute_force as near_groups
from test_pseudonyms import brute_force as pseudonymised

import corpus_pipeline as P
from plumbline.llm import quality as Q
from plumbline.llm.queries import QUERY_KEY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def expected(documents, benchmark):
    """The stages with the operators' brute-force forms, one after another."""
    known, limits = Q.references(documents), Q.Limits()
    stages = [[r for r in rows_of(documents) if Q.judge(None if r[1] is None else r[1].encode(), r[2], known, limits)[-1]]]
    kept = {g[0] for g in near_groups([r[:2] for r in stages[-1]], 80) if g[3]}
    stages.append([r for r in stages[-1] if r[0] in kept])
    items = [(str(r[0]), r[1].encode()) for r in benchmark.select("item_id", "text").collect()]
    clean = {x[0] for x in D.brute_force([(r[0], r[1].encode()) for r in stages[-1]], items) if not x[5]}
    stages.append([r for r in stages[-1] if r[0] in clean])
    treated = [(r[0], pseudonymised(r[1], QUERY_KEY)[0], r[2], r[3]) for r in stages[-1]]
    stages.append([(*r, len(r[1])) for r in treated])
    return stages


def test_stages_equal_brute_force(spark, documents, benchmark):
    docs = documents
    for (name, stage), want in zip(P.STAGES, expected(documents, benchmark)):
        docs = P.written(stage(spark, docs, SF), name)
        assert docs.columns == COLUMNS
        assert plain(rows_of(docs)) == plain(want), name
    final = P.STAGES[-1][1](spark, docs, SF).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert len(final) == docs.count()
    assert all(r["ids"] == lib.encode(r["text"]) and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in final)
    assert plain(tuple(r) for r in P.run(spark, SF).select("doc_id", "n_tokens").collect()) == plain((r["doc_id"], r["n_tokens"]) for r in final)


def test_edge_cases(spark, edge, empty):
    docs = crowded(edge, "verdict", "found", "before", "ids", "decoded", "n_tokens", "round_trip", "matches", "digest", "row")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        out.collect()
        assert stage(spark, empty, SF).collect() == []
    kept = plain(tuple(r) for r in P.near_duplicates(spark, edge, SF).select("doc_id").collect())
    # Without their letter case 1 and 2 are the same, 8 repeats 7, and the rows without an id stay.
    assert kept == plain([(1,), (3,), (4,), (5,), (6,), (7,), (-9,), (None,), (None,)])


def test_rows_that_share_an_id(spark):
    rows = [(1, "b c d e f g h"), (1, "a c d e f g h"), (2, None), (2, None), (3, "x y z p q r s t"), (None, "x"), (None, "x")]
    kept = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert plain(tuple(r) for r in kept) == plain([(1, "a c d e f g h"), (2, None), (3, "x y z p q r s t"), (None, "x"), (None, "x")])
