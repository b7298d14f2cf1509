import math
from collections import Counter

from conftest_llm import SF, crowded, plain

from plumbline.llm import quality as Q
from plumbline.llm.queries import QUERIES


def plainly(text):
    """The base measures, written as they are defined."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            hit.update((i, i + 1, i + 2))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n)


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def divergence(p, q):
    """Jensen-Shannon by its definition, in plain numbers."""
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_query(spark, documents):
    got = QUERIES["op10_divergence"](spark, SF)
    assert plain(got.select(*BASE).collect()) == plain((r["doc_id"], *plainly(r["text"])) for r in documents.collect())
    rows = got.collect()
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    known = Q.references(documents)
    texts = {r["doc_id"]: (r["text"], r["lang"]) for r in documents.collect()}
    limits = Q.Limits()
    for r in rows[:60]:
        text, lang = texts[r["doc_id"]]
        classes, index, spread = known.get(lang) or known[...]
        if r["word_distance"] is not None:
            words = [w.lower() if w.isascii() else w for w in text.encode().decode().split()]
            counts = Counter(index.get(w.encode().lower(), len(spread) - 1) for w in words)
            p = [counts.get(i, 0) / len(words) for i in range(len(spread))]
            assert math.isclose(r["word_distance"], divergence(p, list(spread / spread.sum())), rel_tol=1e-9)
        odd = (r["class_distance"] or 0) > limits.class_distance or (r["word_distance"] or 0) > limits.word_distance
        assert r["kept"] == (not r["base_failed"] and not odd)


def test_references_cover_all_documents(documents):
    known, words, total = Q.references(documents.repartition(7)), Counter(), Counter()
    for r in documents.collect():
        w = [x.lower() for x in r["text"].encode().split()]
        if len(w) >= 50:
            words.update((r["lang"], x) for x in w)
            total[r["lang"]] += len(w)
    for lang in [k for k in known if k is not ...]:
        _, index, spread = known[lang]
        assert spread.sum() == total[lang] >= Q.Limits().least_language
        assert {w: spread[i] for w, i in index.items()} == {
            w: n for (lg, w), n in words.items() if lg == lang and n >= 0.002 * total[lang]
        }


def test_references_start_no_python_workers_of_another_kind(spark, documents, monkeypatch):
    """Rows given as tuples are pickled by Python workers that stay in every executor (three processes each)."""
    want = Q.references(documents)

    def refused(*args, **kwargs):
        raise AssertionError("rows go through an RDD of Python objects")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    got = Q.references(documents)
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] for k in want)


def test_labelled_junk_goes_and_prose_stays(spark, documents):
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op10_divergence"](spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    n = {r["doc_id"]: len(r["text"].split()) for r in documents.collect()}
    good = [kept[d] for d, q in labels.items() if q == 1 and n[d] >= 50]
    bad = [kept[d] for d, q in labels.items() if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_edge_cases(edge, empty):
    found = Q.quality(crowded(edge, "quality", "kept", "n_words"))
    assert "kept" in found.columns and found.where("kept != 'theirs'").count() == 0
    got = found.select("doc_id", *[f"quality.{c}" for c in BASE[1:]])
    assert plain(got.collect()) == plain((r["doc_id"], *plainly(r["text"])) for r in edge.collect())
    assert Q.quality(empty).collect() == []
    assert Q.quality(edge, known={}).where("quality.class_distance is not null").count() == 0


def test_a_language_without_reference_is_not_judged_by_others(spark, documents):
    """Clean Russian among Latin scripts stays, few words of it or many, and without a language too."""
    words = "дом река утро книга город дорога письмо солнце ветер берег мост сад окно зима лето человек время слово день ночь".split()
    text = lambda i: " ".join(words[(i * 7 + k * k + k // 9) % 20] for k in range(120)) + "."
    latin = documents.select("doc_id", "text", "lang")
    for n in (3, 200):
        rows = [(-1 - i, text(i), "ru") for i in range(n)] + [(-1000, text(1), None)]
        found = Q.quality(latin.unionByName(spark.createDataFrame(rows, latin.schema))).where("doc_id < 0").select("doc_id", "quality.*").collect()
        assert len(found) == n + 1
        for r in found:
            assert r["kept"] == (not r["base_failed"])
            assert (r["word_distance"] is None) == (n == 3 or r["doc_id"] == -1000)
        assert any(r["kept"] for r in found)
