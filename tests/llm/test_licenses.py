import random

import numpy as np
from conftest_llm import SF, crowded

from plumbline.llm import licenses as C
from plumbline.llm.common import WordHash
from plumbline.llm.decontaminate import words
from plumbline.llm.license_texts import NOTICES, built_in
from plumbline.llm.queries import QUERIES


def lcs(a, b):
    """Longest common subsequence without a band."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def brute_force(text, templates, coverage=C.COVERAGE, band=C.BAND):
    """Templates that some stretch of the text of their length holds well enough, with words enough in a row."""
    w, found = words((text or "").encode()), set()
    for name, t in templates.items():
        x = words(t.encode())
        run = C.GRAM if len(x) < C.SHORT else C.GRAM + C.NEAR - 1
        rows = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        in_a_row = any(tuple(x[i : i + run]) in rows for i in range(len(x) - run + 1))
        if in_a_row and any(
            lcs(x, w[s : s + len(x)]) >= coverage * len(x) for s in range(max(1, len(w) - 3)) if w[s : s + 1]
        ):
            found.add(name)
    return found


def found_in(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).add(r["license"])
    return out


def test_query_finds_the_lines(spark, documents):
    rows = QUERIES["op4_licenses"](spark, SF).collect()
    lines = {n: t for n, t in NOTICES.items() if "line" in n}
    got = found_in(rows)
    for d in documents.where("text like '%icens%'").collect():
        want = {n for n, t in lines.items() if f" {' '.join(map(bytes.decode, words(t.encode())))} " in f" {' '.join(map(bytes.decode, words(d['text'].encode())))} "}
        assert want <= got.get(d["doc_id"], set())
    assert rows and all(r["coverage"] >= C.COVERAGE and r["start"] < r["stop"] for r in rows)


def planted():
    """Notices with words dropped, added and changed, at different depths."""
    rnd = random.Random(9)
    noise = lambda n: [f"n{rnd.randrange(500)}" for _ in range(n)]
    rows = []
    for i in range(60):
        name, rate = rnd.choice(sorted(NOTICES)), rnd.choice([0, 0.02, 0.06, 0.1])
        out = []
        for w in NOTICES[name].split():
            if rnd.random() >= rate:
                out.append(w)
            elif rnd.random() < 0.4:
                out.append(noise(1)[0])
        rows.append((i, " ".join(noise(rnd.randrange(40)) + out + noise(rnd.randrange(40)))))
    rows += [(100 + i, " ".join(noise(80))) for i in range(10)]
    rows.append((200, " ".join([NOTICES["MIT line"]] * 30)))
    return rows


def test_planted_notices_equal_brute_force(spark):
    rows, templates = planted(), NOTICES
    got = C.matches(C.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    by_doc = found_in(got)
    for d, text in rows:
        want = brute_force(text, templates)
        assert by_doc.get(d, set()) >= want, (d, want, by_doc.get(d))
        w = words(text.encode())
        for r in (r for r in got if r["doc_id"] == d):
            x = words(templates[r["license"]].encode())
            assert lcs(x, w[r["start"] : r["stop"]]) >= r["matched"] and r["coverage"] == r["matched"] / len(x)
    assert sum(r["license"] == "MIT line" for r in got if r["doc_id"] == 200) == 30


def test_alignment_equals_plain_lcs_in_a_wide_band():
    rnd = random.Random(5)
    for _ in range(200):
        a = np.array([rnd.randrange(6) for _ in range(rnd.randrange(1, 25))], np.uint64)
        b = np.array([rnd.randrange(6) for _ in range(rnd.randrange(1, 25))], np.uint64)
        matched, start, stop = C.align(a, b, -30, 30)
        assert matched == lcs(list(a), list(b))
        assert matched == 0 or lcs(list(a), list(b[start:stop])) == matched


def test_winnowing_guarantee():
    rnd = np.random.default_rng(2)
    h = rnd.integers(0, 50, 300, dtype=np.uint64)
    chosen = set(C.winnowed(h).tolist())
    assert all(chosen & set(range(i, i + C.NEAR)) for i in range(len(h) - C.NEAR + 1))


def test_blocks_and_edge_cases(spark, edge, empty):
    df = spark.createDataFrame(planted(), "doc_id long, text string")
    key = lambda r: (r["doc_id"], r["license"], r["start"], r["stop"], r["matched"])
    one = sorted(map(key, C.matches(C.scan_licenses(df)).collect()))
    assert sorted(map(key, C.matches(C.scan_licenses(df, block_bytes=300)).collect())) == one
    out = C.scan_licenses(crowded(edge, "licenses", "coverage", "m"))
    assert out.where("size(licenses) > 0").count() == 0 and "coverage" in out.columns and out.count() == edge.count()
    assert C.scan_licenses(empty).collect() == [] and C.scan_licenses(edge, {}).where("size(licenses) > 0").count() == 0
    assert C.scan(b"one two three four", C.Index([("x", "two three")]), WordHash(), 0.8, 8, 0.1) == []


def spaced(text):
    return f" {' '.join(map(bytes.decode, words(text.encode())))} "


def test_query_finds_every_template_the_texts_hold(spark, documents):
    got = found_in(QUERIES["op4_licenses"](spark, SF).collect())
    want = {}
    for d in documents.where("text is not null").collect():
        held = {n for n, t in NOTICES.items() if spaced(t) in spaced(d["text"])}
        want |= {d["doc_id"]: held} if held else {}
    assert all(held <= got.get(d, set()) for d, held in want.items())


def test_templates_of_three_words():
    index = C.Index([("x", "All rights reserved"), ("y", "two three")])
    found = lambda text: [(r["license"], r["start"], r["stop"], r["best"]) for r in C.scan(text, index, WordHash(), 0.8, 8, 0.1)]
    assert found(b"All rights reserved.") == [("x", 0, 3, True)]
    assert found(b"a (c) 2020. All rights\nreserved. all rights are reserved, ALL RIGHTS RESERVED") == [("x", 3, 6, True), ("x", 10, 13, True)]
    assert found(b"") == found(b"two three") == found(b"rights reserved") == []


def best_of(text, templates=None):
    index = C.Index(sorted((templates or built_in()).items()))
    rows = C.scan(text.encode(), index, WordHash(), C.COVERAGE, C.BAND, C.LEAST_HITS)
    return [r["license"] for r in rows if r["best"]]


def test_each_licence_is_its_own_best_match():
    """Near relatives (BSD with two and three clauses, the GNU notices and texts) are told apart."""
    for name, text in built_in().items():
        if len(words(text.encode())) >= C.SHORT:
            assert best_of(f"Copyright 2020 somebody\n\n{text}\n\nint main") == [name]


def test_half_a_licence_is_no_licence():
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"):
        w = NOTICES[name].split()
        assert name not in best_of(" ".join(w[: len(w) // 2]))


def with_gaps(text, rnd, inserted, dropped):
    """A text with a sentence of so many words inserted, and so many words left out, away from its ends."""
    w = [x.decode() for x in words(text.encode())]
    k = rnd.randrange(len(w) // 4, len(w) // 2)
    w[k:k] = [f"n{rnd.randrange(500)}" for _ in range(inserted)]
    k = rnd.randrange(k + inserted, len(w) - dropped - 8)
    return " ".join(w[:k] + w[k + dropped :])


def test_inserted_and_missing_sentences():
    rnd = random.Random(3)
    for name, text in NOTICES.items():
        n = len(words(text.encode()))
        if n < 80:
            continue
        for inserted, dropped in ((9, 0), (40, 0), (0, 12), (n // 2, 10)):
            x = f"start of it {with_gaps(text, rnd, inserted, dropped)} end of it"
            rows = C.scan(x.encode(), C.Index([(name, text)]), WordHash(), C.COVERAGE, C.BAND, C.LEAST_HITS)
            assert [r["license"] for r in rows] == [name], (name, inserted, dropped)
            assert rows[0]["matched"] >= n - dropped - 3 and rows[0]["stop"] - rows[0]["start"] >= n + inserted - dropped - 3
            w, t = words(x.encode()), words(text.encode())
            assert lcs(t, w[rows[0]["start"] : rows[0]["stop"]]) >= rows[0]["matched"]


def test_copies_with_sentences_inserted_are_found_one_by_one():
    rnd = random.Random(4)
    x = "\n\n".join(with_gaps(NOTICES["MIT"], rnd, 20, 0) for _ in range(5))
    rows = C.scan(x.encode(), C.Index([("MIT", NOTICES["MIT"])]), WordHash(), C.COVERAGE, C.BAND, C.LEAST_HITS)
    assert len(rows) == 5 and all(a["stop"] <= b["start"] for a, b in zip(rows, rows[1:]))


def test_few_hits_are_aligned():
    """Every fifth word changed, but for five in a row: a single fingerprint, and 0.8 of the words."""
    t = [f"w{i}" for i in range(100)]
    x = [f"x{i}" if i % 4 == 3 and i > 30 else w for i, w in enumerate(t)]
    index = C.Index([("t", " ".join(t))])
    assert sum(a == b for a, b in zip(t, x)) >= 80
    assert [r["matched"] for r in C.scan(" ".join(x).encode(), index, WordHash(), C.COVERAGE, C.BAND, C.LEAST_HITS)] == [82]
    x = [f"x{i}" if i % 4 == 3 and i > 10 else w for i, w in enumerate(t)]
    assert C.scan(" ".join(x).encode(), index, WordHash(), 0.7, C.BAND, C.LEAST_HITS)


def test_alignment_on_parted_diagonals_is_a_common_subsequence():
    rnd = random.Random(6)
    for _ in range(200):
        a = np.array([rnd.randrange(4) for _ in range(rnd.randrange(4, 25))], np.uint64)
        b = np.array([rnd.randrange(4) for _ in range(rnd.randrange(4, 40))], np.uint64)
        d = np.array(sorted(rnd.sample(range(-20, 40), rnd.randrange(1, 12))))
        matched, start, stop = C.align_on(a, b, d)
        assert matched <= lcs(list(a), list(b[start:stop])) and matched >= max(C.align(a, b, k, k)[0] for k in d)
