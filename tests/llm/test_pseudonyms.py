import datetime
import hashlib
import re

import pytest
from conftest_llm import SF, crowded, plain

from plumbline.llm import pseudonyms as S
from plumbline.llm.queries import QUERIES, QUERY_KEY

KEY = "test key"


# The same permutations with Python's numbers and strings ------------------


def hexes(key, kind, turn, size, other):
    return hashlib.sha512("|".join(map(str, (key, kind, turn, size, other))).encode()).hexdigest()


def shifted(x, h):
    out = ""
    for i, c in enumerate(x):
        by = int(h[i % 32 * 4:][:4], 16)
        for base, n in ((48, 10), (97, 26), (65, 26)):
            if base <= ord(c) < base + n:
                c = chr(base + (ord(c) - base + by) % n)
                break
        out += c
    return out


def permuted(x, key, kind):
    a, b = x[: len(x) // 2], x[len(x) // 2 :]
    for turn in range(8):
        a, b = b, shifted(a, hexes(key, kind, turn, len(x), b))
    return a + b


def number(a, b, sizes, key, kind):
    for turn in range(8):
        a, b = b, (a + int(hexes(key, kind, turn, 0, b)[:8], 16)) % sizes[turn % 2]
    return a, b


def refilled(pattern, new, kind="0-9"):
    it = iter(new)
    return "".join(next(it) if re.match(f"[{kind}]", c) else c for c in pattern)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x)) % 97


def card(m, key):
    d = re.sub("[^0-9]", "", m)
    if luhn(d):
        return None
    body = permuted(d[:-1], key, "card")
    return refilled(m, body + str(-luhn(body + "0") % 10))


def iban(m, key):
    x = m.replace(" ", "")
    if len(x) < 15 or mod97(x[4:] + x[:4]) != 1:
        return None
    account = permuted(x[4:], key, "iban")
    return refilled(m, x[:2] + f"{98 - mod97(account + x[:2] + '00'):02}" + account, "A-Z0-9")


def address(m, key):
    p = list(map(int, m.split(".")))
    a, b = number(p[0] * 256 + p[1], p[2] * 256 + p[3], (65536, 65536), key, "address")
    return ".".join(map(str, (*divmod(a, 256), *divmod(b, 256))))


def person(m, key):
    area, group, serial = map(int, m.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    a, b = number((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, (898 * 99, 9999), key, "person")
    index = a // 99 + 1
    return f"{index + (index >= 666):03}-{a % 99 + 1:02}-{b + 1:04}"


def phone(m, key):
    if not 8 <= len(re.sub("[^0-9]", "", m)) <= 15:
        return None
    n = re.match(r"(\+[0-9]{1,3}(?=[ .(-])|\+[0-9]|)", m).end()
    return m[:n] + refilled(m[n:], permuted(re.sub("[^0-9]", "", m[n:]), key, "phone"))


def mail(m, key):
    name, domain = m.split("@")
    return permuted(name, key, "mail") + "@" + domain


def day(m, key):
    mark = re.search("[-/.]", m)[0]
    p = re.split("[-/.]", m)
    ahead = len(p[0]) == 4
    year, one, two = (p[0], p[1], p[2]) if ahead else (p[2], p[0], p[1])
    american = ahead or (mark == "/" and int(one) <= 12)
    month, date = (one, two) if american else (two, one)
    try:
        real = datetime.date(int(year), int(month), int(date))
    except ValueError:
        return None
    if not 1800 <= real.year <= 2199:
        return None
    start = datetime.date(1800, 1, 1)
    a, b = number(*divmod((real - start).days, 773), (189, 773), key, "day")
    new = start + datetime.timedelta(a * 773 + b)
    pad = "02" if len(one) == len(two) == 2 else ""
    pair = [format(new.month, pad), format(new.day, pad)]
    pair = pair if american else pair[::-1]
    return mark.join([str(new.year), *pair] if ahead else [*pair, str(new.year)])


KINDS = {"mail": mail, "iban": iban, "address": address, "day": day, "phone": phone, "person": person, "card": card}


def brute_force(text, key):
    if text is None:
        return None, None
    n = 0

    def one(match):
        nonlocal n
        m = match[0]
        kind = next((k for k, p in S.PATTERNS.items() if re.fullmatch(S.renumbered(p), m)), None)
        new = (KINDS[kind](m, key) if kind else None) or m
        n += new != m
        return new

    return re.sub(S.ANY, one, text), n


CASES = [
    "call +1 (017) 555-7713 or (017) 555-7713 now, 415-555-2671, 415.555.2671, +442071838750, +49 30 901820!",
    "4539578763621486 and 1234567812345678; 4111-1111-1111-1111 x 3782 822463 10005 6011 1111 1111 1117!!",
    "7536784127813050 4845168114407329 abc4845168114407329 0000000000000 99999999999999999999",
    "ip 97.51.17.173, 300.1.1.1 1.2.3.4.5 10.0.0.1. 1.2.3.4%%%",
    "born 1987-02-28, 31/12/1999, 3.4.2020, 2021-02-30, 12/31/1999 29/02/2000 2/29/1900 1799-12-31 1800-01-01 31.12.2199",
    "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 XX00 1111 2222 3333",
    "ssn 078-05-1120 666-12-1234 000-11-2222 899-99-9999 665-01-0001 667-01-0001 123-45-6789-0",
    "mail the.72@mail3.example.com, A@b.de a@b Ünder.x@yy.org x" + "y" * 80 + "@long.example.com one@two@three.com",
    "12 nothing 3.5 here v1.2 2001 12:30 and 1,000,000",
    "4539578763621486!! the.72@mail3.example.com### \n+1 (974) 555-3436%%% 4539578763621486",
]


@pytest.fixture(scope="module")
def treated(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    return dict((r[0], (r[1], r[2])) for r in S.pseudonymise(df, KEY, found="n").select("doc_id", "text", "n").collect())


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(treated, i):
    assert treated[i] == brute_force(CASES[i], KEY)


def test_what_changes_and_what_stays(treated):
    assert treated[0][1] == 6 and treated[3][1] == 3 and treated[8] == (CASES[8], 0)
    assert "1234567812345678" in treated[1][0] and "4539578763621486" not in treated[1][0] + treated[9][0]
    assert "2021-02-30" in treated[4][0] and "1987-02-28" not in treated[4][0]
    card_ = treated[1][0].split()[0]
    assert card_ == treated[9][0].split("!!")[0] == treated[9][0].split()[-1]  # linked across documents
    assert luhn(card_) == 0
    phones = treated[0][0].split(" or ")
    assert phones[0].endswith(phones[1].split(" now")[0])  # and across notations


def test_permutations_are_one_to_one():
    assert len({number(*divmod(n, 773), (189, 773), KEY, "day") for n in range(146_097)}) == 146_097
    assert len({permuted(f"{n:04}", KEY, "card") for n in range(10_000)}) == 10_000
    assert len({permuted(f"a{n:03}Z", KEY, "x") for n in range(1000)}) == 1000


def test_query(spark, documents):
    got = plain(QUERIES["op6_pseudonyms"](spark, SF).collect())
    want = plain((r["doc_id"], *brute_force(r["text"], QUERY_KEY)) for r in documents.collect())
    assert got == want and sum(r[2] for r in got) > 10


def test_edge_cases(edge, empty):
    df = crowded(edge, "matches", "parts", "n")
    out = S.pseudonymise(df, KEY, found="n")
    assert out.columns == df.columns and out.where("matches != 'theirs'").count() == 0
    assert plain(out.select("doc_id", "text", "n").collect()) == plain((r["doc_id"], *brute_force(r["text"], KEY)) for r in edge.collect())
    assert S.pseudonymise(empty, KEY).collect() == []


def test_native(documents):
    plan = S.pseudonymise(documents, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


HIDDEN = {
    "call +33 6 12 34 56 78 now": "+33 6 12 34 56 78",
    "+61 2 9876 5432": "+61 2 9876 5432",
    "+32 2 123 45 67, 5 times": "+32 2 123 45 67",
    "+44 (0) 20 7946 0958": "+44 (0) 20 7946 0958",
    "+442071838750 1234 5678 9012": "+442071838750",
    "+33 6 12 34 56 78 5 items": "+33 6 12 34 56 78",
    "_alice@example.com_": "alice@example.com",
    "see -alice@example.com": "alice@example.com",
    "%bob.x@example.com and ..carl@example.org": "bob.x@example.com",
    "ES91 2100 0418 4502 0005 1332 BIC": "ES91 2100 0418 4502 0005 1332",
    "ES9121000418450200051332 BIC": "ES9121000418450200051332",
    "NL91 ABNA 0417 1643 00 BIC ABNANL2A": "NL91 ABNA 0417 1643 00",
    "AT61 1904 3002 3457 3201 AB": "AT61 1904 3002 3457 3201",
}


def test_forms_that_stayed_in_clear(spark):
    df = spark.createDataFrame(list(enumerate(HIDDEN)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n"]) for r in S.pseudonymise(df, KEY, found="n").collect()}
    for i, (text, value) in enumerate(HIDDEN.items()):
        new, n = got[i]
        assert (new, n) == brute_force(text, KEY)
        assert value not in new and n >= 1 and len(new) == len(text), text
        at = text.index(value)
        assert new[:at] == text[:at], text
        if " and " not in text:
            assert new[at + len(value) :] == text[at + len(value) :], text
