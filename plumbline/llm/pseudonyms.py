"""Format-preserving pseudonyms, in DataFrame expressions only.

Validated personal numbers, dates and the names of mail addresses are replaced by
keyed permutations of themselves within their own format: Feistel rounds whose round
function is a SHA-512 of the key, the kind of value and the other half. Equal values get
equal pseudonyms in every document, days in every notation; a phone number is linked across
notations only where its country prefix is set off alike. Different values of a kind get
different ones. Only the key can undo it.

The text is split at the matches and put together again with what they become, so a
replacement is never looked at twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import col, fresh

ROUNDS = 8  # even, so halves of unequal length end where they began

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Lengths of bank accounts by country, so that a word behind one is not taken for its end.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _land(length: int, lands: str) -> str:
    groups, rest = divmod(length - 4, 4)
    end = rf" ?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{end}"


def _plus() -> str:
    """Phone digits behind a plus: 8 to 15 with the country's, an area in brackets or none, the last group of two or more."""
    out = [r"[1-9](?:[ .-]?[0-9]){6,13}[0-9]"]
    for country in (1, 2, 3):
        for area in (1, 2, 3, 4):
            least, most = max(1, 7 - country - area), 14 - country - area
            out.append(
                rf"[1-9][0-9]{{{country - 1}}}[ .-]?\([0-9]{{{area}}}\)(?:[ .-]?[0-9]){{{least},{most}}}[0-9]"
            )
    return "|".join(out)


_LANDS, _PLUS = "|".join(_land(n, lands) for n, lands in IBAN_LENGTHS.items()), _plus()

#: What may be a value. Validation comes after; what fails it stays.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}",
    "iban": rf"(?<![A-Za-z0-9])(?:{_LANDS}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "address": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "day": r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])",
    "phone": rf"(?<![A-Za-z0-9+])\+(?:{_PLUS})(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])"
    r"|(?<![0-9.-])[0-9]{3}([-.])[0-9]{3}\3[0-9]{4}(?![0-9]|[.-][0-9])",
    "person": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\4[0-9]{4}\4[0-9]{4}|3[47][0-9]{2}([ -])[0-9]{6}\5[0-9]{5})(?![0-9])",
}
#: All of them, behind tests that fail fast within words: a value begins where a word or a number does.
START = r"(?:(?<![A-Za-z0-9])|(?<=[A-Za-z])(?=[0-9]))(?=[0-9A-Z+(]|[a-z][A-Za-z0-9._%+-]{0,63}@)"
ANY = START + "(?:" + "|".join(PATTERNS.values()) + ")"
#: No value is without one of these.
HINT = "[0-9@]"

#: Days of 400 years from 1800-01-01, after which the calendar repeats; 189 * 773 of them.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def hashed(key: str, kind: str, turn: Column, size: Column, other: Column) -> Column:
    """128 hexadecimal digits that depend on the key, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn, size, other).cast("binary"), 512)


def share(hexes: Column, at: Column) -> Column:
    """The number in four of the hexadecimal digits."""
    return F.conv(F.substring(hexes, (at % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def shifted(x: Column, hexes: Column) -> Column:
    """Each letter and digit of a string moved on within its class; other characters stay."""

    def one(c: Column, by: Column) -> Column:
        return (
            F.when(c.between("0", "9"), F.char(48 + (F.ascii(c) - 48 + by) % 10))
            .when(c.between("a", "z"), F.char(97 + (F.ascii(c) - 97 + by) % 26))
            .when(c.between("A", "Z"), F.char(65 + (F.ascii(c) - 65 + by) % 26))
            .otherwise(c)
        )

    return let(hexes, lambda h: F.array_join(F.transform(F.split(x, ""), lambda c, i: one(c, share(h, i))), ""))


def rounds(first: Column, second: Column, step) -> Column:
    """``ROUNDS`` Feistel rounds over two halves; ``step(turn, half, other)`` is the new half."""
    start = F.struct(first.alias("a"), second.alias("b"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        start,
        lambda s, turn: F.struct(s["b"].alias("a"), step(turn, s["a"], s["b"]).alias("b")),
    )


def permuted(x: Column, key: str, kind: str) -> Column:
    """A string's letters and digits permuted, each within its class and place."""

    def halves(v: Column) -> Column:
        n, half = F.length(v), F.floor(F.length(v) / 2).cast("int")
        return rounds(
            F.substring(v, F.lit(1), half),
            F.substring(v, half + 1, n),
            lambda turn, a, b: shifted(a, hashed(key, kind, turn, n, b)),
        )

    return let(x, lambda v: let(halves(v), lambda done: F.concat(done["a"], done["b"])))


def permuted_number(a: Column, b: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """A number written as ``a`` below ``sizes[0]`` and ``b`` below ``sizes[1]``, permuted in that domain."""

    def step(turn: Column, x: Column, other: Column) -> Column:
        by = F.conv(F.substring(hashed(key, kind, turn, F.lit(0), other), 1, 8), 16, 10).cast("long")
        return (x + by) % F.when(turn % 2 == 0, F.lit(sizes[0])).otherwise(F.lit(sizes[1])).cast("long")

    return rounds(a.cast("long"), b.cast("long"), step)


def refilled(pattern: Column, new: Column, kind: str = "[^0-9]") -> Column:
    """``pattern`` with its characters outside ``kind`` replaced in order by those of ``new``."""

    def one(c: Column, i: Column, given: Column) -> Column:
        place = F.length(F.regexp_replace(F.substring(pattern, F.lit(1), i + 1), kind, ""))
        return F.when(c.rlike(kind), c).otherwise(F.substring(given, place, F.lit(1)))

    return let(new, lambda v: F.array_join(F.transform(F.split(pattern, ""), lambda c, i: one(c, i, v)), ""))


# Cards ---------------------------------------------------------------------


def luhn(d: Column) -> Column:
    """Weighted digit sum modulo 10 of a digit string; the last digit has weight one."""

    def weight(c: Column, i: Column) -> Column:
        v = F.ascii(c) - 48
        double = (F.length(d) - i) % 2 == 0
        return F.when(double, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    return F.aggregate(F.transform(F.split(d, ""), weight), F.lit(0), lambda s, v: s + v) % 10


def card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = permuted(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        check = lambda x: ((10 - luhn(F.concat(x, F.lit("0")))) % 10).cast("string")
        return F.when(luhn(d) == 0, let(body, lambda x: refilled(m, F.concat(x, check(x)))))

    return let(digits(m), new)


# Bank accounts --------------------------------------------------------------


def remainder97(x: Column) -> Column:
    """A string of digits and capitals, read as a number (A is 10), modulo 97."""

    def step(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(x, ""), F.lit(0), step)


def iban(m: Column, key: str) -> Column:
    def new(x: Column) -> Column:
        land, rest = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
        check = lambda a: F.lpad((98 - remainder97(F.concat(a, land, F.lit("00")))).cast("string"), 2, "0")
        valid = (F.length(x) >= 15) & (remainder97(F.concat(rest, F.substring(x, 1, 4))) == 1)
        account = permuted(rest, key, "iban")
        return F.when(valid, let(account, lambda a: refilled(m, F.concat(land, check(a), a), " ")))

    return let(F.regexp_replace(m, " ", ""), new)


# Network addresses, personal numbers, phones, mail ----------------------------


def address(m: Column, key: str) -> Column:
    def new(part: Column) -> Column:
        done = permuted_number(part[0] * 256 + part[1], part[2] * 256 + part[3], (65536, 65536), key, "address")
        octets = lambda d: [F.floor(d["a"] / 256), d["a"] % 256, F.floor(d["b"] / 256), d["b"] % 256]
        return let(done, lambda d: F.concat_ws(".", *(o.cast("string") for o in octets(d))))

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), new)


def person(m: Column, key: str) -> Column:
    """Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999."""

    def written(d: Column) -> Column:
        index = F.floor(d["a"] / 99) + 1
        parts = [index + F.when(index >= 666, 1).otherwise(0), d["a"] % 99 + 1, d["b"] + 1]
        return F.concat_ws("-", *(F.lpad(p.cast("string"), w, "0") for p, w in zip(parts, (3, 2, 4))))

    def new(part: Column) -> Column:
        area, group, serial = part[0], part[1], part[2]
        at = area - 1 - F.when(area > 666, 1).otherwise(0)
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(valid, let(permuted_number(at * 99 + group - 1, serial - 1, (898 * 99, 9999), key, "person"), written))

    return let(F.transform(F.split(m, "-"), lambda x: x.cast("int")), new)


def phone(m: Column, key: str) -> Column:
    """The country prefix stays."""

    def new(prefix: Column) -> Column:
        rest = F.substring(m, F.length(prefix) + 1, F.length(m))
        return F.concat(prefix, refilled(rest, permuted(digits(rest), key, "phone")))

    prefix = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9]|)", 1)
    return F.when(F.length(digits(m)).between(8, 15), let(prefix, new))


def mail(m: Column, key: str) -> Column:
    """The name is permuted, the domain stays."""
    name = F.substring_index(m, "@", 1)
    return F.concat(permuted(name, key, "mail"), F.lit("@"), F.substring_index(m, "@", -1))


# Dates ------------------------------------------------------------------------


def day(m: Column, key: str) -> Column:
    """Year first, or day and month before the year: month first if that is a date, else day first."""

    def read(part: Column) -> Column:
        """Year, month and day as numbers, and which notation this is."""
        ahead = F.length(part[0]) == 4
        one, two = (F.when(ahead, part[i + 1]).otherwise(part[i]) for i in (0, 1))
        month_first = ahead | (m.contains("/") & (one.cast("int") <= 12))
        return F.struct(
            F.when(ahead, part[0]).otherwise(part[2]).cast("int").alias("y"),
            F.when(month_first, one).otherwise(two).cast("int").alias("m"),
            F.when(month_first, two).otherwise(one).cast("int").alias("d"),
            ahead.alias("ahead"),
            month_first.alias("month_first"),
            F.when((F.length(one) == 2) & (F.length(two) == 2), 2).otherwise(1).alias("width"),
        )

    def new(t: Column) -> Column:
        leap = ((t["y"] % 4 == 0) & (t["y"] % 100 != 0)) | (t["y"] % 400 == 0)
        last = F.when(t["m"] == 2, F.when(leap, 29).otherwise(28)).when(t["m"].isin(4, 6, 9, 11), 30).otherwise(31)
        valid = t["y"].between(1800, 2199) & t["m"].between(1, 12) & (t["d"] >= 1) & (t["d"] <= last)
        return F.when(valid, let(moved(t), lambda to: shown(t, to)))

    def moved(t: Column) -> Column:
        start = F.to_date(F.lit(FIRST_DAY))
        n = F.date_diff(F.make_date(t["y"], t["m"], t["d"]), start)
        done = let(
            n, lambda v: permuted_number(F.floor(v / DAYS_B), v % DAYS_B, (DAYS_A, DAYS_B), key, "day")
        )
        return let(done, lambda d: F.date_add(start, (d["a"] * DAYS_B + d["b"]).cast("int")))

    def shown(t: Column, to: Column) -> Column:
        mark = F.regexp_extract(m, "[-/.]", 0)
        pad = lambda v: F.when(v < 10, F.concat(F.when(t["width"] == 2, "0").otherwise(""), v.cast("string"))).otherwise(v.cast("string"))  # noqa: E731, E501
        month, date, year = pad(F.month(to)), pad(F.dayofmonth(to)), F.year(to).cast("string")
        pair = F.when(t["month_first"], F.concat(month, mark, date)).otherwise(F.concat(date, mark, month))
        return F.when(t["ahead"], F.concat(year, mark, pair)).otherwise(F.concat(pair, mark, year))

    return let(F.split(m, "[-/.]"), lambda part: let(read(part), new))


KINDS = {"mail": mail, "iban": iban, "address": address, "day": day, "phone": phone, "person": person, "card": card}


def pseudonym(m: Column, key: str) -> Column:
    """What a match becomes; itself if it is no valid value. The first kind whose pattern fits is tried."""
    whole = {k: "^(?:" + renumbered(p) + ")$" for k, p in PATTERNS.items()}
    out = reduce(lambda acc, k: acc.when(m.rlike(whole[k]), KINDS[k](m, key)), list(KINDS)[1:], F.when(m.contains("@"), mail(m, key)))
    return F.coalesce(out, m)


def renumbered(pattern: str) -> str:
    """A pattern by itself: its back references count from one again."""
    first = next((i for i in "12345" if f"\\{i}" in pattern), None)
    if first is None:
        return pattern
    for k, i in enumerate(c for c in "12345" if f"\\{c}" in pattern):
        pattern = pattern.replace(f"\\{i}", f"\\{k + 1}")
    return pattern


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """Documents with the values in ``text`` replaced; ``found`` names a column for how many were.

    Kinds: mail names, bank accounts (IBAN, checked modulo 97), IPv4 addresses, calendar dates of
    1800 to 2199, phone numbers of 8 to 15 digits, personal numbers ``ddd-dd-dddd`` within their
    ranges, and card numbers of 13 to 19 digits with a right check digit. Check digits are right
    again afterwards. Anything else, invalid numbers included, stays as it is.

    One narrow transformation: no shuffle, no Python. Null texts stay null, with null found; empty
    texts stay empty with none. Rows are treated one by one, so repeated rows stay equal. Other
    columns pass through (one called like ``found`` is replaced).
    """
    matches = fresh(docs, "matches")
    x = col(text)
    any_ = F.lit(ANY)
    has = x.rlike(HINT) & x.rlike(ANY)
    old = F.regexp_extract_all(x, any_, F.lit(0))
    new = F.transform(old, lambda m: pseudonym(m, key))
    marked = docs.withColumn(
        matches, F.when(has, F.arrays_zip(F.split(x, ANY, -1).alias("p"), old.alias("o"), new.alias("n")))
    )
    pieces = F.transform(F.col(matches), lambda r: F.concat(r["p"], F.coalesce(r["n"], F.lit(""))))
    changed = F.size(F.filter(F.col(matches), lambda r: r["o"] != r["n"])).cast("long")
    out = marked.withColumn(text, F.when(F.col(matches).isNull(), x).otherwise(F.array_join(pieces, "")))
    if found:
        count = F.when(F.col(matches).isNull(), F.when(x.isNotNull(), F.lit(0).cast("long"))).otherwise(changed)
        out = out.withColumn(found, count)
    return out.drop(matches)
