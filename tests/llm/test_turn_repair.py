import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest_llm import SF, crowded
from pyspark.sql import functions as F

from plumbline.llm import repair_grammar as G
from plumbline.llm import turn_repair as R
from plumbline.llm.queries import QUERIES

GOOD = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def options(role, fault):
    """``(cost, letter, role written or None)`` of one turn."""
    yield 4, "D", None
    if fault not in ("blank", "duplicate"):
        more = 3 if fault == "truncated" else 0
        yield more, "K", role
        yield from ((3 + more, "R", r) for r in ("user", "assistant"))


def plain_repair(turns):
    """``(cost, audit, lines)`` of ``(role, text, fault)`` turns: all edits, the best of each beginning."""
    best = {"": (0, "", ())}

    def offer(table, key, found):
        if key not in table or found < table[key]:
            table[key] = found

    def inserted(table):
        for _ in range(2):
            for shape, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    new = step(shape, role)
                    if new is not None:
                        offer(table, new, (cost + 3, audit + "I", (*lines, f"{role}:")))
        return table

    def step(shape, role):
        """What matters of the initials so far: nothing, s, or the last one."""
        now = shape + role[:1]
        if not role:
            return None
        return now[-1] if now in ("s", "u", "su", "ua", "au") else None

    for role, text, fault in turns:
        after = {}
        for shape, (cost, audit, lines) in inserted(best).items():
            for more, letter, new_role in options(role, fault):
                to = shape if new_role is None else step(shape, new_role)
                if to is not None:
                    written = lines if new_role is None else (*lines, f"{new_role}:{text}")
                    offer(after, to, (cost + more, audit + letter, written))
        best = after
    ends = inserted(best)
    return min(v for k, v in ends.items() if k in ("", "a"))


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        end = text.rstrip(BLANK)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def plain_row(turns):
    """The contract's columns of one conversation's turns in order."""
    found = faults(turns)
    cost, audit, lines = plain_repair([(r, t, f) for (_, r, t), f in zip(turns, found)])
    numbers = [n for n, _, _ in turns if n is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    counts = [found.count(k) for k in ("blank", "duplicate", "truncated")]
    initials = "".join(x[0] for x in lines)
    assert GOOD.fullmatch(initials)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    """Turns by conversation in order, after damage."""
    out = {}
    word = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        turns = out.setdefault(conv, [])
        role, text = word(role), word(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        turns += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest() if t[2].rstrip(BLANK) else b"")
    return {c: sorted(turns, key=order) for c, turns in out.items()}


def as_dict(frame, conv="conv_id"):
    rows = frame.select(conv, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def test_every_short_conversation_by_all_edits():
    """The matrices against all audits of up to six edits, tried one by one."""
    symbols = [G.MUST_GO, *(G.symbol(i, u) for i in ("s", "u", "a", "x") for u in (False, True))]
    grammar = G.Grammar([])
    for turns in itertools.chain([()], ((a,) for a in symbols), itertools.product(symbols, repeat=2)):
        found = []
        for n in range(len(turns), 7):
            for audit in itertools.product("DIKR", repeat=n):
                if len(audit) - audit.count("I") == len(turns):
                    found += costs("".join(audit), turns)
        assert grammar.solve("".join(turns)) == min(found)


def costs(audit, turns):
    """Costs at which an audit gives a good conversation, with every choice of roles."""
    shapes, at, cost = {""}, 0, 0
    for letter in audit:
        if letter == "I":
            cost += 3
            shapes = {s + r for s in shapes for r in "ua"}
            continue
        code = -1 if turns[at] == G.MUST_GO else ord(turns[at]) - G.FIRST_TURN - 1
        at += 1
        if letter == "D":
            cost += 4
            continue
        if code < 0:
            return []
        cost += 3 * (code % 2) + 3 * (letter == "R")
        shapes = {s + r for s in shapes for r in ("sua?"[code // 2] if letter == "K" else "ua")}
    return [(cost, audit)] if any(GOOD.fullmatch(s) for s in shapes) else []


def test_rules_change_nothing():
    rnd = random.Random(4)
    symbols = [G.MUST_GO, *(G.symbol(i, u) for i in ("s", "u", "a", "x") for u in (False, True))]
    known, rules = list(symbols), []
    for k in range(40):
        rules.append((rnd.choice(known), rnd.choice(known)))
        known.append(chr(G.FIRST_RULE + k))
    by_rules, plain = G.Grammar(rules), G.Grammar([])
    for _ in range(400):
        turns = "".join(rnd.choice(symbols) for _ in range(rnd.randint(0, 60)))
        assert by_rules.solve(turns) == plain.solve(turns)
        cut = rnd.randint(0, len(turns))
        assert G.finish(G.product(by_rules.matrix(turns[:cut]), by_rules.matrix(turns[cut:]))[0])[0][0] == plain.solve(turns)[0]


def test_ropes_compare_like_texts():
    rnd = random.Random(6)

    def rope(depth):
        if depth == 0 or rnd.random() < 0.2:
            return "".join(rnd.choice("DI") for _ in range(rnd.randint(0, 3)))
        return G.joined(rope(depth - 1), rope(depth - 1)) if rnd.random() < 0.5 else (rope(depth - 1), rope(depth - 1))

    for _ in range(3_000):
        a, b = rope(4), rope(4)
        assert G.before(a, b) == (G.flat(a) < G.flat(b))


def test_query_against_plain_repair(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = {c: plain_row(t) for c, t in damaged([tuple(r) for r in rows]).items()}
    assert as_dict(QUERIES["op12_turn_repair"](spark, SF)) == want


def odd_rows(rnd, n):
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t\n", " ", None, "Ünïcode …", "x. \n"]
    roles = ["system", "user", "assistant", "tool", "", None, "User"]
    return [
        (rnd.choice([None, 1, 1, 1, 2, 3, rnd.randint(4, 60)]), rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice(texts))
        for _ in range(n)
    ]


@pytest.mark.parametrize("size", [3, 4096])
def test_odd_conversations_whole_and_cut(spark, size):
    rows = odd_rows(random.Random(size), 600)
    table = crowded(spark.createDataFrame(rows, SCHEMA), "kept", "chunk", "h", "k", "place").repartition(5)
    want = {c: plain_row(t) for c, t in damaged(rows).items()}
    found = R.repair(R.damage(table), copies="copies", chunk_turns=size)
    assert as_dict(found.conversations) == want
    lines = found.turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "place", "role", "text"))).alias("t"))
    for r in lines.collect():
        text = "\n".join(f"{x.role}:{x.text}" for x in r.t)
        assert hashlib.sha256(text.encode()).hexdigest() == want[r.conv_id][-1]


def test_one_conversation_with_most_rows(spark):
    """One turn repeated, and one conversation over many chunks."""
    rows = [(7, i // 2, ["user", "assistant"][i % 2], f"text {i % 50}.") for i in range(3_000)] + [(8, 0, "user", "same.")] * 5_000
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = as_dict(R.repair(table, chunk_turns=256).conversations)
    order = lambda t: (t[0], t[1], hashlib.sha256(t[2].encode()).digest())
    for conv in (7, 8):
        assert found[conv] == plain_row(sorted([r[1:] for r in rows if r[0] == conv], key=order))
    assert found[8][2] == 4_999


def test_empty_and_all_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.repair(empty).conversations.collect() == []
    assert R.repair(empty).turns.collect() == []
    none = spark.createDataFrame([("a", 1, "user", "x.", 0), ("b", 1, "user", "x.", None)], "conv_id string, turn long, role string, text string, n long")
    got = as_dict(R.repair(none, copies="n").conversations)
    assert got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in "ab"}


def test_sql(spark):
    import duckdb

    from plumbline.llm.queries import SQL

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    want = {c: plain_row(t) for c, t in damaged(rows).items()}
    assert {r[0]: tuple(r[1:]) for r in con.execute(SQL["op12_turn_repair"]).fetchall()} == want
