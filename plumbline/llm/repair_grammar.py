"""Cheapest repairs of conversations as min-plus matrices over a Re-Pair grammar.

A turn is a symbol: its role's initial, and whether it must go or lacks its end. What has been
written so far is one of four states, so a turn is a 4 by 4 matrix of (cost, audit), a run of
turns the product of theirs, and a grammar rule the product of its two sides. Rules are found once
for all conversations (``Re-Pair``: the most frequent pair of neighbours becomes a new symbol) and
their matrices computed bottom-up, each audit a rope that shares the parts of its rule's sides.

Of equally cheap audits the least in ASCII order counts. Two different audits of one cost that
lead from one state to another over the same turns are never one the beginning of the other (an
insertion more costs more), so the least of a product is made of the least of its factors.
"""

from __future__ import annotations

import numpy as np

from plumbline.llm.memo import Memo

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after writing a turn with this initial; what is missing may not be written.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INITIALS = "sua"
WRITTEN = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
#: Fixed costs of the edits.
RENAME, DELETE, INSERT, UNENDED = 3, 4, 3, 3

FIRST_TURN, FIRST_RULE = 0x100, 0x200
MUST_GO = chr(FIRST_TURN)


def symbol(initial: str, unended: bool) -> str:
    """A turn that may stay, as one character; turns that must go are ``MUST_GO``."""
    role = INITIALS.find(initial) if initial else -1
    return chr(FIRST_TURN + 1 + 2 * (role if role >= 0 else len(INITIALS)) + unended)


# Ropes: a text, or a pair of ropes --------------------------------------------

LEAF = 64


def joined(a, b):
    if not a or not b:
        return a or b
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= LEAF:
        return a + b
    return a, b


def pieces(rope):
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            if top:
                yield top
        else:
            stack += (top[1], top[0])


def flat(rope) -> str:
    return "".join(pieces(rope))


def before(a, b) -> bool:
    """Whether one rope's text comes before another's."""
    if a is b:
        return False
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    left, right, x, y = pieces(a), pieces(b), "", ""
    while True:
        x, y = x or next(left, ""), y or next(right, "")
        if not x or not y:
            return bool(y) and not x
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]


# Matrices ----------------------------------------------------------------------


def better(a, b):
    """The cheaper of two ``(cost, rope)``, either of which may be None."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if before(b[1], a[1]) else a


def row_product(row, matrix):
    """A row of four entries times a matrix, and from which state each entry came."""
    out, origin = [], []
    for q in range(4):
        best, of = None, START
        for p in range(4):
            if row[p] is not None and matrix[p][q] is not None:
                found = row[p][0] + matrix[p][q][0], joined(row[p][1], matrix[p][q][1])
                chosen = better(best, found)
                if chosen is not best:
                    best, of = chosen, p
        out.append(best)
        origin.append(of)
    return out, origin


def product(a, b):
    return [row_product(row, b)[0] for row in a]


def insertions():
    """Cheapest empty turns between any two states."""
    out = [[(0, "") if p == q else None for q in range(4)] for p in range(4)]
    for p in range(4):
        here, audit = p, ""
        for _ in range(2):  # more than two lead back
            here = STEPS["a"][here] if here == USER else STEPS["u"][here]
            audit += "I"
            out[p][here] = better(out[p][here], (INSERT * len(audit), audit))
    return out


INSERTED = insertions()
#: How a conversation may end from each state.
ENDING = [better(row[START], row[ASSISTANT]) for row in INSERTED]


def turn_matrix(char: str):
    """Insertions before a turn, then what may be done with it."""
    out = [[(DELETE, "D") if p == q else None for q in range(4)] for p in range(4)]
    if char != MUST_GO:
        code = ord(char) - FIRST_TURN - 1
        more = UNENDED * (code % 2)
        own = INITIALS[code // 2] if code < 6 else None
        for edit, role, cost in [("K", own, 0), ("R", "u", RENAME), ("R", "a", RENAME)]:
            for p, q in STEPS.get(role, {}).items():
                out[p][q] = better(out[p][q], (cost + more, edit))
    return product(INSERTED, out)


TURNS = {chr(FIRST_TURN + i): turn_matrix(chr(FIRST_TURN + i)) for i in range(9)}


class Grammar:
    """Rules ``(left, right)``; rule k is the character ``FIRST_RULE + k``."""

    def __init__(self, rules: list[tuple[str, str]], memo_bytes: int = 32 << 20):
        self.rules = rules
        self.matrices = dict(TURNS)
        for k, (a, b) in enumerate(rules):
            self.matrices[chr(FIRST_RULE + k)] = product(self.matrices[a], self.matrices[b])
        self.solved = Memo(self.solve, memo_bytes, lambda found: len(found[1]) + 80)

    def compressed(self, text: str) -> str:
        for k, (a, b) in enumerate(self.rules):
            text = text.replace(a + b, chr(FIRST_RULE + k))
        return text

    def matrix(self, turns: str):
        """The matrix of a run of turns."""
        out = [[(0, "") if p == q else None for q in range(4)] for p in range(4)]
        for char in self.compressed(turns):
            out = product(out, self.matrices[char])
        return out

    def solve(self, turns: str) -> tuple[int, str]:
        """Cost and audit of a whole conversation."""
        row = [(0, ""), None, None, None]
        for char in self.compressed(turns):
            row = row_product(row, self.matrices[char])[0]
        cost, audit = finish(row)[0]
        return cost, flat(audit)


def finish(row):
    """The best ending of a row of entries, and the state it starts from."""
    best, of = None, START
    for p in range(4):
        if row[p] is not None:
            chosen = better(best, (row[p][0] + ENDING[p][0], joined(row[p][1], ENDING[p][1])))
            if chosen is not best:
                best, of = chosen, p
    return best, of


def neighbours(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours in lines of symbols, as 64-bit numbers, and how often they occur."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    apart = (codes[:-1] >= FIRST_TURN) & (codes[1:] >= FIRST_TURN)
    return np.unique((codes[:-1] << 32 | codes[1:])[apart], return_counts=True)


def applied(audit: str, turns: str, start: int) -> tuple[list[tuple[str, int, str]], int]:
    """Edits as ``(letter, turn or -1, initial written or "")``, and the state they lead to."""
    out, state, at = [], start, 0
    for letter in audit:
        own = -1
        if letter != "I":
            own, at = at, at + 1
        if letter == "D":
            out.append((letter, own, ""))
            continue
        kept = letter == "K" and state == START and (ord(turns[own]) - FIRST_TURN - 1) // 2 == 0
        state = SYSTEM if kept else ASSISTANT if state == USER else USER
        out.append((letter, own, WRITTEN[state]))
    return out, state
