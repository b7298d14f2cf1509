"""Tokens of a SentencePiece vocabulary as paths through a lattice of pieces.

Two kinds of model are read. In a unigram model a path is worth the sum of its
pieces' scores and the best path wins. In a merge (BPE) model a path is worth 0 if
each pair of neighbours is *compatible*, that is if merging the two strings together
gives back exactly these two pieces, and minus infinity otherwise; a merge encoding
is the only path of worth 0. So both are max-plus problems over the same lattice.

No piece has a space mark after another character, so pieces never cross the place
where a space begins (a *hard* boundary); nor do they touch characters that occur in
no piece. Words between hard boundaries are independent.
"""

from __future__ import annotations

import math
import re
from array import array

from plumbline.llm.memo import Memo

SPACE = "\u2581"
SPACE_BYTES = SPACE.encode()
UNKNOWN_PENALTY = 10.0  # fixed value of unigram models
MARKS = b".,!?;:%$&*#|)\"'-"
#: What is remembered besides the machine's states, in an encoder of fewer states as much less.
LED_BYTES, BARE_BYTES, PAIRS = 56 << 20, 12 << 20, 80_000
#: States that a machine may hold, about 400 bytes each, before it starts again.
STATES = 220_000
#: Bits of a character, and of a state's number in a move: what the move emits stands above them.
CHAR, STATE = 21, 32
NUMBER = (1 << STATE) - 1
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Vocabulary:
    """Pieces, scores and ids read from a model file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        proto.ParseFromString(model)
        norm, spec = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that leave characters and white space as they are")
        if spec.model_type not in (1, 2) or spec.treat_whitespace_as_suffix or not spec.byte_fallback:
            raise ValueError("only unigram and merge models with byte fallback")
        self.merges = spec.model_type == 2
        self.dummy = norm.add_dummy_prefix
        kinds = proto.SentencePiece
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.pieces = [p.piece for p in proto.pieces]
        self.bytes = [0] * 256
        self.control, self.unknown = set(), set()
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
            elif p.type == kinds.CONTROL:
                self.control.add(i)
            elif p.type == kinds.UNKNOWN:
                self.unknown.add(i)
            elif p.type == kinds.NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
            else:
                raise ValueError(f"pieces of kind {p.type} are not supported")
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i, b in self.byte_of.items():
            self.raw[i] = bytes([b])
        for i in self.control:
            self.raw[i] = b""
        for i in self.unknown:
            self.raw[i] = " \u2047 ".encode()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character")
        self.chars = {c for p in self.ids for c in p}
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.longest = max(map(len, self.ids), default=1)
        self.starts = {p[:i] for p in self.ids for i in range(len(p))} | {""}
        self.one = {p: p for p in self.starts} | {p: p for p in self.ids}  # each text held once
        self.unknown_score = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        runs = {len(p) for p in self.ids if len(p) > 1 and not p.strip(SPACE)}
        self.runs = runs | {1}
        if self.merges:
            words = [s for p, s in self.score.items() if len(p) > 1 and p.strip(SPACE)]
            if len(set(words)) < len(words) or any(
                self.score[SPACE * n] >= min(words, default=0.0) for n in runs
            ):
                raise ValueError("merge ranks of words are not distinct or come after runs of spaces")

    def merge(self, text: str) -> list[str]:
        """Greedy merging of adjacent symbols: best score first, leftmost on ties (for short texts)."""
        return self.merged(text)[0]

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging leaves, and the two parts that merged last."""
        parts, last = list(text), None
        while len(parts) > 1:
            found = [
                (-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score
            ]
            if not found:
                break
            _, i = min(found)
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [last[0] + last[1]]
        return parts, last

    def run(self, length: int) -> list[int]:
        """Piece lengths of a run of spaces that no word has taken part of."""
        if not self.merges:
            raise ValueError("unigram models score runs like any other text")
        stack: list[int] = []
        for _ in range(length):
            stack.append(1)
            while len(stack) > 1 and stack[-1] + stack[-2] in self.runs:
                stack.append(stack.pop() + stack.pop())
        return stack

    def width(self, piece: str) -> int:
        """Tokens that a lattice piece stands for: one, or its bytes where it is unknown."""
        return 1 if piece in self.ids else len(piece.encode())

    def token_ids(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        return [known] if known is not None else [self.bytes[b] for b in piece.encode()]


class Lattice:
    """Paths through the pieces of a text, within a word or across a cut of it."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: dict[tuple[str, str], bool] = {}
        self.most_pairs = PAIRS
        self.halves: dict[str, tuple[str, str] | None] = {}

    def compatible(self, left: str, right: str) -> bool:
        """Whether two pieces may be neighbours; an empty one is a hard boundary."""
        if not left or not self.v.merges:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > self.most_pairs:
                self.pairs.clear()
            known = self.pairs[left, right] = self.apart(left, right)
        return known

    def apart(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` ends with these two pieces.

        Their last merges are taken back one by one, worst score first. If the two parts that
        then meet would merge with a better score than what was taken back, that merge had come
        first (the left one, of equals) and crossed the boundary.
        """
        score, best = self.v.score, float("-inf")
        while True:
            across = score.get(left + right)
            if across is not None and across > best:
                return False
            a = score[left] if len(left) > 1 else float("inf")
            b = score[right] if len(right) > 1 else float("inf")
            if a < b:
                best, left = a, self.half(left)[1]
            elif len(right) > 1:
                # The same piece on both sides: the left one merged first, so an equal score across loses to it only.
                best, right = math.nextafter(b, float("-inf")), self.half(right)[0]
            else:
                return True

    def half(self, piece: str) -> tuple[str, str]:
        """The two parts that merge last into a piece."""
        if piece not in self.halves:
            parts, last = self.v.merged(piece)
            self.halves[piece] = last if parts == [piece] else None
        return self.halves[piece]

    def usable(self, piece: str) -> bool:
        """Whether merging the piece's own text gives the piece."""
        return len(piece) == 1 or not self.v.merges or self.half(piece) is not None

    def at(self, text: str, start: int) -> list[str]:
        """Pieces that begin at a place: one character at least."""
        v, found, stop = self.v, [text[start]], min(len(text), start + self.v.longest)
        if text[start] in v.starts:
            for end in range(start + 2, stop + 1):
                part = text[start:end]
                if part in v.ids and self.usable(part):
                    found.append(part)
                if part not in v.starts:
                    break
        return found

    def worth(self, piece: str) -> float:
        if self.v.merges:
            return 0.0
        return self.v.score.get(piece, self.v.unknown_score)

    def key(self, piece: str) -> str:
        """What the next piece must know of this one."""
        return piece if self.v.merges and piece in self.v.ids else ""

    def path(self, word: str) -> list[str]:
        """The best path through a text between hard boundaries."""
        n, v = len(word), self.v
        back: list[str | None] = [None] * (n + 1)
        best = [0.0] + [float("-inf")] * n
        for i in range(n):
            if i and back[i] is None:
                continue
            left = self.key(back[i]) if i else ""
            for piece in self.at(word, i):
                end = i + len(piece)
                if v.merges:
                    if back[end] is None and self.compatible(left, piece):
                        back[end] = piece
                elif best[i] + self.worth(piece) > best[end]:
                    best[end], back[end] = best[i] + self.worth(piece), piece
        out: list[str] = []
        while n:
            out.append(back[n])
            n -= len(back[n])
        return out[::-1]

    def unit(self, unit: str, path=None) -> list[int]:
        """Token ids of a run of spaces (maybe empty) with the word that follows (maybe empty).

        ``path`` finds the pieces of a word; ``self.path`` unless a machine does it.
        """
        v, path_of = self.v, path or self.path
        spaces = len(unit) - len(unit.lstrip(SPACE))
        if not v.merges:
            return [i for p in path_of(unit) for i in v.token_ids(p)]
        word = unit[spaces:]
        path = path_of(SPACE + word if spaces else word) if word else []
        if spaces and path:
            if path[0] == SPACE:
                path = path[1:]
            else:
                spaces -= 1
        run = [v.ids.get(SPACE * n) for n in v.run(spaces)]
        ids = [i if i is not None else j for i in run for j in ([i] if i is not None else v.token_ids(SPACE))]
        return ids + [i for p in path for i in v.token_ids(p)]


class Transducer:
    """The merge tokenizer of one word as a deterministic machine, built as it is used.

    A state lists the places that a piece may still begin at: the text since then, the piece that
    ends there and how many tokens lie before it, less the least of these numbers. Reading a
    character moves to the next state and emits by how much that least number rose; a word's end
    emits what its last place has above it. States are few, as places die once no piece fits.

    All moves are in one table by state and character, as the next state and what is emitted in one
    number, and a state is one flat tuple: a table and tuples for each state took twice the memory.
    """

    def __init__(self, lattice: Lattice, limit: int = STATES):
        self.lattice, self.limit = lattice, limit
        self.known: dict[str, tuple[int, bytes]] = {}
        self.reset()

    def reset(self) -> None:
        start = ("", "", 0)
        self.states = [start]
        self.number = {start: 0}
        self.moves: dict[int, int] = {}
        self.last = [0]
        self.tails: list[tuple[int, bytes] | None] = [None]  # length and packed id of the piece that ends here

    def move(self, state: int, code: int) -> int:
        v, places, new, char = self.lattice.v, [], None, chr(code)
        held = iter(self.states[state])
        for pending, left, n in zip(held, held, held):
            piece = v.one.get(pending + char) or pending + char
            fits = not pending or (piece in v.ids and self.lattice.usable(piece))
            if fits and new is None and self.lattice.compatible(left, piece):
                new = ("", self.lattice.key(piece), n + v.width(piece))
            if piece in v.starts:
                places.append((piece, left, n))
        places.append(new)
        least = min(n for _, _, n in places)
        key = tuple(x for p, left, n in places for x in (p, left, n - least))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.last.append(key[-1])
            self.tails.append(self.tail(key[-2]))
        move = self.moves[state << CHAR | code] = least << STATE | to
        return move

    def tail(self, piece: str) -> tuple[int, bytes] | None:
        """Length and packed id of a piece, one object for all states that it ends in."""
        if piece and piece not in self.known:
            self.known[piece] = len(piece), array("i", [self.lattice.v.ids[piece]]).tobytes()
        return self.known.get(piece)

    def count(self, word: str) -> int:
        """Tokens of a text between hard boundaries."""
        if len(self.states) > self.limit:
            self.reset()
        state, n, known = 0, 0, self.moves.get
        for code in map(ord, word):
            move = known(state << CHAR | code)
            if move is None:
                move = self.move(state, code)
            state = move & NUMBER
            n += move >> STATE
        return n + self.last[state]

    def path(self, word: str) -> list[str]:
        """Pieces of a text between hard boundaries: each state knows the piece that ends where it stands."""
        ends, n, out = self.ends(word), len(word), []
        while n:
            piece = self.states[ends[n - 1]][-2] or word[n - 1]
            out.append(piece)
            n -= len(piece)
        return out[::-1]

    def ends(self, word: str) -> list[int]:
        """The state after each character."""
        if len(self.states) > self.limit:
            self.reset()
        state, known, ends = 0, self.moves.get, []
        for code in map(ord, word):
            move = known(state << CHAR | code)
            state = (self.move(state, code) if move is None else move) & NUMBER
            ends.append(state)
        return ends

    def packed(self, word: str) -> bytes:
        """Packed ids of a text between hard boundaries."""
        ends, tails, n, out = self.ends(word), self.tails, len(word), []
        while n:
            tail = tails[ends[n - 1]] or self.unknown(word[n - 1])
            out.append(tail[1])
            n -= tail[0]
        out.reverse()
        return b"".join(out)

    def unknown(self, char: str) -> tuple[int, bytes]:
        return 1, array("i", self.lattice.v.token_ids(char)).tobytes()

    def unit(self, unit: str) -> int:
        """Tokens of a run of spaces (maybe empty) with the word that follows (maybe empty)."""
        v = self.lattice.v
        spaces = len(unit) - len(unit.lstrip(SPACE))
        if spaces <= 1:
            return self.count(unit)
        word = unit[spaces:]
        if not word:
            return len(v.run(spaces))
        whole, bare = self.count(SPACE + word), self.count(word)
        # The last space stands alone exactly if the word costs one token more with it.
        alone = whole == bare + 1 and self.lattice.path(SPACE + word)[0] == SPACE
        return len(v.run(spaces)) + bare if alone else len(v.run(spaces - 1)) + whole


def marks_off(word: bytes, v: Vocabulary) -> int:
    """Length of a word without its closing marks, if no piece holds the characters where they meet; else 0."""
    stem = word.rstrip(MARKS)
    if not stem or len(stem) == len(word):
        return 0
    left = chr(stem[-1]) if stem[-1] < 0x80 else stem.decode()[-1]
    return 0 if left + chr(word[len(stem)]) in v.neighbours else len(stem)


def by_words(make, v: Vocabulary, size=len, share: float = 1.0) -> tuple[Memo, Memo]:
    """Memos of words with a space before them and of bare ones; a word with closing marks is put together.

    ``share``: of the bytes that they may take.
    """

    def of(lead: str, own):
        def miss(word: bytes):
            n = marks_off(word, v)
            return own()[word[:n]] + bare[word[n:]] if n else make(lead + word.decode())

        return miss

    led = Memo(of(SPACE, lambda: led), int(LED_BYTES * share), size)
    bare = Memo(of("", lambda: bare), int(BARE_BYTES * share), size)
    return led, bare


def units_of(text: bytes, newline_apart: bool):
    """``(line number, words, plain)`` of a text: words in a row are each led by one space.

    The first word of the first line is led by the model's own space, those of other lines by
    none. A line that is not plain (spaces in a row, at its start or end) comes as one text.
    """
    text = text.replace(SPACE_BYTES, b" ")
    for k, line in enumerate(text.split(b"\n") if newline_apart else [text]):
        odd = b"  " in line or line.startswith(b" ") or line.endswith(b" ")
        if odd or not line:
            yield k, line, False
        else:
            yield k, line.split(b" "), True


def spaced(line: bytes, first: bool) -> list[str]:
    """Units of a line that is not plain."""
    return UNIT.findall((SPACE if first else "") + line.decode().replace(" ", SPACE))


class Counts:
    """Token counts of texts, words remembered."""

    def __init__(self, lattice: Lattice):
        self.lattice, self.machine = lattice, Transducer(lattice)
        self.unit = self.machine.unit if lattice.v.merges else lambda u: len(lattice.unit(u))
        word = self.machine.count if lattice.v.merges else self.unit  # at most one space leads a word
        self.led, self.bare = by_words(word, lattice.v, lambda n: 0)
        self.newline = lattice.v.width("\n") if "\n" not in lattice.v.chars else 0

    def text(self, text: bytes, first: bool = True) -> int:
        """Tokens of a text that begins and ends at hard boundaries; ``first``: the model's own space leads it."""
        if not text:
            return 0
        total, led = 0, self.led
        for k, line, plain in units_of(text, bool(self.newline)):
            total += self.newline * (k > 0)
            own = first and not k
            if not plain:
                total += sum(map(self.unit, spaced(line, own)))
            elif own:
                total += sum(map(led.__getitem__, line))
            else:
                total += self.bare[line[0]] + sum(map(led.__getitem__, line[1:]))
        return total


class Encoder:
    """Token ids of texts as packed 32-bit numbers, words remembered; with fewer ``states`` as much less of all."""

    def __init__(self, lattice: Lattice, states: int = STATES):
        self.lattice, self.states = lattice, states
        share = min(1.0, states / STATES)
        lattice.most_pairs = int(PAIRS * share)
        machine = Transducer(lattice, states) if lattice.v.merges else None
        self.unit = lambda u: self.pack(lattice.unit(u, machine and machine.path))
        word = machine.packed if machine else self.unit  # at most one space leads a word
        self.led, self.bare = by_words(word, lattice.v, share=share)
        apart = "\n" not in lattice.v.chars
        self.newline = self.pack(lattice.v.token_ids("\n")) if apart else b""

    def pack(self, ids) -> bytes:
        return array("i", ids).tobytes()

    def text(self, text: bytes, first: bool = True) -> bytes:
        """Ids of a text that begins and ends at hard boundaries; ``first``: the model's own space leads it."""
        if not text:
            return b""
        out, led = [], self.led
        for k, line, plain in units_of(text, bool(self.newline)):
            if k:
                out.append(self.newline)
            own = first and not k
            if not plain:
                out += map(self.unit, spaced(line, own))
            elif own:
                out += map(led.__getitem__, line)
            else:
                out.append(self.bare[line[0]])
                out += map(led.__getitem__, line[1:])
        return b"".join(out)


def decode(ids, v: Vocabulary, first: bool = True) -> str:
    """Text of token ids: control ids give nothing; unknown, null and foreign ids give ``" \u2047 "``.

    ``first``: the ids begin a text, so the model's own space is taken off.
    """
    try:
        if min(ids, default=0) < 0:
            return decode_odd(ids, v, first)
    except TypeError:  # a null id
        return decode_odd(ids, v, first)
    return decode_known(ids, v, first)


def decode_known(ids, v: Vocabulary, first: bool = True) -> str:
    """The same for ids that are numbers from 0."""
    try:
        raw = b"".join(map(v.raw.__getitem__, ids))
        lead = next((i for i in ids if i not in v.control), None)
        return raw[first and v.dummy and lead is not None and v.pieces[lead].startswith(SPACE) :].decode()
    except (IndexError, UnicodeDecodeError):
        return decode_odd(ids, v, first)


def decode_odd(ids, v: Vocabulary, first: bool = True) -> str:
    """The same for any list, one id at a time."""
    out: list[str] = []
    held = bytearray()
    first = first and v.dummy
    for i in ids:
        byte = v.byte_of.get(i)
        if byte is not None:
            held.append(byte)
            first = False
            continue
        if held:
            out.append(valid(bytes(held)))
            held.clear()
        if i in v.control:
            continue
        if i is None or not 0 <= i < len(v.pieces) or i in v.unknown:
            out.append(" \u2047 ")
        else:
            piece = v.pieces[i]
            out.append((piece[1:] if first and piece.startswith(SPACE) else piece).replace(SPACE, " "))
        first = False
    if held:
        out.append(valid(bytes(held)))
    return "".join(out)


def valid(raw: bytes) -> str:
    """Bytes as text, one replacement character for every byte that is not part of any."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "\ufffd" + valid(raw[e.start + 1 :])


_KERNELS: dict[bytes, Lattice] = {}


def lattice_of(model: bytes) -> Lattice:
    """One lattice per process and model, so that its memos outlive a task."""
    import hashlib

    key = hashlib.sha256(model).digest()
    if key not in _KERNELS:
        _KERNELS[key] = Lattice(Vocabulary(model))
        _KERNELS[key].counts = _KERNELS[key].encoder = None
    return _KERNELS[key]


def counts_of(model: bytes) -> Counts:
    lattice = lattice_of(model)
    lattice.counts = lattice.counts or Counts(lattice)
    return lattice.counts


def encoder_of(model: bytes, states: int = STATES) -> Encoder:
    lattice = lattice_of(model)
    if lattice.encoder is None or lattice.encoder.states != states:
        lattice.encoder = Encoder(lattice, states)
    return lattice.encoder
