"""Two tokenizations of one text, aligned byte by byte.

Both tokenizers end a token before a space or line break that follows another character, so texts
are cut there and the parts aligned once each (``Aligner`` remembers them). Within many parts at
once, the ends of both tokenizations are offsets in one array: where they coincide groups end, and
every stretch between two neighbouring ends is the overlap of one pair of tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

from plumbline.llm.word_ids import BYTE_CHARS

#: Fixed value: how byte-level tokenizers divide a text.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text with white space other than single spaces and line breaks between words.
ODD = re.compile(r"[^\S \n]|[ \n][ \n]|\A[ \n]|[ \n]\Z|\x00")
PART = re.compile(r"(?<=\S)\n(?=\S)|[ \n]?\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
SPACE = "▁"
WHOLE = "\x00"  # leads the key of a part that is spelled out
PART_BYTES = 400  # longer parts are not remembered
LINK, A_SHIFT = np.int64, 32


def byte_tokens(model: bytes):
    """``(encode, bytes of each id)`` of a byte-level tokenizer's JSON: special strings are plain text."""
    spec = json.loads(model)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    before, ids = spec["pre_tokenizer"], spec["model"]["vocab"]
    if spec["normalizer"] or before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"]:
        raise ValueError("only byte-level tokenizers that divide texts by their usual pattern")
    back = {chr(BYTE_CHARS.get(b, b)): b for b in range(256)}
    known = {i: t for t, i in ids.items() if i < 256 + len(merges)}
    ranks = {bytes(back[c] for c in t): i for i, t in known.items()}
    in_order = all(ids.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    if not in_order or len(ranks) != 256 + len(merges) or any(len(t) > 1 for t, i in ranks.items() if i < 256):
        raise ValueError("only tokenizers whose ids follow their merges")
    import tiktoken

    encode = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    raw = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        raw[i] = t
    return lambda texts: [encode(t) for t in texts], raw


def piece_tokens(model: bytes):
    """``(encode, bytes of each id)`` of a SentencePiece model; what is encoded goes on after a line break."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as schema

    proto = schema.ModelProto()
    proto.ParseFromString(model)
    norm, kinds = proto.normalizer_spec, proto.SentencePiece
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only models that leave characters and white space as they are and add a space")
    if proto.trainer_spec.treat_whitespace_as_suffix or not proto.trainer_spec.byte_fallback:
        raise ValueError("only models with spaces in front and byte fallback")
    raw = []
    for p in proto.pieces:
        plain = p.type in (kinds.NORMAL, kinds.USER_DEFINED)
        if plain and ("\n" in p.piece or SPACE in p.piece.lstrip(SPACE)):
            raise ValueError("a piece holds a line break, or a space after another character")
        raw.append(bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() if plain else b"")
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    lead = len(lib.encode("\n"))
    return lambda texts: [x[lead:] for x in lib.encode(["\n" + t for t in texts], num_threads=1)], raw


def parts_of(text: str) -> list[str]:
    """Keys of the parts of a space and a text: a bare word has a space before it, others are spelled out."""
    if ODD.search(text):
        return [WHOLE + p for p in PART.findall(" " + text)]
    first, *lines = text.split("\n")
    out = first.split(" ")
    for line in lines:
        words = line.split(" ")
        words[0] = "\n" + words[0]
        out += words
    return out


def spelled(key: str) -> str:
    """The text of a part."""
    return key[1:] if key[0] == WHOLE else key if key[0] == "\n" else " " + key


class Aligned:
    """Parts side by side. ``links``: pairs ``a << 32 | b``; the others hold numbers per part."""

    def __init__(self, n_a, n_b, n_groups, n_links, links, groups, good):
        self.n_a, self.n_b, self.n_groups, self.n_links = n_a, n_b, n_groups, n_links
        self.links, self.groups, self.good = links, groups, good


class Aligner:
    def __init__(self, a_model: bytes, b_model: bytes):
        self.encode_a, self.raw_a = byte_tokens(a_model)
        self.encode_b, self.raw_b = piece_tokens(b_model)
        self.size_a = np.array([len(x) for x in self.raw_a], np.int64)
        self.size_b = np.array([len(x) for x in self.raw_b], np.int64)
        sep = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.a_more, self.a_last = sep(len(self.raw_a), ","), sep(len(self.raw_a), "|")
        self.b_more, self.b_last = sep(len(self.raw_b), ","), sep(len(self.raw_b), ";")

    def align(self, keys: list[str], with_groups: bool = True) -> Aligned:
        """All parts at once. Parts whose bytes a tokenization does not give back are not ``good`` and have no tokens."""
        texts = [spelled(k) for k in keys]
        a, b = self.encode_a(texts), self.encode_b(texts)
        raw = [t.encode() for t in texts]
        good = np.ones(len(keys), bool)
        joined = b"".join(raw)
        if joined != self.bytes_of(a, self.raw_a) or joined != self.bytes_of(b, self.raw_b):
            for i, own in enumerate(raw):
                if own != self.bytes_of([a[i]], self.raw_a) or own != self.bytes_of([b[i]], self.raw_b):
                    good[i], a[i], b[i], raw[i] = False, [], [], b""
        n_a, n_b = (np.array([len(x) for x in y], np.int64) for y in (a, b))
        a, b = (np.array([i for x in y for i in x], np.int64) for y in (a, b))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.cumsum([len(x) for x in raw])
        both = np.union1d(end_a, end_b)
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        count = lambda x: np.diff(np.searchsorted(x, ends, side="right"), prepend=0)
        links = a[np.searchsorted(end_a, both)] << A_SHIFT | b[np.searchsorted(end_b, both)]
        n_groups = count(common)
        groups = self.strings(a, b, end_a, end_b, common, n_groups) if with_groups else None
        return Aligned(n_a, n_b, n_groups, count(both), links, groups, good)

    @staticmethod
    def bytes_of(ids, raw) -> bytes:
        return b"".join([raw[i] for x in ids for i in x])

    def strings(self, a, b, end_a, end_b, common, n_groups) -> list[str]:
        """``a1,a2|b1;`` and so on, for each part."""
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        words = np.concatenate([np.where(last_a, self.a_last[a], self.a_more[a]), np.where(last_b, self.b_last[b], self.b_more[b])])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = words[order].tolist()
        tokens = np.bincount(group_a, minlength=len(common)) + np.bincount(group_b, minlength=len(common))
        upto = np.append(0, np.cumsum(tokens))[np.append(0, np.cumsum(n_groups))]
        return ["".join(words[i:j]) for i, j in zip(upto[:-1], upto[1:])]


class Parts:
    """Records of parts in two generations, found for many parts at once and bounded by bytes."""

    def __init__(self, find: Callable[[list[str]], list], size: Callable, most: int = 240 << 20):
        self.find, self.size, self.half = find, size, most // 2
        self.young, self.old, self.taken = {}, {}, 0

    def of(self, texts: list[list[str]]) -> list[list]:
        """The records of all parts of all texts."""
        if self.taken > self.half:
            self.old, self.young, self.taken = self.young, {}, 0
        young, missing = self.young, []
        long: dict = {}
        for key in set().union(*texts):
            if key not in young:
                found = self.old.get(key)
                if found is None:
                    missing.append(key)
                else:
                    self.keep(key, found)
        for key, found in zip(missing, self.find(missing) if missing else []):
            if len(key) > PART_BYTES:
                long[key] = found
            else:
                self.keep(key, found)
        if not long:
            return [list(map(young.__getitem__, keys)) for keys in texts]
        return [[young[k] if k in young else long[k] for k in keys] for keys in texts]

    def keep(self, key: str, found) -> None:
        self.young[key] = found
        self.taken += 200 + len(key) + self.size(found)
