"""Token ids of the ``tokenizers`` library for whole texts.

A tokenizer that drops white space and looks at no word together with another gives each word the
same ids in every text. The distinct words of many plain texts are set out with one space behind
every word and mark, and the merges run in ``tiktoken``'s loop, several times faster than the
library's own, with that space as the word's end. Other texts ask the library once a word; any
other tokenizer gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.memo import Memo

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the pattern of tokenizers with word ends whose matches hold no white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = {"NFC", "Lowercase", "Replace"}
#: Characters that no normal form changes; the letters among them have one small letter each.
PLAIN = re.compile("[ -~\\n\\u00a1\\u00ab\\u00bb\\u00bf-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u0148\\u014a-\\u017f\\u2013\\u2014\\u2018-\\u201d\\u2026]*")
APART = re.compile(r"'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+|\d")
#: Where a plain text may hold such places.
RUN = re.compile("[!-@\\[-`{-~\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018-\u201d\u2026]+(?:(?<=')(?:s|t|re|ve|m|ll|d))?")
END = b" "
#: Fixed values of byte-level tokenizers: bytes that are no plain character stand 256 places higher, in order.
SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = dict(zip(sorted(set(range(256)) - SHOWN), range(256, 512)))
BATCH_BYTES = 1 << 20
PLAIN_BYTES = 8 << 20  # plain texts whose words are encoded together, each once
BETWEEN = "\x01"  # a word that is in no plain text


def splits_at_space(spec: dict) -> bool:
    """Whether each run of characters other than ASCII white space is tokenized by itself."""
    normal = spec.get("normalizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    spaces = [s for s in steps if s["type"] == "Replace"]
    return (
        all(s["type"] in NORMALIZERS for s in steps)
        and any(s["type"] == "Lowercase" for s in steps)
        and all(s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in spaces)
        and before[0].get("type") == "Split"
        and before[0]["pattern"] == {"Regex": WORD_PATTERN}
        and before[0]["behavior"] == "Removed"
        and before[0]["invert"]
        and [(p["type"], p.get("use_regex"), p.get("add_prefix_space")) for p in before[1:]] == [("ByteLevel", False, False)]
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") or t["content"].split() != [t["content"]] for t in spec["added_tokens"])
        and spec["model"]["type"] == "BPE"
    )


def merge_loop(model: dict):
    """The merges for ``tiktoken``, a word's end as one byte more; None if ids do not follow the merges.

    No word holds a space, so it can mark the end. The first 512 ids are the bytes and the bytes at
    a word's end, which hence come together before anything else; each later id is one merge.
    """
    import tiktoken

    mark, ids = model["end_of_word_suffix"], model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if not mark or model.get("dropout") or any(ids.get(a + b) != 512 + i for i, (a, b) in enumerate(merges)):
        return None
    back = {chr(BYTE_CHARS.get(b, b)): b for b in range(256)}
    raw = lambda t: bytes(back[c] for c in t.removesuffix(mark)) + (END if t.endswith(mark) else b"")
    ranks = {raw(t): i for t, i in ids.items() if i < 512 + len(merges)}
    whole = len(ranks) == 512 + len(merges) and all(len(t) == 1 + (i >= 256) for t, i in ranks.items() if i < 512)
    return tiktoken.Encoding("merges", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}) if whole else None


class WordIds:
    """Packed ids of texts, each number in ``width`` bytes."""

    def __init__(self, model: bytes, memo_bytes: int = 32 << 20):
        from tokenizers import Tokenizer

        spec = json.loads(model)
        if spec["truncation"] or spec["padding"]:
            raise ValueError("a tokenizer that cuts or fills texts")
        self.library = Tokenizer.from_str(model.decode())
        most = max(self.library.get_vocab(with_added_tokens=True).values())
        self.kind = np.dtype("<u2" if most < 1 << 16 else "<u4")
        self.code = "H" if most < 1 << 16 else "I"
        self.by_words = splits_at_space(spec)
        self.loop = merge_loop(spec["model"]) if self.by_words else None
        self.between = self.library.token_to_id(chr(BYTE_CHARS[1]) + (spec["model"]["end_of_word_suffix"] or "")) if self.loop else None
        self.words = Memo(self.word, memo_bytes)

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def word(self, word: bytes) -> bytes:
        return self.pack(self.library.encode(word.decode(), add_special_tokens=False).ids)

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of ``PLAIN`` characters: their distinct words are encoded in one run."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = lists.flatten().dictionary_encode()
        apart = lambda run: f" {run[0]} " if len(run[0]) == 1 else APART.sub(lambda m: f" {m[0]} ", run[0])
        words = RUN.sub(apart, "\n".join(coded.dictionary.to_pylist()).lower())
        words = words.replace("\n", f" {BETWEEN} ")
        ids = np.array(self.loop.encode_ordinary(words + " "), self.kind)
        cuts = np.flatnonzero(ids == self.between)
        starts, ends = np.append(0, cuts + 1), np.append(cuts, len(ids))
        at = coded.indices.to_numpy()
        sizes = (ends - starts)[at]
        upto = np.append(0, np.cumsum(sizes))
        flat = ids[np.repeat(starts[at] - upto[:-1], sizes) + np.arange(upto[-1])]
        bounds = upto[lists.offsets.to_numpy()]
        return [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]

    def texts(self, texts: list[bytes | None]) -> list[bytes]:
        """Packed ids of all texts, null ones as empty ones."""
        out: list[bytes | None] = [None] * len(texts)
        held: list[tuple[int, str]] = []
        size = 0

        def done():
            run = self.plain if self.loop is not None else self.batch
            for (i, _), found in zip(held, run([x for _, x in held])):
                out[i] = found
            held.clear()

        for i, raw in enumerate(texts):
            text = (raw or b"").decode()
            if self.by_words and (self.loop is None or "<|" in text or not PLAIN.fullmatch(text)):
                out[i] = b"".join(map(self.words.__getitem__, (raw or b"").split()))
                continue
            held.append((i, text))
            size += len(text)
            if size > (PLAIN_BYTES if self.loop is not None else BATCH_BYTES):
                done()
                size = 0
        if held:
            done()
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
