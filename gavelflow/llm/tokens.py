"""Token ids of a public BPE vocabulary with word ends, fast and exactly those of its library.

Whole texts go through a per-task cache of words: a word's ids do not depend on
its neighbours. Words not in the cache are merged by the rank table, which the
vocabulary file gives (its ids follow the order of its merges). Texts with
anything unusual (special tokens, control characters that the two libraries
split at differently) go through the library as a whole.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import regex
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: how the vocabulary's file splits text before the merges.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ODD = regex.compile("<\\||[\x1c-\x1f᠎​﻿]")
END = b"\xff"  # never occurs in UTF-8; stands for the end of a word


def _byte_names() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes; computed when missing, at most ``most`` words kept."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        self.most = most
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        special = {t["content"] for t in spec["added_tokens"]}
        name, ranks = _byte_names(), {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                end = token.endswith("</w>")
                ranks[bytes(name[c] for c in (token[:-4] if end else token)) + (END if end else b"")] = i
        merges = spec["model"]["merges"]
        first = len(ranks) - len(merges)
        if any(spec["model"]["vocab"][a + b] != first + i for i, (a, b) in enumerate(merges)):
            raise ValueError("the vocabulary's ids don't follow its merges")
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if word.isalpha():
            ids = array("I", self.merge(word.encode() + END))
        elif word[:-1].isalpha() and word[-1] in ".,":
            ids = array("I", self.merge(word[:-1].encode() + END))
            ids.extend(self.merge(word[-1].encode() + END))
        else:
            ids = array("I")
            for piece in PIECES.findall(word):
                ids.extend(self.merge(piece.encode() + END))
        out = self[word] = ids.tobytes()
        return out

    def ids(self, text: str) -> bytes:
        if ODD.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() alone knows a final sigma
        return b"".join(map(self.__getitem__, text.lower().split()))
