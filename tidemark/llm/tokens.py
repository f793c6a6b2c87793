"""Byte-level BPE ids, as the tokenizers library gives them for a byte-level vocabulary file.

The vocabulary is read from that library's JSON file; pieces are merged by tiktoken, which gives the same ids faster,
and remembered by the text between spaces. A single space before a non-space always begins a token of its own
pattern, so such texts have the same ids in any document. Texts with double spaces, or with the vocabulary's special
tokens, go the direct way.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import tiktoken

# The pattern of byte-level pre-tokenization and the printable ranges of its byte alphabet.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


def _alphabet() -> dict[str, int]:
    shown = [b for r in PRINTABLE for b in r]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; as a dict, of texts that follow a space."""

    def __init__(self, path: str, remember: int):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _alphabet()
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special, self.remember = tuple(special), remember
        self.full = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.plain = self.full._core_bpe.encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise KeyError(word)
        ids = array("I", self.plain(" " + word)).tobytes()
        if len(word) <= 40:
            if len(self) >= self.remember:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        for s in self.special:
            if s in text:
                return array("I", self.full.encode(text, allowed_special="all")).tobytes()
        head, *rest = text.split(" ")
        try:
            return array("I", self.plain(head)).tobytes() + b"".join(map(self.__getitem__, rest))
        except KeyError:
            return array("I", self.plain(text)).tobytes()


@lru_cache(2)
def bpe(path: str, remember: int = 400_000) -> Bpe:
    """One for each worker; remember bounds its memory (about 200 bytes a word)."""
    return Bpe(path, remember)
