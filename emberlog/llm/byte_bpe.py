"""Byte-level BPE vocabularies in the JSON format of public tokenizers: tables and pre-tokenisation."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import regex

# Fixed value: how byte-level vocabularies split a text before merging; white space is the
# Unicode property, as in the libraries that read these files.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself if printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


@dataclass
class ByteBPE:
    """``first``: id of each byte; ``merges``: (left id, right id) → (rank, merged id); ``spell``: bytes of each id.

    ``rank_of``, ``pair_of`` and ``merged`` hold the same merges as pair → rank, rank → pair and rank → merged id.
    """

    first: list[int]
    merges: dict[tuple[int, int], tuple[int, int]]
    spell: dict[int, bytes]
    special: dict[str, int]

    def __post_init__(self) -> None:
        self.rank_of = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.pair_of = sorted(self.rank_of, key=self.rank_of.get)
        self.merged = [i for _, i in sorted(self.merges.values())]
        self.find = regex.compile(SPLIT).findall
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None

    def segments(self, text: str) -> list[str]:
        """Ordinary text and special strings in turn; the special ones have odd positions."""
        return self.cut(text) if self.cut else [text]


@lru_cache(maxsize=4)
def load(content: str) -> ByteBPE:
    """Tables of a vocabulary file's content; a Python worker keeps them for its later tasks."""
    data = json.loads(content)
    model, kind = data["model"], data["pre_tokenizer"]
    if model["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or data["normalizer"]:
        raise ValueError("only byte-level BPE files without prefix space and normalizer are understood")
    byte_of = printable_bytes()
    vocab = model["vocab"]
    spell = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    for text, i in special.items():
        spell[i] = text.encode()
    first = [0] * 256
    for c, b in byte_of.items():
        first[b] = vocab[c]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
    return ByteBPE(first, merges, spell, special)
