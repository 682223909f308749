"""Encoding, counting and decoding against the library that the vocabulary file is made for."""

from __future__ import annotations

import random
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberlog.llm import bpe_codec, token_counts
from emberlog.llm.byte_bpe import load

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def bpe():
    return load(Path(PATH).read_text(encoding="utf-8"))


def encoded(bpe, pieces, text):
    out = []
    for n, segment in enumerate(bpe.segments(text)):
        out.extend([bpe.special[segment]] if n % 2 else [i for p in bpe.find(segment) for i in pieces[p]])
    return out


def counted(bpe, counts, text):
    parts = bpe.segments(text)
    return len(parts) // 2 + sum(counts[p] for segment in parts[::2] for p in bpe.find(segment))


def check(bpe, texts):
    library = Tokenizer.from_file(PATH)
    pieces, counts, tables = bpe_codec._Pieces(bpe), token_counts._Counts(bpe), bpe_codec.spelling(bpe)
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = encoded(bpe, pieces, text)
        assert ids == expected.ids, text
        assert counted(bpe, counts, text) == len(ids), text
        decoded = bpe_codec.decode_ids(np.array(ids, dtype=np.int32), tables)
        assert decoded == library.decode(ids, skip_special_tokens=False)


def test_every_tenth_code_point(bpe):
    points = [chr(c) for c in range(0, 0x110000, 10) if not 0xD800 <= c < 0xE000]
    check(bpe, [f"a{c}b 1{c}2 !{c}! {c}{c} {c}" for c in points])


def test_mixed_and_long_texts(bpe):
    rng = random.Random(3)
    parts = ["a", "b", " ", "\n", "é", "\U0001f600", "'s", "'", "1", "!", " the", "<|endoftext|>", "́", "\x1c", "\x85", "�"]
    texts = ["".join(rng.choices(parts, k=60)) for _ in range(1500)]
    check(bpe, [*texts, "", "a" * 5000, "ab" * 3000 + " " * 1000 + "é" * 999, "<|endoftext|>" * 3])


def test_documents(bpe, spark, sf_dir):
    check(bpe, [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()])


def test_decoding_cut_characters(bpe):
    library, tables = Tokenizer.from_file(PATH), bpe_codec.spelling(bpe)
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(50257), rng.randrange(100, 260)]) for _ in range(12)]
        assert bpe_codec.decode_ids(np.array(ids), tables) == library.decode(ids, skip_special_tokens=False)


def test_forced_cuts(bpe):
    joined = bpe_codec.joined_pairs(bpe)
    for piece in ("hello", "éèê", "\U0001f600\U0001f600", "!!é"):
        parts = bpe_codec.fragments(piece.encode(), joined)
        assert b"".join(parts) == piece.encode()
        for a, b in zip(parts, parts[1:]):
            assert not any(a[-1:] + b[:1] in token for token in bpe.spell.values())


def test_small_tables_change_nothing(bpe, monkeypatch):
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    check(bpe, ["one two three four five one two six seven one", "é è ê é one two"])


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        load(Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8"))


def test_long_runs_take_bounded_memory(bpe):
    """A run without any place to cut: equal to the library, in some 60 bytes a byte."""
    rng = random.Random(5)
    size = 300_000
    run = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size))
    expected = Tokenizer.from_file(PATH).encode(run, add_special_tokens=False).ids
    for work, out in ((bpe_codec.merge, tuple(expected)), (token_counts.merged_count, len(expected))):
        tracemalloc.start()
        try:
            assert work(run.encode(), bpe) == out
            assert tracemalloc.get_traced_memory()[1] < 100 * size
        finally:
            tracemalloc.stop()
