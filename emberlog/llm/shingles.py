"""Word shingles of texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from emberlog.llm.common import mix, seeds, slices, utf8, word_hashes

WORDS = 5


def shingles(hashes: np.ndarray, counts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` words inside each text, and the number of shingles before each text.

    ``counts`` holds the number of words before each text. A text with fewer words, but one at
    least, has its whole sequence as its only shingle.
    """
    n_words = np.diff(counts)
    n = np.where(n_words >= words, n_words - words + 1, (n_words > 0).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(n)])
    factors = seeds(words, 3 << 40) | np.uint64(1)
    at = np.repeat(counts[:-1] - before[:-1], n) + np.arange(before[-1])
    out = np.zeros(len(at), dtype=np.uint64)
    size = np.repeat(np.minimum(n_words, words), n)
    padded = np.concatenate([hashes, np.zeros(words, dtype=np.uint64)])
    for k in range(words):
        word = padded[at + k] * factors[k]
        word[size <= k] = 0
        out += word
    return mix(out + size.astype(np.uint64)), before


def shingle_runs(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column: first row, its shingles, and the number of shingles before each text."""
    raw, starts = utf8(column)
    for a, b in slices(starts):
        part = raw[starts[a] : starts[b]]
        hashes, _, counts = word_hashes(part, starts[a : b + 1] - starts[a])
        yield a, *shingles(hashes, counts, words)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted set of every text."""
    for _, all_shingles, before in shingle_runs(column, words):
        for a, b in zip(before, before[1:]):
            yield np.unique(all_shingles[a:b])
