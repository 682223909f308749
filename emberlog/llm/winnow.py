"""Anchors of fixed-length byte windows: equal windows choose the same inner k-gram, wherever they are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from emberlog.llm.common import mix, seeds

#: length of the compared strings, and of the k-grams inside them
WINDOW, GRAM = 50, 24
CHUNK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_BYTE = seeds(256, 31 << 40)
_FACTOR = seeds(8, 32 << 40) | np.uint64(1)


def _gram_hashes(part: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on, put together from powers of two."""
    out, done, width, level = None, 0, 1, 0
    power = _BYTE[part]
    while True:
        if gram & width:
            # the bits of ``gram`` in turn: the next ``width`` bytes follow the ones already hashed
            tail = power[done : len(part) - gram + 1 + done]
            out = tail.copy() if out is None else out * _FACTOR[7 - level] + tail
            done += width
        width *= 2
        if width > gram:
            return mix(out)
        half = width // 2
        power = power[: len(power) - half] * _FACTOR[level] + power[half:]
        level += 1


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, reach = values, 1
    while reach * 2 <= width:
        out = np.minimum(out[: len(out) - reach], out[reach:])
        reach *= 2
    if reach < width:
        out = np.minimum(out[: len(out) - (width - reach)], out[width - reach :])
    return out


@dataclass
class Strips:
    """Runs of windows that chose one anchor: text number, begin of the first window in the text, number of
    windows, place of the anchor in the first window, hash of the anchor, and begin in the raw bytes."""

    text: np.ndarray
    begin: np.ndarray
    windows: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    raw: np.ndarray


def strips(
    raw: np.ndarray, starts: np.ndarray, window: int = WINDOW, gram: int = GRAM, chunk: int = CHUNK
) -> Iterator[Strips]:
    """All windows of all texts, run by run; no window crosses from one text to the next."""
    width = window - gram + 1
    for low in range(0, max(0, len(raw) - window + 1), chunk):
        part = raw[low : low + chunk + window - 1]
        hashes = _gram_hashes(part, gram)
        places = np.arange(len(hashes), dtype=np.uint64)
        best = (_sliding_min((hashes & ~_PLACE) | places, width) & _PLACE).astype(np.int64)
        # windows that begin in the last bytes of a text would leave it
        inside = np.ones(len(best), dtype=bool)
        edge = np.ones(len(best) + 1, dtype=bool)
        edge[1:-1] = best[1:] != best[:-1]
        near = np.arange(np.searchsorted(starts, low), np.searchsorted(starts, low + len(best) + window))
        for end in np.unique(starts[near]) - low:
            inside[max(0, end - window + 1) : max(0, end)] = False
            if 0 <= end < len(best):
                edge[end] = True
        begin = np.flatnonzero(edge[:-1] & inside)
        if not len(begin):
            continue
        stop = np.flatnonzero((edge[1:] | ~np.append(inside[1:], False)) & inside) + 1
        text = np.searchsorted(starts, begin + low, side="right") - 1
        yield Strips(
            text, begin + low - starts[text], stop - begin, best[begin] - begin, hashes[best[begin]], begin + low
        )
