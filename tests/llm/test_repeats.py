"""Suffix arrays, window anchors, and removal of repeated byte strings against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from emberlog.llm import suffix_dedup
from emberlog.llm.suffix_array import suffix_array
from emberlog.llm.winnow import strips


def test_suffix_array():
    rng = random.Random(1)
    for n_symbols in (1, 2, 3, 5, 100):
        for _ in range(150):
            text = [rng.randrange(n_symbols) for _ in range(rng.randrange(40))]
            text = rng.choice([text, text[:5] * 6, text[:9] * 3 + text])
            expected = sorted(range(len(text)), key=lambda i: text[i:])
            assert suffix_array(np.array(text, dtype=np.int64)).tolist() == expected


@pytest.mark.parametrize("chunk", [37, 100, 1 << 19])
def test_every_window_once(chunk):
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"abc ", k=rng.choice([0, 10, 49, 50, 51, 90, 400]))) for _ in range(40)]
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    seen, anchors = [], {}
    for found in strips(raw, starts, chunk=chunk):
        for t, b, w, p, a in zip(found.text, found.begin, found.windows, found.place, found.anchor):
            for k in range(w):
                seen.append((int(t), int(b + k)))
                window = texts[t][b + k : b + k + 50]
                assert len(window) == 50 and 0 <= p - k <= 50 - 24
                # equal windows agree on the anchor and its place
                assert anchors.setdefault(window, (int(a), int(p - k))) == (int(a), int(p - k))
    assert sorted(seen) == [(t, i) for t, x in enumerate(texts) for i in range(len(x) - 49)]


def brute(texts: dict[int, str]) -> dict[int, list[int]]:
    first: dict[bytes, int] = {}
    raw = {i: t.encode() for i, t in texts.items()}
    for i in sorted(raw):
        for k in range(len(raw[i]) - 49):
            first.setdefault(raw[i][k : k + 50], i)
    out = {}
    for i, x in raw.items():
        gone = [False] * len(x)
        for k in range(len(x) - 49):
            if first[x[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        edges = [k for k in range(len(x) + 1) if (k > 0 and gone[k - 1]) != (k < len(x) and gone[k])]
        out[i] = edges
    return out


@pytest.mark.parametrize("most_strips", [1, 8, 4096])
def test_removal_is_exact(spark, monkeypatch, most_strips):
    monkeypatch.setattr(suffix_dedup, "MOST_STRIPS", most_strips)
    rng = random.Random(3)

    def prose(n):
        return " ".join(rng.choice(["ola", "é", "rumba", "x", "tremolo"]) + str(rng.randrange(30)) for _ in range(n))

    passage, texts = prose(40), {}
    for i in range(60):
        body = prose(rng.randrange(0, 60))
        if i % 2:
            cut = rng.randrange(len(passage) - 60)
            body = body + rng.choice(["", " "]) + passage[cut : cut + rng.randrange(40, 200)] + prose(rng.randrange(5))
        if i % 7 == 0 and i:
            body = texts[rng.randrange(i)]
        texts[i] = body
    texts |= {60: "a" * 300, 61: "a" * 49, 62: "a" * 200 + "b", 63: passage * 3, 64: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    out = suffix_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: list(r.spans) for r in out} == brute(texts)
    for r in out:
        raw, spans = texts[r.doc_id].encode(), r.spans
        assert bytes(r.kept) == b"".join(raw[a:b] for a, b in zip([0, *spans[1::2]], [*spans[::2], len(raw)]))


def test_candidates_lose_no_window():
    rng = random.Random(4)
    for _ in range(40):
        gram, members = bytes(rng.choices(b"xyz", k=24)), []
        for _ in range(rng.randrange(2, 30)):
            left = bytes(rng.choices(b"ab", k=rng.randrange(27)))[-rng.randrange(1, 27) :]
            left = rng.choice([left, b"passage before the gram is"[len(left) :]])
            right = rng.choice([bytes(rng.choices(b"ab", k=26)), b"and what comes behind it. "])[: rng.randrange(27)]
            if len(left) + len(right) >= 26:
                members.append((len(left), left + gram + right, rng.randrange(6)))
        first: dict[bytes, int] = {}
        at = [[(p - w, s[w : w + 50]) for w in range(len(s) - 49)] for p, s, _ in members]
        for windows, (_, _, rank) in zip(at, members):
            for window in windows:
                first[window] = min(rank, first.get(window, rank))
        expected = {
            (i, w) for i, windows in enumerate(at) for w, x in enumerate(windows) if first[x] < members[i][2]
        }
        chosen = list(suffix_dedup.candidates(members))
        found = set()
        if chosen:
            masks = suffix_dedup.earlier_windows([(*part, members[i][2]) for i, _, *part in chosen])
            for (i, cut, *_), mask in zip(chosen, masks.tolist()):
                found |= {(i, cut + w) for w in range(mask.bit_length()) if mask >> w & 1}
        assert found == expected
