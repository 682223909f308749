"""Both classifiers against plain versions: features and ratios, the dual, and the loop over windows."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from emberlog.llm import quality, toxicity
from emberlog.llm.common import mix, word_hashes
from emberlog.llm.gru import forward, new_params

MASK = (1 << 64) - 1
TEXTS = [
    "", "a", "the cat the cat sat sat sat", "Éa É \x00 z", "x\ty\nz  x", "word " * 40, "one two three four five",
    "lone", "sat sat", "sat sat sat sat on", "mixed CASE case Case", "1234 5678", "tail ", " head", "é", "\U0001f600 ☃",
    "the dog the dog ran", "the cat ran", "dog dog", "end",
]


def plain_features(text, bits):
    """The features of a text, one n-gram, word and pair at a time."""
    kind = [int(k) for k in quality._KIND]
    raw, shift, found = text.encode(), 64 - bits, set()
    for n in range(1, 5):
        for i in range(len(raw) - n + 1):
            wide = int.from_bytes(raw[i : i + n], "little")
            found.add((((((wide + (n << 40)) * kind[0]) & MASK) ^ kind[1]) * kind[2] & MASK) >> shift)
    one = lambda word: int(word_hashes(np.frombuffer(word, np.uint8), np.array([0, len(word)]), lower=False)[0][0])
    mixed = lambda x: int(mix(np.array([x & MASK], dtype=np.uint64))[0])
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    hashes = [one(w) for w in words]
    for i, h in enumerate(hashes):
        found.add(mixed(h + kind[3]) >> shift)
        if i:
            again = words[i] == words[i - 1]
            thrice = again and i > 1 and words[i - 1] == words[i - 2]
            pair = kind[6] if thrice else kind[5] if again else mixed(h * kind[4] + hashes[i - 1])
            found.add(pair >> shift)
    return found


def test_features_and_ratios(spark):
    bits = 12
    got = list(quality.ngrams(pa.array(TEXTS), bits))
    assert [set(x.tolist()) for x in got] == [plain_features(t, bits) for t in TEXTS]
    labels = [i % 3 == 0 for i in range(len(TEXTS))]
    rows = spark.createDataFrame([(t, int(y)) for t, y in zip(TEXTS, labels)], "_text string, _label int").repartition(3)
    counts, n = quality.class_counts(rows, bits)
    expected = np.zeros((2, 1 << bits), dtype=int)
    for text, y in zip(TEXTS, labels):
        for feature in plain_features(text, bits):
            expected[int(y), feature] += 1
    assert (counts == expected).all() and n.tolist() == [labels.count(False), labels.count(True)]


def test_dual_descent_finds_the_optimum():
    """The same weights as sweeps over the full Gram matrix of the dual."""
    rng = np.random.default_rng(2)
    values = rng.standard_normal(60)
    examples = [np.sort(rng.choice(60, rng.integers(3, 12), replace=False)) for _ in range(20)]
    labels = np.where(rng.random(20) < 0.5, 1, -1)
    dense = np.zeros((20, 61))
    for i, x in enumerate(examples):
        dense[i, x] = values[x] / np.linalg.norm(values[x])
        dense[i, 60] = 1.0
    gram = (dense @ dense.T) * np.outer(labels, labels)
    duals = np.zeros(20)
    for _ in range(5000):
        for i in range(20):
            duals[i] = min(max(duals[i] - (gram[i] @ duals - 1) / gram[i, i], 0.0), 1.0)
    best = (duals * labels) @ dense
    weights, bias = quality.descend(examples, values, labels, 1.0, 5000)
    assert np.allclose(weights, best[:60], atol=2e-3) and abs(bias - best[60]) < 2e-3


def test_scores_are_maxima_over_windows():
    """Every window read on its own, as a text of its 32 words."""
    rng = random.Random(3)
    vocabulary = ["good", "BAD", "naïve", "x1", "it's", "well-known", "a", "über", "zzz"]
    texts = ["", "...", "one"] + [" ".join(rng.choices(vocabulary, k=n)) for n in (2, 15, 16, 17, 31, 32, 33, 47, 48, 49, 200)]
    params = new_params(toxicity.SLOTS, toxicity.SIZE, toxicity.HIDDEN, toxicity.ATTENTION, seed=9)
    got = np.concatenate(list(toxicity.top_logits(pa.array(texts), params)))
    for text, logit in zip(texts, got):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())
        if not words:
            assert logit == -np.inf
            continue
        best, begin = -np.inf, 0
        while True:
            raw = b" ".join(words[begin : begin + 32])
            known, which, _, _ = toxicity.distinct_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            at = np.zeros((32, 1), dtype=int)
            at[: len(which), 0] = which
            real = (np.arange(32)[:, None] < len(which)).astype(np.float32)
            best = max(best, float(forward(params, known, at, real)[0]))
            if begin + 32 >= len(words):
                break
            begin += 16
        assert abs(best - logit) < 1e-4
