"""Near duplicates and components against brute force, with groups that only the later steps can link."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import minhash_dedup
from emberlog.llm.components import connected_components
from emberlog.llm.shingles import shingle_sets


def exact_components(texts: dict[int, str | None], percent: int = 85) -> dict[int, int]:
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: root(i) for i in texts}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def family():
    """Copies of two related texts with so many edits that some are linked only by way of others."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    other = base[:120] + [f"c{i}" for i in range(30)]
    texts = {i: edited(rng, base if i % 3 else other, rng.randrange(0, 7)) for i in range(140)}
    texts |= {200 + i: " ".join(rng.choices(["x", "y", "z"], k=rng.randrange(0, 9))) for i in range(60)}
    return texts | {300: None, 301: "", 302: base[0], 303: base[0].upper()}


@pytest.mark.parametrize("small_bucket", [1, 32])
def test_components_are_exact(spark, family, small_bucket):
    docs = spark.createDataFrame(list(family.items()), "doc_id long, text string").repartition(5)
    out = minhash_dedup.near_duplicates(docs, small_bucket=small_bucket).collect()
    expected = exact_components(family)
    assert len(set(expected.values())) < len(expected)
    assert {r.doc_id: r.component_id for r in out} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_signatures_estimate_similarity():
    """Share of equal values is unbiased, minima and maxima alike."""
    rng = np.random.default_rng(2)
    universe = rng.integers(0, 2**63, 1300).astype(np.uint64)
    a, b = universe[:1000], universe[300:]
    both = minhash_dedup.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 2000)
    equal = both[0] == both[1]
    assert abs(equal.mean() - 700 / 1300) < 0.05
    assert abs(equal[::2].mean() - equal[1::2].mean()) < 0.08


def test_shingles_of_odd_texts():
    texts = [None, "", "a", "A", "a b", "ab", "a b c d e", "a b c d e f", "a\x0bb\tc\nd\re\x0cf", "a b c d e f " * 30, "é È"]
    sizes = [len(s) for s in shingle_sets(pa.array(texts))]
    assert sizes == [0, 0, 1, 1, 1, 1, 1, 2, 2, 6, 1]
    sets = [s.tobytes() for s in shingle_sets(pa.array(texts))]
    assert sets[2] == sets[3] and sets[7] == sets[8] and sets[4] != sets[5]


def test_connected_components(spark):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    loose = [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(45)]
    links = [(a, b) for a, b in chain + star + loose]
    label = {}

    def root(i):
        label.setdefault(i, i)
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    out = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    # a node that is only linked with itself has no row
    assert {r.node: r.label for r in out} == {i: root(i) for i in label if any(i in p and p[0] != p[1] for p in links)}
