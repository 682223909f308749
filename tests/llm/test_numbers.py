"""Top-k search, mixing and the two classifiers on small inputs."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import mixing, quality, topk, toxicity
from emberlog.llm.gru import Words, gradients, new_params


def brute_top(rows, asks, k):
    whole = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in whole if asks(i)}):
        vec = min(v for i, v in whole if i == q)
        scored = sorted((-sum(a * b for a, b in zip(vec, v)), i) for i, v in whole if i != q and len(v) == len(vec))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block_rows", [3, 16, 2048])
def test_top_k(spark, block_rows):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, rng.random()]) for _ in range(6)]) for i in range(90)]
    rows += [(i, rows[3][1]) for i in range(90, 130)]
    rows += [(130, None), (140, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (150, [math.nan] * 6), (160, [math.inf] * 6)]
    rows += [(None, [1.0] * 6), (170, [1.0, 2.0]), (180, [3.0, 4.0]), (190, [0.0] * 6), (200, []), (20, [0.5] * 6), (7, [0.5] * 6)]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, score int")
    out = topk.top_k(vectors.repartition(3), F.col("vec_id") % 10 == 0, block_rows=block_rows, query_rows=4)
    assert sorted(map(tuple, out.collect())) == brute_top(rows, lambda i: i % 10 == 0, 5)


def test_top_k_of_nothing(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, F.col("vec_id") % 10 == 0).count() == 0


def test_huge_query_against_small_candidates():
    """Products pass 2^53, where floats no longer tell neighbours apart."""
    data = np.array([[1000, 1000, i] for i in range(40)])
    q = np.array([2**52 + 1, 2**52 - 1, 1])
    ids, scores = topk._Block(np.arange(40), data).best(-1, q, 5, None)
    assert list(zip(ids, scores)) == [(i, sum(int(a) * int(b) for a, b in zip(data[i], q))) for i in range(39, 34, -1)]


def test_threshold_stops_early():
    """A candidate far ahead in all lists ends the search before the others are met."""
    rng = np.random.default_rng(1)
    data = rng.integers(-5, 6, (4000, 4))
    data[:10] = 200 + np.arange(10)[:, None]
    block = topk._Block(np.arange(4000), data)
    met = []
    block.values = type("Counted", (), {"__getitem__": lambda self, at: met.extend(at) or data[at].astype(float)})()
    ids, _ = block.best(-1, np.array([3, 2, 1, 1]), 5, None)
    assert sorted(ids) == [5, 6, 7, 8, 9] and len(met) < 100


def shares(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = {s: w for s, w in weight.items() if s not in capped}
        target = {s: rest * w / sum(free.values()) for s, w in free.items()} if free else {}
        over = {s: most * sizes[s] for s in target if target[s] > most * sizes[s]}
        if not over:
            return capped | target
        capped |= over


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), rng.choice(["a", "b", "c", "d", None, "é"])) for i in range(3000)]
    rows += [(3000 + i, "one two", "hot") for i in range(1500)] + [(9000, "only four words here", "tiny"), (9001, "", "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mix(docs).join(docs, "doc_id").collect()
    sizes = {s: sum(r["size"] for r in out if r.source == s) for s in {r.source for r in out}}
    targets = shares(sizes)
    for source, target in targets.items():
        own = [r for r in out if r.source == source]
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(target, rel=1e-9) for r in own)
        assert sum(r["size"] * r.rate for r in own) == pytest.approx(target, rel=1e-6)
        assert abs(sum(r.taken for r in own) - target) <= max(8, 0.01 * target)
        assert all(r.copies in (0, 1, 2, 3) for r in own)
    # rates are exponential in the size
    own = [r for r in out if r.source == "a" and 0 < r["size"] and r.rate < 3]
    slopes = {round(math.log(r.rate) / r["size"], 9) for r in own}
    assert len(slopes) == 1
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in out}


def test_gradients():
    rng = np.random.default_rng(0)
    params = {k: v.astype(np.float64) for k, v in new_params(50, 3, 4, 3).items()}
    words = Words(np.array([1, 2, 3, 4]), np.array([5, 6, 7, 8, 9, 10, 11]), np.array([0, 2, 3, 5]))
    windows, real = rng.integers(0, 4, (6, 5)), np.ones((6, 5), np.float32)
    real[4:, 1], real[2:, 3] = 0, 0
    labels = np.array([1, 0, 1, 0, 1.0])
    slopes = gradients(params, words, windows, real, labels)[1]
    for name, values in params.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in values.shape)
            if name in ("word", "char"):
                at = (rng.choice(words.slot if name == "word" else words.grams), at[1])
            kept = values[at]
            values[at] = kept + 1e-5
            above = gradients(params, words, windows, real, labels)[0]
            values[at] = kept - 1e-5
            below = gradients(params, words, windows, real, labels)[0]
            values[at] = kept
            assert (above - below) / 2e-5 == pytest.approx(slopes[name][at], rel=1e-3, abs=1e-6)


def test_windows_cover_all_words():
    counts = np.array([0, 0, 1, 33, 65, 114, 1114])
    first, size, before = toxicity.text_windows(counts)
    for i in range(len(counts) - 1):
        covered = set()
        for f, n in zip(first[before[i] : before[i + 1]], size[before[i] : before[i + 1]]):
            assert 0 < n <= toxicity.WINDOW
            covered |= set(range(f, f + n))
        assert covered == set(range(counts[i], counts[i + 1]))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, given = [], []
    for i in range(500):
        words = ["".join(rng.choices(["la", "no", "ti", "re", "mu"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 160))]
        bad, junk = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            for _ in range(rng.randrange(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["grumpf", "zurk", "blarg"]) + rng.choice(["", ".", "s"])
        text = " ".join(words)
        rows.append((i, text.upper() + "!!" if junk else text, "en", "s"))
        given.append((i, int(not junk), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame(given, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(labelled, operator, label):
    docs, labels = labelled
    scored = operator.score(docs, operator.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in scored)
    assert sum(r.predicted == r[label] for r in scored) >= 0.95 * len(scored)


def test_dropping_toxic_rows(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    gone = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    left = toxicity.drop_toxic(docs, model)
    assert {r.doc_id for r in left.collect()} == set(range(500)) - gone and left.dtypes == docs.dtypes
