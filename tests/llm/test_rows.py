"""Stages on rows whose ids are null or repeat."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from emberlog.llm import exact_dedup, labelled, minhash_dedup, mixing

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(params=["files", "frame"])
def stored(request, spark, tmp_path):
    """Rows as a table in files and as a plain DataFrame."""

    def make(rows):
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        if request.param == "frame":
            return df
        df.write.parquet(str(tmp_path / "docs"))
        return spark.read.parquet(str(tmp_path / "docs"))

    return make


def prose(rng, n=30):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_exact_dedup_keeps_one_row_of_each_text(stored):
    rng = random.Random(1)
    many = [(rng.choice([None, 1, 2, 3]), rng.choice(["x", "Y", "y", None, "", "z"]), str(i)) for i in range(60)]
    rows = [(5, "A", "p"), (9, "a", "q"), (5, "B", "r"), *many]
    rows += [(None, "C", str(i)) for i in range(20)] + [(7, "D", str(i)) for i in range(20)]
    docs = stored(rows)
    out = exact_dedup.drop_exact_duplicates(docs)
    kept = out.collect()
    assert out.dtypes == docs.dtypes and not Counter(map(tuple, kept)) - Counter(rows)
    largest = {}
    for i, text, _ in rows:
        norm = (text or "").lower()
        largest[norm] = max(largest.get(norm, -1), -1 if i is None else i)
    found = [((r.text or "").lower(), -1 if r.doc_id is None else r.doc_id) for r in kept]
    assert sorted(found) == sorted(largest.items())


def test_near_dedup_keeps_one_row_of_each_component(stored):
    rng = random.Random(2)
    one, two, three, four = (prose(rng) for _ in range(4))
    near = lambda text, n: text + " " + " ".join(f"end{n}x{i}" for i in range(n % 2))
    rows = [(5, one, "p"), (3, near(one, 1), "q"), (5, two, "r")]
    rows += [(None, near(three, i), str(i)) for i in range(20)] + [(7, near(four, i), str(i)) for i in range(20)]
    rows += [(None, None, "s"), (None, "", "t"), (7, " ", "u")]
    docs = stored(rows)
    out = minhash_dedup.drop_near_duplicates(docs)
    kept = out.collect()
    assert out.dtypes == docs.dtypes and not Counter(map(tuple, kept)) - Counter(rows)
    # rows without words are linked with nothing
    assert sorted(r.source for r in kept if not (r.text or "").strip()) == ["s", "t", "u"]
    firsts = Counter((r.doc_id, r.text.split()[0]) for r in kept if (r.text or "").strip())
    head = [t.split()[0] for t in (one, two, three, four)]
    assert firsts == {(3, head[0]): 1, (5, head[1]): 1, (None, head[2]): 1, (7, head[3]): 1}


def test_mix_takes_the_rounded_copies(stored):
    """Sources "a" and "c" give far from the same rate, and no id tells their rows apart."""
    rng = random.Random(3)
    rows = [
        (rng.choice([None, 1, 2]), f"t{i} " + "w " * rng.randrange(20, 60), "a" if i < 60 else "c") for i in range(600)
    ]
    docs = stored(rows)
    out = mixing.take_mix(docs)
    taken = out.collect()
    times = Counter(map(tuple, taken))
    assert out.dtypes == docs.dtypes and set(times) <= set(rows) and max(times.values()) <= 3
    targets = {
        words: target for words, target in mixing.mix(docs).select("source_size", "target").distinct().collect()
    }
    for source in "ac":
        target = targets[sum(len(t.split()) for _, t, s in rows if s == source)]
        assert abs(sum(len(r.text.split()) for r in taken if r.source == source) - target) <= 0.02 * target


def test_samples_are_bounded_by_rows(spark):
    """An id that repeats thousands of times, with one text or many, takes no more than its share."""
    rows = [(7, f"text {i % 40}", i % 2) for i in range(3000)] + [(i, f"own {i}", i % 2) for i in range(100, 140)]
    df = spark.createDataFrame(rows, "_id long, _text string, _label int").repartition(5)
    for n in (2, 15, 1000):
        counts = Counter(r._label for r in labelled.sample_rows(df, n).collect())
        assert counts == {0: min(n, 40), 1: min(n, 40)}
    first = sorted(map(tuple, labelled.sample_rows(df, 15).collect()))
    assert first == sorted(map(tuple, labelled.sample_rows(df.repartition(3), 15).collect()))
