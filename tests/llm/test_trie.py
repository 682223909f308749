"""The prefix trie against a brute-force version, and its perfect hash."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import prefix_trie
from emberlog.llm.perfect_hash import PerfectHash

SCHEMA = "conv_id long, turn int, role string, text string, conv long, depth int, h string, _at int, _turn string"
RESULT = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def truncated(c):
    return c - (abs(c) % 100) * (1 if c >= 0 else -1)


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        made[c] = turns.get(truncated(c), [])[:h] + turns[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, line in made.items():
        for d in range(len(line) + 1):
            members[tuple(line[:d])].append(c)
        ends[tuple(line)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, own_members in members.items():
        ids = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ids.encode()).hexdigest()
        out.append((min(own_members), len(node), parent, len(own_members), children[node], leaves[node], saved[node], sha))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, "x", 3, "y") for r in rows], SCHEMA).repartition(5)
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    options = {"head": head, "base": F.col("conv") - F.col("conv") % 100, "most": 5, **options}
    out = prefix_trie.prefix_trie(df, **options)
    assert out.columns == RESULT
    return sorted(map(tuple, out.collect()), key=str)


def made_rows(n=60, seed=1):
    rng = random.Random(seed)
    texts = ["a", "b", "é\U0001f600", "", None, "long " * 500]
    rows = []
    for c in rng.sample(range(-150, 350), n):
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant", None, ""]), rng.choice(texts)))
    # no order but by role and text, repeated rows, no conversation
    rows += [(5, None, "user", "b"), (5, None, "user", "a"), (5, 0, "user", "a"), (5, 0, "user", "a")]
    rows += [(None, 0, "user", "lost"), (None, None, None, None)]
    # a hot group: many conversations that are all alike
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1150) for t in range(3)]
    return rows


def test_like_brute_force(spark):
    rows = made_rows()
    assert found(spark, rows, shard_rows=50) == brute(rows)


def test_bands_deeper_than_one(spark):
    """Long conversations that share turns far below the first band, with and without rebuilding."""
    rng = random.Random(2)
    rows = []
    for c in range(12):
        same = rng.choice([0, 9, 10, 21])
        rows += [(c, t, "user", f"shared {t}" if t < same else f"own {c} {t}") for t in range(rng.choice([3, 10, 11, 40]))]
    assert found(spark, rows, band=10, shard_rows=7) == brute(rows)
    plain = found(spark, rows, band=10, head=None, base=None, most=0)
    assert plain == brute(rows, rebuild=False)


def test_one_conversation_over_many_ranges(spark):
    rows = [(7, t, "user", f"turn {t % 3}") for t in range(900)] + [(8, t, "user", f"turn {t % 3}") for t in range(899)]
    assert found(spark, rows, band=64, shard_rows=100) == brute(rows)


def test_turnless_and_empty(spark):
    # h of 100 and 101 is at least one somewhere: conversations may lose all of their turns
    rows = [(c, 0, "user", "only") for c in range(101, 130)]
    got = found(spark, rows)
    assert got == brute(rows) and any(r[1] == 0 and r[7] != prefix_trie.EMPTY_SHA for r in got)
    assert found(spark, []) == []


def test_colliding_digests_end_the_job(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_chain", lambda before, th, tl: b"0123456789abcdef")
    with pytest.raises(Exception, match="two prefixes have one digest"):
        found(spark, [(0, 0, "user", "a"), (0, 1, "user", "b"), (6, 0, "user", "c")], head=None, base=None, most=0)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(3)
    high = rng.integers(0, 50, n).astype(np.uint64)
    low = np.arange(n, dtype=np.uint64)
    table = PerfectHash(high, low)
    assert sorted(table.find(high, low)) == list(range(n))
    assert (table.find(high, low + np.uint64(n)) == -1).all()


def test_repeated_digest_is_refused():
    same = np.array([5, 5], dtype=np.uint64)
    with pytest.raises(ValueError):
        PerfectHash(same, same)
