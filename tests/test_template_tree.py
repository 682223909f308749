"""Mined templates from a tree of splits, against the rule written as a recursion."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import template_tree as ops
from emberlog.operators.templates import SIMILARITY

START = dt.datetime(2024, 1, 1)
SCHEMA = "log_id long, service string, ts timestamp, cleaned_text string"


def routed(token):
    return "<*>" if any(c in "0123456789" for c in token) else token


def recursive(lines):
    """Template of every line: groups by token count and leading token, split while their lines agree too little."""
    groups, out = {}, {}
    for line in set(lines):
        tokens = line.split(" ")
        groups.setdefault((len(tokens), routed(tokens[0])), []).append(tokens)

    def settle(group):
        columns = list(zip(*group))
        same = sum(len(set(c)) == 1 for c in columns)
        ways = [(len(set(map(routed, c))), i) for i, c in enumerate(columns) if len(set(map(routed, c))) > 1]
        if same >= SIMILARITY * len(columns) or not ways:
            template = " ".join(c[0] if len(set(c)) == 1 else "<*>" for c in columns)
            for tokens in group:
                out[" ".join(tokens)] = template
            return
        parts, at = {}, min(ways)[1]
        for tokens in group:
            parts.setdefault(routed(tokens[at]), []).append(tokens)
        for part in parts.values():
            settle(part)

    for group in groups.values():
        settle(group)
    return out


def sample(n=500, seed=1):
    rng = random.Random(seed)
    users, verbs = ["ann", "bob", "cid", "dan", "eve"], ["reads", "writes", "drops"]
    kinds = [
        lambda: f"job {rng.choice(verbs)} {rng.choice(users)} {rng.choice('abcdef')} {rng.choice('xyz')} {rng.random():.3f} end",
        lambda: f"login user {rng.choice(users)} from host{rng.randint(1, 4)} ok",
        lambda: f"{rng.randint(1, 9)} {rng.choice(verbs)} {rng.choice(users)} {rng.choice('pqr')}",
        lambda: f"{rng.choice(users)} {rng.choice(users)}",
        lambda: rng.choice(["heartbeat", "", str(rng.randint(0, 5))]),
    ]
    return [rng.choice(kinds)() for _ in range(n)]


def frame(spark, lines, first=0):
    rows = [(first + i, "s", START + dt.timedelta(seconds=first + i), line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("partitions", [1, 200])
def test_like_the_recursion(spark, partitions):
    """The same templates and keys however the lines are dealt."""
    lines = sample()
    keyed, tree = ops.tree_keyed(frame(spark, lines).repartition(partitions))
    rows = keyed.orderBy("log_id").collect()
    expected = recursive(lines)
    assert [r.template for r in rows] == [expected[line] for line in lines]
    assert tree.filter("at > 0").count() > 3
    keys = {}
    for r in rows:
        assert r.key_id == keys.setdefault(r.template, len(keys) + 4)
    sizes = {r.template: r["size"] for r in ops.dictionary(tree).collect()}
    assert sizes == {t: sum(r.template == t for r in rows) for t in sizes}


def test_growth(spark):
    """Keys stay, templates only widen, and lines that find no branch make groups of their own."""
    lines = sample(400, seed=2) + ["quite new words", "job naps x y z w end", "quite other words"]
    tree, known, total = None, {}, 0
    for low, high in ((0, 150), (150, 151), (151, 403)):
        keyed, tree = ops.tree_keyed(frame(spark, lines[low:high], low), tree)
        now = {r.key_id: r.template for r in ops.dictionary(tree).collect()}
        total += high - low
        assert len(now) == ops.dictionary(tree).count() and len(set(now.values())) == len(now)
        for key, template in known.items():
            assert all(a == b or b == "<*>" for a, b in zip(template.split(" "), now[key].split(" ")))
        for r in keyed.collect():
            assert r.template == now[r.key_id]
            assert all(a == b or b == "<*>" for a, b in zip(r.cleaned_text.split(" "), r.template.split(" ")))
        known = now
        assert ops.dictionary(tree).agg(F.sum("size")).first()[0] == total
    assert "quite <*> words" in known.values() and "job naps x y z w end" in known.values()
    assert sorted(known) == list(range(4, 4 + len(known)))


def test_lines_seen_before_change_nothing(spark):
    logs = frame(spark, sample(200, seed=3))
    keyed, tree = ops.tree_keyed(logs)
    again, same = ops.tree_keyed(logs, tree)
    assert sorted(again.collect()) == sorted(keyed.collect())
    assert sorted(same.drop("size").collect(), key=str) == sorted(tree.drop("size").collect(), key=str)


def test_no_lines(spark):
    keyed, tree = ops.tree_keyed(frame(spark, ["a"]).limit(0))
    assert keyed.collect() == [] and tree.collect() == []
