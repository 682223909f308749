from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import templates as ops

START = dt.datetime(2024, 1, 1)
SCHEMA = "log_id long, service string, ts timestamp, cleaned_text string"


def sequential(lines):
    """The miner one line at a time: leaves by token count and leading token."""
    leaves, found = {}, {}
    for line in lines:
        tokens = line.split(" ")
        head = "<*>" if any(c.isdigit() for c in tokens[0]) else tokens[0]
        leaf = leaves.setdefault((len(tokens), head), [])
        best, best_rank = None, None
        for template in leaf:
            same = sum(a == b and a != "<*>" for a, b in zip(template, tokens))
            rank = (same, template.count("<*>"))
            if same >= ops.SIMILARITY * len(tokens) and (best is None or rank > best_rank):
                best, best_rank = template, rank
        if best is None:
            best = list(tokens)
            leaf.append(best)
        else:
            best[:] = [a if a == b else "<*>" for a, b in zip(best, tokens)]
        found[line] = best
    return {line: " ".join(t) for line, t in found.items()}


def sample(n=400, seed=1):
    random.seed(seed)
    users = ["ann", "bob", "cid", "dan", "eve"]
    kinds = [
        lambda: f"login user {random.choice(users)} from host{random.randint(1, 4)} ok",
        lambda: f"login user {random.choice(users)} failed again today now",
        lambda: f"disk {random.choice('abc')} is full at {random.choice(['noon', 'night'])}",
        lambda: f"{random.randint(1, 9)} retries of job {random.choice(users)}",
        lambda: "heartbeat",
    ]
    return [random.choice(kinds)() for _ in range(n)]


def frame(spark, lines):
    return spark.createDataFrame(
        [(i, "s", START + dt.timedelta(seconds=i), line) for i, line in enumerate(lines)], SCHEMA
    )


def test_mining_equals_the_sequential_miner(spark):
    lines = sample()
    distinct = list(dict.fromkeys(lines))
    got = {r.cleaned_text: r.template for r in ops.fit_templates(frame(spark, lines)).collect()}
    assert got == sequential(distinct)


def test_leaves_over_many_batches(spark):
    """Leaves that span Arrow batches of a few lines give the same templates."""
    lines = sample(600, seed=2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.cleaned_text: r.template for r in ops.fit_templates(frame(spark, lines)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sequential(list(dict.fromkeys(lines)))
    assert set(got) == set(lines)
    for line, template in got.items():
        assert len(line.split(" ")) == len(template.split(" "))
        assert all(a == b or b == "<*>" for a, b in zip(line.split(" "), template.split(" "))), (line, template)
    assert len(set(got.values())) < len(set(lines)) / 2


def test_keys_stats_and_sizes(spark):
    lines = ["b x", "a 1", "a 2", "c y", "a 3", "b x"]
    templated = ops.masked_templates(frame(spark, lines))
    dictionary = ops.template_keys(templated)
    assert {(r.template, r.key_id, r.size) for r in dictionary.collect()} == {("b x", 4, 2), ("a <*>", 5, 3), ("c y", 6, 1)}
    keys = [r.key_id for r in ops.assign_keys(templated, dictionary).orderBy("log_id").collect()]
    assert keys == [4, 5, 5, 6, 5, 4]
    top = ops.template_stats(dictionary, top=2).orderBy("rank").collect()
    assert [(r.template, r.n_templates) for r in top] == [("a <*>", 3), ("b x", 3)]
    assert ops.vocabulary_size(dictionary).first().vocab_size == 6


def test_growth_keeps_old_keys(spark):
    old = ops.template_keys(ops.masked_templates(frame(spark, ["b x", "a 1"])))
    later = spark.createDataFrame(
        [(9, "s", START, "new z"), (10, "s", START, "a 7"), (11, "t", START, "first of t")], SCHEMA
    )
    grown = ops.template_keys(ops.masked_templates(later), old)
    assert {(r.service, r.template, r.key_id, r["size"]) for r in grown.collect()} == {
        ("s", "b x", 4, 1), ("s", "a <*>", 5, 2), ("s", "new z", 6, 1), ("t", "first of t", 4, 1)
    }


def test_mined_keys_grow_in_steps(spark):
    """Mining in three steps keeps every key, and the lines' templates fit them."""
    lines = sample(300, seed=3)
    logs = frame(spark, lines)
    dictionary, keys = None, {}
    for low, high in ((0, 60), (60, 61), (61, 300)):
        keyed, dictionary = ops.mined_keys(logs.filter(F.col("log_id").between(low, high - 1)), dictionary)
        now = {r.key_id: r.template for r in dictionary.collect()}
        assert len(now) == dictionary.count() and set(keys) <= set(now)
        for key, template in keys.items():
            # a key's template only ever gets wider
            assert all(a == b or b == "<*>" for a, b in zip(template.split(" "), now[key].split(" ")))
        keys = now
        for r in keyed.collect():
            assert all(a == b or b == "<*>" for a, b in zip(r.cleaned_text.split(" "), keys[r.key_id].split(" ")))
    assert dictionary.agg(F.sum("size")).first()[0] == 300 and min(keys) == 4 and max(keys) == 3 + len(keys)


@pytest.mark.parametrize("lines", [["a b c"], ["x"] * 5])
def test_single_templates(spark, lines):
    got = ops.fit_templates(frame(spark, lines)).collect()
    assert [(r.cleaned_text, r.template) for r in got] == [(lines[0], lines[0])]


def test_cached_vocabulary_size(spark):
    df = spark.createDataFrame([([4, 9],), ([5],)], "line array<int>")
    assert ops.cached_vocabulary_size(df).first().vocab_size == 9
    assert df.agg(F.count("*")).first()[0] == 2
