from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.detectors import NextKeyDetector
from emberlog.functions.sequences import BOS, EOS, PAD
from emberlog.operators import nextkey as ops
from emberlog.operators import ordering, policy
from emberlog.plans import nextkeys, views

SCHEMA = "chunk_id string, service string, input_ids array<int>, train_strategy string"


def chunks(spark, n, seed, width=14):
    random.seed(seed)
    rows = []
    for i in range(n):
        keys = [random.choices([4, 5, 6, 7, 8], weights=[8, 4, 2, 1, 1])[0] for _ in range(random.randint(1, width - 2))]
        ids = [BOS, *keys, EOS]
        rows.append((f"c{seed}-{i}", random.choice("ab"), ids + [PAD] * (width - len(ids)), random.choice([None, "finetune"])))
    return rows, spark.createDataFrame(rows, SCHEMA)


def fit(rows, order=2, weight=1, counts=None):
    counts = counts if counts is not None else defaultdict(Counter)
    for _, service, ids, _ in rows:
        ids = [i for i in ids if i != PAD]
        for at in range(1, len(ids)):
            for m in range(0, min(order, at) + 1):
                counts[service, tuple(ids[at - m : at])][ids[at]] += weight
    return counts


def rank_of(counts, service, before, actual, order=2):
    for m in range(min(order, len(before)), -1, -1):
        seen = counts.get((service, tuple(before[len(before) - m :])))
        if seen:
            ordered = sorted(seen, key=lambda k: (-seen[k], k))
            return (ordered.index(actual) + 1 if actual in seen else None), seen[actual], sum(seen.values())
    return None, 0, 0


def as_table(model):
    return {(r.service, tuple(r.context), r.next_id): (r.n, r["rank"], r.total) for r in model.collect()}


def expected_table(counts):
    out = {}
    for (service, context), seen in counts.items():
        for i, k in enumerate(sorted(seen, key=lambda k: (-seen[k], k))):
            out[service, context, k] = (seen[k], i + 1, sum(seen.values()))
    return out


def test_model_and_update(spark):
    rows, train = chunks(spark, 60, 1)
    more, extra = chunks(spark, 20, 2)
    model = ops.train(train)
    assert as_table(model) == expected_table(fit(rows))
    assert as_table(ops.update(model, extra, weight=3)) == expected_table(fit(more, weight=3, counts=fit(rows)))


@pytest.mark.parametrize("k", [1, 3])
def test_detection_equals_a_loop(spark, k):
    rows, train = chunks(spark, 40, 3)
    test_rows, test = chunks(spark, 40, 4)
    counts = fit(rows)
    expected = {}
    for cid, service, ids, _ in test_rows:
        ids = [i for i in ids if i != PAD]
        misses = []
        for at in range(1, len(ids)):
            rank, _, _ = rank_of(counts, service, ids[max(0, at - 2) : at], ids[at])
            if rank is None or rank > k:
                misses.append(at)
        expected[cid] = (len(ids) - 1, len(misses), misses[0] if misses else None, bool(misses))
    top_k = spark.createDataFrame([("a", k), ("b", k)], "service string, top_k int")
    got = ops.detect(test, ops.train(train), top_k).collect()
    assert {r.chunk_id: (r.n_positions, r.n_miss, r.first_miss_pos, r.is_anomaly) for r in got} == expected


def test_cost_and_loss(spark):
    rows, train = chunks(spark, 40, 5)
    test_rows, test = chunks(spark, 30, 6)
    counts, vocab, k, cut = fit(rows), 8, 2, 0.8
    settings = spark.createDataFrame([("a", k, vocab), ("b", k, vocab)], "service string, top_k int, vocab_size int")
    costs, losses = {}, defaultdict(list)
    for cid, service, ids, _ in test_rows:
        ids = [i for i in ids if i != PAD]
        reward = log_prob = 0.0
        for at in range(1, len(ids)):
            rank, n, total = rank_of(counts, service, ids[max(0, at - 2) : at], ids[at])
            lp = math.log((n + 1) / (total + vocab))
            losses[service].append(-lp)
            if at >= math.floor(cut * len(ids)):
                reward += 1 if rank is not None and rank <= k else -1
                log_prob += lp
        costs[cid] = -reward * log_prob
    model = ops.train(train)
    assert {r.chunk_id: r.cost for r in ops.policy_cost(test, model, settings, cut).collect()} == pytest.approx(costs)
    got = {r.service: r.loss for r in ops.held_out_loss(test, model, settings).collect()}
    assert got == pytest.approx({s: sum(v) / len(v) for s, v in losses.items()})


def test_training_summary_follows_the_loop(spark):
    random.seed(7)
    rows, expected = [], {}
    for g in range(25):
        losses = [round(random.uniform(0, 3), 3) for _ in range(random.randint(1, 12))]
        last = count = 0
        best, best_at, stopped, kept = math.inf, None, None, 0
        for i, loss in enumerate(losses):
            rows.append((f"s{g}", i, loss))
            if stopped is not None:
                continue
            count += last - loss <= 0.01
            if count > 3:
                stopped = i
                continue
            kept += 1
            if loss < best:
                best, best_at = loss, i
            last = loss
        expected[f"s{g}"] = (stopped, best_at, best, kept)
    df = spark.createDataFrame(rows, "service string, episode int, loss double")
    got = {r.service: (r.stopped_at, r.best_step, r.best_loss, r.steps_kept) for r in ops.training_summary(df).collect()}
    assert got == expected


def test_training_sets(spark):
    rows, df = chunks(spark, 30, 8)
    assert ops.training_sets(df, "finetune").count() == sum(r[3] == "finetune" for r in rows)
    sizes = {(r.train_strategy, r.service): r.n_chunks for r in ops.training_set_sizes(df).collect()}
    assert sizes == Counter((r[3] or "ignore", r[1]) for r in rows)


def test_sequence_predictions(spark):
    _, df = chunks(spark, 12, 9)
    services = spark.createDataFrame([("a", True), ("b", False)], "name string, is_train boolean")
    verdicts = df.select("chunk_id", (F.substring("chunk_id", -1, 1).cast("int") % 2 == 0).alias("is_anomaly"))
    got = ops.sequence_predictions(df, verdicts, services).collect()
    bad = {r.chunk_id for r in verdicts.filter("is_anomaly").collect()}
    assert {(r.chunk_id, r.is_anomaly) for r in got} == {
        (r.chunk_id, r.service == "b") for r in df.collect() if r.service == "a" or r.chunk_id in bad
    }


def test_detector(spark):
    normal = spark.createDataFrame([(i, [4, 5, 6, 4, 5, 6]) for i in range(20)], "sid long, line array<int>")
    test = spark.createDataFrame([(100, [4, 5, 6, 4]), (101, [4, 9, 6])], "sid long, line array<int>")
    detector = NextKeyDetector(top_k=1, context=16).fit(normal)
    got = {r.sid: r.is_predicted for r in detector.transform(test, "sid").collect()}
    assert got == {100: True, 101: True}  # the first one ends early
    assert NextKeyDetector(top_k=2, context=16).fit(normal).transform(test, "sid").filter("sid = 100").first().n_miss <= 1
    detector.update(spark.createDataFrame([(1, [4, 9, 6])] * 50, "sid long, line array<int>"))
    assert {r.sid: r.n_miss for r in detector.transform(test, "sid").collect()}[101] == 0


def test_sliding_detector_reads_whole_sessions(spark, monkeypatch):
    """The only odd keys of a session come after its first 256."""
    lines = {0: [3, 4, 5] * 120, 2: [4, 3], 1: [3, 4, 5] * 100 + [9, 5, 3], 3: [5], 5: [3, 4]}
    lines[0] += list(range(30, 60))
    rows = [
        (1000 * b + i, b * 1000 + i, f"x blk_{b} y", key, False) for b, keys in lines.items() for i, key in enumerate(keys)
    ]
    logs = spark.createDataFrame(rows, "log_id long, ts long, original_text string, key_id long, is_anomaly boolean")
    logs = logs.withColumn("ts", F.timestamp_seconds("ts"))
    monkeypatch.setattr(nextkeys.v, "keyed_logs", lambda spark, sf_dir: logs)
    got = {r.sid: (r.n_positions, r.n_miss, r.is_predicted) for r in nextkeys.sliding_detector(spark, "").collect()}
    counts = defaultdict(Counter)
    for keys in (lines[0], lines[2]):
        for i in range(1, len(keys)):
            for m in range(min(i, 2) + 1):
                counts[tuple(keys[i - m : i])][keys[i]] += 1
    expected = {}
    for b in (1, 5):
        keys, misses = lines[b], 0
        for i in range(1, len(keys)):
            context = next(c for m in (2, 1, 0) if (c := tuple(keys[max(i - m, 0) : i])) in counts)
            best = sorted(counts[context], key=lambda k: (-counts[context][k], k))[:20]
            misses += keys[i] not in best
        expected[f"blk_{b}"] = (len(keys) - 1, misses, misses > 0)
    assert got == expected and got["blk_1"][1] > 0


def test_reward_rises_with_steps(spark):
    """A key outside the top k, in sequences that earn more than they lose, comes into it; shares stay shares."""

    def made(keys, first):
        rows = [(f"{first}-{i}", "a", [BOS, 4, 5, 6, 7, 8, 4, 5, 6, x, 7, EOS], None) for i, x in enumerate(keys)]
        return spark.createDataFrame(rows, SCHEMA)

    settings = spark.createDataFrame([("a", 2, 12)], "service string, top_k int, vocab_size long")
    start = policy.initial_policy(ops.train(made([7] * 30 + [8] * 20 + [9] * 10, "old")), settings)
    held_out = made([9] * 5, "held-out")
    mean = lambda p: policy.policy_rewards(held_out, p, settings).agg(F.avg("reward")).first()[0]
    tuned, history = policy.fine_tune(made([9] * 12, "new"), start, settings, episodes=2, rate=3.0)
    assert mean(start) == 1 and mean(tuned) == 3
    losses = {r.episode: (r.loss, r.reward) for r in history.collect()}
    assert losses[0][1] == 1 and losses[1][1] == 3
    shares = policy._shares(tuned).groupBy("context").agg(F.sum(F.col("share") * F.col("n_keys")).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in shares)
    # a key that the context has never had gets a row of its own, at the others' cost
    new = policy.policy_step(made([11] * 3, "unseen"), start, settings, rate=1.0)
    row = new.filter("context = array(5, 6) and next_id = 11").first()
    rest = {tuple(r.context): r.n_keys for r in start.filter("next_id is null").collect()}
    assert row and new.filter("context = array(5, 6) and next_id is null").first().n_keys == rest[(5, 6)] - 1


def test_key_sequences_move_no_texts(spark, sf_dir, monkeypatch):
    """No table that the chunks are made of holds the text of a log, and what they say is what chunks with texts say."""
    stored = []
    for module in (nextkeys, views, ordering):
        monkeypatch.setattr(module, "written", lambda df, label, keep=module.written: stored.append((label, df.columns)) or keep(df, label))
    e = nextkeys.KeyExperiment(spark, sf_dir)
    found = {(r.chunk_id, r.service, r.window_no, tuple(r.input_ids)) for r in e.stored_chunks.collect()}
    columns = dict(stored)
    assert set(columns["rows-to-number"]) == {"service", "key", "ts", "log_id", "key_id"}
    assert not {c for _, names in stored for c in names} & {"original_text", "original_logs", "hash", "train_strategy"}
    whole = views.chunks(spark, sf_dir).collect()
    assert found == {(r.chunk_id, r.service, r.window_no, tuple(r.input_ids)) for r in whole} and len(found) == len(whole) > 0
    named = nextkeys.KeyExperiment(spark, sf_dir, "train_strategy", "cleaned_text").stored_chunks.collect()
    assert {(r.chunk_id, r.train_strategy, r.hash) for r in named} == {(r.chunk_id, r.train_strategy, r.hash) for r in whole}


def test_a_step_stores_what_is_earned_by_key(spark, monkeypatch):
    """Not one row per position."""
    stored, keep = {}, policy.written

    def noted(df, label):
        stored[label] = keep(df, label)
        return stored[label]

    monkeypatch.setattr(policy, "written", noted)
    settings = spark.createDataFrame([("a", 2, 12), ("b", 2, 12)], "service string, top_k int, vocab_size long")
    start = policy.initial_policy(ops.train(chunks(spark, 60, 1)[1]), settings)
    policy.policy_step(chunks(spark, 200, 2)[1], start, settings).count()
    earned = stored["policy-earned"]
    assert 0 < earned.count() == earned.select("service", "context", "next_id").distinct().count() < stored["policy-played"].count()
